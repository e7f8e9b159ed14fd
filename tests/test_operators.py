"""Job transitions, rule tables, observations and landed input against plain versions."""

import json
import random
import re

from pyspark.sql import functions as F

from vidcohort.operators import jobs, rulematch, semantic
from vidcohort.sources import ingest


def settled(reports):
    """One job's reports, in order."""
    state, rejected, first = None, 0, None
    for seq, _, s in sorted({(seq, jobs.STATES.index(s), s) for seq, s in reports if s in jobs.STATES and seq is not None}):
        if s == state or s in jobs.NEXT[jobs.STATES.index(state) + 1 if state else 0]:
            state = s
        else:
            rejected += 1
            first = first or (seq, s)
    return state, rejected, first or (None, None)


def test_transitions_whatever_the_order_of_arrival(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for job in range(60):
        own = [(rng.choice([None, *range(-5, 40)]), rng.choice([*jobs.STATES[:5], *jobs.STATES[:5], *jobs.STATES, "odd", None])) for _ in range(rng.randint(1, 30))]
        rows += [(job, *x) for x in own + own[:3]]  # some are delivered twice
    rows += [(99, i, jobs.STATES[min(i // 40, 4)]) for i in range(400)] + [(99, 10**15, "queued")]
    rng.shuffle(rows)
    want = {}
    for job in {r[0] for r in rows}:
        own = [(s, x) for j, s, x in rows if j == job]
        n = len({x for x in own if x[1] in jobs.STATES and x[0] is not None})
        state, rejected, first = settled(own)
        if n:
            want[job] = (state, n, rejected, *first)
    table = spark.createDataFrame(rows, "job_id long, seq long, state string").repartition(5)
    for chunk in (1024, 4):
        monkeypatch.setattr(jobs, "CHUNK", chunk)
        assert {r[0]: tuple(r)[1:] for r in jobs.settled(table).collect()} == want
    assert want[99][0] == "complete" and want[99][2:] == (1, 10**15, "queued")
    assert jobs.settled(table.where("false")).count() == 0


def test_thousands_of_rules(spark):
    rng = random.Random(7)
    letters = "ab c"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rules = [(i, [word(rng.randint(1, 7)) for _ in range(rng.randint(1, 3))], f"r{i}") for i in range(300, 3300)] + [(5000, None, "none")]
    rules += [(200, ["%_", "a.b", "é\n"], "odd"), (201, ["", None], "every"), (100, ["bcbcbcbcb"], "rare")]
    texts = [(i, word(rng.randint(0, 30))) for i in range(80)] + [(90, None), (91, "x" * 50_000 + "a.b"), (92, "é\né"), (93, "%_bcbcbcbcb")]
    for own in (rules, [r for r in rules if r[0] != 201]):
        table = spark.createDataFrame(own, "ord int, keywords array<string>, name string")
        asked = spark.createDataFrame(texts, "id long, text string")
        want = {}
        for i, text in texts:
            fit = sorted(o for o, words, _ in own if words and any(w is not None and w in (text or "") for w in words))
            want[i] = fit
        names = {o: n for o, _, n in own}
        assert {r.id: r.name for r in rulematch.first_rule(asked, table).collect()} == {i: names[fit[0]] if fit else "none" for i, fit in want.items()}
        assert {r.id: r.ords for r in rulematch.all_rules(asked, table, 4).collect()} == {i: fit[:4] for i, fit in want.items()}
    plan = rulematch.matches(asked, table)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_texts_are_not_dealt_by_gram(spark):
    """However large the texts and whatever Spark knows of their size, no exchange carries them."""
    rules = spark.createDataFrame([(0, ["common word"], "a"), (1, None, "b")], "ord int, keywords array<string>, name string")
    texts = spark.range(200).selectExpr("id", "concat(id, ' common wor', if(id % 2 = 0, 'd', 't')) text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = rulematch.matches(texts, rules)
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert sorted(tuple(r) for r in found.collect()) == [(i, 0) for i in range(0, 200, 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def observation(video, **fields):
    return (video, "success" if fields else "failed", *[fields.get(n) for n in semantic.FIELDS])


def test_medoids_and_positions(spark):
    seen = [
        observation("u", opening_type="red car drives", visual_focus="a face", attention_focus="only mine"),
        observation("t1", opening_type="red car stops", visual_focus="a wall"), observation("t2", opening_type="red car drives fast", visual_focus="a wall"),
        observation("t3", opening_type="blue sky", visual_focus=""), observation("l1", opening_type="quiet room", visual_focus="a face"),
        observation("l2"), observation("x", opening_type="red wall"),
    ]
    obs = spark.createDataFrame(seen, "video_id string, status string, " + ", ".join(f"{n} string" for n in semantic.FIELDS))
    members = [("s", "user", 0, "u"), *[("s", "top", i, f"t{i}") for i in (1, 2, 3)], ("s", "lower", 1, "l1"), ("s", "lower", 2, "l2"), ("q", "user", 0, "l2"), ("q", "top", 1, "t1")]
    table = spark.createDataFrame(members, "subject_id string, grp string, pos int, video_id string")
    got = {(r.subject_id, r.field): r for r in semantic.field_positions(table, obs).collect()}
    assert set(got) == {("s", "opening_type"), ("s", "visual_focus"), ("s", "attention_focus")}
    # of six opening texts red is in four, car in three, drives in two, the rest in one
    weight = {"red": 1, "car": 2, "drives": 3, "fast": 6, "stops": 6}
    opening = got["s", "opening_type"]
    assert opening.top_medoid == "red car stops" and opening.lower_medoid == "quiet room"  # t1 and t2 are as near to each other; the first counts
    both, whole = weight["red"] + weight["car"], weight["red"] + weight["car"] + weight["drives"] + weight["stops"]
    assert abs(opening.top_distance - (1 - both / whole)) < 1e-12 and opening.lower_distance == 1 and opening.position == "closer_to_top"
    assert got["s", "visual_focus"].position == "closer_to_lower" and got["s", "visual_focus"].lower_distance == 0
    assert got["s", "attention_focus"].position == "unknown" and got["s", "attention_focus"].top_medoid is None
    subjects = spark.createDataFrame([("s",), ("q",), ("none",)], "subject_id string")
    told = {r.subject_id: r for r in semantic.comparison(subjects, semantic.field_positions(table, obs)).collect()}
    assert told["s"].status == "ready" and told["s"].user_position == ["opening_type: closer_to_top", "visual_focus: closer_to_lower"] and told["s"].warnings == []
    assert told["s"].semantic_differences[0] == "opening_type: top 'red car stops', lower 'quiet room'"
    for other in ("q", "none"):
        assert (told[other].status, told[other].user_position, told[other].warnings) == ("not_ready", [], [semantic.NOT_READY])


def test_malformed_responses_are_put_aside(spark, tmp_path):
    item = lambda i, **more: {"id": i, "snippet": {"title": "T"}, **more}
    files = {
        "good.json": json.dumps({"items": [item("a"), item("b", statistics={"viewCount": "7"})]}), "cut.json": json.dumps({"items": [item("c")]})[:20], "empty.json": "\n",
        "shape.json": json.dumps({"items": {"id": "x"}}), "error.json": json.dumps({"error": 403}), "none.json": json.dumps({"items": []}),
        "mixed.json": json.dumps({"items": [item(None), item("d"), {"id": "e"}, item(" ")]}),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = ingest.checked(ingest.read_responses(spark, str(tmp_path)), ingest.VIDEO_ITEMS).cache()
    assert sorted((r.video_id, r.views) for r in ingest.videos(ingest.usable(rows)).collect()) == [("a", 0), ("b", 7), ("d", 0)]
    name = F.regexp_extract("origin", "([^/]+)$", 1).alias("f")
    assert {(r.f, r.item_pos, r.reason) for r in ingest.put_aside(rows).select(name, "item_pos", "reason").collect()} == {
        ("cut.json", None, "not_json"), ("empty.json", None, "not_json"), ("shape.json", None, "not_json"), ("error.json", None, "no_items"),
        ("none.json", None, "no_items"), ("mixed.json", 0, "no_id"), ("mixed.json", 2, "no_snippet"), ("mixed.json", 3, "no_id"),
    }
    counts = {r.f: tuple(r)[2:] for r in ingest.quality(rows).select(name, "*").collect()}
    assert counts["good.json"] == (2, 0, 0, 0, 0) and counts["mixed.json"] == (1, 0, 0, 2, 1) and counts["cut.json"] == (0, 1, 0, 0, 0)


def test_equal_texts_are_taken_apart_once(spark):
    """Sixty videos with two texts: the words are counted as often as there are videos, but come from two rows."""
    rows = [(f"v{i}", 0, "red Car") for i in range(50)] + [(f"w{i}", 0, "red wall!") for i in range(10)] + [("w0", 0, "red wall!"), ("x", 0, "?"), ("y", 0, None), ("z", 1, "red")]
    texts = spark.createDataFrame(rows, "video_id string, ord int, text string")
    found = semantic.weights(texts)
    assert {(r.ord, r.word): r.weight for r in found.collect()} == {(0, "red"): 0, (0, "car"): 1, (0, "wall"): 5, (1, "red"): 1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate explode.*\n(.*\n)*?.*Aggregate \[ord#\d+, text#\d+\]", plan)
