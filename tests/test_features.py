import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vidcohort.functions import text as t
from vidcohort.operators import contrast, features, jobs
from vidcohort.plans import report
from vidcohort.sources import ingest


@pytest.mark.parametrize("fn,points", [
    (features.lighting, [(74.9, "dark"), (75.0, "medium"), (170.0, "medium"), (170.1, "bright")]),
    (features.motion, [(7.9, "low"), (8.0, "medium"), (21.9, "medium"), (22.0, "high")]),
    (features.overlay, [(0.029, "absent"), (0.03, "unknown"), (0.13, "unknown"), (0.131, "present"), (None, "unknown")]),
    (features.human, [(0, "unknown"), (1, "present"), (None, "unknown")]),
])
def test_class_boundaries(spark, fn, points):
    df = spark.createDataFrame([(float(x) if x is not None else None, w) for x, w in points], "x double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", fn(F.col("x"))).collect())


def test_color_and_pacing_boundaries(spark):
    rows = [(24.9, 1, "warm"), (25.0, 1, "neutral"), (79.9, 1, "neutral"), (80.0, 1, "cool"), (140.0, 1, "cool"), (140.1, 1, "neutral"), (150.0, 1, "neutral"), (150.1, 1, "warm"), (10.0, 0, "neutral"), (None, 5, "neutral")]
    df = spark.createDataFrame(rows, "hue double, valid int, want string")
    assert all(r.got == r.want for r in df.withColumn("got", features.color_feel(F.col("hue"), F.col("valid"))).collect())
    rows = [(0, 1, "unknown"), (0, 0, "unknown"), (0, 2, "slow"), (1, 6, "medium"), (4, 10, "medium"), (9, 21, "fast"), (1, 3, "fast")]
    df = spark.createDataFrame(rows, "c int, n int, want string")
    assert all(r.got == r.want for r in df.withColumn("got", features.pacing(F.col("c"), F.col("n"))).collect())


def test_energy_and_scene(spark):
    rows = [("low", "slow", "low"), ("medium", "slow", "low"), ("medium", "medium", "medium"), ("high", "medium", "medium"), ("high", "fast", "high"), ("high", "unknown", "medium")]
    df = spark.createDataFrame(rows, "m string, p string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", features.energy(F.col("m"), F.col("p"))).collect())
    rows = [("present", "present", "high", "fast", "reaction"), ("present", "unknown", "low", "slow", "commentary"), ("present", "absent", "high", "fast", "montage"), ("unknown", "present", "high", "slow", "movie_scene"), ("unknown", "absent", "low", "slow", "unknown"), ("present", "absent", "high", "slow", "unknown")]
    df = spark.createDataFrame(rows, "h string, o string, m string, p string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", features.scene_type(*map(F.col, "homp"))).collect())


def test_majority_and_dominant_ties_go_to_the_first(spark):
    rng = random.Random(3)
    rows, major, dominant = [], {}, {}
    for g in range(60):
        own = [(i, rng.choice(["a", "b", "c", "unknown"])) for i in range(rng.randint(1, 7))]
        rows += [(f"s{g}", "top", i, "f", v) for i, v in own]
        known = [v for _, v in own if v != "unknown"]
        if known:
            counts = Counter(known)
            value = max(counts, key=counts.get)
            major[f"s{g}"] = value
            dominant[f"s{g}"] = (value, counts[value], len(known), counts[value] >= 2 and list(counts.values()).count(counts[value]) == 1)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "subject_id string, grp string, pos int, feature string, value string").repartition(4)
    got = {r.subject_id: r.m for r in features.majority_class(df.withColumnRenamed("pos", "frame_no"), "subject_id", F.col("value"), "m").collect()}
    assert got == major
    assert {r.subject_id: (r["value"], r["count"], r["total"], r.is_dominant) for r in contrast.dominant_values(df).collect()} == dominant


def summary(**own):
    base = {f: "unknown" for f, _ in features.FEATURES} | {"scene_change_count": 0}
    return base | own


def summaries(spark, rows, ids):
    names = [f for f, _ in features.FEATURES]
    kind = ", ".join([*[f"{i} string" for i in ids if i != "pos"], *(["pos int"] if "pos" in ids else []), *[f"{n} {'int' if n == 'scene_change_count' else 'string'}" for n in names], "status string"])
    order = [i for i in ids if i != "pos"] + (["pos"] if "pos" in ids else [])
    return spark.createDataFrame([tuple(r[i] for i in order) + tuple(r[n] for n in names) + (r.get("status"),) for r in rows], kind)


def test_no_evidence_gives_low_confidence_and_no_recommendation(spark):
    """Downloads were blocked: nothing is known of the subject, the benchmarks all failed."""
    users = summaries(spark, [summary(subject_id="s")], ["subject_id"])
    members = summaries(spark, [summary(subject_id="s", grp="top", pos=1, status="failed")], ["subject_id", "grp", "pos"])
    parts = report.contrast_parts(users, members, users.select("subject_id"))
    table = parts["contrast"].collect()
    assert len(table) == 9 and {r.status for r in table} == {"insufficient_evidence"}
    assert contrast.recommendations(parts["contrast"]).count() == 0
    assert parts["confidence"].first().confidence == "low"
    assert parts["verdict"].first().final_verdict == "The available benchmark evidence is too limited for a clear position."


def test_positions_and_verdict(spark):
    users = summaries(spark, [summary(subject_id="s", motion_level=" HIGH ", pacing_level="slow", scene_type="montage", visual_energy="high", dominant_lighting="dark")], ["subject_id"])
    top = summary(motion_level="high", pacing_level="fast", scene_type="reaction", visual_energy="low", dominant_lighting="bright")
    low = summary(motion_level="low", pacing_level="slow", scene_type="commentary", visual_energy="low", dominant_lighting="bright")
    rows = [dict(x, subject_id="s", grp=g, pos=i) for g, x in (("top", top), ("lower", low)) for i in (1, 2, 3)]
    parts = report.contrast_parts(users, summaries(spark, rows, ["subject_id", "grp", "pos"]), users.select("subject_id"))
    status = {r.feature: r.status for r in parts["contrast"].collect()}
    assert status["motion_level"] == "aligned_with_top" and status["pacing_level"] == "risk_signal" and status["scene_type"] == "missing_winning_feature"
    assert status["visual_energy"] == "non_discriminative" and status["dominant_lighting"] == "observed_difference"
    assert status["scene_change_count"] == "non_discriminative" and status["human_presence"] == "insufficient_evidence"
    assert parts["confidence"].first().confidence == "moderate"
    assert parts["verdict"].first().final_verdict == "Your intro matches 1 lower-benchmark pattern(s), misses 1 top-benchmark pattern(s), and aligns with 1 top-benchmark pattern(s)."
    assert {r.title for r in contrast.recommendations(parts["contrast"]).collect()} == {"Experiment with pacing level", "Experiment with scene type"}


def test_a_video_without_frames_still_votes_no_scene_change(spark):
    videos = spark.createDataFrame([("a", 1), ("b", 2)], "video_id string, video_no long")
    frames = spark.createDataFrame([(1, 1, 80.0, 0.0, 10.0, 1, 0.2, 1)], "video_no long, frame_no int, luma double, diff double, mean_hue double, valid_px long, edge_density double, face_count int")
    got = {r.video_id: r for r in features.feature_summary(videos, features.intro_features(frames)).collect()}
    assert got["b"].scene_change_count == 0 and got["b"].motion_level == "unknown"
    assert got["a"].pacing_level == "unknown" and got["a"].motion_level == "low" and got["a"].scene_type == "reaction"


def test_report_status_and_warnings(spark):
    """No member at all warns; a group of failed members only does not; a missing channel leaves one warning and no section;
    an intro that was not acquired, or has no frames, leaves its warnings and no section of its own."""
    users = summaries(spark, [summary(subject_id=i) for i in "abcde"], ["subject_id"])
    rows = [summary(subject_id=s, grp=g, pos=1, status="failed") for s in "ade" for g in ("top", "lower")] + [summary(subject_id="b", grp="top", pos=1)]
    context = spark.createDataFrame([(s, "failed" if s == "c" else "success") for s in "abcde"], "subject_id string, status string")
    evidence = [("a", "success", 3, ["not told"]), ("b", "success", 3, []), ("c", "success", 3, []), ("d", "failed", 0, ["gone"]), ("e", "success", 0, [])]
    evidence = spark.createDataFrame(evidence, "subject_id string, acquisition_status string, n_frames long, warnings array<string>")
    parts = report.contrast_parts(users, summaries(spark, rows, ["subject_id", "grp", "pos"]), users.select("subject_id"))
    state = report.status(users.select("subject_id"), context, evidence, parts["confidence"])
    seen = users.select("subject_id", "motion_level")
    got = {r.subject_id: r for r in report.report(state, parts, {"feature_report": seen, "video": seen}).collect()}
    assert got["a"].status == "success" and got["a"].warnings == []
    assert got["b"].status == "partial" and got["b"].warnings == [report.NO_LOWER]
    assert got["c"].status == "failed" and got["c"].warnings == [report.NO_VIDEO] and got["c"].patterns is got["c"].video is got["c"].feature_report is None
    assert got["d"].status == "partial" and got["d"].warnings == ["gone"] and got["d"].feature_report is None and got["d"].video is not None
    assert got["e"].status == "success" and got["e"].feature_report is None and got["e"].patterns is not None
    for s in "abde":
        p = got[s].patterns
        assert len(p.feature_comparison) == 9 and p.recommendations == [] and p.confidence == "low"


def test_sections_of_the_whole_report(spark, tmp_path):
    """Every section is there, failed intros have none of theirs and no feature value, and the sink writes a table of each."""
    from tests.conftest import SF
    from vidcohort.plans import queries

    rows = queries.full_report(spark, SF)
    report.write_report(rows, str(tmp_path))
    back = report.read_report(spark, str(tmp_path))
    got = back.collect()
    assert len(got) == 10 and {r.status for r in got} <= {"success", "partial"}
    sections = [f.name for f in rows.schema.fields if f.dataType.typeName() == "struct"]
    assert len(sections) == 14
    for name in sections:
        assert report.read_report(spark, str(tmp_path), name).count() == sum(r[name] is not None for r in got) > 0
    lost = [r for r in got if "The intro could not be acquired." in r.warnings]
    for r in got:
        assert (r.vision is None) == (r in lost) and r.semantic_comparison.status == "not_ready"
        assert r not in lost or {x.user_value for x in r.patterns.feature_comparison} == {"unknown"}


def test_sections_are_not_broadcast(spark):
    """Tables with a row a subject or a video are small as files, but not as rows: none of them may be sent whole to every executor."""
    import re

    from tests.conftest import SF
    from vidcohort.plans import queries

    plan = queries.report_values(spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x]
    assert not [x for x in joins if re.search(r"\[(subject_id|video_id|video_no)#", x)]


def test_gathered_tables(spark):
    from vidcohort.sources.stored import gathered

    one = spark.createDataFrame([("a", 1, [1]), ("b", None, None)], "k string, x int, y array<int>")
    two = spark.createDataFrame([("b", "p"), ("c", None)], "k string, z string")
    got = {r.k: r for r in gathered("k", {"one": one, "two": two, "none": two.where("false")}).collect()}
    assert {k: (r.one, r.two, r.none) for k, r in got.items()} == {"a": ((1, [1]), None, None), "b": ((None, None), ("p",), None), "c": (None, (None,), None)}
    assert gathered("k", {"one": one, "two": two})._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_job_states(spark):
    rows = [(1, 1, "queued"), (1, 3, "extracting"), (1, 2, "acquiring"), (2, 1, "failed"), (2, 2, "acquiring"), (3, 5, "x"), (4, 1, "partial"), (4, 2, "complete"), (4, 3, None)]
    got = {r.job_id: (r.state, r.reports, r.finished) for r in jobs.current(spark.createDataFrame(rows, "job_id long, seq long, state string")).collect()}
    assert got == {1: ("extracting", 3, False), 2: ("failed", 2, True), 4: ("partial", 2, True)}


def test_observation_rows(spark):
    intros = spark.createDataFrame([("a", 4), ("b", 0), ("c", 4), ("d", None)], "subject_id string, n_frames long")
    answers = spark.createDataFrame([("a", '{"opening_type":"x","confidence":"high"}'), ("b", '{"opening_type":"x"}')], "subject_id string, text string")
    got = {r.subject_id: (r.status, r.opening_type, r.confidence, r.warning) for r in ingest.observations(intros, answers, "subject_id").collect()}
    none = ("failed", None, "low", ingest.NO_FRAMES)
    assert got == {"a": ("success", "x", "high", None), "b": none, "c": ("failed", None, "low", "VLM observation failed"), "d": none}


def test_shapes_and_formats(spark):
    items = ['{"feature_summary":{"motion_level":"low"}}', '{"features":{"feature_summary":{"motion_level":"high"}}}', "{}", None, "not json"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, item string")
    assert [r.m for r in df.orderBy("i").select(features.summary_of(F.col("item"))["motion_level"].alias("m")).collect()] == ["low", "high", None, None, None]
    row = spark.range(1).select(t.title_case(F.lit("it's a SCENE-change é2x")), t.thousands(F.lit(1234567)), t.thousands(F.lit(None).cast("long"))).first()
    assert tuple(row) == ("It'S A Scene-Change É2X", "1,234,567", "0")
