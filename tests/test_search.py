"""The bounded search against all pairs: skewed words, long titles, and how few pairs it looks at."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from vidcohort.operators import search


def top(queries, classes, most):
    """All pairs, in plain words: query to its first classes."""
    out = {}
    for q, words in queries.items():
        hits = [(-len(words & w), seen is None, -(seen or 0), c) for c, (w, seen) in classes.items() if words & w]
        out[q] = [(c, -n) for n, _, _, c in sorted(hits)[:most]]
    return out


@pytest.mark.parametrize("share,long", [(0.001, 40), (0.1, 40), (0.05, 3), (0.9, 40)])
def test_against_all_pairs(spark, monkeypatch, share, long):
    monkeypatch.setattr(search, "LONG", long)
    rng = random.Random(int(share * 1000) + long)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    draw = lambda n: frozenset(rng.choices(words, weights, k=n))
    titles = {draw(rng.randint(1, 7)) for _ in range(400)} | {frozenset(words[:50]), frozenset(words[5:])}
    classes = {f"c{i:04d}": (w, rng.choice([None, 1, 1, 5, 9])) for i, w in enumerate(sorted(titles, key=sorted))}
    queries = dict(enumerate({draw(rng.randint(1, 6)) for _ in range(80)} | {frozenset(["nothing"]), frozenset(words[:45])}))
    asked = spark.createDataFrame([(q, sorted(w)) for q, w in queries.items()], "q long, words array<string>")
    heads = spark.createDataFrame([(c, 0, s, sorted(w)) for c, (w, s) in classes.items()], "class string, mark long, most_seen long, words array<string>")
    got = {q: {} for q in queries}
    for r in search.search(asked, heads, 5, share).collect():
        got[r.q][r["class"]] = r.overlap
    assert got == {q: dict(x) for q, x in top(queries, classes, 5).items()}


def test_pairs_that_are_looked_at(spark, monkeypatch):
    """No more than a fifth of the pairs with a common word are ever joined."""
    from vidcohort.operators import cohort, hypotheses
    from vidcohort.sources import fixtures

    sf = SF.replace("0.001", "0.01")
    joined = []
    count = search.counted

    def counted(pairs):
        joined.append(pairs.count())
        return count(pairs)

    monkeypatch.setattr(search, "counted", counted)
    videos = fixtures.videos(spark, sf)
    queries = hypotheses.subject_queries(fixtures.subjects(videos))
    cohort.candidate_search(queries, videos).count()
    every = cohort.token_overlap(queries, videos).count()
    assert len(joined) == 2 and sum(joined) * 5 < every


def test_no_words_and_empty_tables(spark):
    heads = spark.createDataFrame([("c", 0, 5, ["a"])], "class string, mark long, most_seen long, words array<string>")
    asked = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "q long, words array<string>")
    assert [tuple(r) for r in search.search(asked, heads, 3).collect()] == [(1, "c", 0, 1)]
    assert search.search(asked, heads.where("false"), 3).count() == 0
    assert search.search(asked.where("false"), heads, 3).count() == 0
    assert heads.where(F.size("words") > 0).count() == 1


def test_overlaps_of_copies(spark, monkeypatch):
    """Every pair is there with its number of words, though words are compared once for each pair of different word sets only."""
    from vidcohort.operators import cohort

    monkeypatch.setattr(cohort, "PART", 16)
    rng = random.Random(3)
    some = ["", None, "!", *[" ".join(rng.choices("abcdefg", k=rng.randint(1, 5))) for _ in range(30)]]
    asked = [(f"s{i}", 0, x) for i, x in enumerate(some[:20])] + [(f"c{i}", 1, "a B") for i in range(60)]
    shown = [(f"v{i}", x) for i, x in enumerate(some)] + [(f"w{i}", "b a h") for i in range(200)]
    queries = spark.createDataFrame(asked, "subject_id string, qpos int, query string")
    videos = spark.createDataFrame(shown, "video_id string, title string")
    words = lambda x: set((x or "").replace("!", "").lower().split())
    want = sorted((s, p, v, len(words(q) & words(x))) for s, p, q in asked for v, x in shown if words(q) & words(x))
    got = cohort.token_overlap(queries, videos)
    assert sorted(map(tuple, got.collect())) == want and dict(got.dtypes)["overlap"] == "bigint"
    asked_classes, titles = (cohort.word_classes(d, c, n, *k)[0] for d, c, n, k in ((queries, "query", "asked", ["subject_id", "qpos"]), (videos, "title", "title", ["video_id"])))
    assert {r.n for r in titles.collect()} == {1, 13} and cohort.class_pairs(asked_classes, titles).count() * 10 < len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    assert cohort.token_overlap(queries.where("false"), videos).count() == cohort.token_overlap(queries, videos.where("false")).count() == 0


def test_pairs_of_copies_are_not_shuffled(spark, monkeypatch):
    """Only word sets are dealt, with all that have them; the pairs are made behind the last shuffle, whatever the shares and parts."""
    from vidcohort.operators import cohort

    for name, n in (("PART", 8), ("ASKED", 3), ("SHARE", 20)):
        monkeypatch.setattr(cohort, name, n, raising=False)
    asked = [(f"s{i}", i % 2, ("a b", "b c d", "e")[i % 3]) for i in range(50)]
    shown = [(f"v{i}", ("b", "a b c", "f", "c e")[i % 4]) for i in range(300)]
    queries, videos = spark.createDataFrame(asked, "subject_id string, qpos int, query string"), spark.createDataFrame(shown, "video_id string, title string")
    got = cohort.token_overlap(queries, videos)
    want = sorted((s, p, v, len(set(q.split()) & set(x.split()))) for s, p, q in asked for v, x in shown if set(q.split()) & set(x.split()))
    assert sorted(map(tuple, got.collect())) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 2
    executed = got._jdf.queryExecution().executedPlan().toString()
    first, last = (next(x for x in executed.splitlines() if "Generate explode(" + c in x) for c in ("transform", "title"))
    assert "*(" not in first and "*(" in last  # queries are handed on one by one, never all rows of a join at once
