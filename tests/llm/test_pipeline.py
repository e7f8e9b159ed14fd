import hashlib

import numpy as np

import corpus_pipeline as cp
from tests.llm.test_neardup import brute
from vidcohort.llm import bpe, decontam
from vidcohort.llm.common import cut, read_table

SF = "/root/testdata/sf0.001"


def without_repeats(docs):
    """The third stage in plain Python."""
    first = {}
    rows = sorted((d, (t or "").encode()) for d, t in docs.items())
    for d, data in rows:
        for i in range(len(data) - 99):
            first.setdefault(data[i : i + 100], (d, i))
    out = {}
    for d, data in rows:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if first[data[i : i + 100]] < (d, i):
                gone[i : i + 100] = True
        out[d] = bytes(np.frombuffer(data, np.uint8)[~gone]).decode("utf-8", "ignore")
    return out


def plain_run(docs, items):
    docs = {d: t for d, t in docs.items() if t and any(c.isalpha() for c in t)}
    docs = {i: docs[i] for i, low in brute(docs).items() if i == low}
    docs = without_repeats(docs)
    norm = lambda t: " " + " ".join(map(str, decontam.words([t or ""])[0].tolist())) + " "
    docs = {d: t for d, t in docs.items() if not any(norm(i) in norm(t) for i in items)}
    own = bpe.codec(bpe.vocabulary())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {d: (len(own.encode(t)), sha(",".join(map(str, own.encode(t)))), sha(t)) for d, t in docs.items()}


def test_run_against_a_plain_version(spark):
    docs = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    items = [r.text for r in read_table(spark, SF, "benchmark").collect()]
    assert {r[0]: tuple(r[1:]) for r in cp.run(spark, SF).collect()} == plain_run(docs, items)


def test_stages_keep_columns_and_clean_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "12 34", None, "s", 5), (4, "a clean text of its own", "en", "s", 23), (5, "A clean text of its own", "en", "s", 23)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("spans0", docs_extra())
    for _, stage in cp.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    assert [r.doc_id for r in docs.collect()] == [4]
    assert cp.STAGES[-1][1](spark, docs, SF).first().n_tokens > 0


def test_stages_with_repeated_null_and_long_rows(spark):
    long = "words of a very long text that has no end " + "and goes on with more and more of it " * 20_000
    rows = [(1, long), (2, long + " "), (3, "A short text of its own here"), (3, "A short text of its own here"), (None, "text without an id"), (None, None), (2**60, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": docs_extra(), "component_id": docs_extra()})
    for _, stage in cp.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
    got = sorted((r.doc_id or 0, (r.text or "")[:9]) for r in docs.collect())
    assert got == [(0, "text with"), (1, "words of "), (3, "A short t"), (3, "A short t"), (2**60, "x")]
    assert cp.STAGES[-1][1](spark, docs, SF).count() == 5


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("x")


def test_empty_input(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
