import math
import re
import zlib

import numpy as np

from vidcohort.llm import toxicity as tx
from vidcohort.llm.lmscore import BASE


def test_held_out_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in tx.op2_toxicity(spark, sf).collect()}
    held = [(rows[r.doc_id], r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    hits = sum(r.predicted and t for r, t in held)
    assert 2 * hits / (sum(t for _, t in held) + sum(r.predicted for r, _ in held)) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_non_negative_risk_finds_hidden_positives():
    """Toxic texts that hide among the unlabelled are still scored as toxic."""
    rng = np.random.default_rng(0)
    noise = lambda: rng.integers(100, 3000, 60)
    p = [np.unique(np.append(noise(), rng.integers(0, 8))) for _ in range(300)]
    u = [np.unique(np.append(noise(), rng.integers(0, 8)) if i % 10 == 0 else noise()) for i in range(2000)]
    used, w, bias = tx.fit(p, u, 0.1)
    weight = np.zeros(3000)
    weight[used] = w
    score = lambda rows: np.array([weight[r].sum() + bias for r in rows])
    assert (score(u[::10]) > 0).mean() > 0.95
    assert (score([r for i, r in enumerate(u) if i % 10]) > 0).mean() < 0.03


def test_features_are_those_of_each_text_alone():
    texts = ["the Cat", "", "cat-the 9x", "ñandú é"]
    owner, f = tx.word_features(texts)
    for i, t in enumerate(texts):
        o, g = tx.word_features([t]) if t else (None, np.zeros(0))
        assert sorted(f[owner == i]) == sorted(g)
    assert set(f[owner == 0]) <= set(f[owner == 2])


def plain_features(text):
    """The places of a text's words, one by one."""
    out, full = set(), 2**64 - 1
    for word in re.findall(b"[a-z\x80-\xff]+", (text or "").encode().lower()):
        whole = sum((c + 1) * pow(BASE, i, 1 << 64) for i, c in enumerate(word)) + len(word)
        for i, k in enumerate((int.from_bytes(word[:4], "little"), int.from_bytes(word[:5], "little"), whole & full)):
            m = (k + i + 1) * 0x9E3779B97F4A7C15 & full
            out.add(((m ^ m >> 29) * 0xBF58476D1CE4E5B9 & full) >> 64 - tx.BITS)
    return out


def test_query_against_brute_force(spark):
    """Every score of the query from the weights, text by text; nothing but the text and the training labels decides."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights, bias = tx.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in tx.op2_toxicity(spark, sf).collect()}
    for r in docs.collect():
        logit = bias + sum(float(weights[f]) for f in plain_features(r.text))
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-logit))) < 1e-5
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)


def test_query_with_odd_rows_and_clashing_names(spark, tmp_path):
    word = lambda k: "".join(chr(97 + k * j % 26) for j in range(1, 9)) + "abcdefghij"[k % 10]
    rows = [(k, f"{'awful nasty' if k % 4 == 0 else 'fine good'} text {word(k)} {word(k + 7)}") for k in range(200)]
    rows += [(None, "awful nasty"), (2**60 + 1, "awful nasty"), (500, "awful nasty " * 200_000), (500, None), (500, "")]
    df = spark.createDataFrame([(*r, 1.0, True, 7) for r in rows], "doc_id long, text string, score double, held_out boolean, predicted int")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 1.0) for k in range(200)] + [(None, 1, 1.0), (0, None, 1.0)], "doc_id long, toxic int, score double")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = tx.op2_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and [r.held_out for r in got if r.doc_id is None] == [None]
    assert {r.predicted for r in got if r.doc_id is None or r.doc_id == 2**60 + 1} == {1}
    assert sorted(r.predicted for r in got if r.doc_id == 500) == [0, 0, 1]
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 200)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x" * 100000, 1), (3, "a b", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0)):
        w, b = tx.train(docs, lab)
        s = tx.score_texts([None, "", "x" * 1000, "a b"], w, b)
        assert len(s) == 4 and ((s >= 0) & (s <= 1)).all()
