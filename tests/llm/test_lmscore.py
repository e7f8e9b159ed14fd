import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vidcohort.llm import lmscore as lm


def tokens(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [None]


def brute(docs):
    """The automaton with all its states, one token after the other."""
    train = [tokens(t) for d, t in docs if zlib.crc32(str(d).encode()) % 10]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    total = n + 0.1 * (v + 1)
    two = Counter(p for t in train for p in zip([None, *t], t))
    three = Counter(p for t in train for p in zip([None, *t], t, t[1:]))
    root = lambda w: (c[w] + 0.1) / total
    second = lambda a, w: (two[a, w] + lm.PRIOR[0] * root(w)) / (c[a] + lm.PRIOR[0])
    third = lambda a, b, w: (three[a, b, w] + lm.PRIOR[1] * second(b, w)) / (two[a, b] + lm.PRIOR[1])
    out = {}
    for d, t in docs:
        ts = tokens(t)
        base = sum(math.log10(root(w)) for w in ts)
        score, state, before = 0.0, (None,) if None in c else (), None
        for w in ts:
            while True:  # along failure arcs until there is an arc
                if len(state) == 2 and (*state, w) in three:
                    score += math.log10(third(*state, w))
                elif len(state) == 1 and (*state, w) in two:
                    score += math.log10(second(*state, w))
                elif not state:
                    score += math.log10(root(w))
                else:
                    count, prior = two[state] if len(state) == 2 else c[state[0]], lm.PRIOR[len(state) - 1]
                    score += math.log10(prior / (count + prior))
                    state = state[1:]
                    continue
                break
            state = (before, w) if (before, w) in two else (w,) if w in c else ()
            before = w
        out[d] = (len(ts), sum(w in c for w in ts), n, base, score)
    return out


def against_brute(rows, docs):
    want = brute(docs)
    assert len(rows) == len(docs)
    for r in rows:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert np.allclose([r.base_score, r.score], w[3:], rtol=1e-9)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = lm.op9_lmscore(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows)
    against_brute(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_many_sources_and_buckets(spark, monkeypatch):
    """Small sources and buckets, a hot word and hot context, repeated and very long texts."""
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(lm, "SOURCE", 2000)
    rng = random.Random(4)
    docs = [(d, " ".join(rng.choice(["the", "the", "of", "w%d" % rng.randrange(300)]) for _ in range(rng.randrange(60)))) for d in range(150)]
    docs += [(500, "the of " * 5000), (501, docs[3][1]), (502, docs[3][1]), (503, None), (504, "")]
    df = spark.createDataFrame(docs, "row long, text string").repartition(7)
    train = F.pmod(F.crc32(F.col("row").cast("string").cast("binary")), F.lit(10)) != 0
    against_brute(lm.score(df.withColumn("train", train)).withColumnRenamed("row", "doc_id").collect(), docs)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "A a\u00a0b", 1), (2, "A a\u00a0b", 1)], "row long, text string, n_tokens int")
    rows = sorted((r.row, r.n_tokens, r.n_known) for r in lm.score(df.withColumn("train", F.col("row") == 2)).collect())
    assert rows == [(1, 1, 1), (2, 1, 1), (2, 3, 3), (2, 3, 3)]
    empty = lm.score(df.withColumn("train", F.lit(None).cast("boolean"))).collect()
    assert all(r.base_score == 0 == r.score and r.n_known == 0 for r in empty) and len(empty) == 4
    assert lm.score(df.limit(0).withColumn("train", F.lit(True))).count() == 0
    no_id = spark.createDataFrame([(None, "a", False), (2**60 + 1, "b", True)], "row long, text string, train boolean").coalesce(1)
    assert {(r.row, r.n_tokens, r.n_known) for r in lm.score(no_id).collect()} == {(None, 2, 1), (2**60 + 1, 2, 2)}


def test_states_sum_to_one():
    """After every pair the probabilities of all words and of one unknown word are one."""
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 6, 200), 0)
    words = np.append(lm.END, np.arange(1, 6, dtype=np.uint64))
    learned = lm.Grams(words, text, np.array([0]))
    counts = dict(zip(learned.hashes.tolist(), learned.counts(np.ones(len(text), bool)).tolist()))
    n, v = len(text), len(set(text.tolist()))
    for a in range(1, 6):
        for b in range(1, 6):
            total = 0.0
            for w in range(7):  # 6 is not known
                own = lm.Grams(np.append(words, np.uint64(77)), np.array([a, b, w]), np.array([0]))
                found = np.array([counts.get(h, 0) for h in own.hashes.tolist()])
                total += 10 ** own.traverse(found, n, v)[1][2]
            assert abs(total - 1) < 1e-9
