import random

import numpy as np
import pytest
import xxhash

from vidcohort.llm import simhash


def brute_fp(text):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps):
    comp = list(range(len(fps)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "one", "A b C", "a b c d", "a b c d e A b c d", "é x y z w " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fp(text)


def test_index_matches_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(20)]))
    q, m = simhash.GrayIndex(codes).search(codes, 4)
    got = set(zip(q.tolist(), m.tolist()))
    want = {(i, j) for i in range(len(codes)) for j in range(len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 4}
    assert got == want


@pytest.mark.parametrize("block_rows", [2, 16, 8192])
def test_components(spark, block_rows):
    random.seed(3)
    fps = [0]
    for _ in range(60):
        x = random.getrandbits(64)
        for _ in range(random.choice([1, 1, 2, 6])):
            fps.append(x)
            for b in random.sample(range(64), random.choice([1, 3, 4, 5])):
                x ^= 1 << b
    fps = list(dict.fromkeys(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r.node: r.component for r in simhash.connected_components(simhash.links(df, block_rows)).collect()}
    of = [signed.index(found.get(f, f)) for f in signed]
    want = brute_components(fps)
    assert len(set(zip(of, want))) == len(set(of)) == len(set(want))


def test_tables_with_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b c d e", None), (3, "a b c d e", None), (4, "A B c d e", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3), (4, 3)]
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 3, 3]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    # a row without id links others; ids over 2^53 stay whole
    big = 2**60 + 1
    rows = [(None, "q r s t u"), (big, "q r s t u"), (None, "only here"), (7, "very long " + "a b c d e f g " * 30_000), (8, "very long " + "a b c d e f g " * 30_000)]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, big), (big, big), (None, None), (7, 7), (8, 7)}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)
    fps = [brute_fp(docs[i]) for i in ids]
    comp = [ids[c] for c in brute_components(fps)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, comp)}
