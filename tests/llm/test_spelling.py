"""Spelling variants: the index against all pairs, groups of any size, the query against a plain version."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from vidcohort.llm import spelling
from vidcohort.llm.fmindex import FMIndex, suffix_array

import numpy as np


def cuts(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def differ_by_one(v, w):
    if len(v) == len(w):
        return sum(a != b for a, b in zip(v, w)) == 1
    v, w = sorted((v, w), key=len)
    return len(w) == len(v) + 1 and v in cuts(w)


def plain_words(rows):
    count = Counter()
    for doc, text in rows:
        for x in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            x = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
            h = zlib.crc32(f"{'' if doc is None else doc}:{x}".encode())
            count[x if h % 199 else x[: h % len(x)] + x[h % len(x) + 1 :]] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def plain(rows):
    words = plain_words(rows)
    shared, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shared[w[:i], w[i + 1 :]].add(w)
        for x in cuts(w) & words.keys():
            near[w].add(x)
            near[x].add(w)
    for group in shared.values():
        for a, b in itertools.permutations(group, 2):
            near[a].add(b)
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= 5 * n:
                form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None


def results(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_suffix_array():
    rng = random.Random(2)
    for n in (1, 2, 9, 300):
        text = np.array([rng.randrange(1, 4) for _ in range(n)] + [0])
        assert suffix_array(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())


def test_index_intervals():
    words = ["banana", "bandana", "ananas", "band", "é", "bananas"]
    index = FMIndex(words)
    for right, patterns, hits in ((False, ["ban", "an", "x", "é"], [4, 1, 0, 1]), (True, ["ana", "nas", "d"], [2, 2, 1])):
        known = [p for p in patterns if set(p) <= set("".join(words))]
        lo, size = index.exact(known, right=right)
        assert dict(zip(known, size.tolist())) == {p: n for p, n in zip(patterns, hits) if p in known}


@pytest.mark.parametrize("group,bucket", [(4096, 1 << 17), (3, 200), (1, 1 << 17)])
def test_near_words_against_all_pairs(spark, group, bucket):
    rng = random.Random(group)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(260)}
    words |= {"prefix" + "".join(rng.choice("xy") for _ in range(rng.randrange(1, 6))) for _ in range(60)} | {"a" * n for n in range(6, 13)}
    counts = {w: rng.randrange(5, 90) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, -r.best.less, r.best.best) for r in spelling.nearest(table, group, bucket).collect()}
    want = {}
    for w in words:
        near = [v for v in words if differ_by_one(v, w)]
        if near:
            best = min(near, key=lambda v: (-counts[v], v))
            want[w] = (len(near), counts[best], best)
    assert got == want


def test_query_against_plain(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = set(plain([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    assert results(spelling.op11_spelling(spark, sf)) == want
    assert any(x[1] for x in want) and len(want) > 1000


def test_odd_rows(spark):
    base = "Überstraße größere straßen ÀÉÎÕÜ abcdef abcdeg abcdefg " * 30 + "abcdex abcde× " * 5 + "x" * 400 + " "
    rows = [(1, base), (1, base), (None, "abcdef " * 40), (2, None), (3, ""), (4, " .,;"), (5, "z" * 300_000), (6, "中文abcdef中文 " * 9)]
    rows += [(i, "chain" + "a" * k + " " + ("x" * 400 + " ") * (i < 18)) for i in range(10, 25) for k in range(1, 5) for _ in range(6**k // 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1))
    assert results(spelling.variants(docs)) == set(plain(rows))
    depth = {r[0]: r for r in plain(rows)}
    assert depth["chaina"][2] == "chainaaaa"  # through two forms


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
