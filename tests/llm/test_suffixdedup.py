import hashlib
import random

import numpy as np
import pytest

from vidcohort.llm import suffixdedup as sd


def brute(docs):
    """Per (doc_id, data) in order: what the definition removes."""
    first = {}
    for d, data in sorted(docs):
        for i in range(len(data) - 99):
            first.setdefault(data[i : i + 100], (d, i))
    out = []
    for d, data in docs:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if first[data[i : i + 100]] < (d, i):
                gone[i : i + 100] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((d, len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spark.catalog.dropTempView("x")
    spans = {r.doc_id: r.spans for r in sd.removed_spans(df).collect()}
    out = []
    for d, t in docs:
        data = (t or "").encode()
        gone = sd.merged(spans.get(d, []))
        kept = sd.kept_bytes(data, gone)
        out.append((d, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["é", "the", "of", "and", "ñandú", "zz"] + ["".join(rng.choices("abcdef", k=rng.randint(1, 9))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    common, texts = [prose(40), "ab" * 300, "x" * 500], []
    for _ in range(60):
        parts = [prose(rng.randint(0, 60)) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 3), rng.choice(common))
        texts.append(" ".join(parts))
        if rng.random() < 0.3:
            texts.append(texts[-1])
        if rng.random() < 0.3:
            at = rng.randint(0, len(texts[-1]))
            texts.append(texts[-1][:at] + "!" + texts[-1][at:])
    texts += ["", "short", "a" * 99, "b" * 100, "b" * 100, "b" * 101]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,crowd", [(1, 5000), (2, 1)])
def test_brute_force(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(sd, "CROWD", crowd)
    docs = corpus(seed)
    assert run(spark, docs) == brute([(d, t.encode()) for d, t in docs])


@pytest.mark.parametrize("crowd", [5000, 1])
def test_few_ranges_and_many_buckets(spark, monkeypatch, crowd):
    """Boundaries are bounded: beyond them, ranges are dealt by what their suffixes begin with."""
    for name, value in (("CROWD", crowd), ("BUCKET_BYTES", 400), ("RANGES", 3)):
        monkeypatch.setattr(sd, name, value)
    docs = corpus(5)
    assert sum(len(t) for _, t in docs) > 10 * 400
    assert run(spark, docs) == brute([(d, t.encode()) for d, t in docs])


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 700)
    text = "".join(random.Random(4).choices("abcd ", k=5000))
    import pandas as pd

    seen = [(a, w) for c in sd.scan([pd.DataFrame({"doc_id": [7], "text": [text]})]) for a, w in zip(c["at"], c["wins"])]
    covered = sorted(i for a, w in seen for i in range(a, a + w))
    assert covered == list(range(len(text) - 99))


def test_odd_rows(spark):
    t = "word " * 60
    docs = [(1, None), (2, t), (2, t), (3, t)]
    df = spark.createDataFrame([(d, x, "u") for d, x in docs] + [(None, t, "u")], "doc_id long, text string, spans string")
    kept = {(r.doc_id, r.text, r.spans) for r in sd.remove_repeats(df).collect()}
    got = {(r.doc_id, len(r.spans or [])) for r in sd.with_spans(df).collect()}
    assert {d for d, n in got if n} == {2, 3}
    assert (3, "", "u") in kept and (1, None, "u") in kept and (None, t, "u") in kept
    assert sd.removed_spans(df.limit(0)).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(0)
    cols = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    order = sd.multikey_order(*cols)
    rows = list(zip(*[c[order].tolist() for c in cols]))
    assert rows == sorted(rows)


def test_buckets_are_in_byte_order_and_neighbours_decide():
    """Suffixes of a task come in the order of their bytes, equal neighbours are those with equal bytes, and buckets follow one another."""
    import pandas as pd

    docs = corpus(3)
    text = {d: t.encode() for d, t in docs}
    parts = list(sd.scan([pd.DataFrame({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]})]))
    c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    sd.in_order(c)
    head = [text[d][a + r : a + r + sd.GRAM] for d, a, r in zip(c["doc"].tolist(), c["at"].tolist(), c["rel"].tolist())]
    assert head == sorted(head) and len(set(head)) < len(head)
    run = sd.runs(*(c[t] for t in sd.TOKENS))
    assert [a == b for a, b in zip(run[1:], run[:-1])] == [a == b for a, b in zip(head[1:], head[:-1])]
    bounds = c["t0"][np.arange(1, 8) * len(head) // 8]
    to, wide = sd.bucket_of(c, bounds)
    low = {b: min(h for h, k in zip(head, to) if k == b)[:8] for b in set(to.tolist())}
    high = {b: max(h for h, k in zip(head, to) if k == b)[:8] for b in set(to.tolist())}
    assert all(high[a] <= low[b] for a in low for b in low if a < b)
    for h, k, w in zip(head, to, wide):  # equal bytes are in one bucket unless their token is on both sides of one
        assert w or all(k == m for g, m in zip(head, to) if g == h)
    gone = sd.later(c)
    segment = [text[d][a : a + w + sd.SIZE - 1] for d, a, w in zip(c["doc"].tolist(), c["at"].tolist(), c["wins"].tolist())]
    first = {}
    for s, d, a in zip(segment, c["doc"].tolist(), c["at"].tolist()):
        first[s] = min(first.get(s, (d, a)), (d, a))
    assert gone.tolist() == [first[s] < (d, a) for s, d, a in zip(segment, c["doc"].tolist(), c["at"].tolist())]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in sd.op3_suffixdedup(spark, sf).collect()) == brute(docs)
