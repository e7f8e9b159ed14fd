import hashlib

import numpy as np
import pandas as pd
import pytest

from vidcohort.llm import media as md


def song(seed, notes=60):
    rng = np.random.default_rng(seed)
    n = np.arange(1024)
    return np.concatenate([sum(rng.uniform(0.2, 1) * np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 24) / 12) * n / md.RATE) for _ in range(3)) for _ in range(notes)])


def pcm(x):
    return np.clip(x * 8000, -32767, 32767).astype("<i2")


def test_alignment_of_a_noisy_clip():
    x = song(1)
    clip = x[40 * md.HOP : 200 * md.HOP] + np.random.default_rng(2).normal(0, 0.05, 160 * md.HOP)
    a, b = md.fingerprint(pcm(x)), md.fingerprint(pcm(clip))
    offset, error = md.align(a, b)
    assert offset == 40 and error < 0.15
    assert md.align(a, md.fingerprint(pcm(song(9))))[1] > 0.2


def test_silence_and_short_signals():
    assert len(md.fingerprint(np.zeros(0, "<i2"))) == len(md.fingerprint(np.zeros(9000, "<i2"))) == len(md.fingerprint(np.ones(100, "<i2"))) == 0


def brute_links(prints):
    """All pairs within MAX_ERROR at any offset."""
    out = set()
    for i in prints:
        for j in prints:
            if i < j and min((md.overlap_error(prints[i], prints[j], o) for o in range(-len(prints[j]), len(prints[i]))), default=1.0) <= md.MAX_ERROR:
                out.add((i, j))
    return out


def components(ids, links):
    comp = {i: i for i in ids}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in links:
        u, v = find(a), find(b)
        comp[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("crowd,small", [(3, 48), (4096, 48), (4096, 2)])
def test_classes_against_brute_force(spark, crowd, small):
    rng = np.random.default_rng(4)
    prints = {}
    for k in range(25):
        base = rng.integers(0, 2**32, 40, dtype=np.uint32)
        base[rng.integers(0, 40, 6)] = 77  # an integer that is common to all
        for _ in range(rng.integers(1, 5)):
            at = rng.integers(0, 8)
            own = base[at : at + 30].copy()
            own ^= (np.uint32(1) << rng.integers(0, 32, 30, dtype=np.uint32)) * (rng.random(30) < 0.5)
            prints[len(prints)] = own
    rows = [(i, p.view(np.int32).tolist()) for i, p in prints.items()]
    df = spark.createDataFrame(rows, "id long, ints array<int>")
    found = {r.node: r.component for r in md.connected_components(md.links(df, crowd, small)).collect()}
    assert {i: found.get(i, i) for i in prints} == components(prints, brute_links(prints))


def test_recall_against_all_pairs_by_noise(spark):
    """Of all pairs of recordings within MAX_ERROR (any offset), at least 0.9 are in one class at every noise level; no class is wrong."""
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.13, (40, 64))
    for noise in (0.0125, 0.03, 0.045, 0.06, 0.08):
        vectors = np.concatenate([base, base + rng.normal(0, noise, base.shape)])
        vectors[70:] = np.roll(vectors[70:], 4, axis=1)  # some start later
        rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
        prints = md.fingerprints(md.recordings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).cache()
        links = brute_links({r.id: np.array(r.ints, np.int32).view(np.uint32) for r in prints.collect()})
        got = {r.id: r.class_id for r in md.classes(prints).collect()}
        want = components(got, links)
        assert np.mean([got[a] == got[b] for a, b in links]) >= 0.9
        assert all(want[i] == want[got[i]] for i in got)


def test_long_repeated_and_clashing_rows(spark):
    long = np.tile(pcm(song(5, 200)), 3)
    rows = [(1, long.tobytes()), (2, long[64 * md.HOP :].tobytes()), (3, None), (3, b""), (4, pcm(song(6)).tobytes()), (4, pcm(song(6)).tobytes())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, audio binary, class_id int")
    got = sorted((r.id, r.class_id) for r in md.classes(md.fingerprints(df)).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3), (4, 4), (4, 4)]


def test_query_and_recall(spark):
    """All rows are there, and of the pairs of close vectors (brute force) at least 0.9 share a class."""
    sf = "/root/testdata/sf0.001"
    rng = np.random.default_rng(7)
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()])
    close = x[:60] + rng.normal(0, 0.0125, (60, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, close]))] + [(5000, None), (5001, []), (5002, x[0].tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, ints int")
    got = {r.id: r for r in md.classes(md.fingerprints(md.recordings(df))).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[500 + i].class_id == got[i].class_id for i in range(60)]) >= 0.9
    assert got[5002].class_id == got[0].class_id and got[5002].bit_error == 0
    assert np.mean([got[i].class_id == i for i in range(500)]) > 0.98
    rows = md.op5_media(spark, sf).collect()
    assert len(rows) == 500
    prints = {r.id: np.array(r.ints, np.int32).view(np.uint32) for r in got.values() if r.id < 500}
    for r in rows:  # class, alignment and digest of the query from the fingerprints, one by one
        own, first = prints[r.vec_id], prints[r.class_id]
        assert r.n_ints == len(own) and r.class_id <= r.vec_id
        assert (r.offset, r.bit_error) == md.align(first, own) or not len(own)
        assert r.fingerprint == hashlib.md5(",".join(map(str, own.view(np.int32).tolist())).encode()).hexdigest()
    want = components(prints, brute_links(prints))
    assert np.mean([r.class_id == want[r.vec_id] for r in rows]) > 0.99
    assert md.classes(md.fingerprints(md.recordings(df.limit(0)))).count() == 0


@pytest.mark.parametrize("small,crowd", [(48, 4096), (1000, 4096), (4, 4096), (4, 16)])
def test_a_recording_that_is_near_locally_only(spark, small, crowd):
    """The first member of a crowded group is like all others around one place, but none of the whole: the others still find each other."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**32, 6, dtype=np.uint32)
    prints = {0: base ^ np.uint32(0xFF)}
    for i in range(1, 61):
        bits = rng.choice(8, rng.integers(2, 4), replace=False)
        prints[i] = base ^ np.uint32(sum(1 << int(b) for b in bits))
    links = brute_links(prints)
    assert not any(0 in pair for pair in links) and len(links) > 800
    df = spark.createDataFrame([(i, p.view(np.int32).tolist()) for i, p in prints.items()], "id long, ints array<int>")
    found = {r.node: r.component for r in md.connected_components(md.links(df, crowd, small)).collect()}
    assert {i: found.get(i, i) for i in prints} == components(prints, links)


@pytest.mark.parametrize("crowd,small", [(8, 48), (8, 4), (4096, 48)])
def test_recordings_that_share_a_crowded_integer_only(spark, crowd, small):
    """Pairs have three equal bytes at one integer alone, which all recordings share; its key is crowded or not."""
    rng = np.random.default_rng(13)
    prints = {}
    for k in range(20):
        base = rng.integers(0, 2**32, 10, dtype=np.uint32)
        base[5] = 77
        other = base ^ np.uint32(0x101)
        other[5] = 77
        prints |= {2 * k: base, 2 * k + 1: other}
    links = brute_links(prints)
    assert len(links) == 20
    df = spark.createDataFrame([(i, p.view(np.int32).tolist()) for i, p in prints.items()], "id long, ints array<int>")
    found = {r.node: r.component for r in md.connected_components(md.links(df, crowd, small)).collect()}
    assert {i: found.get(i, i) for i in prints} == components(prints, links)


@pytest.mark.parametrize("crowd,small", [(4096, 48), (4096, 4), (8, 4)])
def test_overlaps_longer_than_a_row_holds(spark, crowd, small):
    """Recordings that agree around their keys, as far as a row holds them, and for some pairs beyond."""
    rng = np.random.default_rng(14)
    n = 6 * md.WIDE
    base = rng.integers(0, 2**32, n, dtype=np.uint32)
    prints = {}
    for i in range(12):
        own = base.copy()
        own[: n // 2] = np.random.default_rng(i % 3).integers(0, 2**32, n // 2, dtype=np.uint32)
        own ^= (np.uint32(1) << rng.integers(0, 32, n, dtype=np.uint32)) * (rng.random(n) < 0.5)
        prints[i] = own[i:] if i % 2 else own
    links = {(i, j) for i in prints for j in prints if i < j and i % 3 == j % 3}
    for i, j in ((0, 3), (0, 1), (2, 5)):
        assert (min(md.overlap_error(prints[i], prints[j], o) for o in range(-n, n)) <= md.MAX_ERROR) == ((i, j) in links)
    df = spark.createDataFrame([(i, p.view(np.int32).tolist()) for i, p in prints.items()], "id long, ints array<int>")
    found = {r.node: r.component for r in md.connected_components(md.links(df, crowd, small)).collect()}
    assert {i: found.get(i, i) for i in prints} == components(prints, links)


def test_at_most_one_link_a_recording_from_each_task():
    """A group of near copies gives as many rows as it has recordings, and what the rows show to be too different gives none."""
    rng = np.random.default_rng(15)
    base, far = rng.integers(0, 2**32, (2, 22), dtype=np.uint32)
    far[8:15] = base[8:15]
    prints = [base ^ (np.uint32(1) << rng.integers(0, 32, 22, dtype=np.uint32)) for _ in range(100)] + [far ^ np.uint32(1 << k) for k in range(3)]
    rows = [{"part": 0, "key": 7, "id": i, "pos": 11, "rest": 10, "around": p.view(np.int32)} for i, p in enumerate(prints)]
    for small in (48, 1000):
        got = md._candidates(pd.DataFrame(rows), small)
        assert got["sure"].all() and len(got) == 101
        assert set(zip(got["a"], got["b"])) == {(0, i) for i in range(1, 100)} | {(100, 101), (100, 102)}


def test_histogram_of_offsets_and_errors():
    rng = np.random.default_rng(12)
    for n, m in ((1, 1), (5, 9), (40, 33), (700, 900)):
        a, b = (rng.integers(0, 3, k, dtype=np.uint32) << np.uint32(14) for k in (n, m))
        votes = np.zeros(n + m - 1, np.int64)
        for i in range(n if n < 100 else 0):
            for j in range(m):
                votes[i - j + m - 1] += int(a[i] & 0xFFFF == b[j] & 0xFFFF) + int(a[i] >> 16 == b[j] >> 16)
        if n < 100:
            assert md.histogram(a, b).tolist() == votes.tolist()
        offsets = np.arange(-(m - 1), n)
        assert md.errors(a, b, offsets) == pytest.approx([md.overlap_error(a, b, int(o)) for o in offsets])


def test_sustained_tones_of_an_hour():
    tone = np.full(57_600, 12345, np.uint32)
    assert md.align(tone, tone[1000:]) == (0, 0.0)
    later = np.concatenate([np.arange(5000, dtype=np.uint32) * np.uint32(2654435761), tone])
    assert md.align(later, later[2000:]) == (2000, 0.0)
