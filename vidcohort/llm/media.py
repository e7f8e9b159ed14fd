"""Media columns: chroma fingerprints of audio and the alignment of recordings.

``fingerprint`` turns 16-bit PCM into packed 32-bit integers: frames are folded into twelve pitch classes, smoothed and
normalised; an integral image over time and pitch gives the area sums of sixteen filters at every frame; each filter's
log ratio is quantised to two Gray-coded bits.

``align`` finds where two recordings overlap: a histogram of the offsets at which half integers agree, and the share of
differing bits at every offset with votes. ``links`` finds what to align. Recordings within ``MAX_ERROR`` need not share
a whole integer, but at some place of their overlap at least three bytes of four are equal but for rare cases (the tests
measure it). So an integer has four keys of three bytes. A key's row carries the ``WIDE`` integers before and after it
and no more, whatever the length of a recording. Of the members of a key, those whose surroundings (``AROUND`` integers on
either side) differ in ``LOCAL_ERROR`` of the bits at most are candidates. Where the rows hold the whole overlap, candidates are
compared there and then, and a task gives at most one link a recording; the others are joined with their integers and
compared afterwards, unless what the rows hold differs too much already. A key with more than ``CROWD`` rows is dealt in chunks,
each pair of chunks a group of its own, so that all its pairs meet; the work on such a key grows with the square of its rows.

Silence and recordings that are too short for a frame have no integers: they are alone in their class. Null media count
as empty. Equal recordings are one class. Rows that repeat an id with the same audio come back as often; with different
audio they link what either links. Ties between offsets go to the smallest shift. Recordings of any length are taken
whole. An empty table gives an empty result.

The given tables hold no audio, so ``recordings`` derives one from every embedding: a step of four tones for each four
numbers, whose loudness follows them; a vector of another length gives a recording of another length, null or not-a-number
counts as zero.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidcohort.llm.common import connected_components, cut, partitions, read_table
from vidcohort.llm.simhash import unite

RATE, FRAME, HOP = 4096, 1024, 256
PITCHES = 12
MAX_ERROR, MIN_OVERLAP = 0.12, 0.6
#: Rows of a key beyond which it is split.
CROWD = 4096
#: Integers on either side of a key that make its surroundings, and the share of their bits that may differ.
AROUND, LOCAL_ERROR = 3, 0.18
#: Integers on either side that a key's row carries.
WIDE = 24
#: Rows of keys for each task that compares them.
TASK_ROWS = 100_000
#: Members up to which all pairs of a group are compared at once.
SMALL = 48
#: Pairs of places, or of integers, that are compared one by one; beyond them by correlation.
PAIRS = 1 << 20
TONES = 4
#: Samples that are handled at once.
AT_ONCE = 1 << 19
#: Pairs of a key's rows that are compared at once.
AT_A_TIME = 100_000


@functools.cache
def chroma_map() -> np.ndarray:
    """Weight of each spectrum bin in each pitch class, between 110 and 1760 Hz."""
    freq = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(freq), PITCHES))
    for k, f in enumerate(freq):
        if 110 <= f <= 1760:
            out[k, int(round(12 * np.log2(f / 440))) % 12] = 1
    return out


@functools.cache
def filters() -> list[tuple[int, int, int, int]]:
    """(kind, lowest pitch, pitches, frames) of the sixteen filters."""
    out = []
    for k in range(16):
        height = (4, 6, 12, 8)[k // 4]
        out.append((k % 6, (5 * k) % (PITCHES - height + 1), height, 4 + k % 5))
    return out


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Normalised pitch-class frames of signals of one length, a row each."""
    if pcm.shape[-1] < FRAME:
        return np.zeros((len(pcm), 0, PITCHES))
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float32), FRAME, axis=-1)[:, ::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.sqrt(np.square(np.abs(np.fft.rfft(frames))) @ chroma_map())
    padded = np.pad(power, ((0, 0), (2, 2), (0, 0)), mode="edge")
    smooth = sum(w * padded[:, i : i + power.shape[1]] for i, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    size = np.linalg.norm(smooth, axis=-1, keepdims=True)
    return np.where(size > 1e-3, smooth / np.maximum(size, 1e-3), 0)


def fingerprint_all(pcm: np.ndarray) -> list[np.ndarray]:
    """Packed integers of signals of one length, one a frame at which all filters fit; none of a silent signal."""
    frames = chroma(pcm)
    n = frames.shape[1] - max(w for *_, w in filters()) + 1
    if n <= 0:
        return [np.zeros(0, np.uint32)] * len(pcm)
    image = np.zeros((len(pcm), frames.shape[1] + 1, PITCHES + 1))
    image[:, 1:, 1:] = frames.cumsum(axis=1).cumsum(axis=2)

    def area(x0, x1, y0, y1):
        return image[:, x1 : x1 + n, y1] - image[:, x0 : x0 + n, y1] - image[:, x1 : x1 + n, y0] + image[:, x0 : x0 + n, y0]

    packed = np.zeros((len(pcm), n), np.uint32)
    for kind, y, h, w in filters():
        whole = area(0, w, y, y + h)
        if kind == 0:
            a = area(0, w, y, y + h // 2)
        elif kind == 1:
            a = area(0, w // 2, y, y + h) * (w / (2 * (w // 2)))
        elif kind == 2:
            a = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        elif kind == 3:
            a = area(0, w, y + h // 4, y + h - h // 4)
        elif kind == 4:
            a = area(w // 3, w - w // 3, y, y + h) * (w / (2 * (w - 2 * (w // 3))))
        else:
            a = area(0, w - w // 2, y + h // 3, y + h)
        value = np.log((0.01 + a) / (0.01 + np.maximum(whole - a, 0)))
        level = (value > -0.25).astype(np.uint32) + (value > 0) + (value > 0.25)
        packed = packed << np.uint32(2) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
    loud = frames.any(axis=(1, 2))
    return [p if x else p[:0] for p, x in zip(packed, loud)]


def fingerprint(pcm: np.ndarray) -> np.ndarray:
    """Packed integers of a signal."""
    return fingerprint_all(pcm[None])[0]


def overlap_error(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of differing bits if b starts ``offset`` integers after a does; 1 if too little overlaps."""
    start, stop = max(0, offset), min(len(a), len(b) + offset)
    if stop - start < max(1, MIN_OVERLAP * min(len(a), len(b))):
        return 1.0
    return float(np.bitwise_count(a[start:stop] ^ b[start - offset : stop - offset]).sum() / (32 * (stop - start)))


def correlate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of a[i] * b[j] for each offset i - j, from -(len(b) - 1) on, by Fourier transform; the numbers are small and whole."""
    n = 1 << (len(a) + len(b) - 2).bit_length()
    out = np.fft.irfft(np.fft.rfft(a, n) * np.fft.rfft(b[::-1], n), n) if n > 1 else a * b
    return np.rint(out[: len(a) + len(b) - 1]).astype(np.int64)


def histogram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Votes of each offset, from -(len(b) - 1) on: how many halves of integers are equal at it.

    A value that stands in many places of both (a sustained tone) is counted by its places' correlation, not pair by pair.
    """
    votes = np.zeros(len(a) + len(b) - 1, np.int64)
    for half in (0, 16):
        x, y = a >> np.uint32(half) & np.uint32(0xFFFF), b >> np.uint32(half) & np.uint32(0xFFFF)
        order, other = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
        for v in np.intersect1d(x, y):
            p = order[np.searchsorted(x, v, "left", order) : np.searchsorted(x, v, "right", order)]
            q = other[np.searchsorted(y, v, "left", other) : np.searchsorted(y, v, "right", other)]
            if len(p) * len(q) <= PAIRS:
                votes += np.bincount((p[:, None] - q + len(b) - 1).ravel(), minlength=len(votes))
            else:
                votes += correlate((x == v).astype(float), (y == v).astype(float))
    return votes


def errors(a: np.ndarray, b: np.ndarray, offsets: np.ndarray) -> list[float]:
    """``overlap_error`` at each offset; of long recordings for all offsets at once, from the correlations of their bits."""
    if len(offsets) * min(len(a), len(b)) <= PAIRS:
        return [overlap_error(a, b, int(o)) for o in offsets]
    agree = np.zeros(len(a) + len(b) - 1, np.int64)  # equal bits less different ones
    for bit in range(32):
        agree += correlate(*(2.0 * (x >> np.uint32(bit) & np.uint32(1)) - 1 for x in (a, b)))
    start, stop = np.maximum(0, offsets), np.minimum(len(a), len(b) + offsets)
    size = stop - start
    different = (32 * size - agree[offsets + len(b) - 1]) // 2
    return np.where(size < max(1, MIN_OVERLAP * min(len(a), len(b))), 1.0, different / (32 * np.maximum(size, 1))).tolist()


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """(offset, bit error) of the best of the offsets with votes."""
    if not len(a) or not len(b):
        return 0, 1.0
    offsets = np.flatnonzero(histogram(a, b)) - (len(b) - 1)
    best = min(((e, abs(o), o) for e, o in zip(errors(a, b, offsets), offsets.tolist())), default=(1.0, 0, 0))
    return best[2], best[0]


def fingerprints(media: DataFrame) -> DataFrame:
    """(id, ints) of ``media`` (id, audio): audio is 16-bit PCM at ``RATE``."""

    @F.pandas_udf("array<int>")
    def run(audio: pd.Series) -> pd.Series:
        out: list = [None] * len(audio)
        same: dict[int, list[int]] = {}
        for k, x in enumerate(audio):
            same.setdefault(len(x or b"") // 2, []).append(k)
        for size, places in same.items():
            step = max(1, AT_ONCE // max(1, size))
            for i in range(0, len(places), step):
                part = places[i : i + step]
                pcm = np.stack([np.frombuffer(audio[k] or b"", "<i2", size) for k in part])
                for k, p in zip(part, fingerprint_all(pcm)):
                    out[k] = p.view(np.int32)
        return pd.Series(out)

    return media.select(F.col("id").cast("long").alias("id"), run("audio").alias("ints"))


def postings(prints: DataFrame) -> DataFrame:
    """(key, id, pos, rest, around): a row for each of the four keys of each integer, which leave out one byte of it each.

    ``rest`` is the number of integers after it, ``around`` holds those up to ``WIDE`` before and after it, and itself.
    """
    rest = [0xFFFFFFFF ^ 0xFF << 8 * j for j in range(4)]
    own = prints.select("id", "ints", F.posexplode("ints").alias("pos", "x"))
    around = F.expr(f"slice(ints, greatest(pos - {WIDE}, 0) + 1, least(pos, {WIDE}) + {WIDE + 1})").alias("around")
    four = F.explode(F.array(*(F.shiftleft(F.col("x").cast("long").bitwiseAND(F.lit(m)), 2).bitwiseOR(F.lit(j)) for j, m in enumerate(rest))))
    return own.select(four.alias("key"), "id", "pos", (F.size("ints") - F.col("pos") - 1).alias("rest"), around)


class Members:
    """Rows of ``postings`` with their surroundings laid out for comparisons."""

    def __init__(self, pdf: pd.DataFrame):
        self.pos, self.rest = (pdf[c].to_numpy().astype(np.int64) for c in ("pos", "rest"))
        at = np.arange(-WIDE, WIDE + 1)
        there = (at >= -self.pos[:, None]) & (at <= self.rest[:, None])
        self.wide = np.zeros(there.shape, np.uint32)
        if len(pdf):
            self.wide[there] = np.concatenate(pdf["around"].to_list()).view(np.uint32)
        close = slice(WIDE - AROUND, WIDE + AROUND + 1)
        self.close = self.in_pairs(self.wide[:, close])
        self.there = self.in_pairs(np.where(there[:, close], np.uint32(0xFFFFFFFF), np.uint32(0)))
        self.which = np.packbits(there[:, close], axis=1)[:, 0]  # there are seven
        #: How many bits may differ, by the number of integers that are compared.
        self.most = np.floor(LOCAL_ERROR * 32 * np.arange(2 * AROUND + 2)).astype(np.uint8)

    @staticmethod
    def in_pairs(ints: np.ndarray) -> list[np.ndarray]:
        """Columns of two integers each, as they are compared faster."""
        even = np.pad(ints, ((0, 0), (0, ints.shape[1] % 2)))
        return list(np.ascontiguousarray(np.ascontiguousarray(even).view(np.uint64).T))

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of rows have similar surroundings; ``i`` and ``j`` are broadcast."""
        bits = sum(np.bitwise_count((x[i] ^ x[j]) & (m[i] & m[j])) for x, m in zip(self.close, self.there))  # 224 at most
        return bits <= self.most[np.bitwise_count(self.which[i] & self.which[j])]

    def whole(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of rows are surely within ``MAX_ERROR`` over their whole overlap, and for which more must be seen than the rows hold."""
        before, after = np.minimum(self.pos[i], self.pos[j]), np.minimum(self.rest[i], self.rest[j])
        size = before + after + 1
        bits = np.zeros(len(i), np.int64)
        at = np.arange(-WIDE, WIDE + 1)
        for k in range(0, len(i), 20_000):
            p = slice(k, k + 20_000)
            both = (at >= -before[p, None]) & (at <= after[p, None])
            bits[p] = (np.bitwise_count(self.wide[i[p]] ^ self.wide[j[p]]) * both).sum(axis=1, dtype=np.int64)
        shorter = np.minimum(self.pos[i] + self.rest[i], self.pos[j] + self.rest[j]) + 1
        fine = (size >= np.maximum(1, MIN_OVERLAP * shorter)) & (bits / (32 * size) <= MAX_ERROR)
        seen = (before <= WIDE) & (after <= WIDE)
        return fine & seen, fine & ~seen


def _candidates(pdf: pd.DataFrame, small: int = SMALL) -> pd.DataFrame:
    """(a, b, shift, part, key, sure) of some keys' members: pairs that connect all that may hang together.

    Pairs of similar surroundings whose whole overlap the rows hold are decided here; recordings that they connect come back as sure
    pairs with their smallest, one a recording. The others are to be compared, unless the bits that the rows hold are too many
    already. Small groups are compared all at once (their key is null). In the others two members may hang together if
    pairs lead from one to the other; the pairs inside such a group stand for all others of it, as long as they
    pass the comparison as a whole. Groups with a pair that does not are sent again with the ``component`` of each recording: then
    all pairs of similar surroundings between different components are given.
    """
    pdf = pdf.sort_values(["key", "id", "pos"])
    members = Members(pdf)
    key, ids, pos, part = (pdf[c].to_numpy() for c in ("key", "id", "pos", "part"))
    names, first, node = np.unique(ids, return_index=True, return_inverse=True)
    again = "component" in pdf.columns
    joined = np.arange(len(names))  # the smallest recording that each is surely connected with
    if again:
        _, low, same = np.unique(pdf["component"].to_numpy()[first], return_index=True, return_inverse=True)
        joined = low[same]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(start, len(key)))
    found, grouped = [], []

    def decided(i, j):
        """Unites what is sure of the pairs; the others that may pass."""
        nonlocal joined
        apart = joined[node[i]] != joined[node[j]]
        i, j = i[apart], j[apart]
        sure, open_ = members.whole(i, j)
        if sure.any():
            joined = unite(joined, node[i[sure]], node[j[sure]])
        return i[open_], j[open_]

    for n in np.unique(count[(count > 1) & (count <= small)]):
        x, y = np.triu_indices(n, 1)
        groups = start[count == n]
        step = max(1, AT_A_TIME // len(x))
        for k in range(0, len(groups), step):
            at = groups[k : k + step, None]
            a, b = (at + x).ravel(), (at + y).ravel()
            near = (ids[a] != ids[b]) & members.near(a, b)
            found.append(decided(a[near], b[near]))
    for s, n in zip(start[count > small], count[count > small]):
        labels = np.unique(joined[node[s : s + n]], return_inverse=True)[1]
        step = max(1, AT_A_TIME // n)
        for k in range(s, s + n - 1, step):
            a, b = np.arange(k, min(k + step, s + n - 1))[:, None], np.arange(k + 1, s + n)
            near = members.near(a, b) & (b > a)
            i, j = np.nonzero(near & (node[a] != node[b]))
            i, j = decided(i + k, j + k + 1)
            if again:
                grouped.append((i, j))
                continue
            for x in np.unique(i):
                y = j[i == x]
                y = y[labels[y - s] != labels[x - s]]
                if len(y):
                    labels = unite(labels, np.full(len(y), x - s), y - s)
                    grouped.append((np.full(len(y), x), y))
    none = (np.zeros(0, np.int64),) * 2
    out = []
    for pairs, named in ((found, False), (grouped, True)):
        a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else none
        a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
        rows = pd.DataFrame({"a": ids[a], "b": ids[b], "shift": pos[a].astype(np.int64) - pos[b], "part": part[a], "key": pd.array(key[a], "Int64"), "sure": False})
        out.append(rows if named else rows.assign(key=pd.NA).drop_duplicates(["a", "b", "shift"]).astype({"key": "Int64"}))
    linked = np.flatnonzero(joined != np.arange(len(names)))
    out.append(pd.DataFrame({"a": names[joined[linked]], "b": names[linked], "shift": 0, "part": part[:1].repeat(len(linked)), "key": pd.NA, "sure": True}).astype({"key": "Int64"}))
    return pd.concat(out)


def links(prints: DataFrame, crowd: int = CROWD, small: int = SMALL) -> DataFrame:
    """(a, b) links that connect the recordings of ``prints`` (id, ints) that align and share a key with similar surroundings.

    Recordings are united by pairs only that passed the comparison over their whole overlap. Where a pair that a crowded group proposed
    fails, the group is asked again for all its pairs between components, so that every pair of similar surroundings has
    passed, has failed, or lies inside a class. So the classes depend neither on ``small`` nor on ``crowd``.
    """
    spark = prints.sparkSession
    prints = prints.where("size(ints) > 0")
    rows = postings(prints)
    crowded = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    crowded = cut(crowded.select("key", "n", F.ceil(F.col("n") / crowd).cast("int").alias("chunks")))
    total = prints.agg(4 * F.sum(F.size("ints"))).first()[0] or 0
    total += crowded.agg(F.sum(F.col("n") * (F.col("chunks") - 1))).first()[0] or 0
    both = rows.join(crowded.drop("n"), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    # each pair of a crowded key's chunks is a group of its own, so that all its pairs meet
    both = both.withColumn("own", F.pmod(F.xxhash64("id", "pos"), F.col("chunks")).cast("int"))
    both = both.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    both = both.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    # several keys are handled in one call; a crowded one's chunks are apart
    parts = max(partitions(spark), -(-total // TASK_ROWS) * 4)
    part = F.pmod(F.xxhash64("key", "i", "j"), F.lit(parts)).alias("part")
    both = both.select(part, F.xxhash64("key", "i", "j").alias("key"), "id", "pos", "rest", "around")
    kind = "a long, b long, shift long, part long, key long, sure boolean"

    @F.pandas_udf("boolean")
    def aligned(a: pd.Series, b: pd.Series, shift: pd.Series) -> pd.Series:
        as_ints = lambda x: np.asarray(x, np.int32).view(np.uint32)
        return pd.Series([overlap_error(as_ints(x), as_ints(y), s) <= MAX_ERROR for x, y, s in zip(a, b, shift)], dtype=bool)

    def compared(pairs: DataFrame) -> DataFrame:
        """``pairs`` with whether they are within ``MAX_ERROR`` over their whole overlap."""
        whole = pairs.join(prints.select(F.col("id").alias("a"), F.col("ints").alias("first")), "a")
        whole = whole.join(prints.select(F.col("id").alias("b"), F.col("ints").alias("second")), "b")
        return cut(whole.select("a", "b", "shift", aligned("first", "second", "shift").alias("fine")))

    pairs = cut(both.groupBy("part").applyInPandas(lambda pdf: _candidates(pdf, small), kind))
    sure = pairs.where("sure").select("a", "b")
    if pairs.where("not sure").isEmpty():
        return sure.distinct()
    tested = compared(pairs.where("not sure").select("a", "b", "shift").distinct())
    passed = sure.unionByName(tested.where("fine").select("a", "b")).distinct()
    failed = tested.where("not fine").select("a", "b", "shift")
    # a pair that failed may have kept others of its group from being tried
    again = cut(pairs.where("key is not null").join(failed, ["a", "b", "shift"]).select("part", "key").distinct())
    if again.isEmpty():
        return passed
    components = connected_components(passed).select(F.col("node").alias("id"), "component")
    at = both.join(again, ["part", "key"]).join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    more = cut(at.groupBy("part").applyInPandas(lambda pdf: _candidates(pdf, small), kind))
    tested = compared(more.where("not sure").select("a", "b", "shift").distinct().join(failed, ["a", "b", "shift"], "left_anti"))
    found = more.where("sure").select("a", "b").unionByName(tested.where("fine").select("a", "b"))
    return passed.unionByName(found).distinct()


def classes(prints: DataFrame) -> DataFrame:
    """(id, ints, class_id, offset, bit_error): the class is its smallest id; the rest align the recording with that one.

    Copies are collapsed first: only one recording of equal integers is joined.
    """
    prints = cut(prints)
    same = prints.where("size(ints) > 0").groupBy("ints").agg(F.min("id").alias("rep"))
    same = cut(same)
    found = connected_components(links(same.select(F.col("rep").alias("id"), "ints")))
    of = same.join(found, same["rep"] == found["node"], "left").select("ints", F.coalesce("component", "rep").alias("class_id"))
    own = prints.join(of, "ints", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    first = same.select(F.col("rep").alias("class_id"), F.col("ints").alias("first"))

    @F.pandas_udf("offset int, bit_error double")
    def place(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        as_ints = lambda x: np.asarray([] if x is None else x, np.int32).view(np.uint32)
        return pd.DataFrame([align(as_ints(x), as_ints(y)) for x, y in zip(a, b)], columns=["offset", "bit_error"])

    return own.join(first, "class_id", "left").withColumn("at", place("first", "ints")).select("id", "ints", "class_id", "at.*")


def tones(vectors: np.ndarray) -> np.ndarray:
    """16-bit signals of vectors of a multiple of ``TONES`` numbers, a row each."""
    step = 2 * HOP
    steps = vectors.shape[1] // TONES
    n = np.arange(steps * step)
    loud = np.exp(4 * np.clip(vectors, -1, 1)).reshape(len(vectors), steps, TONES)
    out = np.zeros((len(vectors), len(n)), np.float32)
    which = np.arange(steps) * 7
    for k in range(TONES):
        pitch = (which + 5 * k) % PITCHES + 12 * (k % 2)
        wave = np.sin(2 * np.pi * (220 * 2 ** (np.repeat(pitch, step) / 12)) * n / RATE).astype(np.float32)
        out += np.repeat(loud[:, :, k], step, axis=1) * wave
    return np.clip(out * 800, -32767, 32767).astype("<i2")


def recordings(embeddings: DataFrame) -> DataFrame:
    """(id, audio) derived from ``embeddings`` (vec_id, embedding); rows without id are left out."""

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        out: list = [b""] * len(vectors)
        same: dict[int, list[int]] = {}
        for k, v in enumerate(vectors):
            if v is not None and len(v):
                same.setdefault(-(-len(v) // TONES) * TONES, []).append(k)
        for size, places in same.items():
            step = max(1, AT_ONCE // (size // TONES * 2 * HOP))
            for i in range(0, len(places), step):
                part = places[i : i + step]
                x = np.zeros((len(part), size))
                for row, k in zip(x, part):
                    row[: len(vectors[k])] = np.nan_to_num(np.asarray(vectors[k], float))
                for k, s in zip(part, tones(x)):
                    out[k] = s.tobytes()
        return pd.Series(out, dtype=object)

    return embeddings.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), run("embedding").alias("audio"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint, class and alignment of the recording of every embedding."""
    found = classes(fingerprints(recordings(read_table(spark, sf_dir, "embeddings"))))
    return found.select(
        F.col("id").alias("vec_id"), F.size("ints").alias("n_ints"), F.md5(F.concat_ws(",", "ints")).alias("fingerprint"),
        "class_id", "offset", "bit_error",
    )
