"""Exact substring deduplication with a sampled suffix array.

Every byte that is covered by a ``SIZE``-byte string which also starts earlier (smaller doc_id, or same
document and earlier start) is removed; strings never cross documents and are judged on the input.

Sorting every suffix would shuffle the text many times over, so the suffixes are sampled by content:
each window of ``SIZE`` bytes picks the start of its ``GRAM``-byte string with the smallest hash
(leftmost if equal). Equal windows pick the same place, so comparing the picked suffixes, and then the
windows that picked them, loses nothing. A suffix stands for a segment: the run of windows that picked it.

1. A suffix travels with its first ``GRAM`` bytes as tokens of eight. Splitters sampled from the leading
   tokens range-partition all suffixes; a task first drops segments that it has seen itself, so a
   passage in a third of all documents is sent once a task. A token that takes up several splitters is
   dealt over their buckets.
2. A bucket sorts by multikey quicksort into byte order: by the leading token, then, among ties only, by
   the next. Neighbours decide: those whose bytes are equal and whose whole segments are (by a hash of
   64 bits) keep the earliest; the rest are removed whole. Neighbours whose bytes are equal but whose
   segments differ, and suffixes of a token that lies on both sides of a boundary between buckets, are
   compared in full:
3. their segments are fetched from the text, dealt by suffix, and every window is compared byte by
   byte with the earliest that has its hash. Crowded suffixes are split by window offset, as windows
   at different offsets from their suffix never match, and by the bytes that all windows of the same
   offsets cover; a task sends equal pieces once.

The numbers of buckets and groups follow the bytes of the input.

Null texts are empty. Texts under ``SIZE`` bytes lose nothing. Rows without doc_id are neither compared
nor changed. Rows that repeat a doc_id hold the same places of the same document, so neither is earlier;
what is removed from one is removed from the other.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidcohort.llm.common import cut, drop_cut, give_back, partitions, read_table, tidy

SIZE, GRAM = 100, 32
SPAN = SIZE - GRAM + 1  # places a window can pick
TOKENS = tuple(f"t{i}" for i in range(GRAM // 8))
PIECE = 1 << 19
#: Segments a task holds before it sends them on.
HELD = 1 << 17
#: Different segments of a suffix beyond which it is split by window offset and content, and offsets a part has.
CROWD, OFFSETS = 5_000, 3
#: Bytes of text for each bucket of suffixes, and of segments for each group that is compared.
BUCKET_BYTES, GROUP_BYTES = 8 << 20, 2 << 20
SAMPLE_DOCS = 1_500
#: Ranges of suffixes at most, so that their boundaries stay small whatever the corpus.
RANGES = 1 << 16
RECORD = (*((t, "<u8") for t in TOKENS), ("seg", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("wins", "u1"), ("rel", "u1"))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def rolling(raw: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` bytes, by doubling."""
    base = 0x9E3779B97F4A7C15
    power = {1: raw.astype(np.uint64) + np.uint64(1)}
    done, out = 0, None
    w = 1
    while True:
        if width & w:
            part = power[w]
            if out is None:
                out = part
            else:
                n = len(raw) - done - w + 1
                out = out[:n] * np.uint64(pow(base, w, 1 << 64)) + part[done : done + n]
            done += w
        if done == width:
            return mix(out)
        h = power.pop(w)
        power[2 * w] = h[:-w] * np.uint64(pow(base, w, 1 << 64)) + h[w:] if len(h) > w else h[:0]
        w *= 2


def segments(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Suffixes picked in some pieces of text that stand one after the other in ``data``.

    ``at`` is the first window of the segment, ``wins`` how many there are, ``rel`` where the suffix starts.
    """
    raw = np.frombuffer(data, np.uint8)
    grams = rolling(raw, GRAM)
    low, reach = grams, 1
    while reach * 2 <= SPAN:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(low) - (SPAN - reach)], low[SPAN - reach :])
    change = np.zeros(len(low), bool)
    change[1:] = (low[1:] < low[:-1]) | (grams[: len(low) - 1] == low[:-1])
    valid = np.zeros(len(low), bool)
    for s, n in zip(starts.tolist(), lengths.tolist()):
        valid[s : s + n - SIZE + 1] = True
    change[starts] = True
    at = np.flatnonzero(change & valid)
    picked = at + (np.lib.stride_tricks.sliding_window_view(grams, SPAN)[at] == low[at, None]).argmax(axis=1)
    piece = np.searchsorted(starts, at, side="right") - 1
    last = starts[piece] + lengths[piece] - SIZE + 1
    wins = np.minimum(np.append(at[1:], len(low) + SIZE), last) - at
    eight = np.ndarray(len(raw) - 7, ">u8", raw, strides=(1,))
    tokens = {t: eight[picked + 8 * i].astype(np.uint64) for i, t in enumerate(TOKENS)}
    digest = xxhash.xxh3_64_intdigest
    seg = np.array([digest(data[i:j]) for i, j in zip(at.tolist(), (at + wins + SIZE - 1).tolist())], np.uint64)
    return tokens | {"seg": seg, "piece": piece, "at": at, "wins": wins, "rel": picked - at}


def scan(batches):
    """Segments of the texts of some batches (doc_id, text), piece by piece; at is an offset in the document."""
    docs, froms, parts, size = [], [], [], 0

    def done():
        lengths = np.array([len(p) for p in parts])
        starts = np.append(0, np.cumsum(lengths)[:-1])
        out = segments(b"".join(parts), starts, lengths)
        piece = out.pop("piece")
        out["doc"] = np.array(docs, np.int64)[piece]
        out["at"] = out["at"] - starts[piece] + np.array(froms)[piece]
        return out

    for b in batches:
        for doc, text in zip(b["doc_id"], b["text"]):
            data = (text or "").encode("utf-8", "surrogatepass")
            for i in range(0, len(data) - SIZE + 1, PIECE):
                docs.append(doc)
                froms.append(i)
                parts.append(data[i : i + PIECE + SIZE - 1])
                size += len(parts[-1])
                if size >= PIECE:
                    yield done()
                    docs, froms, parts, size = [], [], [], 0
    if parts:
        yield done()


def multikey_order(*tokens: np.ndarray) -> np.ndarray:
    """Order by the first token; by each next one only where all before are equal."""
    order = np.argsort(tokens[0], kind="stable")
    tied = np.zeros(len(order), np.int64)
    key = tokens[0][order]
    tied[1:] = np.cumsum(key[1:] != key[:-1])
    for token in tokens[1:]:
        run = np.bincount(tied, minlength=1)
        open_ = np.flatnonzero(run[tied] > 1) if len(order) else np.zeros(0, np.int64)
        if not len(open_):
            break
        inner = np.lexsort((token[order[open_]], tied[open_]))
        order[open_] = order[open_[inner]]
        key = token[order]
        step = np.zeros(len(order), bool)
        step[1:] = (tied[1:] != tied[:-1]) | (key[1:] != key[:-1])
        tied = np.cumsum(step)
    return order


def runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each row is in."""
    step = np.zeros(len(keys[0]), bool)
    for k in keys:
        step[1:] |= k[1:] != k[:-1]
    return np.cumsum(step)


def in_order(c: dict[str, np.ndarray]) -> None:
    """Put the rows in byte order of the suffixes; equal ones by segment and place."""
    order = multikey_order(*(c[t] for t in TOKENS), c["seg"], c["doc"], c["at"])
    for k in c:
        c[k] = c[k][order]


def dealing(c: dict[str, np.ndarray]) -> np.ndarray:
    """A hash of the suffix's first bytes, by which work is dealt."""
    out = np.zeros(len(c["seg"]), np.uint64)
    for t in TOKENS:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + c[t])
    return out


def later(c: dict[str, np.ndarray]) -> np.ndarray:
    """Which rows have an equal segment at an earlier place; the rows are put in order first."""
    in_order(c)
    if not len(c["seg"]):
        return np.zeros(0, bool)
    run = runs(*(c[t] for t in TOKENS), c["seg"])
    first = np.searchsorted(run, run)
    return (c["doc"] > c["doc"][first]) | (c["at"] > c["at"][first])


def spans_blob(c: dict[str, np.ndarray], rows: np.ndarray) -> bytes:
    at = c["at"][rows]
    return np.stack([c["doc"][rows], at, at + c["wins"][rows] + SIZE - 1]).astype("<i8").tobytes()


def pack(c: dict[str, np.ndarray], rows: np.ndarray) -> bytes:
    return struct.pack("<q", len(rows)) + b"".join(c[k][rows].astype(t).tobytes() for k, t in RECORD)


def unpack(blobs) -> dict[str, np.ndarray]:
    out = {k: [] for k, _ in RECORD}
    for b in blobs:
        n, at = struct.unpack_from("<q", b)[0], 8
        for k, t in RECORD:
            out[k].append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
    return {k: np.concatenate([*v, np.zeros(0, t)]) for (k, t), v in zip(RECORD, out.values())}


def splitters(docs: DataFrame, ranges: int, total: int) -> np.ndarray:
    """Boundaries between ranges from the leading tokens of about ``SAMPLE_DOCS`` of the documents, and more for many ranges (``RANGES`` at most)."""
    wanted = max(SAMPLE_DOCS, ranges)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("splitters")), F.lit(1 << 30)) / float(1 << 30)

    def run(batches):
        for c in scan(batches):
            some = c["seg"] % np.uint64(4) == 0
            yield pd.DataFrame({"lead": c[TOKENS[0]][some].view(np.int64)})

    leads = docs.where(draw < wanted / max(1, total)).mapInPandas(tidy(run), "lead long").toPandas()["lead"]
    leads = np.sort(leads.to_numpy(np.int64).view(np.uint64))
    return leads[np.arange(1, ranges) * len(leads) // ranges] if len(leads) else leads


def bucket_of(c: dict[str, np.ndarray], bounds: np.ndarray, subs: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each suffix, one of ``subs`` of its range, and whether its equals lie in several buckets."""
    lead = c[TOKENS[0]]
    low, high = np.searchsorted(bounds, lead, "left"), np.searchsorted(bounds, lead, "right")
    wide = high - low >= 2
    deal = np.where(wide, c["seg"], dealing(c))
    at = low + (deal % (high - low + 1).astype(np.uint64)).astype(np.int64)
    return at * subs + ((deal >> np.uint64(32)) % np.uint64(subs)).astype(np.int64), wide


def sort_suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop, suffix, crowd): removed spans (suffix null) and segments to compare in full."""
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES))
    ranges = min(buckets, RANGES)
    subs = -(-buckets // ranges)  # beyond so many ranges, each is dealt by what its suffixes begin with
    buckets = ranges * subs
    bounds = splitters(docs, ranges, total)  # fewer than ``RANGES`` numbers

    def send(batches):
        held, count = [], 0

        def flush():
            c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            gone = later(c)
            kept = np.flatnonzero(~gone)
            kept = kept[np.lexsort((c["at"][kept], c["doc"][kept]))]  # packs better
            to = bucket_of({k: c[k][kept] for k in (*TOKENS, "seg")}, bounds, subs)[0]
            order = np.argsort(to, kind="stable")
            edges = np.flatnonzero(np.diff(to[order], prepend=-1))
            rows = [(int(to[part[0]]), pack(c, kept[part]), None) for part in np.split(order, edges[1:]) if len(part)]
            if gone.any():
                rows.append((int(c["doc"][0] % buckets), None, spans_blob(c, np.flatnonzero(gone))))
            return pd.DataFrame(rows, columns=["bucket", "suffixes", "spans"])

        for c in scan(batches):
            held.append(c)
            count += len(c["at"])
            if count >= HELD:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        c = unpack(b for b in pdf["suffixes"] if b is not None)
        spans = [np.frombuffer(b, "<i8").reshape(3, -1) for b in pdf["spans"] if b is not None]
        gone = later(c)
        rows = np.flatnonzero(gone)
        spans.append(np.frombuffer(spans_blob(c, rows), "<i8").reshape(3, -1))
        spans = np.concatenate(spans, axis=1)
        out = pd.DataFrame({"doc_id": spans[0], "start": spans[1], "stop": spans[2]})
        out = out.assign(suffix=pd.NA, rel=0, crowd=0)
        left = {k: v[~gone] for k, v in c.items()}
        if len(left["at"]):
            wide = bucket_of(left, bounds, subs)[1]
            run = runs(*(left[t] for t in TOKENS))
            size = np.bincount(run)[run]
            size = np.where(wide, CROWD + 1, size)
            open_ = size > 1
            more = pd.DataFrame({
                "doc_id": left["doc"][open_], "start": left["at"][open_], "stop": (left["at"] + left["wins"] + np.int64(SIZE - 1))[open_],
                "suffix": dealing(left)[open_].view(np.int64), "rel": left["rel"][open_].astype(np.int64), "crowd": size[open_],
            })
            out = pd.concat([out.astype({"suffix": "Int64"}), more.astype({"suffix": "Int64"})])
        return out

    sent = docs.mapInPandas(tidy(send), "bucket int, suffixes binary, spans binary")
    return sent.groupBy("bucket").applyInPandas(settle, "doc_id long, start long, stop long, suffix long, rel long, crowd long")


def compare_windows(content: list[bytes], doc: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Spans of the windows in some segments that equal a window at an earlier place."""
    order = np.lexsort((start, doc))
    content, doc, start = [content[i] for i in order], doc[order], start[order]
    raw = np.frombuffer(b"".join(content) + bytes(8), np.uint8)
    lengths = np.array([len(x) for x in content])
    base = np.cumsum(lengths) - lengths
    wins = lengths - SIZE + 1
    row = np.repeat(np.arange(len(content)), wins)
    at = np.arange(len(row)) - np.repeat(np.cumsum(wins) - wins, wins)
    pos = base[row] + at
    hashes = rolling(raw, SIZE)[pos]
    words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    steps = [*range(0, SIZE - 7, 8), SIZE - 8]
    gone = np.zeros(len(pos), bool)
    left = np.argsort(hashes, kind="stable")
    while len(left):
        run = runs(hashes[left])
        first = left[np.searchsorted(run, run)]
        same = np.ones(len(left), bool)
        for s in steps:
            same &= words[pos[left] + s] == words[pos[first] + s]
        place = (doc[row[left]] > doc[row[first]]) | (start[row[left]] + at[left] > start[row[first]] + at[first])
        gone[left[same & place]] = True
        left = left[~same]  # another text with the same hash: compare among themselves
    hit = np.flatnonzero(gone)
    if not len(hit):
        return pd.DataFrame({"doc_id": [], "start": [], "stop": []}).astype("int64")
    head = np.flatnonzero((np.diff(hit, prepend=-2) != 1) | (np.diff(row[hit], prepend=-1) != 0))
    tail = np.append(head[1:], len(hit)) - 1
    r = row[hit[head]]
    return pd.DataFrame({"doc_id": doc[r], "start": start[r] + at[hit[head]], "stop": start[r] + at[hit[tail]] + SIZE})


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): start and stop of what is removed, in bytes, for the documents that lose some; spans may overlap."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut(sort_suffixes(docs.where("doc_id is not null")))
    open_ = found.where("suffix is not null").groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "suffix", "rel", "crowd")).alias("open"))
    size = found.where("suffix is not null").agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()[0]
    groups = max(partitions(docs.sparkSession), -(-size // GROUP_BYTES))

    def fetch(batches):
        """The segments to compare, by group; a crowded suffix's are cut by offset and dealt by what all windows of these
        offsets have in common. Equal pieces of a batch are one, the rest goes as removed spans."""
        for b in batches:
            rows, crowded = [], {}
            for doc, text, open_ in zip(b["doc_id"], b["text"], b["open"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                for x in open_:
                    start, stop, rel = x["start"], x["stop"], x["rel"]
                    wins = stop - start - SIZE + 1
                    if x["crowd"] <= CROWD:
                        rows.append((x["suffix"] % groups, doc, start, data[start:stop], None))
                        continue
                    at = 0
                    while at < wins:  # offset of window ``at`` from the suffix is rel - at
                        part = (rel - at) // OFFSETS
                        end = min(wins, rel - part * OFFSETS + 1)
                        common = start + rel - part * OFFSETS  # windows of these offsets all cover the bytes from here
                        deal = xxhash.xxh3_64_intdigest(data[common : common + SIZE - OFFSETS + 1], part)
                        crowded.setdefault((deal, data[start + at : start + end + SIZE - 1]), []).append((doc, start + at))
                        at = end
            for (deal, content), places in crowded.items():
                first = min(places)
                rows.append((deal % groups, *first, content, None))
                rows += [(deal % groups, *p, None, p[1] + len(content)) for p in places if p != first]
            yield pd.DataFrame(rows, columns=["part", "doc_id", "start", "content", "stop"]).astype({"stop": "Int64"})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sent = pdf["stop"].isna()
        rest = pdf[sent]
        out = compare_windows(list(rest["content"]), rest["doc_id"].to_numpy(), rest["start"].to_numpy()) if len(rest) else None
        give_back()
        return pd.concat([out, pdf.loc[~sent, ["doc_id", "start", "stop"]].astype("int64")])

    texts = docs.join(open_, "doc_id").mapInPandas(tidy(fetch), "part long, doc_id long, start long, content binary, stop long")
    compared = texts.groupBy("part").applyInPandas(compare, "doc_id long, start long, stop long")
    both = found.where("suffix is null").select("doc_id", "start", "stop").unionByName(compared)
    return both.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((x["start"], x["stop"]) for x in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def kept_bytes(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for start, stop in gone:
        parts.append(data[at:start])
        at = stop
    return b"".join([*parts, data[at:]])


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row with the spans to remove, null if there are none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.join(removed_spans(docs), "doc_id", "left")


def op3_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def run(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, spans):
            data = (text or "").encode("utf-8", "surrogatepass")
            gone = [] if own is None else merged(own)
            kept = kept_bytes(data, gone)
            rows.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(read_table(spark, sf_dir, "documents")).select("doc_id", run("text", "spans").alias("x")).select("doc_id", "x.*")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes taken out of text, and n_chars, if there is one, counted anew.

    A character of which a byte goes is dropped whole.
    """
    name = next(c for c in map("spans{}".format, range(len(docs.columns) + 1)) if c not in docs.columns)
    spans = removed_spans(docs).select(F.col("doc_id").alias(f"{name}_id"), F.col("spans").alias(name))

    @F.pandas_udf("string")
    def keep(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(texts, spans):
            if text is not None and gone is not None:
                text = kept_bytes(text.encode("utf-8", "surrogatepass"), merged(gone)).decode("utf-8", "ignore")
            out.append(text)
        return pd.Series(out, dtype=object)

    both = docs.join(spans, docs["doc_id"] == spans[f"{name}_id"], "left").withColumn("text", keep("text", name))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.select(*docs.columns)
