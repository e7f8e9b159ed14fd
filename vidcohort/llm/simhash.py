"""SimHash near-duplicates over a Gray-order hierarchical index.

1. ``fingerprints``: 64-bit majority fingerprints of the word shingles of each whole text.
2. ``links``: distinct fingerprints are dealt to blocks. A fingerprint is rotated three ways so that
   each third of its bits leads once; of two fingerprints with at most four differing bits, some
   third differs in at most one. In a rotation, a block holds one prefix of that leading third, that
   is a run of Gray ranks; fingerprints also visit the blocks whose prefix differs in one bit.
   Inside a block the members are sorted by Gray rank, shared bit patterns are factored into upper
   nodes (a mask of the bits on which all members agree), and a search carries the differences
   accumulated on the way down, pruning whole groups at the threshold. A node whose members are
   already in the query's component is pruned too, so dense groups emit a spanning set, not all pairs.
3. ``near_duplicates``: components over the links.

Nulls and texts without words have fingerprint zero and link like any other. Every row is in the result, so
rows that repeat a doc_id come back as often; with different texts they link what either links. Rows without
doc_id link others, but are never the smallest; a component without any doc_id has a null component_id.
Texts of any length are read whole, 4096 shingles at a time. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidcohort.llm.common import connected_components, cut, partitions, read_table

#: Bits of the three leading parts; with at most four differences one part has at most one.
PARTS = (21, 21, 22)
MAX_BITS = 4
#: Four times the usual number of members of a block.
BLOCK_ROWS = 8192
FANOUT = 8
#: Rows of blocks that a task searches.
TASK_ROWS = 50_000


def fingerprint(text: str | None, words: int = 4) -> int:
    """Majority fingerprint of one text; 0 if it has no word."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], 42) for i, j in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        bits = np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), run(F.col("text").cast("string")).alias("fp"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Sorted fingerprints with upper nodes of shared masked bit patterns."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        full = np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF))
        ones, zeros = self.codes, ~self.codes
        self.levels = [(self.codes, full, np.arange(len(codes) + 1))]  # leaves first
        while len(ones) > FANOUT:
            cuts = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            self.levels.append((ones, ones | zeros, np.append(cuts, len(self.levels[-1][0]))))

    def components(self, labels: np.ndarray) -> list[np.ndarray]:
        """By level: the component all members of a node are in, or -1."""
        low = high = labels[self.order]
        out = [low]
        for _, _, edges in self.levels[1:]:
            low, high = np.minimum.reduceat(low, edges[:-1]), np.maximum.reduceat(high, edges[:-1])
            out.append(np.where(low == high, low, -1))
        return out

    def search(self, queries: np.ndarray, most: int, own=None, nodes=None) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) positions within ``most`` bits; members of a query's own component are left out."""
        top = len(self.levels) - 1
        pattern, mask, _ = self.levels[top]
        q = np.repeat(np.arange(len(queries)), len(pattern))
        n = np.tile(np.arange(len(pattern)), len(queries))
        parent = np.zeros(len(q), np.uint64)
        acc = np.zeros(len(q), np.uint8)
        for level in range(top, -1, -1):
            pattern, mask, edges = self.levels[level]
            acc = acc + np.bitwise_count((queries[q] ^ pattern[n]) & (mask[n] & ~parent))
            keep = acc <= most
            if own is not None:
                keep &= nodes[level][n] != own[q]
            q, n, acc = q[keep], n[keep], acc[keep]
            if not level:
                break
            parent = mask[n]
            width = edges[n + 1] - edges[n]
            at = np.repeat(edges[n] - np.cumsum(width) + width, width) + np.arange(width.sum())
            q, acc, parent, n = np.repeat(q, width), np.repeat(acc, width), np.repeat(parent, width), at
        return q, self.order[n]


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest position of each component) after linking positions a and b."""
    parent = np.arange(len(labels))
    x, y = labels[a], labels[b]
    while len(x):
        x, y = parent[x], parent[y]
        differ = x != y
        x, y = x[differ], y[differ]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    return parent[labels]


def _link_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["fp", "home"], ascending=[True, False])
    codes, fp = rows["code"].to_numpy().view(np.uint64), rows["fp"].to_numpy()
    home = np.flatnonzero(rows["home"].to_numpy())
    labels = np.arange(len(rows))
    if len(home) and len(rows) > 1:
        index = GrayIndex(codes[home])
        for i in range(0, len(rows), 512):
            q = np.arange(i, min(i + 512, len(rows)))
            hit, member = index.search(codes[q], MAX_BITS, labels[q], index.components(labels[home]))
            labels = unite(labels, q[hit], home[member])
    linked = labels != np.arange(len(rows))
    return pd.DataFrame({"a": fp[linked], "b": fp[labels[linked]]})


def links(distinct: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) pairs that connect all fingerprints within ``MAX_BITS`` bits.

    ``distinct`` has fp, one row a fingerprint. The blocks hold about a
    quarter of ``block_rows`` each, visitors not counted; one with over eight times ``block_rows`` is
    dealt in chunks by hash and each pair of chunks is one group, so that no group is unbounded.
    """
    n = distinct.count()
    bits = min(min(PARTS), max(0, math.ceil(math.log2(max(n, 1) * 4 / block_rows))))
    moves = []
    for r, before in enumerate((0, PARTS[0], PARTS[0] + PARTS[1])):
        code = F.expr(f"shiftleft(fp, {before}) | shiftrightunsigned(fp, {64 - before})") if before else F.col("fp")
        moves.append(F.struct(F.lit(r).alias("r"), code.alias("code")))
    rows = distinct.select("fp", F.explode(F.array(*moves)).alias("m")).select("fp", "m.r", "m.code")
    if bits:
        rows = rows.withColumn("at", F.expr(f"shiftrightunsigned(code, {64 - bits})"))
        near = f"filter(transform(sequence(0, {bits - 1}), j -> at ^ shiftleft(1L, j)), b -> b > at)"
        rows = rows.withColumn("block", F.explode(F.expr(f"concat(array(at), {near})")))
    else:
        rows = rows.withColumn("at", F.lit(0).cast("long")).withColumn("block", F.col("at"))
    rows = rows.select("r", "block", "fp", "code", (F.col("block") == F.col("at")).alias("home"))
    most = 8 * block_rows  # a usual block has up to (1 + bits / 2) * block_rows / 4, visitors included
    crowded = rows.groupBy("r", "block").agg(F.count("*").alias("n")).where(F.col("n") > most)
    crowded = crowded.withColumn("chunks", F.ceil(F.col("n") / (most // 2)).cast("int"))
    rows = rows.join(crowded.drop("n"), ["r", "block"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    # tasks by rows: groups are small in bytes, but each row is a search
    tasks = max(partitions(distinct.sparkSession), 3 * n * (2 + bits) // 2 // TASK_ROWS)
    return (
        rows.repartition(tasks, "r", "block", "i", "j").groupBy("r", "block", "i", "j")
        .applyInPandas(lambda pdf: _link_block(pdf), "a long, b long")
        .where("a <> b")
    )


def near_duplicates(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text)."""
    prints = cut(fingerprints(docs, words))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = connected_components(links(distinct))
    of = distinct.join(found, distinct["fp"] == found["node"], "left").withColumn("component", F.coalesce("component", "fp"))
    of = cut(of.select("fp", "low", "component"))
    # plain tables on the small sides let the skew join split a large component or a frequent fingerprint
    lows = cut(of.groupBy("component").agg(F.min("low").alias("component_id")))
    classes = cut(of.join(lows, "component").select("fp", "component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component; columns are kept."""
    gone = near_duplicates(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
