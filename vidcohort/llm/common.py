"""Helpers shared by the training-data operators: tables, lineage cuts, components."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidcohort.sources.stored import cut, drop_cut, shared_dir

__all__ = ["connected_components", "cut", "drop_cut", "fold_remainder", "give_back", "partitions", "read_table", "shared_dir", "tidy"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the machine: Python workers outlive their tasks and would hold it while others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """A function over batches that gives memory back when the last batch is done."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def fold_remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): component is the smallest id reachable; nodes without an edge are absent.

    ``edges`` has long columns ``a`` and ``b``. Alternates large-star and small-star steps: each is
    one minimum per node and one join, so a hub is never gathered in one task, and the number of
    edges never grows. The minima are written first: a plain table on that side lets the skew join split
    a hub's edges. Stops when a round changes nothing.
    """
    def minima(e: DataFrame) -> DataFrame:
        return cut(e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))

    now = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    seen = None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        tops = minima(both)
        large = cut(both.join(tops, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lows = minima(small)
        new = cut(
            small.join(lows, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(lows.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .where("a <> b").distinct()
        )
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in (now, tops, large, lows):
            drop_cut(old)
        now = new
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
