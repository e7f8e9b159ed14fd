"""Evidence of several acquisition methods: one schema, best method, completeness, failures, reuse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS = ["frames", "thumbnails", "captions", "metadata"]
SCHEMA_VERSION = 1


def unified(tables: list[DataFrame]) -> DataFrame:
    """Rows of all methods under one schema; what a method does not give is null."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return rows.withColumn("schema_version", F.lit(SCHEMA_VERSION))


def completeness(rows: DataFrame) -> DataFrame:
    """Adds the share of evidence parts that are there."""
    there = [F.when(F.col(p).isNotNull(), 1).otherwise(0) if p in rows.columns else F.lit(0) for p in PARTS]
    return rows.withColumn("completeness", reduce(lambda a, b: a + b, there) / float(len(PARTS)))


def best_method(rows: DataFrame, priority: list[str]) -> DataFrame:
    """One row a video: of the methods that did not fail the first by priority; unknown methods come last, the more complete row first."""
    ranks = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col("method")), F.lit(0)), F.lit(len(priority) + 1))
    order = Window.partitionBy("video_id").orderBy(ranks, "method", *([F.desc("completeness")] if "completeness" in rows.columns else []))
    return rows.where(F.coalesce("status", F.lit("")) != "failed").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def failure_rates(rows: DataFrame) -> DataFrame:
    """(method, platform, attempts, failure_rate), with totals over each and both as nulls."""
    failed = F.when(F.col("status") == "failed", 1.0).otherwise(0.0)
    return rows.cube("method", "platform").agg(F.count("*").alias("attempts"), F.avg(failed).alias("failure_rate"))


def missing(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests (video_id, intro_seconds) for which nothing is stored yet."""
    return requests.join(stored.select("video_id", "intro_seconds"), ["video_id", "intro_seconds"], "left_anti")
