"""Incremental ingest: landed responses as a stream into a table of versions, and its latest rows.

Nothing in the batch operators is specific to streams; this only feeds them as files land. A micro-batch writes what it
brought as one partition of the table and reads nothing of it, so its cost follows the batch and not the table; a batch
that is run again replaces its own partition. Repeats are settled when the table is read: the latest version of a video counts.

``compact`` takes finished micro-batches together into runs, which hold one row a video, sorted by bucket of its id. Runs
are merged by size tiers: ``FANOUT`` neighbours of one tier become one of the next. So a row is rewritten once a tier, the
number of runs grows with the logarithm of what came in, and reading follows the rows that live. A manifest tells which runs
count and up to which micro-batch; readers add only the later batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidcohort.sources import ingest, published

FANOUT, BUCKETS = 4, 16


def stream_videos(spark: SparkSession, landed: str, table: str, checkpoint: str):
    """Start (available data, then stop) a write of landed videos into ``table``, a partition a micro-batch."""
    rows = ingest.videos(ingest.read_landed(spark, landed, ingest.VIDEO_ITEMS, streaming=True))

    def add(batch: DataFrame, number: int) -> None:
        batch.where(F.col("video_id").isNotNull()).write.mode("overwrite").parquet(f"{table}/batch={number:09d}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, table: str, after: int) -> list[str]:
    """Folders of the finished micro-batches behind number ``after``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/batch=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    names = sorted(s.getPath().getParent().getName() for s in found or [])
    return [f"{table}/{n}" for n in names if int(n.split("=")[1]) > after]


def _latest(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("video_id").orderBy(F.desc("batch"), F.desc("views"), "title")
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def _rows(spark: SparkSession, table: str, folders: list[str], batches: list[str]) -> DataFrame:
    """The rows of runs and micro-batches with their batch; no settling yet."""
    parts = []
    if folders:
        parts.append(spark.read.parquet(*[f"{table}/{f}" for f in folders]))
    if batches:
        parts.append(spark.read.option("basePath", table).parquet(*batches).withColumn("batch", F.col("batch").cast("long")))
    if not parts:
        raise ValueError(f"{table} holds nothing yet")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def compact(spark: SparkSession, table: str, most: int = 64) -> int:
    """Take the micro-batches since the last time into one run and merge the runs that are due; how many runs there are.

    At most ``most`` batches at a time; call again for the rest. The batches' own folders can be removed as soon as no reader of the
    manifest before is left (``forget``).
    """
    while True:
        number, content = published.latest(spark, table)
        runs, upto = content.get("folders", []), content.get("upto", -1)
        batches = _batches(spark, table, upto)[:most]
        if not batches:
            return len(runs)
        last = int(batches[-1].rsplit("=", 1)[1])
        runs = [*runs, {"folder": _write(spark, table, _rows(spark, table, [], batches)), "tier": 0}]
        while len(runs) >= FANOUT and len({r["tier"] for r in runs[-FANOUT:]}) == 1:
            merged = _write(spark, table, _rows(spark, table, [r["folder"] for r in runs[-FANOUT:]], []))
            runs = [*runs[:-FANOUT], {"folder": merged, "tier": runs[-1]["tier"] + 1}]
        published.publish(spark, table, number, {"folders": runs, "upto": last})


def _write(spark: SparkSession, table: str, rows: DataFrame) -> str:
    """The latest rows as a run; its folder."""
    folder = f"run-{uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64("video_id"), F.lit(BUCKETS))
    _latest(rows).repartition(BUCKETS, bucket).sortWithinPartitions("video_id").write.parquet(f"{table}/{folder}")
    return folder


def forget(spark: SparkSession, table: str) -> list[str]:
    """Delete runs that no kept manifest names and micro-batches that the last manifest has taken in."""
    _, content = published.latest(spark, table)
    gone = published.sweep(spark, table, 1, spared="batch=")
    where = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(where):
        name = s.getPath().getName()
        if name.startswith("batch=") and int(name.split("=")[1]) <= content.get("upto", -1):
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)


def latest_videos(spark: SparkSession, table: str) -> DataFrame:
    """One row a video, of the latest micro-batch that brought it; of several in one batch that with most views."""
    _, content = published.latest(spark, table)
    folders = [r["folder"] for r in content.get("folders", [])]
    return _latest(_rows(spark, table, folders, _batches(spark, table, content.get("upto", -1)))).drop("batch")
