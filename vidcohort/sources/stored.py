"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only if that is unset and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; ``codec`` is for large tables that pack well.

    Later stages then start from files that outlive any executor, and not from a long lineage.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a table made by ``cut`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cut-" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def gathered(key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """(key, a struct for each table): the rows of all tables that have the same key as one row; null where a table has none.

    Each table has a key once. All of them are dealt and sorted once, together: tables that are small as files, but not as rows, are
    never broadcast, and a task sorts one table and not as many as there are joins.
    """
    kinds = {n: df.drop(key).schema for n, df in tables.items()}
    named = lambda n: F.struct(*[F.col(c) for c in kinds[n].names]).alias(n)
    nothing = lambda n: F.lit(None).cast(kinds[n]).alias(n)
    parts = [df.select(key, *[named(n) if n == name else nothing(n) for n in tables]) for name, df in tables.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, key).groupBy(key).agg(*[F.first(n, ignorenulls=True).alias(n) for n in tables])
