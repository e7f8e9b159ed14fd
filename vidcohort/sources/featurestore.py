"""A store of keyed rows: bucketed generations, idempotent upserts, lookups that leave the stored side where it is.

A generation is one folder of Parquet files, bucketed and sorted by the key. An upsert writes what it brings as one generation
more, and is known by its run: the same run again changes nothing. Generations are merged by size tiers: as soon as
``FANOUT`` of one tier stand together they become one of the next, so that a row is rewritten once a tier and the number of
generations grows with the logarithm of the rows. ``missing`` joins the asked keys to each generation by their common buckets:
the asked side is dealt once, the stored files are read in place. Later generations win over earlier ones. What is valid is
told by a manifest (``published``).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidcohort.sources import published

FANOUT = 4


class FeatureStore:
    """Rows under ``path``, one for each value of ``keys``; ``buckets`` is fixed when the store is made."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.buckets = self.manifest().get("buckets", buckets)

    def manifest(self) -> dict:
        return published.latest(self.spark, self.path)[1]

    def generations(self) -> list[dict]:
        """Folder, run, tier and rows of each generation, the oldest first."""
        return self.manifest().get("folders", [])

    def _write(self, rows: DataFrame, folder: str) -> int:
        """``rows`` bucketed by the key as ``folder``; how many there are."""
        name = f"store_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, *self.keys)  # a file a bucket
        dealt.write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.path}/{folder}").saveAsTable(name)
        n = self.spark.table(name).count()
        self.spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
        return n

    def _open(self, generation: dict) -> DataFrame:
        """A generation as a bucketed table, for this session."""
        name = f"store_{generation['folder'].replace('-', '_')}"
        if not self.spark.catalog.tableExists(name):
            where = f"{self.path}/{generation['folder']}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(where).schema)
            by = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return self.spark.table(name)

    def _latest(self, rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(*self.keys).orderBy(F.desc("_generation"))
        return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")

    def upsert(self, rows: DataFrame, run: str) -> bool:
        """Add or replace rows; of several with one key, the one that is greatest as a whole counts. False if the run is there already."""
        number, content = published.latest(self.spark, self.path)
        if run in content.get("runs", []):
            return False
        rest = [c for c in rows.columns if c not in self.keys]
        one = rows.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*self.keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest]) if rest else rows.distinct()
        folder = f"g{number + 1:012d}-{uuid.uuid4().hex[:8]}"
        added = {"folder": folder, "tier": 0, "rows": self._write(one, folder)}
        folders = self._merged([*content.get("folders", []), added], number)
        published.publish(self.spark, self.path, number, {"buckets": self.buckets, "folders": folders, "runs": [*content.get("runs", []), run]})
        return True

    def _merged(self, folders: list[dict], number: int) -> list[dict]:
        """The same generations after the merges that are due: the last ``FANOUT`` of one tier become one of the next."""
        while len(folders) >= FANOUT and len({f["tier"] for f in folders[-FANOUT:]}) == 1:
            last = folders[-FANOUT:]
            tier = last[0]["tier"] + 1
            folder = f"g{number + 1:012d}-{uuid.uuid4().hex[:8]}"
            folders = [*folders[:-FANOUT], {"folder": folder, "tier": tier, "rows": self._write(self._union(last), folder)}]
        return folders

    def _union(self, folders: list[dict]) -> DataFrame:
        """The valid rows of some generations."""
        if len(folders) == 1:
            return self._open(folders[0])
        rows = [self._open(f).withColumn("_generation", F.lit(i)) for i, f in enumerate(folders)]
        return self._latest(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)).drop("_generation")

    def read(self) -> DataFrame:
        """All valid rows."""
        folders = self.generations()
        if not folders:
            raise ValueError(f"{self.path} holds nothing yet")
        return self._union(folders)

    def missing(self, asked: DataFrame) -> DataFrame:
        """The rows of ``asked`` whose keys are in no generation; the asked side alone is dealt, to the buckets."""
        for f in self.generations():
            asked = asked.join(self._open(f).select(*self.keys).hint("merge"), self.keys, "left_anti")
        return asked

    def known(self, asked: DataFrame) -> DataFrame:
        """``asked`` with the stored columns of its keys, from the latest generation that has them; rows without any are left out."""
        found, left = [], asked
        for f in reversed(self.generations()):
            stored = self._open(f).hint("merge")
            found.append(left.join(stored, self.keys))
            left = left.join(stored.select(*self.keys), self.keys, "left_anti")
        if not found:
            raise ValueError(f"{self.path} holds nothing yet")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
