"""Published tables: feature store, report sink and versions, with writers that die and run again."""

import pytest
from pyspark.sql import functions as F

from vidcohort.plans import report
from vidcohort.sources import published
from vidcohort.sources.featurestore import FANOUT, FeatureStore
from vidcohort.streaming import incremental


def rows(spark, items):
    return spark.createDataFrame(items, "video_id string, intro_seconds int, n long")


def test_store_upserts_and_merges(spark, tmp_path):
    path, model = str(tmp_path / "store"), {}
    for i in range(2 * FANOUT + 1):
        new = [(f"v{k}", 8, 100 * i + k) for k in range(i, i + 4)] + [(f"v{i}", 8, 100 * i - 1)]
        store = FeatureStore(spark, path, ["video_id", "intro_seconds"], 4)  # every run opens it anew
        assert store.upsert(rows(spark, new), f"run{i}") and not store.upsert(rows(spark, [("v0", 8, -1)]), f"run{i}")
        model |= {(v, s): n for v, s, n in sorted(new, key=lambda x: x[2])}
    assert {(r.video_id, r.intro_seconds): r.n for r in store.read().collect()} == model
    assert [g["tier"] for g in store.generations()] == [1, 1, 0]
    asked = spark.createDataFrame([("v1", 8, "x"), ("v1", 15, "y"), ("none", 8, "z")], "video_id string, intro_seconds int, by string")
    assert {(r.video_id, r.intro_seconds, r.by) for r in store.missing(asked).collect()} == {("v1", 15, "y"), ("none", 8, "z")}
    assert [(r.video_id, r.by, r.n) for r in store.known(asked).collect()] == [("v1", "x", model["v1", 8])]
    assert published.sweep(spark, path, 1) and {(r.video_id, r.intro_seconds): r.n for r in store.read().collect()} == model


def test_stored_side_is_not_dealt(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "store"), ["video_id", "intro_seconds"], 4)
    store.upsert(rows(spark, [(f"v{i}", 8, i) for i in range(50)]), "a")
    store.upsert(rows(spark, [(f"v{i}", 8, i) for i in range(40, 90)]), "b")
    asked = spark.createDataFrame([(f"v{i}", 8) for i in range(100)], "video_id string, intro_seconds int").repartition(3)
    missing = store.missing(asked)
    plan = missing._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") == 2
    assert missing.count() == 10


def test_a_failed_writer_leaves_the_store(spark, tmp_path, monkeypatch):
    store = FeatureStore(spark, str(tmp_path / "store"), ["video_id", "intro_seconds"], 4)
    store.upsert(rows(spark, [("a", 8, 1)]), "a")
    with monkeypatch.context() as m:
        m.setattr(published, "publish", lambda *x: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.upsert(rows(spark, [("a", 8, 2)]), "b")
    assert [r.n for r in store.read().collect()] == [1]
    assert store.upsert(rows(spark, [("a", 8, 2)]), "b") and [r.n for r in store.read().collect()] == [2]


def test_two_writers_cannot_take_one_number(spark, tmp_path):
    table = str(tmp_path / "t")
    assert published.latest(spark, table) == (0, {})
    published.publish(spark, table, 0, {"a": 1})
    with pytest.raises(RuntimeError):
        published.publish(spark, table, 0, {"a": 2})
    assert published.latest(spark, table) == (1, {"a": 1})


def nested(spark, mark):
    return spark.createDataFrame([("s1", "success", [mark], (mark, 1), None), ("s2", "partial", [], (mark, 2), ("x",))],
                                 "subject_id string, status string, warnings array<string>, a struct<m:string,n:int>, b struct<m:string>")


def test_report_is_published_as_a_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "reports")
    report.write_report(nested(spark, "one"), path, "r1")
    assert [r.m for r in report.read_report(spark, path, "a").collect()] == ["one", "one"]
    assert report.read_report(spark, path, "b").count() == 1 and {r.status for r in report.read_report(spark, path).collect()} == {"success", "partial"}

    from pyspark.sql.readwriter import DataFrameWriter

    write = DataFrameWriter.parquet
    with monkeypatch.context() as m:  # dies between two sections
        m.setattr(DataFrameWriter, "parquet", lambda self, p, *a, **k: (_ for _ in ()).throw(OSError("lost")) if p.endswith("/b") else write(self, p, *a, **k))
        with pytest.raises(OSError):
            report.write_report(nested(spark, "two"), path, "r2")
    assert [r.m for r in report.read_report(spark, path, "a").collect()] == ["one", "one"]
    report.write_report(nested(spark, "three"), path, "r2")
    assert [r.m for r in report.read_report(spark, path, "a").collect()] == ["three", "three"]
    report.write_report(nested(spark, "four"), path, "r2")  # the same run again
    assert [r.m for r in report.read_report(spark, path, "a").collect()] == ["three", "three"]
    with pytest.raises(ValueError):
        report.read_report(spark, path, "c")


def test_values_of_nested_rows(spark):
    df = spark.sql("select 's' as subject_id, named_struct('x', 1, 'y', array(named_struct('z', 'a'), named_struct('z', cast(null as string)))) as a, array(2.5D) as b, map('k', true) as c, cast(null as struct<q:int>) as d")
    assert {tuple(r) for r in report.values(df).collect()} == {("s", "a", "x", "1"), ("s", "a", "y.0.z", "a"), ("s", "b", "0", "2.5"), ("s", "c", "k", "true")}


def test_versions_are_compacted(spark, tmp_path):
    """Two hundred micro-batches: the same latest rows at any time, and a number of runs that grows with the logarithm."""
    table, model = str(tmp_path / "versions"), {}
    ids = F.explode(F.array(F.pmod(F.col("batch") * 7, F.lit(50)), F.pmod(F.col("batch") * 3, F.lit(50)), F.lit(60) + F.col("batch") % 2))
    made = spark.range(200).select(F.col("id").alias("batch")).select("batch", ids.alias("v"))
    made = made.select(F.concat(F.lit("v"), "v").alias("video_id"), (F.col("batch") * 2 + F.col("v") % 5).alias("views"), F.lit("t").alias("title"), "batch").distinct()
    for r in sorted(made.collect(), key=lambda r: (r.batch, r.views)):
        model[r.video_id] = r.views
    made.withColumn("batch", F.lpad(F.col("batch").cast("string"), 9, "0")).repartition(1).write.partitionBy("batch").parquet(table)
    for i in range(200):
        (tmp_path / f"versions/batch={i:09d}/_SUCCESS").touch()  # each batch is a write of its own in the stream
    latest = lambda: {r.video_id: r.views for r in incremental.latest_videos(spark, table).collect()}
    assert latest() == model
    assert incremental.compact(spark, table, 10) == 2  # of twenty takings: sixteen and four
    assert latest() == model
    runs = published.latest(spark, table)[1]["folders"]
    kept = sum(spark.read.parquet(f"{table}/{r['folder']}").count() for r in runs)
    assert kept <= len(model) * len(runs) and [r["tier"] for r in runs] == sorted((r["tier"] for r in runs), reverse=True)
    assert len(incremental.forget(spark, table)) > 200 and latest() == model
    spark.createDataFrame([("v1", 1, "t"), ("new", 5, "t")], "video_id string, views long, title string").write.parquet(f"{table}/batch=000000200")
    assert latest() == model | {"v1": 1, "new": 5}
    incremental.compact(spark, table)
    assert latest() == model | {"v1": 1, "new": 5}
