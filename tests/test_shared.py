import os

import pytest
from pyspark.sql import functions as F

from tapeloom.catalog import fixtures
from tapeloom.plans import shared
from tapeloom.sources import files


def folder_of(df):
    return df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]


def test_released_tables_are_gone(spark):
    outer = shared.settle(spark.range(5), "outer")
    with shared.released(spark):
        inner = shared.settle(spark.range(7), "inner")
        path = folder_of(inner)
        assert inner.count() == 7 and os.path.isdir(path)
    assert not os.path.exists(path)
    assert outer.count() == 5


def test_a_cluster_needs_a_configured_folder(spark, monkeypatch):
    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


def test_kept_tables_follow_the_input(spark, tmp_path):
    path = str(tmp_path / "lineitem.parquet")
    spark.range(3).write.parquet(path)
    first = fixtures.kept(spark, str(tmp_path), "n", lambda: spark.read.parquet(path))
    again = fixtures.kept(spark, str(tmp_path), "n", lambda: spark.range(99).toDF("id"))
    assert first.count() == again.count() == 3
    spark.range(5).write.mode("overwrite").parquet(path)
    changed = fixtures.kept(spark, str(tmp_path), "n", lambda: spark.read.parquet(path))
    assert changed.count() == 5


def scan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_minute_cache_reads_only_wanted_days(spark, tmp_path):
    rows = spark.range(100).select(
        (F.lit(20240100) + F.col("id") % 28 + 1).cast("int").alias("date"),
        F.lit("000001").alias("ticker"),
        F.col("id").cast("int").alias("minute"),
        F.lit(1).alias("seq"),
        F.lit(1.0).alias("order__price"),
    )
    path = str(tmp_path / "cache.parquet")
    rows.write.parquet(path)
    targets = spark.createDataFrame([(20240105, "000001"), (20240107, "000001")], "date int, ticker string")
    got = files.read_minute_cache(spark, [path], "order", targets)
    assert {r.date for r in got.collect()} == {20240105, 20240107}
    plan = scan_of(got)
    assert "GreaterThanOrEqual(date,20240105)" in plan and "LessThanOrEqual(date,20240107)" in plan


def test_day_folders_are_pruned(spark, tmp_path):
    root = str(tmp_path / "days")
    spark.range(60).select(
        (F.lit(20240100) + F.col("id") % 6 + 1).cast("int").alias("trade_date"),
        F.lit("000001.SZ").alias("ts_code"),
        F.lit("2024-01-01 09:31:00").cast("timestamp").alias("trade_time"),
        F.col("id").alias("seq"),
        F.lit(1.0).alias("close"),
    ).write.partitionBy("trade_date").parquet(root)
    targets = spark.createDataFrame([(20240102, "000001")], "date int, ticker string")
    got = files.read_trade_date_minutes(spark, root, targets, ["close"])
    assert got.count() == 10
    filters = scan_of(got).split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "20240102" in filters
