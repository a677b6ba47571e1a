"""Ordered scans against plain windows, with groups cut into many parts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.plans import scans
from tapeloom.plans.scans import ordered_scan


@pytest.fixture(scope="module")
def skewed(spark):
    """One group owns most rows and one value half of that group; some groups and values are null."""
    rng = np.random.default_rng(8)
    n = 5000
    pdf = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abc"), n)),
            "v": np.where(rng.random(n) < 0.5, 1.0, rng.normal(size=n).round(2)),
            "k": np.arange(n),
            "x": np.where(rng.random(n) < 0.1, rng.integers(0, 99, n), -1),
        }
    )
    rows = spark.createDataFrame(pdf).repartition(7)
    return rows.select(
        F.when(F.col("g") != "c", F.col("g")).alias("g"),
        F.when(F.col("k") % 11 > 0, F.col("v")).alias("v"),
        "k",
        F.when(F.col("x") >= 0, F.col("x")).alias("x"),
    ).cache()


@pytest.mark.parametrize("part_rows", [20, 300, 100_000])
@pytest.mark.parametrize("group", [["g"], []])
def test_scan_equals_windows(skewed, group, part_rows):
    got = ordered_scan(
        skewed,
        group,
        [F.col("v"), F.col("k")],
        size="n",
        lag={"k_before": "k"},
        carry={"held": "x"},
        ties=("v", "first", "last"),
        part_rows=part_rows,
    )
    w = Window.partitionBy(*group)
    along = w.orderBy("v", "k")
    ties = Window.partitionBy(*group, "v")
    null = F.col("v").isNull()
    want = skewed.select(
        "*",
        F.row_number().over(along).alias("pos"),
        F.count(F.lit(1)).over(w).alias("n"),
        F.lag("k").over(along).alias("k_before"),
        F.last("x", ignorenulls=True)
        .over(along.rowsBetween(Window.unboundedPreceding, 0))
        .alias("held"),
    )
    want = want.withColumns(
        {
            "first": F.when(null, F.col("pos")).otherwise(F.min("pos").over(ties)),
            "last": F.when(null, F.col("pos")).otherwise(F.max("pos").over(ties)),
        }
    )
    assert got.columns == want.columns
    assert got.count() == 5000
    assert got.exceptAll(want).count() == 0


def test_parts_are_many_and_small(skewed):
    key = F.struct(F.col("v").alias("k0"), F.col("k").alias("k1"))
    cuts = scans.cutting_points(skewed, ["g"], key, 20)
    parted = scans._beside(skewed, cuts, ["g"], "left").withColumn("_part", scans._part(key))
    sizes = [r["count"] for r in parted.groupBy("g", "_part").count().collect()]
    assert len(sizes) > 200 and max(sizes) <= 60


def test_rows_move_once(spark):
    rows = spark.range(1000).selectExpr("id % 3 AS g", "id % 7 AS v", "id AS k")
    out = ordered_scan(rows, ["g"], [F.col("v"), F.col("k")], size="n", ties=("v", "a", "b"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("- Sort [") == 1
