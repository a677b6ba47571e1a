"""Isotonic regression as blocks that merge.

Inside range partitions of the sorted rows, adjacent violators are pooled to blocks. A block can only
be pooled further if its mean is above the least mean of a later partition or below the largest of
an earlier one; all others are final and separate the rest into short runs, each pooled by itself.
The fitted line is a table: flat over a block, straight between the ends of two blocks, flat outside.
It is applied by an ordered scan that carries the last knot, so neither the fit nor its use gathers
rows in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.plans.ordering import prefix_sum
from tapeloom.plans.scans import ordered_scan
from tapeloom.plans.shared import settle, sized

_BLOCK = "low double, high double, weight double, total double"


class _Pool:
    """Blocks of ascending means: (low, high, weight, total)."""

    def __init__(self) -> None:
        self.blocks: list[tuple[float, float, float, float]] = []

    def add(self, low: float, high: float, weight: float, total: float) -> None:
        blocks = self.blocks
        while blocks and blocks[-1][3] * weight >= total * blocks[-1][2]:
            low_, _, weight_, total_ = blocks.pop()
            low, weight, total = low_, weight + weight_, total + total_
        blocks.append((low, high, weight, total))

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(self.blocks, columns=["low", "high", "weight", "total"])


def _pool_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pool = _Pool()
    for batch in batches:
        for x, weight, total in zip(batch["x"], batch["weight"], batch["total"], strict=True):
            pool.add(x, x, weight, total)
    yield pool.frame()


def _pool_run(rows: pd.DataFrame) -> pd.DataFrame:
    pool = _Pool()
    for row in rows.sort_values("low")[["low", "high", "weight", "total"]].itertuples(index=False):
        pool.add(*row)
    return pool.frame()


def isotonic_blocks(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(low, high, mean): the blocks of the least-squares ascending fit of ``y`` on ``x``.

    Equal ``x`` are one point. Both columns must be finite.
    """
    points = rows.groupBy(F.col(x).cast("double").alias("x")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.sum(y).alias("total")
    )
    pooled = settle(
        settle(points, "points")
        .repartitionByRange("x")
        .sortWithinPartitions("x")
        .mapInPandas(_pool_partition, _BLOCK)
        .withColumn("part", F.spark_partition_id()),
        "pooled",
    ).withColumn("mean", F.col("total") / F.col("weight"))
    # One row per partition; within one, means ascend.
    along = Window.orderBy("part")
    reach = pooled.groupBy("part").agg(F.min("mean").alias("least"), F.max("mean").alias("most"))
    reach = sized(
        reach.select(
            "part",
            F.min("least").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
            F.max("most").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        ),
        "reach",
    )
    loose = F.coalesce(F.col("mean") >= F.col("later"), F.lit(False)) | F.coalesce(
        F.col("mean") <= F.col("earlier"), F.lit(False)
    )
    marked = pooled.join(reach, "part").withColumn("final", F.when(loose, 0).otherwise(1))
    # Loose blocks between the same final ones are one run.
    numbered = settle(
        prefix_sum(
            marked.select("low", "high", "weight", "total", "final"),
            [],
            [F.col("low")],
            "final",
            "run",
            "finals",
        ),
        "runs",
    )
    runs = numbered.where("final = 0").groupBy("run").applyInPandas(_pool_run, _BLOCK)
    fixed = numbered.where("final = 1").select("low", "high", "weight", "total")
    return settle(
        fixed.unionByName(runs).select(
            "low", "high", (F.col("total") / F.col("weight")).alias("mean")
        ),
        "blocks",
    )


def apply_blocks(blocks: DataFrame, rows: DataFrame, x: str, out: str) -> DataFrame:
    """Add the fitted value of ``x``; between two blocks a straight line, outside the end values."""
    linked = settle(
        ordered_scan(
            blocks, [], [F.col("low")], pos="_pos", lag={"_high": "high", "_mean": "mean"}
        ),
        "linked",
    )
    slope = (F.col("mean") - F.col("_mean")) / (F.col("low") - F.col("_high"))
    flat = linked.select(
        F.struct(F.col("low").alias("at"), F.col("mean").alias("value"), F.lit(0.0).alias("slope"))
        .alias("knot")
    )
    rising = linked.where("_high IS NOT NULL").select(
        F.struct(F.col("_high").alias("at"), F.col("_mean").alias("value"), slope.alias("slope"))
        .alias("knot")
    )
    # At one place the flat knot comes first, then the rising one, then the rows.
    knots = flat.withColumn("_kind", F.lit(0)).unionByName(rising.withColumn("_kind", F.lit(1)))
    lined = knots.select(F.col("knot.at").alias("_at"), "_kind", "knot").unionByName(
        rows.select(
            F.col(x).cast("double").alias("_at"),
            F.lit(2).alias("_kind"),
            F.struct(*[F.col(c) for c in rows.columns]).alias("_row"),
        ),
        allowMissingColumns=True,
    )
    scanned = ordered_scan(
        lined, [], [F.col("_at"), F.col("_kind")], pos="_pos", carry={"_last": "knot"}
    )
    first = blocks.agg(F.min_by("mean", "low")).scalar()
    value = F.col("_last.value") + (F.col("_at") - F.col("_last.at")) * F.col("_last.slope")
    return scanned.where("_kind = 2").select("_row.*", F.coalesce(value, first).alias(out))
