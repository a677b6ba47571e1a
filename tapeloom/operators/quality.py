"""Constraint checks that return the offending rows or the counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, with the name of the first rule broken.

    Rules state what must hold; an undefined rule counts as broken.
    """
    reason = F.lit(None).cast("string")
    for name, rule in reversed(list(rules.items())):
        reason = F.when(~F.coalesce(rule, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull())


def prediction_contract(rows: DataFrame, expected: int) -> DataFrame:
    """Per label date: date uniqueness, candidate count and tradability counts."""
    no = lambda name: F.count(F.when(~F.col(name), 1))
    per_date = rows.groupBy("label_date").agg(
        F.count_distinct("trading_date").alias("signal_dates"),
        F.count_distinct("return_end_date").alias("end_dates"),
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("in_universe"), 1)).alias("candidates"),
        no("can_buy").alias("cannot_buy"),
        no("can_sell").alias("cannot_sell"),
    )
    one = (F.col("signal_dates") == 1) & (F.col("end_dates") == 1)
    return per_date.withColumn("valid", one & (F.col("candidates") == expected))


def locked_period(rows: DataFrame, dates: Sequence[str], locked_from: str) -> DataFrame:
    """One row: the latest date over all date columns and whether it is before the lock."""
    latest = F.greatest(*[F.max(c) for c in dates]) if len(dates) > 1 else F.max(dates[0])
    return rows.agg(latest.alias("latest")).withColumn(
        "safe", F.col("latest") < F.lit(locked_from).cast("date")
    )


def coverage(expected: DataFrame, actual: DataFrame, keys: Sequence[str], floor: float = 0.9) -> DataFrame:
    """One row: missing, extra and shared keys and the covered share of the expected ones."""
    mine = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    theirs = actual.select(*keys).distinct().withColumn("_a", F.lit(1))
    has_e, has_a = F.col("_e").isNotNull(), F.col("_a").isNotNull()
    counts = mine.join(theirs, list(keys), "full_outer").agg(
        F.count(F.when(has_e & has_a, 1)).alias("shared"),
        F.count(F.when(has_e & ~has_a, 1)).alias("missing"),
        F.count(F.when(~has_e & has_a, 1)).alias("extra"),
    )
    ratio = F.try_divide("shared", F.col("shared") + F.col("missing"))
    return counts.withColumn("coverage", ratio).withColumn("covered", F.col("coverage") >= floor)


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-independent content hash: row count and sum of 60-bit row digests.

    Each row hashes its JSON text, nulls included; addition merges the partial sums of any
    partitioning, so nothing is sorted or gathered.
    """
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    digest = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(28,0)")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(digest).cast("string").alias("digest"),
    )


def partition_counts(expected: DataFrame, rows: DataFrame, period: str = "period") -> DataFrame:
    """Expected against actual row counts per period, including periods on one side only."""
    actual = rows.groupBy(period).agg(F.count(F.lit(1)).alias("actual"))
    joined = expected.select(period, "expected").join(actual, period, "full_outer")
    return joined.select(
        period,
        F.coalesce("expected", F.lit(0)).alias("expected"),
        F.coalesce("actual", F.lit(0)).alias("actual"),
        F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("matches"),
    )
