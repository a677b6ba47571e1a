"""Experiment tables: gates, comparisons, robustness and research context.

Metric tables are narrow (experiment_id, seed, metric, value); every result is a grouped
aggregate or a small join on experiment and metric.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.stats import share

# Fixed values.
BASELINE_STATUSES = ("completed", "frozen", "locked_tested")
FAILURE_STATUSES = ("failed", "rejected")
INHERITABLE_DECISIONS = ("KEEP", "EXTEND")


def gate_evidence(metrics: DataFrame, gates: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Per experiment and gate: mean over seeds, missing seeds and whether it passes.

    A gate is (metric, operator, threshold) with operator gt, gte, lt or lte.
    """
    rules = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.lit(o).alias("operator"), F.lit(float(t)).alias("threshold")
            )
            for m, o, t in gates
        ]
    )
    wanted = (
        metrics.groupBy("experiment_id")
        .agg(F.count_distinct("seed").alias("_seeds"))
        .select("experiment_id", "_seeds", F.inline(rules))
    )
    means = metrics.groupBy("experiment_id", "metric").agg(
        F.avg("value").alias("mean_value"), F.count("value").alias("_n")
    )
    joined = wanted.join(means, ["experiment_id", "metric"], "left")
    mean, limit = F.col("mean_value"), F.col("threshold")
    passed = (
        F.when(F.col("operator") == "gt", mean > limit)
        .when(F.col("operator") == "gte", mean >= limit)
        .when(F.col("operator") == "lt", mean < limit)
        .otherwise(mean <= limit)
    )
    return joined.select(
        "experiment_id",
        "metric",
        "operator",
        "threshold",
        "mean_value",
        (F.col("_seeds") - F.coalesce("_n", F.lit(0))).alias("missing_seeds"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def gate_decision(evidence: DataFrame, stage: str) -> DataFrame:
    kept = "EXTEND" if stage == "screening" else "KEEP"
    return evidence.groupBy("experiment_id").agg(
        F.when(F.bool_and("passed"), kept).otherwise("DISCARD").alias("decision"),
        F.count(F.when(F.col("passed"), 1)).alias("gates_passed"),
    )


def direction_sign(metric: Column, lower_is_better: Sequence[str]) -> Column:
    return F.when(metric.isin(*lower_is_better), -1.0).otherwise(1.0)


def compare_to_baseline(
    metrics: DataFrame, baseline_id: str, lower_is_better: Sequence[str] = ()
) -> DataFrame:
    """Seed distribution per experiment and metric, and deltas to a baseline experiment.

    Paired figures use the seeds both experiments have.
    """
    base = metrics.where(F.col("experiment_id") == baseline_id)
    by_seed = base.select("metric", "seed", F.col("value").alias("_base"))
    base_mean = base.groupBy("metric").agg(F.avg("value").alias("_base_mean"))
    paired = metrics.join(by_seed, ["metric", "seed"], "left").withColumn(
        "_delta", F.col("value") - F.col("_base")
    )
    stats = paired.groupBy("experiment_id", "metric").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("_delta").alias("paired_seed_count"),
        F.avg("_delta").alias("paired_delta_mean"),
        F.stddev_samp("_delta").alias("paired_delta_std"),
    )
    sign = direction_sign(F.col("metric"), lower_is_better)
    delta = F.col("mean") - F.col("_base_mean")
    return (
        stats.join(base_mean, "metric")
        .withColumns(
            {
                "delta_vs_baseline_mean": delta,
                "improvement_vs_baseline_mean": sign * delta,
                "paired_improvement_mean": sign * F.col("paired_delta_mean"),
            }
        )
        .drop("_base_mean")
    )


def walk_forward_summary(metrics: DataFrame, lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Mean per window (experiment), worst window and share of windows above zero.

    Equal worst values keep the first experiment id.
    """
    windows = metrics.groupBy("experiment_id", "metric").agg(F.avg("value").alias("_mean"))
    sign = direction_sign(F.col("metric"), lower_is_better)
    worst = F.min(F.struct((sign * F.col("_mean")).alias("v"), "experiment_id", "_mean"))
    return (
        windows.groupBy("metric")
        .agg(
            F.count(F.lit(1)).alias("window_count"),
            F.avg("_mean").alias("window_mean"),
            F.stddev_samp("_mean").alias("window_std"),
            F.min("_mean").alias("window_min"),
            F.max("_mean").alias("window_max"),
            share(F.col("_mean") > 0).alias("above_zero_window_ratio"),
            worst.alias("_worst"),
        )
        .select(
            "*",
            F.col("_worst._mean").alias("worst_window_value"),
            F.col("_worst.experiment_id").alias("worst_window_experiment_id"),
        )
        .drop("_worst")
    )


def average_metrics(metrics: DataFrame, experiment_ids: Sequence[str] | None = None) -> DataFrame:
    rows = metrics
    if experiment_ids is not None:
        rows = rows.where(F.col("experiment_id").isin(*experiment_ids))
    return rows.groupBy("experiment_id", "metric").agg(F.avg("value").alias("mean_value"))


def list_reviews(
    reviews: DataFrame, experiments: DataFrame, review_type: str | None = None, limit: int | None = 100
) -> DataFrame:
    """Latest reviews with the status of their experiment."""
    rows = reviews if review_type is None else reviews.where(F.col("review_type") == review_type)
    joined = rows.join(
        experiments.select(
            "experiment_id",
            F.col("status").alias("experiment_status"),
            F.col("decision").alias("experiment_decision"),
        ),
        "experiment_id",
    ).orderBy(F.desc("review_id"))
    return joined if limit is None else joined.limit(limit)


def recent_experiments(experiments: DataFrame, limit: int) -> DataFrame:
    return experiments.orderBy(F.desc("created_at"), "experiment_id").limit(limit)


def failures(experiments: DataFrame, limit: int) -> DataFrame:
    failed = F.col("status").isin(*FAILURE_STATUSES) | (F.col("decision") == "DISCARD")
    return recent_experiments(experiments.where(failed), limit)


def distinct_signatures(experiments: DataFrame) -> DataFrame:
    """Signatures seen so far with the date they were last used."""
    return (
        experiments.where(F.coalesce("signature", F.lit("")) != "")
        .groupBy("signature")
        .agg(F.max("created_at").alias("last_used"))
    )


def baseline_experiment(experiments: DataFrame) -> DataFrame:
    """Latest completed experiment, KEEP before EXTEND."""
    order = F.when(F.col("decision") == "KEEP", 0).otherwise(1)
    return (
        experiments.where(
            F.col("status").isin(*BASELINE_STATUSES)
            & F.col("decision").isin(*INHERITABLE_DECISIONS)
        )
        .orderBy(order, F.desc("created_at"), "experiment_id")
        .limit(1)
    )


def review_anomalies(reviews: DataFrame, experiments: DataFrame, limit: int | None = None) -> DataFrame:
    """Anomalies listed in audit reviews, newest review first."""
    schema = "struct<anomalies: array<struct<type: string, severity: string, detail: string>>>"
    opened = list_reviews(reviews, experiments, "audit_anomalies", None).select(
        "review_id",
        "experiment_id",
        "experiment_status",
        F.posexplode(F.from_json("payload", schema)["anomalies"]).alias("place", "a"),
    )
    rows = opened.select(
        "review_id",
        "experiment_id",
        "experiment_status",
        "place",
        F.coalesce("a.type", F.lit("unknown")).alias("type"),
        F.coalesce("a.severity", F.lit("unknown")).alias("severity"),
    ).orderBy(F.desc("review_id"), "place")
    return rows if limit is None else rows.limit(limit)


def export_counts(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("symbol").alias("symbols"),
        F.count_distinct("label_date").alias("dates"),
    )


def metric_paths(metrics: Mapping[str, Column], rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Named aggregates of a table as (keys, metric, value) rows."""
    wide = rows.groupBy(*keys).agg(*[c.cast("double").alias(n) for n, c in metrics.items()])
    return wide.unpivot(list(keys), list(metrics), "metric", "value")
