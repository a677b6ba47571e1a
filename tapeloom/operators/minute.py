"""Minute features: per-minute last rows, modality joins, trailing aggregates, scaling.

A stock-day has at most 1,440 minutes once each minute keeps its last row, and that
reduction is an aggregate with map-side merging, so later stock-day windows are small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalars import clip
from tapeloom.functions.stats import is_finite
from tapeloom.operators.book import summary_aggregates
from tapeloom.plans.ordering import exact_quantiles
from tapeloom.plans.shared import sized

KEY = ("date", "ticker")


def trailing(rows: DataFrame, minutes: int) -> DataFrame:
    """Latest ``minutes`` rows of each stock-day."""
    backwards = Window.partitionBy(*KEY).orderBy(F.desc("minute"))
    return (
        rows.withColumn("_place", F.row_number().over(backwards))
        .where(F.col("_place") <= minutes)
        .drop("_place")
    )


def last_per_minute(rows: DataFrame, features: Sequence[str], keep_minutes: int, seq: str = "seq") -> DataFrame:
    """Last row of every minute, then the trailing minutes of the stock-day."""
    latest = rows.groupBy(*KEY, "minute").agg(
        F.max_by(F.struct(*features), seq).alias("_row")
    )
    return trailing(latest.select(*KEY, "minute", "_row.*"), keep_minutes)


def merge_modalities(modalities: Sequence[DataFrame], keep_minutes: int) -> DataFrame:
    """Strict join on the minute of modalities already trimmed one by one, trimmed again."""
    merged = modalities[0]
    for other in modalities[1:]:
        merged = merged.join(other, [*KEY, "minute"])
    return trailing(merged, keep_minutes)


def trailing_summary(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, population deviation, last and last-minus-first of all features, NaN kept."""
    return rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("minutes"),
        *summary_aggregates(features, F.col("minute")),
    )


def build_samples(
    rows: DataFrame,
    targets: DataFrame,
    features: Sequence[str],
    window_minutes: int,
    min_minutes: int,
) -> DataFrame:
    """One row per target: its summary, or the reason it has none."""
    summary = trailing_summary(trailing(rows, window_minutes), features)
    joined = targets.join(summary, list(KEY), "left")
    status = (
        F.when(F.col("minutes").isNull(), "missing rows")
        .when(F.col("minutes") < min_minutes, "insufficient window")
        .otherwise("written")
    )
    return joined.withColumn("status", status)


def sample_report(samples: DataFrame) -> DataFrame:
    return samples.agg(
        F.count(F.lit(1)).alias("requested_targets"),
        F.count(F.when(F.col("status") == "missing rows", 1)).alias("missing_rows"),
        F.count(F.when(F.col("status") == "insufficient window", 1)).alias("insufficient_window"),
        F.count(F.when(F.col("status") == "written", 1)).alias("written_samples"),
    )


def complete_samples(targets: DataFrame, samples: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full target list with a feature vector; stock-days without a sample are all NaN."""
    vector = F.array(*[F.col(c).cast("float") for c in columns])
    known = samples.select(*KEY, vector.alias("features"), F.lit(True).alias("_has"))
    blank = F.array_repeat(F.lit(float("nan")).cast("float"), len(columns))
    return targets.join(known, list(KEY), "left").withColumns(
        {
            "features": F.coalesce("features", blank),
            "feature_available": F.coalesce("_has", F.lit(False)),
        }
    ).drop("_has")


def median_fill(rows: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """NaN and null replaced by the train-only exact median of the column."""
    observed = (
        rows.where(train)
        .select(*columns)
        .unpivot([], list(columns), "feature", "value")
        .where(is_finite("value"))
    )
    medians = exact_quantiles(observed, ["feature"], "value", {"median": 0.5})
    wide = medians.agg(
        *[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(c) for c in columns]
    )
    wide = sized(wide, "medians")
    filled = {}
    for c in columns:
        value = F.when(is_finite(c), F.col(c)).otherwise(wide.select(c).scalar())
        filled[c] = value
    return rows.withColumns(filled)


def fit_scaler(rows: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """One row of train means and scales over finite values; tiny scales become 1."""
    finite = {c: F.when(is_finite(c), F.col(c)) for c in columns}
    fit = rows.where(train).agg(
        *[F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{c}__m") for c, v in finite.items()],
        *[F.stddev_pop(v).alias(f"{c}__s") for c, v in finite.items()],
    )
    scale = lambda c: F.when(F.col(c) >= 1e-6, F.col(c)).otherwise(1.0).alias(c)
    return fit.select(
        *[f"{c}__m" for c in columns], *[scale(f"{c}__s") for c in columns]
    )


def standardize(
    rows: DataFrame, columns: Sequence[str], scaler: DataFrame, available: str, limit: float = 10.0
) -> DataFrame:
    """Mean-imputed, scaled and clipped features with the availability flag as a feature."""
    fit = sized(scaler, "scaler")
    out = {}
    for c in columns:
        mean, scale = fit.select(f"{c}__m").scalar(), fit.select(f"{c}__s").scalar()
        value = F.when(is_finite(c), F.col(c)).otherwise(mean)
        out[c] = clip((value - mean) / scale, -limit, limit)
    return rows.withColumns(out | {"available": F.col(available).cast("double")})


def period_summary(rows: DataFrame, available: str = "feature_available") -> DataFrame:
    return rows.groupBy("period").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col(available), 1)).alias("available_rows"),
        F.count(F.when(~F.col(available), 1)).alias("imputed_rows"),
    )


def joint_rows(features: DataFrame, cache: DataFrame, partitions: Mapping[str, str]) -> DataFrame:
    """Features with their split joined to a keyed cache; disagreement is a status.

    ``partitions`` maps the split of a feature row to the partition name of the cache.
    """
    pairs = [F.lit(x) for pair in partitions.items() for x in pair]
    expected = F.create_map(*pairs)[F.col("split")]
    joined = features.where(F.col("split").isNotNull()).join(cache, list(KEY))
    return joined.withColumn(
        "status", F.when(F.col("partition") == expected, "ok").otherwise("partition differs")
    )
