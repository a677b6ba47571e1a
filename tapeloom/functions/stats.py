"""Aggregate expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_finite(value: Column | str) -> Column:
    """Not null, not NaN and not infinite (NaN compares above every number in Spark)."""
    c = _col(value).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def is_positive(value: Column | str) -> Column:
    return is_finite(value) & (_col(value) > 0)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation, null where either side is constant."""
    x, y = _col(x), _col(y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def safe_ratio(x: Column | str, y: Column | str) -> Column:
    return F.try_divide(_col(x), _col(y))


def share(condition: Column) -> Column:
    """Fraction of rows on which the condition holds."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))
