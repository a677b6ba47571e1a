"""Wide panels, benchmark, label and prediction tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.scalars import STOCK_CODE_PATTERN, parse_day, to_bool
from tapeloom.functions.stats import is_finite, is_positive
from tapeloom.plans.shared import sized
from tapeloom.sinks.tables import part_path, read_if_present

# Fixed values.
PARTITION_ALIASES = {"val": "validation", "validation": "validation", "test": "oos", "oos": "oos"}


def stock_columns(names: Sequence[str], pattern: str = STOCK_CODE_PATTERN) -> list[str]:
    import re

    return [n for n in names if re.match(pattern, n)]


def _placed(spark: SparkSession, path: str) -> DataFrame | None:
    """(symbol, part, slot) of the parts at ``path``; None if one wide table is there."""
    placed = read_if_present(spark, f"{path}/_symbols")
    if placed is None:
        return None
    return placed.withColumn("symbol", F.col("symbol").cast("string"))


def _is_stock(pattern: str) -> Column:
    """:func:`stock_columns` for names that are rows."""

    def run(names: pd.Series) -> pd.Series:
        return names.str.match(pattern)

    return F.pandas_udf(run, "boolean")("symbol")


def wide_tables(
    spark: SparkSession, path: str, symbols: Sequence[str] | None = None
) -> list[DataFrame]:
    """The wide tables at ``path`` by their symbols' names: one, or the parts with some of ``symbols``.

    For few parts; :func:`wide_rows` reads any number of them in one scan.
    """
    placed = _placed(spark, path)
    if placed is None:
        return [spark.read.parquet(path)]
    wanted = placed
    if symbols is not None:
        picked = placed.where(F.col("symbol").isin(list(symbols))).select("part").distinct()
        wanted = placed.join(picked, "part")
    names: dict[int, list[str]] = {}
    for r in wanted.orderBy("part", "slot").collect():
        names.setdefault(r["part"], []).append(r["symbol"])
    return [
        spark.read.parquet(part_path(path, part))
        .select("value", *[f"s{slot}" for slot in range(len(own))])
        .toDF("value", *own)
        for part, own in names.items()
    ]


def _cells(wide: DataFrame, columns: list[str], places: DataFrame, value: str) -> DataFrame:
    """(value, symbol, ``value``) of the cells that ``places`` (symbol, part, slot) names; a slot
    counts ``columns``."""
    opened = wide.select("part", "value", F.posexplode(F.array(*columns)).alias("slot", "_v"))
    return opened.join(places, ["part", "slot"]).select(
        "value", "symbol", F.col("_v").alias(value)
    )


def wide_rows(
    spark: SparkSession,
    path: str,
    value: str = "value",
    symbols: Sequence[str] | DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Every cell of the wide table or parts at ``path`` as (day, symbol, ``value``), the day under
    its own name; empty cells are nulls.

    Parts are one scan, whatever their number. ``symbols`` are names or a table of them.
    """
    named = symbols is not None and not isinstance(symbols, DataFrame)
    placed = _placed(spark, path)
    if placed is None:
        wide = _bounded(spark.read.parquet(path), start, end)
        day = day_column(wide.columns)
        columns = [c for c in wide.columns if c != day]
        columns = columns if pattern is None else stock_columns(columns, pattern)
        wanted = set(symbols) if named else None
        columns = [c for c in columns if wanted is None or c in wanted]
        if not columns:
            raise ValueError(f"no stock column in {path}")
        rows = wide.unpivot([day], columns, "symbol", "_v").withColumnRenamed("_v", value)
        return rows if named or symbols is None else rows.join(symbols, "symbol", "left_semi")
    if pattern is not None:
        placed = placed.where(_is_stock(pattern))
    if named:
        # At most as many as the caller has named; only their folders and columns are read.
        found = placed.where(F.col("symbol").isin(list(symbols))).collect()
        if not found:
            raise ValueError(f"no stock column in {path}")
        slots = sorted({r["slot"] for r in found})
        at = {slot: i for i, slot in enumerate(slots)}
        places = spark.createDataFrame(
            [(r["symbol"], r["part"], at[r["slot"]]) for r in found],
            "symbol string, part int, slot int",
        )
        folders = [part_path(path, part) for part in sorted({r["part"] for r in found})]
        wide = spark.read.parquet(*folders)
        return _cells(_bounded(wide, start, end), [f"s{slot}" for slot in slots], places, value)
    if symbols is not None:
        placed = placed.join(symbols, "symbol", "left_semi")
    if placed.isEmpty():
        raise ValueError(f"no stock column in {path}")
    wide = spark.read.option("recursiveFileLookup", "true").parquet(path)
    columns = [c for c in wide.columns if c not in ("part", "value")]
    return _cells(_bounded(wide, start, end), columns, placed, value)


def _bounded(wide: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        wide = wide.where(F.col("value") >= int(start.replace("-", "")))
    if end is not None:
        wide = wide.where(F.col("value") <= int(end.replace("-", "")))
    return wide


def read_wide_panel(
    spark: SparkSession,
    path: str,
    value: str = "value",
    symbols: Sequence[str] | DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
    pattern: str = STOCK_CODE_PATTERN,
) -> DataFrame:
    """One row per day with a column per stock, melted to (trading_date, symbol, value).

    ``path`` is one wide table or the parts of one. Of named ``symbols`` only their columns are read,
    of parts only those that hold some, and the day bounds reach the Parquet scan.
    """
    rows = wide_rows(spark, path, "_cell", symbols, start, end, pattern)
    return rows.select(
        parse_day(F.col("value")).alias("trading_date"), "symbol", F.col("_cell").alias(value)
    )


def _panel_symbols(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    placed = _placed(spark, path)
    if placed is not None:
        return placed.where(_is_stock(pattern)).select("symbol")
    columns = stock_columns(spark.read.parquet(path).columns, pattern)
    return spark.createDataFrame([(c,) for c in columns], "symbol string")


def load_market_panels(
    spark: SparkSession,
    paths: Mapping[str, str],
    pattern: str = STOCK_CODE_PATTERN,
    end: str | None = None,
) -> DataFrame:
    """Several wide panels side by side for the symbols common to all of them.

    The melted panels are stacked and folded in one aggregation instead of joined pairwise.
    """
    shared = sized(
        reduce(DataFrame.intersect, [_panel_symbols(spark, p, pattern) for p in paths.values()]),
        "shared",
    )
    stacked = [
        read_wide_panel(spark, p, "v", shared, end=end, pattern=pattern).withColumn(
            "panel", F.lit(name)
        )
        for name, p in paths.items()
    ]
    long = reduce(DataFrame.unionByName, stacked)
    picks = [F.max(F.when(F.col("panel") == name, F.col("v"))).alias(name) for name in paths]
    return long.groupBy("trading_date", "symbol").agg(*picks)


def axis_mismatch(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Days missing from some of the panels, with the number of panels that have them."""
    days = []
    for name, p in paths.items():
        # Every part has all days.
        first = p if _placed(spark, p) is None else part_path(p, 0)
        days.append(spark.read.parquet(first).select("value", F.lit(name).alias("panel")))
    return (
        reduce(DataFrame.unionByName, days)
        .groupBy("value")
        .agg(F.count_distinct("panel").alias("panels"))
        .where(F.col("panels") < len(paths))
    )


def align_optional_panel(axis: DataFrame, optional: DataFrame, value: str) -> DataFrame:
    """Values of an optional panel on an existing (trading_date, symbol) axis, 0 if absent."""
    picked = optional.select("trading_date", "symbol", value)
    return axis.join(picked, ["trading_date", "symbol"], "left").withColumn(
        value, F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    )


def read_benchmark(
    spark: SparkSession, path: str, day: str = "trade_date", need_close: bool = True
) -> DataFrame:
    """Benchmark opens and closes with invalid prices removed."""
    raw = spark.read.parquet(path)
    keep = is_positive("open")
    columns = ["open"]
    if need_close:
        keep = keep & is_positive("close")
        columns.append("close")
    return raw.where(keep).select(parse_day(F.col(day)).alias("trading_date"), *columns)


def day_column(names: Sequence[str]) -> str:
    """Name of the day column of a wide label table."""
    for candidate in ("value", "__index_level_0__"):
        if candidate in names:
            return candidate
    return names[0]


def read_wide_labels(spark: SparkSession, path: str) -> DataFrame:
    """Wide label table to (trading_date, symbol, label), finite labels only."""
    rows = wide_rows(spark, path, "label")
    return rows.where(is_finite("label")).select(
        parse_day(F.col(day_column(rows.columns))).alias("trading_date"), "symbol", "label"
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction table with dates and flags coerced and defaults filled in."""
    raw = spark.read.parquet(path)
    required = {"symbol", "trading_date", "label_date", "score", "target_return"}
    missing = required - set(raw.columns)
    if missing:
        raise ValueError(f"prediction table lacks {sorted(missing)}")
    sides = {"can_buy", "can_sell"} & set(raw.columns)
    if len(sides) == 1:
        raise ValueError("can_buy and can_sell come together or not at all")

    def flag(name: str):
        if name not in raw.columns:
            return F.lit(True).alias(name)
        text = F.col(name).cast("string")
        return F.when(text.isNull(), True).otherwise(to_bool(F.col(name))).alias(name)

    return raw.select(
        F.col("symbol").cast("string").alias("symbol"),
        parse_day(F.col("trading_date")).alias("trading_date"),
        parse_day(F.col("label_date")).alias("label_date"),
        F.col("score").cast("double").alias("score"),
        F.col("target_return").cast("double").alias("target_return"),
        flag("can_buy"),
        flag("can_sell"),
        flag("in_universe"),
        F.lit(len(sides) == 2).alias("tradability_known"),
        F.lit("in_universe" in raw.columns).alias("universe_membership_known"),
    )


def read_signals(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Signals of several partitions under their common names, finite scores only."""
    parts = []
    for raw_name, path in paths.items():
        if raw_name not in PARTITION_ALIASES:
            raise ValueError(f"unknown signal partition: {raw_name}")
        parts.append(
            spark.read.parquet(path)
            .where(is_finite("score"))
            .select(
                F.lit(PARTITION_ALIASES[raw_name]).alias("partition"),
                parse_day(F.col("trading_day")).alias("trading_date"),
                F.col("symbol").cast("string").alias("symbol"),
                "score",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def restore_scores(keys: DataFrame, scores: DataFrame) -> DataFrame:
    """Score shards joined to their identity rows; ``status`` names what disagrees."""
    on = ["partition", "row_index"]
    mine = keys.select(*on, "symbol", F.col("trading_day").alias("_day"))
    theirs = scores.select(*on, "trading_day", "score")
    joined = mine.join(theirs, on, "full_outer")
    return joined.select(
        *on,
        "symbol",
        F.coalesce("_day", "trading_day").alias("trading_day"),
        "score",
        F.when(F.col("symbol").isNull(), "no identity")
        .when(F.col("trading_day").isNull(), "no score")
        .when(F.col("_day") != F.col("trading_day"), "day differs")
        .when(~is_finite("score"), "score not finite")
        .otherwise("ok")
        .alias("status"),
    )


def read_horizon_sidecar(
    spark: SparkSession, path: str, horizon: int, keys: DataFrame | None = None
) -> DataFrame:
    """Labels of one horizon; the horizon filter prunes partitions of the sidecar."""
    rows = spark.read.parquet(path).where(F.col("horizon") == horizon)
    if keys is not None:
        rows = rows.join(keys.select("symbol", "trading_date"), ["symbol", "trading_date"], "left_semi")
    return rows
