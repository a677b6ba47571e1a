"""Minute caches, book months, raw day files and text inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.scalars import (
    day_number,
    modality_columns,
    pad_symbol,
    parse_day,
    strip_suffix,
)
from tapeloom.sources.zones import wanted_paths

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("trading_date", T.StringType()),
        T.StructField("open", T.StringType()),
        T.StructField("close", T.StringType()),
    ]
)
BENCHMARK_SCHEMA = T.StructType(
    [T.StructField("trading_date", T.StringType()), T.StructField("return", T.StringType())]
)
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("trading_date", T.StringType()),
        T.StructField("features_path", T.StringType()),
        T.StructField("last_event_timestamp", T.StringType()),
        T.StructField("signal_timestamp", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def within_days(raw: DataFrame, column: str, wanted: DataFrame, day: str) -> DataFrame:
    """Rows from the first to the last wanted day, as literals on the stored column.

    The bounds are taken first, so that the scan itself skips files, folders and row groups.
    ``column`` holds yyyymmdd as a number.
    """
    first, last = wanted.agg(F.min(day), F.max(day)).first()
    if first is None:
        return raw.where(F.lit(False))
    return raw.where(F.col(column).between(F.lit(first), F.lit(last)))


def read_minute_cache(
    spark: SparkSession,
    paths: Sequence[str],
    modality: str,
    targets: DataFrame,
    zones: DataFrame | None = None,
) -> DataFrame:
    """Yearly files of one modality, restricted to the wanted stock-days.

    Column pruning keeps the features of the modality, and the scan skips what lies outside
    the wanted days. With a zone map of the files (``sources.zones``) only those are opened that may
    hold a wanted stock-day, however far apart these lie.
    """
    if zones is not None:
        asked = targets.select(F.col("date").alias("day"), F.col("ticker").alias("symbol"))
        paths = wanted_paths(zones, asked) or paths
    raw = spark.read.parquet(*paths)
    features = modality_columns(raw.columns, modality)
    if not features:
        raise ValueError(f"no {modality} feature column")
    wanted = targets.select("date", "ticker").distinct()
    picked = within_days(raw, "date", wanted, "date").select(
        "date", "ticker", "minute", "seq", *features
    )
    return picked.join(wanted, ["date", "ticker"], "left_semi")


def read_trade_date_minutes(
    spark: SparkSession, root: str, targets: DataFrame, features: Sequence[str]
) -> DataFrame:
    """Minute OHLCV under trade_date=YYYYMMDD, reading only the folders of wanted days.

    The distinct wanted days, one value per session, become literals on the partition column.
    """
    days = [r["date"] for r in targets.select("date").distinct().collect()]
    raw = spark.read.parquet(root)
    raw = raw.where(F.col("trade_date").isin(days))
    rows = raw.select(
        F.col("trade_date").cast("int").alias("date"),
        strip_suffix(F.col("ts_code")).alias("ticker"),
        (F.hour("trade_time") * 60 + F.minute("trade_time")).alias("minute"),
        "seq",
        *features,
    )
    return rows.join(targets.select("date", "ticker").distinct(), ["date", "ticker"], "left_semi")


def read_book_months(
    spark: SparkSession,
    paths: Sequence[str],
    targets: DataFrame,
    start_ms: int,
    signal_ms: int,
    columns: Sequence[str],
    zones: DataFrame | None = None,
) -> DataFrame:
    """Book snapshots of the target stock-days inside [start_ms, signal_ms).

    Where days are stored as numbers, their bounds reach the scan; days stored as text may
    have two forms and are compared after parsing. A zone map of the files, keyed by
    trading date and padded symbol, leaves only those that may hold a target.
    """
    if zones is not None:
        asked = targets.select(F.col("trading_date").alias("day"), "symbol")
        paths = wanted_paths(zones, asked) or paths
    raw = spark.read.parquet(*paths).select("ticker", "TradingDay", "time_ms", "seq", *columns)
    if isinstance(raw.schema["TradingDay"].dataType, T.IntegralType):
        days = targets.select(day_number(F.col("trading_date")).alias("day"))
        raw = within_days(raw, "TradingDay", days, "day")
    timed = raw.where((F.col("time_ms") >= start_ms) & (F.col("time_ms") < signal_ms))
    keyed = timed.select(
        parse_day(F.col("TradingDay")).alias("trading_date"),
        pad_symbol(F.col("ticker")).alias("symbol"),
        "time_ms",
        "seq",
        *columns,
    )
    wanted = targets.select("trading_date", "symbol").distinct()
    return keyed.join(wanted, ["trading_date", "symbol"], "left_semi")


def resolve_book_paths(
    spark: SparkSession, root: str, months: Sequence[str], days: Sequence[str]
) -> tuple[list[str], list[str]]:
    """Month files where readable, else the day files of that month.

    A month without a readable file falls back to its day files, all of which must exist.
    Returns the paths and the months that fell back. The folder is listed once, and file
    footers are opened in one parallel job unless one of them turns out broken.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_extract("path", r"snapshot_(\d+)\.parquet", 1)
    present = {r["n"] for r in listed.select(name.alias("n")).distinct().collect()}
    path_of = lambda n: f"{root}/*snapshot_{n}.parquet"
    whole = [m for m in months if m in present]
    if not _readable(spark, [path_of(m) for m in whole]):
        whole = [m for m in whole if _readable(spark, [path_of(m)])]
    paths = [path_of(m) for m in whole]
    fallback = [m for m in months if m not in set(whole)]
    for month in fallback:
        daily = [d for d in days if d.startswith(month)]
        missing = [d for d in daily if d not in present]
        if missing or not daily:
            raise FileNotFoundError(f"day files of {month} incomplete: {missing[:5]}")
        paths.extend(path_of(d) for d in daily)
    return paths, fallback


def _readable(spark: SparkSession, paths: Sequence[str]) -> bool:
    from pyspark.errors import PySparkException

    if not paths:
        return True
    try:
        return bool(spark.read.option("mergeSchema", True).parquet(*paths).columns)
    except PySparkException:
        return False


def read_raw_days(spark: SparkSession, root: str, stream: str) -> DataFrame:
    """Order or trade files, one per day; the day comes from the file name."""
    raw = spark.read.parquet(f"{root}/{stream}/*.parquet")
    day = F.regexp_extract(F.col("_metadata.file_path"), rf"{stream}_(\d{{8}})\.parquet", 1)
    return raw.withColumn("day", F.to_date(day, "yyyyMMdd"))


def read_raw_snapshots(
    spark: SparkSession, root: str, months: Sequence[str] = ("*",)
) -> DataFrame:
    """Snapshot month files; the day is a column and its filter reaches the scan."""
    paths = [f"{root}/snapshot/*snapshot_{m}.parquet" for m in months]
    raw = spark.read.parquet(*paths)
    return raw.withColumn("day", parse_day(F.col("TradingDay")))


def read_bar_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from CSV; ``problem`` is null for a valid row."""
    raw = spark.read.schema(BAR_SCHEMA).option("header", True).csv(path)
    typed = raw.select(
        "symbol",
        F.try_to_date("trading_date", "yyyy-MM-dd").alias("trading_date"),
        F.col("open").try_cast("double").alias("open"),
        F.col("close").try_cast("double").alias("close"),
    )
    problem = (
        F.when(F.coalesce(F.length("symbol"), F.lit(0)) == 0, "symbol")
        .when(F.col("trading_date").isNull(), "trading_date")
        .when(F.col("open").isNull(), "open")
        .when(F.col("close").isNull(), "close")
    )
    return typed.withColumn("problem", problem)


def read_benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(BENCHMARK_SCHEMA).option("header", True).csv(path)
    return raw.select(
        F.try_to_date("trading_date", "yyyy-MM-dd").alias("trading_date"),
        F.col("return").try_cast("double").alias("return"),
    )


def read_calendar_text(spark: SparkSession, path: str) -> DataFrame:
    """One ISO date per line; blank lines are skipped, others that do not parse are null."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    return lines.select(F.try_to_date("value", "yyyy-MM-dd").alias("trading_date"))


def read_event_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with typed fields; ``problem`` names the first invalid field."""
    raw = (
        spark.read.schema(MANIFEST_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    typed = raw.select(
        "symbol",
        F.try_to_date("trading_date", "yyyy-MM-dd").alias("trading_date"),
        "features_path",
        F.col("last_event_timestamp").try_cast("timestamp_ntz").alias("last_event_timestamp"),
        F.col("signal_timestamp").try_cast("timestamp_ntz").alias("signal_timestamp"),
        "_corrupt_record",
    )
    problem = (
        F.when(F.col("_corrupt_record").isNotNull(), "json")
        .when(F.col("symbol").isNull(), "symbol")
        .when(F.col("trading_date").isNull(), "trading_date")
        .when(F.col("features_path").isNull(), "features_path")
        .when(F.col("last_event_timestamp").isNull(), "last_event_timestamp")
        .when(F.col("signal_timestamp").isNull(), "signal_timestamp")
    )
    return typed.withColumn("problem", problem).drop("_corrupt_record")
