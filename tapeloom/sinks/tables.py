"""Writers: label sidecars, periodic materialization, wide tables, prediction tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.plans.ordering import ordinal
from tapeloom.plans.shared import new_path, settle, sized

# Fixed values.
PORTFOLIO_TABLES = ("daily", "holdings", "trades")


def write_horizon_sidecar(targets: DataFrame, path: str) -> DataFrame:
    """Typed labels by horizon folder; returns the row counts of what was written."""
    typed = targets.select(
        "symbol",
        "trading_date",
        "entry_date",
        "return_end_date",
        F.col("horizon").cast("smallint").alias("horizon"),
        F.col("label").cast("tinyint").alias("label"),
        "raw_return",
        "benchmark_return",
        "target_return",
    )
    typed.write.partitionBy("horizon").option("compression", "zstd").mode("overwrite").parquet(
        path
    )
    written = targets.sparkSession.read.parquet(path)
    return written.groupBy("horizon").agg(F.count(F.lit(1)).alias("rows"))


def period_fingerprints(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(period, rows, digest): an order-free digest of the content of each period."""
    picked = [F.col(c) for c in columns]
    # The null flags keep (null, x) apart from (x, null).
    content = F.xxhash64(*picked, *[c.isNull() for c in picked])
    return rows.groupBy("period").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(content.cast("decimal(38,0)")).alias("digest"),
    )


def write_periods(
    rows: DataFrame,
    path: str,
    available: str = "feature_available",
    resume: bool = True,
    rows_per_file: int = 1_000_000,
) -> DataFrame:
    """Write ``rows`` by ``period`` folder, skipping periods that hold the same content.

    What is stored is read and compared by fingerprint, so a changed value, a lost row or a
    tampered file makes its period be written again. Periods that ``rows`` lacks are removed, and
    other columns than before replace the whole table, so what is there is always what the manifest
    lists. A period is spread over as many files as its rows ask for. The manifest (rows,
    digest and columns per period) is kept beside the data and returned with the counts.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c != "period"]
    rows = settle(rows, "period-rows")
    wanted = sized(period_fingerprints(rows, columns), "wanted")
    todo = wanted
    existing = read_if_present(spark, path) if resume else None
    kept = existing is not None and set(existing.columns) == set(rows.columns)
    if kept:
        stored = existing.withColumn("period", F.col("period").cast(rows.schema["period"].dataType))
        done = sized(period_fingerprints(stored, columns), "stored")
        todo = sized(wanted.join(done, ["period", "rows", "digest"], "left_anti"), "todo")
        gone = stored.select("period", "_metadata.file_path").join(wanted, "period", "left_anti")
        # One row per folder of a period that is no longer wanted.
        folders = gone.select(F.regexp_replace("file_path", "/[^/]*$", "").alias("folder")).distinct()
        for row in folders.collect():
            remove_folder(spark, row["folder"])
    spread = sized(
        todo.select("period", F.ceil(F.col("rows") / rows_per_file).alias("_files")), "todo"
    )
    (
        rows.join(spread, "period")
        .repartition("period", F.pmod(F.xxhash64(*columns[:2]), "_files"))
        .drop("_files")
        .write.partitionBy("period")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if kept else "static")
        .parquet(path)
    )
    manifest = wanted.withColumn("columns", F.array(*[F.lit(c) for c in columns]))
    manifest.write.mode("overwrite").parquet(f"{path}/_manifest")
    written = spark.read.parquet(path)
    return written.groupBy("period").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col(available), 1)).alias("available_rows"),
        F.count(F.when(~F.col(available), 1)).alias("imputed_rows"),
    )


def remove_folder(spark: SparkSession, url: str) -> None:
    """Delete a folder given as the URL of a file that Spark has read there."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(url))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows, digest and columns of each period as last written."""
    return spark.read.parquet(f"{path}/_manifest")


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing is there; other errors are raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def to_wide(
    rows: DataFrame,
    value: str,
    symbols: Sequence[str] | None = None,
    day: str = "trading_date",
) -> DataFrame:
    """Long rows to one row per day (``value`` = yyyymmdd) and a column per symbol.

    One table with a column per symbol, so Spark's pivot limit applies; beyond it see
    :func:`write_wide_parts`.
    """
    keyed = rows.select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("value"), "symbol", F.col(value).alias("_v")
    )
    pivot = keyed.groupBy("value").pivot("symbol", list(symbols) if symbols else None)
    return pivot.agg(F.first("_v"))


def write_wide_parts(
    rows: DataFrame,
    value: str,
    path: str,
    width: int = 1000,
    day: str = "trading_date",
) -> DataFrame:
    """Long rows as several wide tables of at most ``width`` symbols each, for any number of symbols.

    Every folder ``part-<n>`` holds a wide table with all days; the table ``_symbols`` (symbol, part,
    slot) tells where a symbol is, so that a reader opens only the folders and columns it wants.
    Symbols are dealt in their order; rows without a symbol have no column. The columns of all parts
    bear the numbers of their slots (``s0``, ``s1``...), so that one job writes every part and one scan
    reads them; no name comes to the driver. Returns (symbol, part, slot).
    """
    spark = rows.sparkSession
    keyed = settle(
        rows.select(
            F.date_format(day, "yyyyMMdd").cast("int").alias("value"),
            "symbol",
            F.col(value).alias("_v"),
        ),
        "long",
    )
    names = keyed.where("symbol is not null").select("symbol").distinct()
    place = F.col("_pos") - 1
    ordinal(names, [], [F.col("symbol")], pos="_pos").select(
        "symbol",
        F.floor(place / width).cast("int").alias("part"),
        F.pmod(place, F.lit(width)).cast("int").alias("slot"),
    ).write.mode("overwrite").parquet(f"{path}/_symbols")
    placed = spark.read.parquet(f"{path}/_symbols")
    last, widest = placed.agg(F.max("part"), F.max("slot")).first()
    if last is None:
        _place_parts(spark, path, 0)
        return placed
    slots = list(range(widest + 1))
    # A row without a slot for each day of each part: every part has all days.
    every = keyed.select("value").distinct().crossJoin(placed.select("part").distinct())
    cells = keyed.join(placed, "symbol").select("part", "value", "slot", "_v").unionByName(
        every, allowMissingColumns=True
    )
    # Pivoted inside the ranges, of which each holds whole days of few parts.
    wide = (
        cells.repartitionByRange("part", "value")
        .groupBy("part", "value")
        .pivot("slot", slots)
        .agg(F.first("_v"))
        .toDF("part", "value", *[f"s{slot}" for slot in slots])
    )
    wide.withColumn("_folder", F.col("part")).write.mode("overwrite").partitionBy(
        "_folder"
    ).parquet(f"{path}/_dealt")
    _place_parts(spark, path, last + 1)
    return placed


def _place_parts(spark: SparkSession, path: str, parts: int) -> None:
    """Give the folders of the parts just written their names, in the place of any parts before."""
    jvm = spark.sparkContext._jvm
    named = jvm.org.apache.hadoop.fs.Path
    fs = named(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for held in fs.listStatus(named(path)):
        if held.getPath().getName().startswith("part-"):
            fs.delete(held.getPath(), True)
    for part in range(parts):
        if not fs.rename(named(f"{path}/_dealt/_folder={part}"), named(part_path(path, part))):
            raise OSError(f"part {part} of {path} was not placed")
    fs.delete(named(path, "_dealt"), True)


def part_path(path: str, part: int) -> str:
    return f"{path}/part-{part:05d}"


def write_portfolio(
    tables: Mapping[str, DataFrame], summary: DataFrame, path: str
) -> dict[str, str]:
    """Daily, holdings and trade tables as Parquet and the summary as JSON lines."""
    written = {}
    for name in PORTFOLIO_TABLES:
        written[name] = f"{path}/{name}"
        tables[name].write.mode("overwrite").parquet(written[name])
    written["summary"] = f"{path}/summary"
    summary.write.mode("overwrite").json(written["summary"])
    return written


def write_predictions(rows: DataFrame, path: str, contract: Mapping[str, str]) -> None:
    """Prediction rows whose contract travels as metadata of the score column."""
    described = rows.withColumn("score", F.col("score").alias("score", metadata=dict(contract)))
    described.write.mode("overwrite").parquet(path)


def read_contract(spark: SparkSession, path: str) -> dict[str, str]:
    return dict(spark.read.parquet(path).schema["score"].metadata)


def feature_vectors(
    rows: DataFrame, keys: Sequence[str], features: Sequence[str], available: str
) -> DataFrame:
    """Key, one float array and the availability flag."""
    return rows.select(
        *keys,
        F.array(*[F.col(c).cast("float") for c in features]).alias("features"),
        F.col(available).alias("feature_available"),
    )


def sharded(rows: DataFrame, order: Sequence[str], rows_per_shard: int) -> DataFrame:
    """Shard number and row inside the shard from the global order of the rows."""
    placed = ordinal(rows, [], [F.col(c) for c in order], pos="_pos")
    index = F.col("_pos") - 1
    return placed.withColumns(
        {
            "shard": F.floor(index / rows_per_shard),
            "shard_row": F.pmod(index, F.lit(rows_per_shard)),
        }
    ).drop("_pos")


def write_sharded(rows: DataFrame, path: str, order: Sequence[str], rows_per_shard: int) -> None:
    """One folder per shard, at most ``rows_per_shard`` rows per file."""
    (
        sharded(rows, order, rows_per_shard)
        .repartition("shard")
        .write.partitionBy("shard")
        .option("maxRecordsPerFile", rows_per_shard)
        .mode("overwrite")
        .parquet(path)
    )
