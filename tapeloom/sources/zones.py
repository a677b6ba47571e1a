"""Zone maps: which file holds which days and symbols, so that scattered targets open few files.

The bounds of a column (file footers, a range of days) help only where targets lie together. A zone
map is built once from the files and has one row per (file, day): the rows, and the slots that the
hashes of its symbols fall into, at most ``SLOTS`` numbers. A file without a wanted slot on a wanted
day cannot hold a wanted row; one that has it by chance costs a read and changes no result.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 4096


def _slot(symbol: Column) -> Column:
    return F.pmod(F.xxhash64(symbol.cast("string")), F.lit(SLOTS)).cast("int")


def write_zone_map(
    spark: SparkSession, paths: Sequence[str], day: Column, symbol: Column, path: str
) -> DataFrame:
    """Write (file, day, rows, slots) of the Parquet files at ``paths``; reads two columns only.

    ``day`` and ``symbol`` give the key in the form in which targets will state it. Rows without a
    day or symbol match no target and only count.
    """
    raw = spark.read.parquet(*paths)
    keyed = raw.select(
        F.col("_metadata.file_path").alias("file"),
        day.alias("day"),
        F.when(symbol.isNotNull(), _slot(symbol)).alias("slot"),
    )
    (
        keyed.groupBy("file", "day", "slot")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("file", "day")
        .agg(F.sum("rows").alias("rows"), F.sort_array(F.collect_list("slot")).alias("slots"))
        .write.mode("overwrite")
        .parquet(path)
    )
    return spark.read.parquet(path)


def zones_wanted(zones: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, rows, wanted) of every file; ``wanted`` has the columns day and symbol."""
    asked = wanted.select("day", _slot(F.col("symbol")).alias("slot")).distinct()
    held = zones.select("file", "day", F.explode("slots").alias("slot"))
    hit = held.join(asked, ["day", "slot"], "left_semi").select("file").distinct()
    files = zones.groupBy("file").agg(F.sum("rows").alias("rows"))
    return files.join(hit.withColumn("_hit", F.lit(True)), "file", "left").select(
        "file", "rows", F.coalesce("_hit", F.lit(False)).alias("wanted")
    )


def zone_report(zones: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files and rows that a read for ``wanted`` scans and skips, as (wanted, files, rows)."""
    return (
        zones_wanted(zones, wanted)
        .groupBy("wanted")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))
    )


def wanted_paths(zones: DataFrame, wanted: DataFrame) -> list[str]:
    """Paths of the files to open for ``wanted``: the list that a read is given anyway."""
    rows = zones_wanted(zones, wanted).where("wanted").select("file").collect()
    return sorted(unquote(r["file"]) for r in rows)
