"""Zone maps: scattered targets open the files that hold them, and no others."""

from pyspark.sql import functions as F
from table_rows import day, rows

from tapeloom.sources import files, zones

MINUTES = "date int, ticker string, minute int, seq int, order__price double"


def cache(spark, tmp_path):
    """One file per day, 40 days of 30 symbols; the folder names need escaping in URLs."""
    paths = []
    for d in range(40):
        part = [(19960101 + d, f"{s:06d}", 5, s, float(d)) for s in range(30)]
        paths.append(str(tmp_path / f"minutes of day {d}"))
        spark.createDataFrame(part, MINUTES).coalesce(1).write.parquet(paths[-1])
    placed = zones.write_zone_map(
        spark, paths, F.col("date"), F.col("ticker"), str(tmp_path / "zones")
    )
    return paths, placed


def test_far_days_read_their_files_only(spark, tmp_path):
    paths, placed = cache(spark, tmp_path)
    targets = spark.createDataFrame(
        [(19960101, "000003"), (19960139, "000004"), (19960120, "999999")],
        "date int, ticker string",
    )
    got = files.read_minute_cache(spark, paths, "order", targets, placed)
    assert len(got.inputFiles()) in (2, 3)  # 999999 may share a slot with a symbol of its day
    assert rows(got, "date", "ticker", "order__price") == [
        (19960101, "000003", 0.0),
        (19960139, "000004", 38.0),
    ]
    asked = targets.limit(2).selectExpr("date AS day", "ticker AS symbol")
    assert rows(zones.zone_report(placed, asked), "wanted", "files", "rows") == [
        (False, 38, 1140),
        (True, 2, 60),
    ]


def test_targets_that_no_file_holds_give_no_rows(spark, tmp_path):
    paths, placed = cache(spark, tmp_path)
    targets = spark.createDataFrame([(20200101, "000003")], "date int, ticker string")
    assert zones.wanted_paths(placed, targets.selectExpr("date AS day", "ticker AS symbol")) == []
    assert files.read_minute_cache(spark, paths, "order", targets, placed).count() == 0


def test_rows_without_a_key_count_but_match_nothing(spark, tmp_path):
    path = str(tmp_path / "book")
    spark.createDataFrame(
        [(19960101, "7", 1, 1, 2.0), (None, "7", 1, 2, 2.0), (19960101, None, 1, 3, 2.0)],
        "TradingDay int, ticker string, time_ms int, seq int, ask_price1 double",
    ).coalesce(1).write.parquet(path)
    from tapeloom.functions.scalars import pad_symbol, parse_day

    placed = zones.write_zone_map(
        spark, [path], parse_day(F.col("TradingDay")), pad_symbol(F.col("ticker")), str(tmp_path / "z")
    )
    assert placed.agg(F.sum("rows")).first()[0] == 3
    targets = spark.createDataFrame(
        [(day(0).replace(1996, 1, 1), "000007")], "trading_date date, symbol string"
    )
    got = files.read_book_months(spark, [path], targets, 0, 10, ["ask_price1"], placed)
    assert [r["seq"] for r in got.collect()] == [1]
