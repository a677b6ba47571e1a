"""Queries over book snapshots (B) and minute features (M), and their file sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.catalog import fixtures as fx
from tapeloom.catalog.fixtures import define_view, with_sql
from tapeloom.catalog.panel import SPLIT, scratch
from tapeloom.catalog.registry import query, rounded
from tapeloom.functions.scalars import modality_columns, session_timestamp, valid_book
from tapeloom.operators import book as bk
from tapeloom.operators import labels as lab
from tapeloom.operators import minute as mn
from tapeloom.plans.shared import settle
from tapeloom.sinks import tables as sink
from tapeloom.sources import files, zones

PRICES = ("ask_price1", "bid_price1", "ask_price2", "bid_price2")
VOLUMES = ("ask_volume1", "bid_volume1", "ask_volume2", "bid_volume2")
START_MS, SIGNAL_MS = 0, 15_000_000


def book(spark, sf_dir):
    """Two-level book from the lines; a stock-day is a supplier's month.

    Lines without a discount have no bid and are invalid.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    bid = F.when(F.col("l_discount") == 0, 0.0).otherwise(price * (1 - F.col("l_discount")))
    ask = price * (1 + F.col("l_discount"))
    size = F.col("l_quantity")
    time = F.pmod(F.col("l_orderkey") * 1009 + F.col("l_partkey") * 31, F.lit(20_000_000)) - 300_000
    return fx.table(spark, sf_dir, "lineitem").select(
        F.trunc("l_shipdate", "month").alias("trading_date"),
        fx.pad_symbol(F.col("l_suppkey")).alias("symbol"),
        time.cast("int").alias("time_ms"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"),
        ask.alias("ask_price1"),
        bid.alias("bid_price1"),
        (ask * 1.5).alias("ask_price2"),
        (bid * 0.5).alias("bid_price2"),
        size.alias("ask_volume1"),
        (size * 2).alias("bid_volume1"),
        (size + 1).alias("ask_volume2"),
        (size + 2).alias("bid_volume2"),
    )


def book_targets(spark, sf_dir):
    """Supplier-months of suppliers with an account balance below 5000."""
    rich = fx.table(spark, sf_dir, "supplier").where("s_acctbal < 5000").select(
        fx.pad_symbol(F.col("s_suppkey")).alias("symbol")
    )
    months = fx.table(spark, sf_dir, "lineitem").select(
        F.trunc("l_shipdate", "month").alias("trading_date"),
        fx.pad_symbol(F.col("l_suppkey")).alias("symbol"),
    )
    return months.distinct().join(rich, "symbol", "left_semi")


define_view(
    "book",
    (),
    """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS trading_date,
      CASE WHEN length(CAST(l_suppkey AS VARCHAR)) >= 6 THEN CAST(l_suppkey AS VARCHAR)
        ELSE lpad(CAST(l_suppkey AS VARCHAR), 6, '0') END AS symbol,
      CAST((l_orderkey * 1009 + l_partkey * 31) % 20000000 - 300000 AS INTEGER) AS time_ms,
      l_orderkey, l_linenumber, l_partkey, l_extendedprice,
      l_extendedprice / l_quantity * (1 + l_discount) AS ask_price1,
      CASE WHEN l_discount = 0 THEN 0.0 ELSE l_extendedprice / l_quantity * (1 - l_discount) END
        AS bid_price1,
      l_extendedprice / l_quantity * (1 + l_discount) * 1.5 AS ask_price2,
      CASE WHEN l_discount = 0 THEN 0.0 ELSE l_extendedprice / l_quantity * (1 - l_discount) END
        * 0.5 AS bid_price2,
      l_quantity AS ask_volume1, l_quantity * 2 AS bid_volume1, l_quantity + 1 AS ask_volume2,
      l_quantity + 2 AS bid_volume2 FROM lineitem""",
)
define_view(
    "btarget",
    ("book",),
    """SELECT DISTINCT trading_date, symbol FROM book WHERE symbol IN (
      SELECT CASE WHEN length(CAST(s_suppkey AS VARCHAR)) >= 6 THEN CAST(s_suppkey AS VARCHAR)
        ELSE lpad(CAST(s_suppkey AS VARCHAR), 6, '0') END FROM supplier WHERE s_acctbal < 5000)""",
)
define_view(
    "bwin",
    ("btarget",),
    """SELECT b.* FROM book b SEMI JOIN btarget t ON b.trading_date = t.trading_date
      AND b.symbol = t.symbol WHERE time_ms >= 0 AND time_ms < 15000000""",
)
define_view(
    "btail",
    ("bwin",),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trading_date, symbol ORDER BY
      time_ms DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC)
      AS place FROM bwin WHERE bid_price1 > 0) WHERE place <= 4""",
)
define_view(
    "bnorm",
    ("btail",),
    """SELECT trading_date, symbol, place, """
    + ", ".join(
        [
            f"least(greatest(({c} / mid - 1.0) * 10000.0 / 100.0, -32.0), 32.0) AS {c}"
            for c in PRICES
        ]
        + [f"ln(1 + {c}) / 16.0 AS {c}" for c in VOLUMES]
    )
    + """ FROM (SELECT *, first_value((ask_price1 + bid_price1) / 2.0) OVER (
      PARTITION BY trading_date, symbol ORDER BY place DESC) AS mid FROM btail)""",
)


def windowed(spark, sf_dir):
    return bk.target_window(
        book(spark, sf_dir), book_targets(spark, sf_dir), START_MS, SIGNAL_MS
    )


def tail(spark, sf_dir):
    return bk.tail_events(windowed(spark, sf_dir), 4, PRICES, VOLUMES)


def normalized(spark, sf_dir):
    return bk.normalize_tail(tail(spark, sf_dir), PRICES, VOLUMES, "bid_price1", "ask_price1")


@query(
    "S7_book_months",
    with_sql("bwin")
    + "SELECT trading_date, symbol, time_ms, l_orderkey AS line, ask_price1, bid_volume2 FROM bwin",
)
def book_months(spark, sf_dir):
    root = scratch(spark, "book")
    raw = book(spark, sf_dir).select(
        F.date_format("trading_date", "yyyyMMdd").cast("int").alias("TradingDay"),
        F.col("symbol").cast("long").cast("string").alias("ticker"),
        "time_ms",
        "seq",
        "ask_price1",
        "bid_volume2",
    )
    paths = []
    for half, keep in (("early", "TradingDay < 19980701"), ("late", "TradingDay >= 19980701")):
        paths.append(f"{root}/{half}.parquet")
        raw.where(keep).write.parquet(paths[-1])
    rows = files.read_book_months(
        spark, paths, book_targets(spark, sf_dir), START_MS, SIGNAL_MS, ["ask_price1", "bid_volume2"]
    )
    return rows.select(
        "trading_date",
        "symbol",
        "time_ms",
        F.col("seq.l_orderkey").alias("line"),
        "ask_price1",
        "bid_volume2",
    )


@query(
    "S8_book_month_fallback",
    with_sql("book")
    + """SELECT trading_date, count(*) AS rows, CAST(sum(ask_volume1) AS BIGINT) AS size
    FROM book GROUP BY trading_date""",
)
def book_fallback(spark, sf_dir):
    """Odd months have a whole file, even months only day files."""
    root = scratch(spark, "months")
    month, day = (F.date_format("trading_date", f) for f in ("yyyyMM", "yyyyMMdd"))
    odd = F.month("trading_date") % 2 == 1
    file = F.concat(F.lit("snapshot_"), F.when(odd, month).otherwise(day), F.lit(".parquet"))
    rows = book(spark, sf_dir).select("trading_date", "symbol", "ask_volume1", file.alias("file"))
    rows.write.partitionBy("file").parquet(root)
    dates = [  # one per month
        r["trading_date"] for r in spark.read.parquet(root).select("trading_date").distinct().collect()
    ]
    paths, _ = files.resolve_book_paths(
        spark,
        root,
        sorted(d.strftime("%Y%m") for d in dates),
        sorted(d.strftime("%Y%m%d") for d in dates),
    )
    return (
        spark.read.parquet(*paths)
        .groupBy("trading_date")
        .agg(
            F.count(F.lit(1)).alias("rows"), F.sum("ask_volume1").cast("bigint").alias("size")
        )
    )


@query(
    "B1_tail_events",
    with_sql("btail")
    + """SELECT trading_date, symbol, time_ms, l_orderkey AS line, place, ask_price1 FROM btail""",
)
def tail_query(spark, sf_dir):
    return tail(spark, sf_dir).select(
        "trading_date", "symbol", "time_ms", F.col("seq.l_orderkey").alias("line"), "place", "ask_price1"
    )


@query(
    "B2_target_window",
    with_sql("bwin") + "SELECT trading_date, symbol, time_ms, l_orderkey AS line FROM bwin",
)
def target_window(spark, sf_dir):
    return windowed(spark, sf_dir).select(
        "trading_date", "symbol", "time_ms", F.col("seq.l_orderkey").alias("line")
    )


@query(
    "B3_normalize_tail",
    with_sql("bnorm")
    + "SELECT trading_date, symbol, place, "
    + ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in PRICES + VOLUMES)
    + " FROM bnorm",
)
def normalize(spark, sf_dir):
    rows = normalized(spark, sf_dir)
    return rows.select(
        "trading_date", "symbol", "place", *[rounded(c).alias(c) for c in PRICES + VOLUMES]
    )


@query(
    "B4_extraction_report",
    with_sql("btail")
    + """SELECT count(*) AS requested, count(*) FILTER (WHERE n >= 3) AS written,
      count(*) FILTER (WHERE n IS NULL) AS missing, count(*) FILTER (WHERE n < 3) AS insufficient,
      (SELECT count(*) FROM bwin WHERE NOT bid_price1 > 0) AS invalid_rows
    FROM btarget LEFT JOIN (SELECT trading_date, symbol, count(*) AS n FROM btail
      GROUP BY trading_date, symbol) USING (trading_date, symbol)""",
)
def report(spark, sf_dir):
    targets = settle(book_targets(spark, sf_dir), "targets")
    rows = bk.target_window(book(spark, sf_dir), targets, START_MS, SIGNAL_MS)
    kept = bk.tail_events(rows, 4, PRICES, VOLUMES)
    return bk.extraction_report(targets, rows, kept, 3, ~valid_book(PRICES, VOLUMES))


SUMMARY_COLUMNS = ("ask_price1", "bid_price2", "bid_volume1")


def _summary_sql(columns, order, view, keys):
    parts = []
    for c in columns:
        last, first = f"arg_max({c}, {order})", f"arg_min({c}, {order})"
        parts += [
            f"round(avg({c}), 8) + 0.0 AS {c}__mean",
            f"round(stddev_pop({c}), 8) + 0.0 AS {c}__std",
            f"round({last}, 8) + 0.0 AS {c}__last",
            f"round({last} - {first}, 8) + 0.0 AS {c}__change",
        ]
    return f"SELECT {keys}, {', '.join(parts)} FROM {view} GROUP BY {keys}"


@query(
    "B5_sequence_summary",
    with_sql("bnorm")
    + _summary_sql(SUMMARY_COLUMNS, "-place", "bnorm", "trading_date, symbol"),
)
def sequence_summary(spark, sf_dir):
    out = bk.sequence_summary(normalized(spark, sf_dir), SUMMARY_COLUMNS, -F.col("place"))
    return _round_all(out, bk.STOCK_DAY)


def _round_all(rows, keys, places=8):
    return rows.select(
        *keys, *[rounded(c, places).alias(c) for c in rows.columns if c not in keys]
    )


@query(
    "B6_leakage_violations",
    with_sql("btail")
    + """, s AS (SELECT trading_date, symbol, max(time_ms) AS t, count(*) AS n FROM btail
      GROUP BY trading_date, symbol)
    SELECT trading_date, symbol, CASE WHEN t > 14000000 THEN 'event after signal'
      ELSE 'label not after input' END AS reason FROM s WHERE t > 14000000 OR n = 2""",
)
def leakage(spark, sf_dir):
    samples = (
        tail(spark, sf_dir)
        .groupBy("trading_date", "symbol")
        .agg(F.max("time_ms").alias("t"), F.count(F.lit(1)).alias("n"))
    )
    day = F.col("trading_date")
    stamped = samples.select(
        "trading_date",
        "symbol",
        session_timestamp(day, F.col("t")).alias("last_event_timestamp"),
        session_timestamp(day, F.lit(14_000_000)).alias("signal_timestamp"),
        F.when(F.col("n") == 2, day).otherwise(F.date_add(day, 1)).alias("label_date"),
    )
    return bk.leakage_violations(stamped).select("trading_date", "symbol", "reason")


define_view(
    "seg",
    (),
    """SELECT l_suppkey AS segment, CAST(l_suppkey % 9 + 1 AS INTEGER) AS fold,
      CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS role,
      l_quantity AS quantity, CAST(l_linenumber % 3 + 1 AS DOUBLE) AS raw_label,
      l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem""",
)


def segments(spark, sf_dir):
    """Lines as feature rows; a supplier is a segment of fold 1..9."""
    return fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("segment"),
        (F.col("l_suppkey") % 9 + 1).cast("int").alias("fold"),
        F.when(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"), "train")
        .otherwise("test")
        .alias("role"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_linenumber") % 3 + 1).cast("double").alias("raw_label"),
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
    )


LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(
    "B7_sliding_windows",
    with_sql("seg")
    + """, p AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY segment) AS n,
      array_to_string(list(CAST(quantity AS BIGINT)) OVER (PARTITION BY segment ORDER BY
        l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice
        ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS window_values FROM seg
      WHERE role = 'train' AND fold = 7 WINDOW w AS (PARTITION BY segment ORDER BY l_shipdate,
        l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
    q AS (SELECT *, pos - 5 AS window_index,
      (n - 4) - greatest(1, CAST(floor((n - 4) * 0.2) AS BIGINT)) AS start FROM p WHERE pos >= 5)
    SELECT segment, window_index, CASE WHEN window_index >= start THEN 'val' ELSE 'train' END
      AS role, window_values, CAST(raw_label - 1 AS INTEGER) AS label FROM q
    WHERE window_index >= start OR window_index < start - 4""",
)
def windows(spark, sf_dir):
    rows = bk.select_segments(segments(spark, sf_dir), "setup2", "train")
    out = bk.sliding_windows(
        rows,
        ["segment"],
        [F.col(c) for c in LINE_ORDER],
        F.col("quantity"),
        bk.normalise_label(F.col("raw_label")),
        window=5,
        validation_share=0.2,
    )
    text = F.concat_ws(",", F.transform("values", lambda v: v.cast("bigint").cast("string")))
    return out.select("segment", "window_index", "role", text.alias("window_values"), "label")


@query(
    "B8_select_segments",
    with_sql("seg")
    + """SELECT fold, role, CAST(raw_label - 1 AS INTEGER) AS label, count(*) AS rows FROM seg
    WHERE role = 'test' AND fold IN (7, 8, 9) GROUP BY ALL""",
)
def segment_choice(spark, sf_dir):
    rows = bk.select_segments(segments(spark, sf_dir), "setup2", "test")
    label = bk.normalise_label(F.col("raw_label")).alias("label")
    return rows.groupBy("fold", "role", label).agg(F.count(F.lit(1)).alias("rows"))


# ---- minutes ---------------------------------------------------------------

MODALITIES = ("order", "trade", "snap")
FEATURES = tuple(f"{m}__{f}" for m in MODALITIES for f in ("price", "size"))


def minutes(spark, sf_dir):
    """Minute rows per supplier-quarter; the return flag decides the modality."""
    flag = F.col("l_returnflag")
    price = F.sqrt(F.col("l_extendedprice") / F.col("l_quantity"))
    modality = F.when(flag == "A", "order").when(flag == "N", "trade").otherwise("snap")
    base = fx.table(spark, sf_dir, "lineitem").select(
        F.date_format(F.trunc("l_shipdate", "quarter"), "yyyyMMdd").cast("int").alias("date"),
        fx.pad_symbol(F.col("l_suppkey")).alias("ticker"),
        (F.col("l_linenumber") + 890).cast("int").alias("minute"),
        F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_extendedprice").alias("seq"),
        modality.alias("modality"),
        price.alias("price"),
        F.when(F.col("l_discount") == 0.05, F.lit(float("nan")))
        .otherwise(F.col("l_quantity"))
        .alias("size"),
    )
    return base


def modality_frames(rows, keep):
    out = []
    for m in MODALITIES:
        part = rows.where(F.col("modality") == m).select(
            "date",
            "ticker",
            "minute",
            "seq",
            F.col("price").alias(f"{m}__price"),
            F.col("size").alias(f"{m}__size"),
        )
        out.append(mn.last_per_minute(part, [f"{m}__price", f"{m}__size"], keep))
    return out


define_view(
    "mins",
    (),
    """SELECT CAST(strftime(date_trunc('quarter', l_shipdate), '%Y%m%d') AS INTEGER) AS date,
      CASE WHEN length(CAST(l_suppkey AS VARCHAR)) >= 6 THEN CAST(l_suppkey AS VARCHAR)
        ELSE lpad(CAST(l_suppkey AS VARCHAR), 6, '0') END AS ticker,
      CAST(l_linenumber + 890 AS INTEGER) AS minute,
      CASE l_returnflag WHEN 'A' THEN 'order' WHEN 'N' THEN 'trade' ELSE 'snap' END AS modality,
      sqrt(l_extendedprice / l_quantity) AS price,
      CASE WHEN l_discount = 0.05 THEN CAST('nan' AS DOUBLE) ELSE l_quantity END AS size,
      l_shipdate, l_orderkey, l_partkey, l_extendedprice FROM lineitem""",
)
define_view(
    "mlast",
    ("mins",),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY modality, date, ticker
        ORDER BY minute DESC) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY modality, date, ticker, minute ORDER BY
        l_shipdate DESC, l_orderkey DESC, l_partkey DESC, l_extendedprice DESC) AS dup FROM mins)
      WHERE dup = 1) WHERE place <= 6""",
)
define_view(
    "mmerged",
    ("mlast",),
    """SELECT * EXCLUDE (place) FROM (SELECT o.date, o.ticker, o.minute, o.price AS order__price,
      o.size AS order__size, t.price AS trade__price, t.size AS trade__size,
      s.price AS snap__price, s.size AS snap__size,
      row_number() OVER (PARTITION BY o.date, o.ticker ORDER BY o.minute DESC) AS place
    FROM (SELECT * FROM mlast WHERE modality = 'order') o
    JOIN (SELECT * FROM mlast WHERE modality = 'trade') t USING (date, ticker, minute)
    JOIN (SELECT * FROM mlast WHERE modality = 'snap') s USING (date, ticker, minute))
    WHERE place <= 4""",
)
define_view(
    "msum",
    ("mmerged",),
    "SELECT date, ticker, count(*) AS minutes, "
    + ", ".join(
        f"avg({c}) AS {c}__mean, stddev_pop({c}) AS {c}__std, arg_max({c}, minute) AS {c}__last,"
        f" arg_max({c}, minute) - arg_min({c}, minute) AS {c}__change"
        for c in FEATURES
        if c.endswith("price")
    )
    + ", avg(order__size) AS order__size__mean, arg_max(trade__size, minute) AS trade__size__last"
    " FROM mmerged GROUP BY date, ticker",
)
define_view(
    "mtarget",
    ("mins",),
    """SELECT DISTINCT s.ticker, d.date FROM (SELECT DISTINCT ticker FROM mins) s,
      (SELECT DISTINCT date FROM mins) d""",
)


def minute_targets(rows):
    """Every quarter for each supplier, whether it traded or not."""
    quarters = rows.select("date").distinct()
    listed = quarters.agg(F.sort_array(F.collect_list("date"))).scalar()  # one per quarter
    return rows.select("ticker").distinct().select("ticker", F.explode(listed).alias("date"))


def merged(spark, sf_dir):
    return mn.merge_modalities(modality_frames(minutes(spark, sf_dir), 6), 4)


NAN_SAFE = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"


def _no_nan(name):
    return F.when(F.isnan(name), F.lit(None)).otherwise(F.col(name))


MODALITIES = ("order", "trade", "snap")


@query(
    "S5_minute_cache",
    with_sql("mins", "mtarget")
    + """SELECT modality, m.date, m.ticker, m.minute, l_orderkey AS line, price,
      CASE WHEN isnan(size) THEN NULL ELSE size END AS size
    FROM mins m SEMI JOIN mtarget t ON m.date = t.date AND m.ticker = t.ticker""",
)
def minute_cache(spark, sf_dir):
    """Two yearly files per modality, each with a column of another one; every modality is read."""
    root = scratch(spark, "cache")
    rows = settle(minutes(spark, sf_dir), "minutes")
    targets = settle(minute_targets(rows), "targets")
    out = None
    for name in MODALITIES:
        own = rows.where(F.col("modality") == name).select(
            "date",
            "ticker",
            "minute",
            "seq",
            F.col("price").alias(f"{name}__price"),
            F.col("size").alias(f"{name}__size"),
            F.lit(True).alias(f"{name}__valid"),
            F.col("price").alias("index__price"),
        )
        paths = []
        for half, keep in (("a", "date < 19980701"), ("b", "date >= 19980701")):
            paths.append(f"{root}/{name}-{half}.parquet")
            own.where(keep).write.parquet(paths[-1])
        read = files.read_minute_cache(spark, paths, name, targets).select(
            F.lit(name).alias("modality"),
            "date",
            "ticker",
            "minute",
            F.col("seq.l_orderkey").alias("line"),
            F.col(f"{name}__price").alias("price"),
            _no_nan(f"{name}__size").alias("size"),
        )
        out = read if out is None else out.unionByName(read)
    return out


def zoned_cache(spark, sf_dir):
    """Per modality: paths with a file per quarter, their zone map, and the scattered targets.

    Targets are all stock-days of the first quarters of even years, traded or not.
    """
    root = scratch(spark, "zoned")
    rows = settle(minutes(spark, sf_dir), "minutes")
    scattered = (F.floor(F.col("date") / 10000) % 2 == 0) & (F.col("date") % 10000 == 101)
    targets = settle(minute_targets(rows).where(scattered), "targets")
    for name in MODALITIES:
        path = f"{root}/{name}"
        rows.where(F.col("modality") == name).select(
            "date",
            "ticker",
            "minute",
            "seq",
            F.col("price").alias(f"{name}__price"),
            F.col("size").alias(f"{name}__size"),
            F.col("date").alias("quarter"),
        ).repartition("quarter").write.partitionBy("quarter").parquet(path)
        placed = zones.write_zone_map(
            spark, [path], F.col("date"), F.col("ticker"), scratch(spark, f"zones-{name}")
        )
        yield name, path, placed, targets


SCATTERED = "date // 10000 % 2 = 0 AND date % 10000 = 101"


@query(
    "S5_zone_map_read",
    with_sql("mins")
    + f"""SELECT modality, date, ticker, minute, l_orderkey AS line, price,
      CASE WHEN isnan(size) THEN NULL ELSE size END AS size
    FROM mins WHERE {SCATTERED}""",
)
def zone_map_read(spark, sf_dir):
    """Days that lie years apart, read from the files that hold them."""
    read = [
        files.read_minute_cache(spark, [path], name, targets, placed).select(
            F.lit(name).alias("modality"),
            "date",
            "ticker",
            "minute",
            F.col("seq.l_orderkey").alias("line"),
            F.col(f"{name}__price").alias("price"),
            _no_nan(f"{name}__size").alias("size"),
        )
        for name, path, placed, targets in zoned_cache(spark, sf_dir)
    ]
    return reduce(DataFrame.unionByName, read)


@query(
    "S5_zone_map_report",
    with_sql("mins")
    + f"""SELECT modality, ({SCATTERED}) AS wanted, count(DISTINCT date) AS files,
      count(*) AS rows FROM mins GROUP BY modality, wanted""",
)
def zone_map_report(spark, sf_dir):
    """Files and rows that a read of the scattered days scans and skips."""
    reports = []
    for name, _, placed, targets in zoned_cache(spark, sf_dir):
        asked = targets.select(F.col("date").alias("day"), F.col("ticker").alias("symbol"))
        reports.append(zones.zone_report(placed, asked).withColumn("modality", F.lit(name)))
    return reduce(DataFrame.unionByName, reports)


@query(
    "S6_trade_date_minutes",
    with_sql("mins", "mtarget")
    + """SELECT modality, m.date, m.ticker, m.minute, price AS close FROM mins m
    SEMI JOIN mtarget t ON m.date = t.date AND m.ticker = t.ticker""",
)
def trade_date_minutes(spark, sf_dir):
    """One folder of days per modality; every modality is read."""
    root = scratch(spark, "minutes")
    rows = settle(minutes(spark, sf_dir), "minutes")
    targets = settle(minute_targets(rows), "targets")
    day = F.to_timestamp_ntz(F.col("date").cast("string"), F.lit("yyyyMMdd"))
    out = None
    for name in MODALITIES:
        rows.where(F.col("modality") == name).select(
            F.col("date").alias("trade_date"),
            F.concat("ticker", F.lit(".SZ")).alias("ts_code"),
            (day + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minute"))).alias("trade_time"),
            "seq",
            F.col("price").alias("close"),
        ).write.partitionBy("trade_date").parquet(f"{root}/{name}")
        read = files.read_trade_date_minutes(spark, f"{root}/{name}", targets, ["close"]).select(
            F.lit(name).alias("modality"), "date", "ticker", "minute", "close"
        )
        out = read if out is None else out.unionByName(read)
    return out


@query(
    "M1_last_per_minute",
    with_sql("mlast")
    + """SELECT modality, date, ticker, minute, price,
      CASE WHEN isnan(size) THEN NULL ELSE size END AS size FROM mlast""",
)
def last_per_minute(spark, sf_dir):
    frames = modality_frames(minutes(spark, sf_dir), 6)
    out = None
    for m, frame in zip(MODALITIES, frames, strict=True):
        part = frame.select(
            F.lit(m).alias("modality"),
            "date",
            "ticker",
            "minute",
            F.col(f"{m}__price").alias("price"),
            _no_nan(f"{m}__size").alias("size"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "M2_merge_modalities",
    with_sql("mmerged")
    + "SELECT date, ticker, minute, "
    + ", ".join(f"{NAN_SAFE.format(c)} AS {c}" for c in FEATURES)
    + " FROM mmerged",
)
def merge_modalities(spark, sf_dir):
    return merged(spark, sf_dir).select(
        "date", "ticker", "minute", *[_no_nan(c).alias(c) for c in FEATURES]
    )


SUMMARY_NAMES = [
    f"{c}__{k}" for c in FEATURES if c.endswith("price") for k in ("mean", "std", "last", "change")
] + ["order__size__mean", "trade__size__last"]


@query(
    "M3_trailing_summary",
    with_sql("msum")
    + "SELECT date, ticker, minutes, "
    + ", ".join(
        f"round(CASE WHEN isnan({c}) THEN NULL ELSE {c} END, 5) + 0.0 AS {c}" for c in SUMMARY_NAMES
    )
    + " FROM msum",
)
def trailing_summary(spark, sf_dir):
    out = mn.trailing_summary(merged(spark, sf_dir), FEATURES)
    return out.select(
        "date", "ticker", "minutes", *[F.round(_no_nan(c), 5).alias(c) for c in SUMMARY_NAMES]
    )


def samples(spark, sf_dir):
    rows = minutes(spark, sf_dir)
    return mn.build_samples(
        merged(spark, sf_dir), minute_targets(rows), FEATURES, window_minutes=3, min_minutes=2
    )


define_view(
    "msamp",
    ("mtarget", "mmerged"),
    """SELECT date, ticker, minutes, order__price__mean, snap__price__change,
      CASE WHEN minutes IS NULL THEN 'missing rows' WHEN minutes < 2 THEN 'insufficient window'
        ELSE 'written' END AS status
    FROM mtarget LEFT JOIN (SELECT date, ticker, count(*) AS minutes,
      avg(order__price) AS order__price__mean,
      arg_max(snap__price, minute) - arg_min(snap__price, minute) AS snap__price__change
      FROM (SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY minute DESC) AS r
        FROM mmerged) WHERE r <= 3 GROUP BY date, ticker) USING (date, ticker)""",
)


@query(
    "M4_build_samples",
    with_sql("msamp")
    + """SELECT date, ticker, status, minutes, round(order__price__mean, 5) AS order__price__mean,
      round(snap__price__change, 5) + 0.0 AS snap__price__change FROM msamp""",
)
def build_samples(spark, sf_dir):
    return samples(spark, sf_dir).select(
        "date",
        "ticker",
        "status",
        "minutes",
        rounded("order__price__mean", 5).alias("order__price__mean"),
        rounded("snap__price__change", 5).alias("snap__price__change"),
    )


@query(
    "M4_sample_report",
    with_sql("msamp")
    + """SELECT count(*) AS requested_targets,
      count(*) FILTER (WHERE status = 'missing rows') AS missing_rows,
      count(*) FILTER (WHERE status = 'insufficient window') AS insufficient_window,
      count(*) FILTER (WHERE status = 'written') AS written_samples FROM msamp""",
)
def sample_report(spark, sf_dir):
    return mn.sample_report(samples(spark, sf_dir))


def completed(spark, sf_dir):
    rows = settle(samples(spark, sf_dir), "samples")
    return mn.complete_samples(
        rows.select("date", "ticker"),
        rows.where("status = 'written'"),
        ["order__price__mean", "snap__price__change"],
    )


@query(
    "M5_complete_samples",
    with_sql("msamp")
    + """SELECT date, ticker, status = 'written' AS feature_available,
      CASE WHEN status = 'written' THEN 0 ELSE 2 END AS nan_values, 2 AS width,
      round(CAST(CASE WHEN status = 'written' THEN order__price__mean END AS FLOAT)::DOUBLE, 1)
        AS first_value FROM msamp""",
)
def complete_samples(spark, sf_dir):
    rows = completed(spark, sf_dir)
    first = F.col("features")[0]
    return rows.select(
        "date",
        "ticker",
        "feature_available",
        F.size(F.filter("features", lambda x: F.isnan(x))).alias("nan_values"),
        F.size("features").alias("width"),
        F.when(~F.isnan(first), F.round(first.cast("double"), 1)).alias("first_value"),
    )


define_view(
    "mfeat",
    ("msum",),
    """SELECT date, ticker, minutes, order__price__mean AS a,
      CASE WHEN isnan(order__size__mean) THEN NULL ELSE order__size__mean END AS b FROM msum""",
)


def two_features(spark, sf_dir):
    out = mn.trailing_summary(merged(spark, sf_dir), FEATURES)
    return settle(
        out.select(
            "date",
            "ticker",
            "minutes",
            F.col("order__price__mean").alias("a"),
            F.col("order__size__mean").alias("b"),
        ),
        "features",
    )


@query(
    "M6_median_fill",
    with_sql("mfeat")
    + """SELECT date, ticker, round(a, 5) AS a, round(coalesce(b, (SELECT quantile_cont(b, 0.5)
      FROM mfeat WHERE date < 19990101)), 9) AS b FROM mfeat""",
)
def median_fill(spark, sf_dir):
    rows = two_features(spark, sf_dir)
    filled = mn.median_fill(rows, ["a", "b"], F.col("date") < 19990101)
    return filled.select("date", "ticker", rounded("a", 5).alias("a"), rounded("b").alias("b"))


@query(
    "M7_standardize_features",
    with_sql("mfeat")
    + """SELECT date, ticker,
      round(least(greatest((a - ma) / sa, -10.0), 10.0), 8) + 0.0 AS a,
      round(least(greatest((coalesce(b, mb) - mb) / sb, -10.0), 10.0), 8) + 0.0 AS b,
      CASE WHEN minutes >= 2 THEN 1.0 ELSE 0.0 END AS available
    FROM mfeat, (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb
      FROM mfeat WHERE date < 19990101)""",
)
def standardize(spark, sf_dir):
    rows = two_features(spark, sf_dir).withColumn("ok", F.col("minutes") >= 2)
    scaler = mn.fit_scaler(rows, ["a", "b"], F.col("date") < 19990101)
    out = mn.standardize(rows, ["a", "b"], scaler, "ok")
    return out.select(
        "date", "ticker", rounded("a", 8).alias("a"), rounded("b", 8).alias("b"), "available"
    )


@query(
    "M8_period_summary",
    with_sql("msamp")
    + """SELECT CAST(date // 10000 AS VARCHAR) AS period, count(*) AS rows,
      count(*) FILTER (WHERE status = 'written') AS available_rows,
      count(*) FILTER (WHERE status <> 'written') AS imputed_rows FROM msamp GROUP BY period""",
)
def period_summary(spark, sf_dir):
    rows = completed(spark, sf_dir)
    return mn.period_summary(rows.withColumn("period", F.substring(F.col("date").cast("string"), 1, 4)))


@query(
    "K2_write_periods_with_resume",
    with_sql("msamp")
    + """SELECT CAST(date // 10000 AS INTEGER) AS period, count(*) AS rows,
      count(*) FILTER (WHERE status = 'written') AS available_rows,
      count(*) FILTER (WHERE status <> 'written') AS imputed_rows FROM msamp GROUP BY period""",
)
def write_periods(spark, sf_dir):
    """Years with another value, then a year that vanishes again, then another column, then all."""
    year = F.floor(F.col("date") / 10000).cast("int")
    rows = settle(completed(spark, sf_dir).withColumn("period", year), "periods")
    path = scratch(spark, "features")
    early = F.col("period") < 1997
    changed = F.when(early, F.col("feature_available")).otherwise(~F.col("feature_available"))
    sink.write_periods(rows.withColumn("feature_available", changed), path)
    past = rows.where("period = 1995").withColumn("period", F.lit(1900))
    sink.write_periods(rows.unionByName(past), path)
    sink.write_periods(rows.where(early).withColumn("feature_width", F.lit(2)), path)
    return sink.write_periods(rows, path)


@query(
    "K6_feature_vectors",
    with_sql("mfeat")
    + """SELECT date, ticker, minutes >= 2 AS feature_available, 2 AS width,
      round(CAST(a AS FLOAT)::DOUBLE, 1) AS first_value FROM mfeat""",
)
def feature_vectors(spark, sf_dir):
    path = scratch(spark, "vectors")
    rows = two_features(spark, sf_dir).withColumn("ok", F.col("minutes") >= 2)
    sink.feature_vectors(rows, ["date", "ticker"], ["a", "b"], "ok").write.parquet(path)
    return spark.read.parquet(path).select(
        "date",
        "ticker",
        "feature_available",
        F.size("features").alias("width"),
        F.round(F.col("features")[0].cast("double"), 1).alias("first_value"),
    )


@query(
    "K7_sharded_writer",
    with_sql("mfeat")
    + """SELECT CAST((r - 1) // 100 AS INTEGER) AS shard, (r - 1) % 100 AS shard_row, date, ticker
    FROM (SELECT date, ticker, row_number() OVER (ORDER BY date, ticker) AS r FROM mfeat)""",
)
def sharded(spark, sf_dir):
    path = scratch(spark, "shards")
    sink.write_sharded(two_features(spark, sf_dir), path, ["date", "ticker"], 100)
    return spark.read.parquet(path).select("shard", "shard_row", "date", "ticker")


@query(
    "M9_joint_rows",
    with_sql("mfeat", "msamp")
    + """SELECT split, status, count(*) AS rows FROM (
      SELECT CASE WHEN f.date BETWEEN 19950101 AND 19981231 THEN 'train'
        WHEN f.date BETWEEN 19990101 AND 19991231 THEN 'val'
        WHEN f.date BETWEEN 20000201 AND 20010630 THEN 'test' END AS split,
      CASE WHEN (CASE WHEN f.date < 19990101 THEN 'train' WHEN f.date < 20000601 THEN 'validation'
          ELSE 'oos' END) = (CASE WHEN f.date BETWEEN 19950101 AND 19981231 THEN 'train'
          WHEN f.date BETWEEN 19990101 AND 19991231 THEN 'validation' ELSE 'oos' END)
        THEN 'ok' ELSE 'partition differs' END AS status
      FROM mfeat f JOIN (SELECT date, ticker FROM msamp WHERE status = 'written')
        USING (date, ticker)) WHERE split IS NOT NULL GROUP BY split, status""",
)
def joint_rows(spark, sf_dir):
    feats = two_features(spark, sf_dir).withColumn(
        "trading_date", F.to_date(F.col("date").cast("string"), "yyyyMMdd")
    )
    split = lab.assign_split(feats, SPLIT, entry="trading_date")
    cached = samples(spark, sf_dir).where("status = 'written'").select(
        "date",
        "ticker",
        F.when(F.col("date") < 19990101, "train")
        .when(F.col("date") < 20000601, "validation")
        .otherwise("oos")
        .alias("partition"),
    )
    names = {"train": "train", "val": "validation", "test": "oos"}
    joined = mn.joint_rows(split, cached, names)
    return joined.groupBy("split", "status").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "F19_modality_columns",
    with_sql("mlast")
    + """SELECT count(*) AS minutes, round(avg(price), 6) AS trade__price
    FROM mlast WHERE modality = 'trade' AND NOT isnan(size)""",
)
def modality_selection(spark, sf_dir):
    frame = modality_frames(minutes(spark, sf_dir), 6)[1].withColumns(
        {"trade__valid": F.lit(True), "order__price": F.lit(0.0)}
    )
    columns = modality_columns(frame.columns, "trade")
    kept = frame.select(*columns).where("NOT isnan(trade__size)")
    return kept.agg(
        F.count(F.lit(1)).alias("minutes"), rounded(F.avg("trade__price"), 6).alias("trade__price")
    )


@query(
    "F22_pad_short_windows",
    with_sql("mmerged")
    + """, s AS (SELECT date, ticker, list(minute ORDER BY minute) AS m FROM mmerged
      GROUP BY date, ticker)
    SELECT date, ticker, array_to_string(m, ',') || repeat(',-1', 4 - len(m)) AS padded FROM s""",
)
def pad_windows(spark, sf_dir):
    from tapeloom.functions.scalars import pad_to_window

    # A merged stock-day holds at most four minutes.
    rows = merged(spark, sf_dir).groupBy("date", "ticker").agg(
        F.sort_array(F.collect_list("minute")).alias("m")
    )
    padded = pad_to_window(F.col("m"), 4, F.lit(-1))
    text = F.concat_ws(",", F.transform(padded, lambda x: x.cast("string")))
    return rows.select("date", "ticker", text.alias("padded"))


@query(
    "F20_pack_events",
    with_sql("btail")
    + """, s AS (SELECT trading_date, symbol, list(time_ms ORDER BY place DESC) AS t FROM btail
      GROUP BY trading_date, symbol),
    f AS (SELECT trading_date, symbol, list_concat(list_resize([]::INTEGER[], 6 - len(t), t[1]), t)
      AS t FROM s)
    SELECT trading_date, symbol, array_to_string(t[1:2], ',') || ';' || array_to_string(t[3:4], ',')
      || ';' || array_to_string(t[5:6], ',') AS packed FROM f""",
)
def pack(spark, sf_dir):
    from tapeloom.functions.scalars import pack_events

    return packed_rows(tail(spark, sf_dir), lambda e: pack_events(e, 3, 2), "packed")


def packed_rows(rows, build, name):
    # A tail holds at most four events.
    events = rows.groupBy("trading_date", "symbol").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("place")).alias("p"), "time_ms"))).alias("e")
    )
    chunks = build(F.transform("e", lambda x: x["time_ms"]))
    text = F.concat_ws(
        ";",
        F.transform(chunks, lambda c: F.concat_ws(",", F.transform(c, lambda v: v.cast("string")))),
    )
    return events.select("trading_date", "symbol", text.alias(name))


@query(
    "F21_last_chunks",
    with_sql("btail")
    + """, s AS (SELECT trading_date, symbol, list(time_ms ORDER BY place DESC) AS t FROM btail
      GROUP BY trading_date, symbol),
    f AS (SELECT trading_date, symbol, list_concat(list_resize([]::INTEGER[], 6 - len(t), t[1]), t)
      AS t FROM s)
    SELECT trading_date, symbol, array_to_string(t[3:4], ',') || ';' ||
      array_to_string(t[5:6], ',') AS chunks FROM f""",
)
def last_two_chunks(spark, sf_dir):
    from tapeloom.functions.scalars import last_chunks, pack_events

    return packed_rows(
        tail(spark, sf_dir), lambda e: last_chunks(pack_events(e, 3, 2), 2), "chunks"
    )


@query(
    "F3_valid_book",
    with_sql("book")
    + """SELECT trading_date, count(*) AS rows, count(*) FILTER (WHERE bid_price1 > 0) AS valid,
      count(*) FILTER (WHERE bid_price1 > 0) AS valid_arrays FROM book GROUP BY trading_date""",
)
def valid_books(spark, sf_dir):
    from tapeloom.functions.scalars import valid_book_arrays

    arrays = valid_book_arrays(F.array(*PRICES), F.array(*VOLUMES))
    return book(spark, sf_dir).groupBy("trading_date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(valid_book(PRICES, VOLUMES), 1)).alias("valid"),
        F.count(F.when(arrays, 1)).alias("valid_arrays"),
    )
