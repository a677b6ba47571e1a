"""Panels, predictions and event streams derived from the given tables.

Each Spark fixture has a SQL twin: ``with_sql('bars', 'cal')`` returns the WITH clause
that defines the named views and everything they need, in dependency order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.scalars import pad_symbol
from tapeloom.operators import calendar as cal_ops
from tapeloom.operators import labels as label_ops
from tapeloom.plans.shared import settle

MIN_CROSS_SECTION = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Derived tables that many queries start from, written once per session and state of the input.
_KEPT: dict[tuple, DataFrame] = {}


def input_state(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of the files at ``path``, from Spark's own file system layer."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(
        sorted(
            (f.getPath().toString(), f.getLen(), f.getModificationTime())
            for f in fs.listStatus(target)
        )
    )


def kept(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """The settled table ``name``, built on first use; :func:`forget` drops it."""
    # All kept tables derive from the lines.
    state = input_state(spark, f"{sf_dir}/lineitem.parquet")
    key = (spark.sparkContext.applicationId, state, name)
    found = _KEPT.get(key)
    if found is None or found.sparkSession is not spark:
        found = _KEPT[key] = settle(build(), name)
    return found


def forget() -> None:
    """Make the next query derive its tables from the given ones again."""
    _KEPT.clear()


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "bars", lambda: build_bars(spark, sf_dir))


def build_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per supplier and ship month; price is the line's unit price."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.trunc("l_shipdate", "month").alias("trading_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.struct(
            "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
        ).alias("place"),
    )
    # Grouped by the number; the padded text is only made for the bars.
    daily = lines.groupBy("l_suppkey", "trading_date").agg(
        F.min_by("price", "place").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "place").alias("close"),
        F.sum("quantity").alias("volume"),
    )
    return daily.select(
        pad_symbol(F.col("l_suppkey")).alias("symbol"),
        "trading_date",
        "open",
        "high",
        "low",
        "close",
        "volume",
    )


def panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Settled bars with their calendar and benchmark; the lines are scanned once."""
    daily = bars(spark, sf_dir)
    sessions = kept(spark, sf_dir, "calendar", lambda: cal_ops.trading_calendar(daily))
    return cal_ops.with_day_index(daily, sessions), sessions, bench(daily)


def bench(bars_df: DataFrame) -> DataFrame:
    """Volume-weighted open and close per period."""
    total = F.sum("volume")
    return bars_df.groupBy("trading_date").agg(
        F.round(F.sum(F.col("open") * F.col("volume")) / total, 4).alias("open"),
        F.round(F.sum(F.col("close") * F.col("volume")) / total, 4).alias("close"),
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "predictions", lambda: build_preds(spark, sf_dir))


def build_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reversal score against the next period's excess return."""
    indexed, _, market = panel(spark, sf_dir)
    targets = label_ops.next_day_targets(indexed, market, keep=["open", "close", "volume"])
    return targets.select(
        "symbol",
        "trading_date",
        "label_date",
        "raw_return",
        "target_return",
        (1 - F.col("close") / F.col("open")).alias("score"),
        (F.col("volume") >= 60).alias("can_buy"),
        (F.col("volume") >= 50).alias("can_sell"),
        (F.col("volume") >= 100).alias("in_universe"),
    )


def signals_of(indexed: DataFrame, sessions: DataFrame) -> DataFrame:
    """Scores with a partition name: earlier half validation, later half oos."""
    count = sessions.agg(F.count(F.lit(1))).scalar()
    return indexed.select(
        F.when(F.col("day_index") * 2 < count, "validation").otherwise("oos").alias("partition"),
        "trading_date",
        "symbol",
        (1 - F.col("close") / F.col("open")).alias("score"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, sessions, _ = panel(spark, sf_dir)
    return signals_of(indexed, sessions)


def horizon_labels(spark: SparkSession, sf_dir: str, horizons=(1, 2, 3)) -> DataFrame:
    indexed, sessions, market = panel(spark, sf_dir)
    return label_ops.horizon_targets(
        indexed, sessions, market, horizons=horizons, min_cross_section=MIN_CROSS_SECTION
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, trade and snapshot events; a stock-day is one user's week.

    ``time_ms`` counts from 09:30 of the week's first day, negative before it.
    """
    ts = F.col("ts")
    week = F.trunc(ts, "week")
    second = F.expr("extract(SECOND FROM ts)")
    of_day = (F.hour(ts) * 3600 + F.minute(ts) * 60) * 1000 + F.floor(second * 1000)
    time_ms = F.datediff(F.to_date(ts), week) * 86_400_000 + of_day - 34_200_000
    kind = F.col("event_type")
    stream = (
        F.when(kind.isin("view", "click"), "order")
        .when(kind.isin("purchase", "signup"), "trade")
        .otherwise("snap")
    )
    return table(spark, sf_dir, "events").select(
        week.alias("day"),
        pad_symbol(F.col("user_id")).alias("ticker"),
        stream.alias("stream"),
        time_ms.cast("int").alias("time_ms"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("int").alias("qty"),
    )


# ---- SQL twins -------------------------------------------------------------

_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "li": (
        (),
        """SELECT CASE WHEN length(CAST(l_suppkey AS VARCHAR)) >= 6 THEN CAST(l_suppkey AS VARCHAR)
             ELSE lpad(CAST(l_suppkey AS VARCHAR), 6, '0') END AS symbol,
           CAST(date_trunc('month', l_shipdate) AS DATE) AS trading_date,
           l_extendedprice / l_quantity AS price, l_quantity AS quantity,
           l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice
           FROM lineitem""",
    ),
    "bars": (
        ("li",),
        """SELECT symbol, trading_date,
           first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)
             AS open,
           max(price) AS high, min(price) AS low,
           last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)
             AS close,
           sum(quantity) AS volume
           FROM li GROUP BY symbol, trading_date""",
    ),
    "cal": (
        ("li",),
        """SELECT trading_date, row_number() OVER (ORDER BY trading_date) - 1 AS day_index,
           lead(trading_date) OVER (ORDER BY trading_date) AS next_date,
           lead(trading_date, 2) OVER (ORDER BY trading_date) AS next_next_date
           FROM (SELECT DISTINCT trading_date FROM li)""",
    ),
    "bench": (
        ("bars",),
        """SELECT trading_date, round(sum(open * volume) / sum(volume), 4) AS open,
           round(sum(close * volume) / sum(volume), 4) AS close
           FROM bars GROUP BY trading_date""",
    ),
    "ibars": (("bars", "cal"), "SELECT b.*, c.day_index, c.next_date FROM bars b JOIN cal c USING (trading_date)"),
    "targets": (
        ("ibars", "bench"),
        """SELECT b.symbol, b.trading_date, b.next_date AS label_date, b.day_index,
           b.open, b.close, b.volume,
           f.close / f.open - 1 AS raw_return,
           (f.close / f.open - 1) - (k.close / k.open - 1) AS target_return
           FROM ibars b JOIN bars f ON f.symbol = b.symbol AND f.trading_date = b.next_date
           JOIN bench k ON k.trading_date = b.next_date""",
    ),
    "preds": (
        ("targets",),
        """SELECT symbol, trading_date, label_date, raw_return, target_return,
           1 - close / open AS score, volume >= 60 AS can_buy, volume >= 50 AS can_sell,
           volume >= 100 AS in_universe FROM targets""",
    ),
    "signals": (
        ("ibars",),
        """SELECT CASE WHEN day_index * 2 < (SELECT count(*) FROM cal) THEN 'validation'
             ELSE 'oos' END AS partition,
           trading_date, symbol, 1 - close / open AS score FROM ibars""",
    ),
    "hraw": (
        ("ibars", "cal", "bench"),
        f"""SELECT s.symbol, s.trading_date, e.trading_date AS entry_date,
           x.trading_date AS return_end_date, h.horizon,
           xb.close / eb.open - 1 AS raw_return, kx.close / ke.open - 1 AS benchmark_return,
           (xb.close / eb.open - 1) - (kx.close / ke.open - 1) AS target_return,
           count(*) OVER (PARTITION BY h.horizon, s.trading_date) AS n
           FROM ibars s CROSS JOIN (SELECT unnest([1, 2, 3]) AS horizon) h
           JOIN cal e ON e.day_index = s.day_index + 1
           JOIN cal x ON x.day_index = s.day_index + h.horizon
           JOIN bars eb ON eb.symbol = s.symbol AND eb.trading_date = e.trading_date
           JOIN bars xb ON xb.symbol = s.symbol AND xb.trading_date = x.trading_date
           JOIN bench ke ON ke.trading_date = e.trading_date
           JOIN bench kx ON kx.trading_date = x.trading_date""",
    ),
    "hlab": (
        ("hraw",),
        f"""SELECT r.symbol, r.trading_date, r.entry_date, r.return_end_date, r.horizon,
           CASE WHEN r.target_return < q.lo THEN 0 WHEN r.target_return > q.hi THEN 2 ELSE 1 END
             AS label,
           r.raw_return, r.benchmark_return, r.target_return
           FROM hraw r JOIN (SELECT horizon, trading_date, quantile_cont(target_return, 0.2) AS lo,
             quantile_cont(target_return, 0.8) AS hi FROM hraw WHERE n >= {MIN_CROSS_SECTION}
             GROUP BY horizon, trading_date) q USING (horizon, trading_date)""",
    ),
    "ev": (
        (),
        """SELECT CAST(date_trunc('week', ts) AS DATE) AS day,
           CASE WHEN length(CAST(user_id AS VARCHAR)) >= 6 THEN CAST(user_id AS VARCHAR)
             ELSE lpad(CAST(user_id AS VARCHAR), 6, '0') END AS ticker,
           CASE WHEN event_type IN ('view', 'click') THEN 'order'
             WHEN event_type IN ('purchase', 'signup') THEN 'trade' ELSE 'snap' END AS stream,
           CAST((epoch_us(ts) - epoch_us(date_trunc('week', ts))) // 1000 - 34200000 AS INTEGER)
             AS time_ms,
           event_id AS seq,
           value AS price,
           CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS qty FROM events""",
    ),
}


def define_view(name: str, needs: tuple[str, ...], sql: str) -> None:
    """Add a SQL view other oracles can build on."""
    _VIEWS[name] = (needs, sql)


def with_sql(*names: str) -> str:
    """WITH clause for the named views and their dependencies."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in _VIEWS[name][0]:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(
        f"{name} AS MATERIALIZED ({_VIEWS[name][1]})" for name in ordered
    ) + "\n"
