"""Queries over panels: sources, sinks, calendar and universe (S, K, C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.catalog import fixtures as fx
from tapeloom.catalog.fixtures import define_view, with_sql
from tapeloom.catalog.registry import query, rounded
from tapeloom.functions.scalars import day_number
from tapeloom.functions.stats import is_positive
from tapeloom.operators import calendar as cal
from tapeloom.operators import labels as lab
from tapeloom.plans.shared import new_path, settle
from tapeloom.sinks import tables as sink
from tapeloom.sources import files, panels

ANY_CODE = r"^\d{6,}$"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder for files a query writes and reads back."""
    return new_path(spark, name)


def write_wide(spark: SparkSession, rows: DataFrame, value: str, width: int = 1000) -> str:
    path = scratch(spark, f"wide-{value}")
    sink.write_wide_parts(rows, value, path, width)
    return path


# ---- sources ---------------------------------------------------------------


@query(
    "S1_wide_panel_to_long",
    with_sql("bars") + "SELECT trading_date, symbol, close FROM bars"
    " WHERE trading_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'",
)
def wide_panel(spark, sf_dir):
    path = write_wide(spark, fx.bars(spark, sf_dir), "close", width=60)
    long = panels.read_wide_panel(
        spark, path, "close", start="1996-01-01", end="2000-12-31", pattern=ANY_CODE
    )
    return long.where(F.col("close").isNotNull())


@query(
    "S2_load_market_panels",
    with_sql("bars")
    + """SELECT trading_date, symbol, open, close, volume FROM bars
    """,
)
def market_panels(spark, sf_dir):
    """The close panel has one symbol more than the others, which common symbols leave out."""
    b = fx.bars(spark, sf_dir)
    extra = b.withColumn("symbol", F.lit("999999")).groupBy("symbol", "trading_date").agg(
        F.max("close").alias("close")
    )
    close = b.select("symbol", "trading_date", "close").unionByName(
        extra.select("symbol", "trading_date", "close")
    )
    paths = {
        "open": write_wide(spark, b, "open"),
        "close": write_wide(spark, close, "close"),
        "volume": write_wide(spark, b, "volume"),
    }
    return panels.load_market_panels(spark, paths, pattern=ANY_CODE).where("close IS NOT NULL")


@query(
    "S2_panel_axis_check",
    with_sql("bars")
    + """SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS value, 1 AS panels
    FROM (SELECT trading_date + INTERVAL 1 DAY AS d FROM bars
      UNION SELECT trading_date AS d FROM bars) GROUP BY value""",
)
def panel_axis(spark, sf_dir):
    """One panel is a day late, so every date of either panel is in one of them only."""
    b = fx.bars(spark, sf_dir)
    late = b.withColumn("trading_date", F.date_add("trading_date", 1))
    paths = {"open": write_wide(spark, b, "open"), "volume": write_wide(spark, late, "volume")}
    return panels.axis_mismatch(spark, paths)


@query(
    "S3_align_optional_panel",
    with_sql("bars")
    + """SELECT trading_date, symbol, CASE WHEN volume >= 200 THEN volume ELSE 0.0 END AS st
    FROM bars""",
)
def optional_panel(spark, sf_dir):
    """All rows are in the optional panel; those of low volume without a value."""
    b = fx.bars(spark, sf_dir)
    some = b.withColumn("st", F.when(F.col("volume") >= 200, F.col("volume")))
    path = write_wide(spark, some, "st")
    st = panels.read_wide_panel(spark, path, "st", pattern=ANY_CODE)
    return panels.align_optional_panel(b.select("trading_date", "symbol"), st, "st")


@query(
    "S4_read_benchmark",
    with_sql("bench")
    + """SELECT trading_date, open, close FROM bench WHERE month(trading_date) <> 6""",
)
def benchmark(spark, sf_dir):
    market = fx.bench(fx.bars(spark, sf_dir))
    broken = F.when(F.month("trading_date") == 6, F.lit(float("nan"))).otherwise(F.col("open"))
    path = scratch(spark, "bench")
    market.select(day_number(F.col("trading_date")).alias("trade_date"), broken.alias("open"), "close").write.parquet(path)
    return panels.read_benchmark(spark, path)


@query(
    "S11_wide_labels_to_long",
    with_sql("targets")
    + "SELECT trading_date, symbol, target_return AS label FROM targets",
)
def wide_labels(spark, sf_dir):
    targets = fx.preds(spark, sf_dir)
    path = write_wide(spark, targets, "target_return")
    return panels.read_wide_labels(spark, path)


@query(
    "S12_read_predictions",
    with_sql("preds")
    + """SELECT symbol, trading_date, label_date, score, target_return, can_buy, can_sell,
    true AS in_universe, true AS tradability_known, false AS universe_membership_known FROM preds""",
)
def predictions_read(spark, sf_dir):
    path = scratch(spark, "preds")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    fx.preds(spark, sf_dir).select(
        "symbol",
        day("trading_date"),
        day("label_date"),
        "score",
        "target_return",
        F.when(F.col("can_buy"), " True ").otherwise("no").alias("can_buy"),
        F.col("can_sell").cast("int").alias("can_sell"),
    ).write.parquet(path)
    return panels.read_predictions(spark, path)


@query("S13_read_signals", with_sql("signals") + "SELECT * FROM signals")
def signals_read(spark, sf_dir):
    s = settle(fx.signals(spark, sf_dir), "signals")
    paths = {}
    for raw, name in (("val", "validation"), ("test", "oos")):
        paths[raw] = scratch(spark, raw)
        s.where(F.col("partition") == name).select(
            day_number(F.col("trading_date")).alias("trading_day"), "symbol", "score"
        ).write.parquet(paths[raw])
    return panels.read_signals(spark, paths)


@query(
    "S14_restore_scores",
    with_sql("signals")
    + """, k AS (SELECT partition, row_number() OVER (PARTITION BY partition
      ORDER BY trading_date, symbol) - 1 AS row_index, trading_date, symbol, score FROM signals)
    SELECT partition, row_index, symbol,
      CAST(strftime(trading_date, '%Y%m%d') AS INTEGER) AS trading_day, score,
      CASE WHEN right(symbol, 1) = '7' THEN 'day differs' ELSE 'ok' END AS status FROM k""",
)
def scores_restored(spark, sf_dir):
    from tapeloom.operators.events import identity_rows

    rows = identity_rows(fx.signals(spark, sf_dir), "partition", ["trading_date", "symbol"])
    day = day_number(F.col("trading_date"))
    keys = rows.select("partition", "row_index", "symbol", day.alias("trading_day"))
    off = F.when(F.col("symbol").endswith("7"), 1).otherwise(0)
    scores = rows.select("partition", "row_index", (day + off).alias("trading_day"), "score")
    return panels.restore_scores(keys, scores)


@query(
    "S15_horizon_sidecar",
    with_sql("hlab", "preds")
    + """SELECT h.symbol, h.trading_date, h.entry_date, h.return_end_date, h.horizon, h.label,
      h.raw_return, h.benchmark_return, h.target_return
    FROM hlab h SEMI JOIN preds p
      ON h.symbol = p.symbol AND h.trading_date = p.trading_date WHERE h.horizon = 2""",
)
def sidecar_read(spark, sf_dir):
    indexed, sessions, market = fx.panel(spark, sf_dir)
    path = scratch(spark, "sidecar")
    rows = lab.horizon_targets(
        indexed, sessions, market, (1, 2, 3), min_cross_section=fx.MIN_CROSS_SECTION
    )
    sink.write_horizon_sidecar(rows, path)
    keys = lab.next_day_targets(indexed, market)
    return panels.read_horizon_sidecar(spark, path, 2, keys)


# ---- sinks -----------------------------------------------------------------


@query(
    "K1_write_horizon_sidecar",
    with_sql("hlab") + "SELECT horizon, count(*) AS rows FROM hlab GROUP BY horizon",
)
def sidecar_write(spark, sf_dir):
    rows = fx.horizon_labels(spark, sf_dir)
    return sink.write_horizon_sidecar(rows, scratch(spark, "sidecar"))


@query(
    "K3_long_to_wide",
    with_sql("targets")
    + """SELECT CAST(strftime(trading_date, '%Y%m%d') AS INTEGER) AS value, symbol, target_return
    FROM targets""",
)
def wide_labels_write(spark, sf_dir):
    """Every column of the wide tables, turned into rows again for the comparison."""
    path = write_wide(spark, fx.preds(spark, sf_dir), "target_return", width=60)
    rows = panels.wide_rows(spark, path, "target_return")
    return rows.where("target_return is not null")


# ---- calendar and universe -------------------------------------------------


@query("C1_trading_calendar", with_sql("cal") + "SELECT * FROM cal")
def calendar_query(spark, sf_dir):
    return cal.trading_calendar(fx.bars(spark, sf_dir))


@query(
    "C2_session_after",
    with_sql("ibars")
    + """SELECT b.symbol, b.trading_date, h.horizon, c.trading_date AS end_date
    FROM ibars b CROSS JOIN (SELECT unnest([1, 3, 5]) AS horizon) h
    JOIN cal c ON c.day_index = b.day_index + h.horizon""",
)
def session_after(spark, sf_dir):
    indexed, sessions, _ = fx.panel(spark, sf_dir)
    return cal.session_after(indexed, sessions, (1, 3, 5)).select(
        "symbol", "trading_date", "horizon", "end_date"
    )


@query(
    "C3_previous_valid_close",
    with_sql("ibars")
    + """SELECT symbol, trading_date,
    last_value(CASE WHEN volume >= 100 THEN close END IGNORE NULLS) OVER (PARTITION BY symbol
      ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_close
    FROM ibars""",
)
def previous_close(spark, sf_dir):
    indexed, _, _ = fx.panel(spark, sf_dir)
    thin = F.when(F.col("volume") >= 100, F.col("close")).otherwise(F.lit(float("nan")))
    return cal.previous_valid_close(indexed.withColumn("close", thin)).select(
        "symbol", "trading_date", "previous_close"
    )


@query(
    "C4_latest_close_before",
    with_sql("bars")
    + """SELECT r.symbol, r.trading_date, coalesce(b.close, 0.0) AS prev_close
    FROM (SELECT DISTINCT s.symbol, d.trading_date FROM (SELECT DISTINCT symbol FROM bars) s,
      (SELECT DISTINCT trading_date FROM bars) d) r
    ASOF LEFT JOIN bars b ON r.symbol = b.symbol AND r.trading_date > b.trading_date""",
)
def close_before(spark, sf_dir):
    indexed, sessions, _ = fx.panel(spark, sf_dir)
    spans = indexed.groupBy("symbol").agg(F.min("day_index").alias("x"))
    every = (
        spans.select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), sessions.agg(F.max("day_index")).scalar())).alias("day_index"))
        .join(sessions.select("day_index", "trading_date"), "day_index")
        .select("symbol", "trading_date")
    )
    return cal.latest_close_before(every, indexed)


@query(
    "C5_first_valid_day",
    with_sql("ibars")
    + """SELECT symbol, min(day_index) AS first_index FROM ibars
    WHERE open > 0 AND close > 0 AND volume > 0 GROUP BY symbol""",
)
def first_day(spark, sf_dir):
    indexed, _, _ = fx.panel(spark, sf_dir)
    return cal.first_valid_day(indexed)


define_view(
    "grid",
    ("ibars", "cal"),
    """SELECT s.symbol, c.day_index, c.trading_date, b.open, b.close, b.volume, s.first_index
    FROM (SELECT symbol, min(day_index) AS first_index, max(day_index) AS last_index
          FROM ibars GROUP BY symbol) s
    JOIN cal c ON c.day_index >= s.first_index AND c.day_index <= s.last_index + 6
    LEFT JOIN ibars b ON b.symbol = s.symbol AND b.day_index = c.day_index""",
)
define_view(
    "liq",
    ("grid",),
    """SELECT *, count(close * volume) OVER w AS observations, avg(close * volume) OVER w AS liquidity
    FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY day_index RANGE BETWEEN 6 PRECEDING
      AND 1 PRECEDING)""",
)
define_view(
    "uni",
    ("liq",),
    """SELECT trading_date, day_index, symbol, liquidity, observations, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY liquidity DESC, symbol DESC)
        AS rank FROM liq WHERE day_index >= 6 AND day_index - first_index >= 8
        AND observations >= 4 AND liquidity > 0) WHERE rank <= 20""",
)


@query(
    "C6_trailing_liquidity",
    with_sql("liq")
    + """SELECT symbol, trading_date, observations, round(ln(liquidity), 9) AS log_liquidity
    FROM liq WHERE day_index >= 6""",
)
def liquidity(spark, sf_dir):
    indexed, sessions, _ = fx.panel(spark, sf_dir)
    grid = cal.symbol_grid(indexed, sessions, tail=6)
    return cal.trailing_liquidity(grid, 6).select(
        "symbol", "trading_date", "observations", rounded(F.log("liquidity")).alias("log_liquidity")
    )


def universe(indexed: DataFrame, sessions: DataFrame) -> DataFrame:
    return cal.dynamic_universe(
        indexed, sessions, top_n=20, min_history_days=8, lookback=6, min_observations=4
    )


@query(
    "C7_dynamic_universe",
    with_sql("uni") + "SELECT trading_date, symbol, observations, rank FROM uni",
)
def universe_query(spark, sf_dir):
    indexed, sessions, _ = fx.panel(spark, sf_dir)
    return universe(indexed, sessions).select("trading_date", "symbol", "observations", "rank")


define_view(
    "bret",
    ("bench", "cal"),
    """SELECT c.trading_date, k.close / k.open - 1 AS open_close,
    lead(k.open) OVER (ORDER BY c.day_index) / k.open - 1 AS open_next_open
    FROM cal c LEFT JOIN bench k USING (trading_date)""",
)


@query("C8_benchmark_returns", with_sql("bret") + "SELECT * FROM bret")
def benchmark_returns(spark, sf_dir):
    _, sessions, market = fx.panel(spark, sf_dir)
    return cal.benchmark_returns(market, sessions)


@query(
    "C9_carried_status",
    with_sql("ibars")
    + """, m AS (SELECT symbol, day_index, trading_date, volume >= 200 AS in_universe,
      volume >= 120 AS can_sell FROM ibars),
    e AS (SELECT *, sum(CAST(in_universe AS INTEGER)) OVER (PARTITION BY symbol ORDER BY day_index)
      AS episode FROM m)
    SELECT symbol, trading_date, can_sell, CAST(episode AS BIGINT) AS episode FROM (
      SELECT *, coalesce(sum(CASE WHEN NOT in_universe AND can_sell THEN 1 ELSE 0 END) OVER (
        PARTITION BY symbol, episode ORDER BY day_index
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sold FROM e)
    WHERE NOT in_universe AND episode > 0 AND sold = 0""",
)
def carried(spark, sf_dir):
    indexed, _, _ = fx.panel(spark, sf_dir)
    member = indexed.select(
        "symbol",
        "trading_date",
        "day_index",
        (F.col("volume") >= 200).alias("in_universe"),
        (F.col("volume") >= 120).alias("can_sell"),
    )
    return cal.carried_status(member).select("symbol", "trading_date", "can_sell", "episode")


@query(
    "C10_comparison_universe",
    with_sql("targets", "cal")
    + """, sel AS (SELECT trading_date, symbol, day_index, 1 - close / open AS score FROM targets),
    every AS (SELECT trading_date, symbol, score, true AS in_universe FROM sel
      UNION ALL
      SELECT c.trading_date, p.symbol, 0.0, false FROM sel p
      JOIN cal c ON c.day_index = p.day_index + 1
      WHERE c.trading_date IN (SELECT trading_date FROM sel) AND NOT EXISTS (
        SELECT 1 FROM sel q WHERE q.symbol = p.symbol AND q.trading_date = c.trading_date))
    SELECT e.trading_date, e.symbol, e.score, e.in_universe, t.label_date, t.raw_return
    FROM every e JOIN targets t USING (trading_date, symbol)""",
)
def comparison(spark, sf_dir):
    indexed, _, market = fx.panel(spark, sf_dir)
    targets = lab.next_day_targets(indexed, market, keep=["open", "close", "volume"])
    selected = targets.select(
        "trading_date", "symbol", (1 - F.col("close") / F.col("open")).alias("score")
    )
    sessions = cal.trading_calendar(selected)
    outcome = targets.select("trading_date", "symbol", "label_date", "raw_return")
    return cal.comparison_universe(selected, outcome, sessions).select(
        "trading_date", "symbol", "score", "in_universe", "label_date", "raw_return"
    )


define_view(
    "attrs",
    ("ibars",),
    """SELECT symbol, trading_date, day_index, ln(close * volume) AS log_size,
      adv * 100.0 AS adv, volatility
    FROM (SELECT *, count(close) OVER w5 AS closes, count(close * volume) OVER w4 AS days,
        avg(close * volume) OVER w4 AS adv, stddev_samp(ret) OVER w4 AS volatility
      FROM (SELECT *, CASE WHEN lag(day_index) OVER s = day_index - 1
          THEN ln(close) - ln(lag(close) OVER s) END AS ret FROM ibars
        WINDOW s AS (PARTITION BY symbol ORDER BY day_index))
      WINDOW w5 AS (PARTITION BY symbol ORDER BY day_index RANGE BETWEEN 4 PRECEDING AND CURRENT ROW),
        w4 AS (PARTITION BY symbol ORDER BY day_index RANGE BETWEEN 3 PRECEDING AND CURRENT ROW))
    WHERE day_index >= 4 AND closes = 5 AND days >= 3 AND volatility IS NOT NULL""",
)


def attributes(indexed: DataFrame) -> DataFrame:
    sized_bars = indexed.withColumn("size", F.col("close") * F.col("volume"))
    return cal.market_attributes(sized_bars, "size", lookback=4, slack=1)


@query(
    "C11_market_attributes",
    with_sql("attrs")
    + """SELECT symbol, trading_date, round(log_size, 9) AS log_size, round(adv, 3) AS adv,
    round(volatility, 9) AS volatility FROM attrs""",
)
def attributes_query(spark, sf_dir):
    indexed, _, _ = fx.panel(spark, sf_dir)
    return attributes(indexed).select(
        "symbol",
        "trading_date",
        rounded("log_size").alias("log_size"),
        rounded("adv", 3).alias("adv"),
        rounded("volatility").alias("volatility"),
    )


define_view(
    "folds",
    ("li",),
    """SELECT CAST(i AS INTEGER) AS fold_index,
      'fold-' || lpad(CAST(i AS VARCHAR), 2, '0') || '-oos-' ||
        strftime(s + INTERVAL 8 MONTH, '%Y%m') AS fold_id,
      CAST(s AS DATE) AS train_start,
      CAST(s + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE) AS train_end,
      CAST(s + INTERVAL 6 MONTH AS DATE) AS val_start,
      CAST(s + INTERVAL 8 MONTH - INTERVAL 1 DAY AS DATE) AS val_end,
      CAST(s + INTERVAL 8 MONTH AS DATE) AS oos_start,
      CAST(s + INTERVAL 9 MONTH - INTERVAL 1 DAY AS DATE) AS oos_end
    FROM (SELECT i, lo + to_months(CAST(i * 3 AS INTEGER)) AS s, hi FROM (
      SELECT min(trading_date) AS lo, max(trading_date) AS hi FROM li),
      range(0, 200) t(i)) WHERE s + INTERVAL 8 MONTH <= hi""",
)


def folds(days: DataFrame) -> DataFrame:
    bounds = days.agg(
        F.min("trading_date").alias("start_month"), F.max("trading_date").alias("end_month")
    )
    return cal.rolling_folds(
        bounds, train_months=6, validation_months=2, oos_months=1, step_months=3
    )


@query("C12_rolling_folds", with_sql("folds") + "SELECT * FROM folds")
def folds_query(spark, sf_dir):
    return folds(fx.bars(spark, sf_dir))


SPLIT = {
    "train": ("1995-01-01", "1998-12-31"),
    "val": ("1999-01-01", "1999-12-31"),
    "test": ("2000-02-01", "2001-06-30"),
}


@query(
    "C13_days_in_one_range",
    with_sql("cal")
    + """SELECT trading_date,
    count(*) FILTER (WHERE s IS NOT NULL) AS ranges,
    CASE WHEN trading_date >= DATE '2001-07-01' THEN 'locked'
      WHEN count(*) FILTER (WHERE s IS NOT NULL) = 0 THEN 'no range'
      WHEN count(*) FILTER (WHERE s IS NOT NULL) > 1 THEN 'several ranges' ELSE 'ok' END AS status
    FROM cal LEFT JOIN (VALUES ('train', DATE '1995-01-01', DATE '1998-12-31'),
      ('val', DATE '1998-12-01', DATE '1999-12-31'), ('test', DATE '2000-02-01', DATE '2001-06-30'))
      r(s, a, b) ON trading_date BETWEEN a AND b GROUP BY trading_date""",
)
def one_range(spark, sf_dir):
    ranges = cal.ranges_frame(
        spark,
        [
            ("train", "1995-01-01", "1998-12-31"),
            ("val", "1998-12-01", "1999-12-31"),
            ("test", "2000-02-01", "2001-06-30"),
        ],
    )
    return cal.days_outside_one_range(
        cal.trading_calendar(fx.bars(spark, sf_dir)), ranges, "2001-07-01"
    )
