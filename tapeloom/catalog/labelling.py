"""Queries over labels and splits (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog import fixtures as fx
from tapeloom.catalog.fixtures import define_view, with_sql
from tapeloom.catalog.panel import SPLIT, folds, universe
from tapeloom.catalog.registry import query, rounded
from tapeloom.operators import calendar as cal
from tapeloom.operators import labels as lab

define_view(
    "labelled",
    ("targets",),
    """SELECT t.*, CASE WHEN target_return < lo THEN 0 WHEN target_return > hi THEN 2 ELSE 1 END
      AS label
    FROM targets t JOIN (SELECT label_date, quantile_cont(target_return, 0.2) AS lo,
      quantile_cont(target_return, 0.8) AS hi FROM targets GROUP BY label_date
      HAVING count(*) >= 5) q USING (label_date)""",
)


@query(
    "L1_next_day_targets",
    with_sql("targets")
    + "SELECT symbol, trading_date, label_date, raw_return, target_return FROM targets",
)
def next_day(spark, sf_dir):
    indexed, _, market = fx.panel(spark, sf_dir)
    return lab.next_day_targets(indexed, market).drop("day_index")


@query(
    "L1_next_day_targets_in_universe",
    with_sql("uni", "bench")
    + """SELECT u.symbol, u.trading_date, c.next_date AS label_date,
      f.close / f.open - 1 AS raw_return,
      (f.close / f.open - 1) - (k.close / k.open - 1) AS target_return
    FROM uni u JOIN cal c USING (trading_date)
    JOIN bars f ON f.symbol = u.symbol AND f.trading_date = c.next_date
    JOIN bench k ON k.trading_date = c.next_date""",
)
def next_day_universe(spark, sf_dir):
    indexed, sessions, market = fx.panel(spark, sf_dir)
    dated = universe(indexed, sessions).join(
        sessions.select("day_index", F.col("next_date").alias("label_date")), "day_index"
    )
    return lab.next_day_targets_in_universe(dated, indexed, market).drop("day_index")


def labelled(spark, sf_dir):
    indexed, _, market = fx.panel(spark, sf_dir)
    targets = lab.next_day_targets(indexed, market)
    return lab.quantile_labels(targets, ["label_date"], min_cross_section=fx.MIN_CROSS_SECTION)


@query(
    "L2_quantile_labels",
    with_sql("labelled") + "SELECT symbol, trading_date, label_date, label FROM labelled",
)
def quantile_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("symbol", "trading_date", "label_date", "label")


@query("L3_horizon_targets", with_sql("hlab") + "SELECT * FROM hlab")
def horizons(spark, sf_dir):
    return fx.horizon_labels(spark, sf_dir)


define_view(
    "sidecar",
    ("hlab", "labelled"),
    """SELECT symbol, trading_date, entry_date, return_end_date, horizon, label, raw_return,
      benchmark_return, target_return FROM hlab WHERE horizon <> 1
    UNION ALL SELECT symbol, trading_date, label_date, label_date, 1, label, raw_return,
      raw_return - target_return, target_return FROM labelled""",
)


@query("L4_horizon_sidecar", with_sql("sidecar") + "SELECT * FROM sidecar")
def sidecar(spark, sf_dir):
    indexed, sessions, market = fx.panel(spark, sf_dir)
    targets = lab.next_day_targets(indexed, market)
    first = lab.quantile_labels(targets, ["label_date"], min_cross_section=fx.MIN_CROSS_SECTION)
    longer = lab.horizon_targets(
        indexed, sessions, market, (2, 3), min_cross_section=fx.MIN_CROSS_SECTION
    )
    return lab.horizon_sidecar(first, longer)


FORMAL = dict(top_n=8, min_history_days=8, lookback=6, min_observations=4)

define_view(
    "fgrid",
    ("ibars", "cal"),
    """SELECT s.symbol, c.day_index, c.trading_date, b.open, b.high, b.low, b.close, b.volume,
      right(s.symbol, 1) = '3' AS is_st,
      last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY c.day_index
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc
    FROM (SELECT symbol, min(day_index) AS first_index FROM ibars GROUP BY symbol) s
    JOIN cal c ON c.day_index >= s.first_index
    LEFT JOIN ibars b ON b.symbol = s.symbol AND b.day_index = c.day_index""",
)
define_view(
    "fstate",
    ("fgrid",),
    """SELECT *, CASE WHEN pc IS NULL THEN NULL WHEN open IS NULL THEN pc ELSE open END AS mark,
      CASE WHEN pc IS NULL THEN NULL WHEN open IS NULL THEN 'suspended'
        WHEN one AND abs(open - round(CAST(pc AS DECIMAL(22,10)) * (1 + ratio), 2)) <= 0.0051
          THEN 'one_price_limit_up'
        WHEN one AND abs(open - round(CAST(pc AS DECIMAL(22,10)) * (1 - ratio), 2)) <= 0.0051
          THEN 'one_price_limit_down' ELSE 'normal' END AS status
    FROM (SELECT *, abs(open - high) <= 0.0051 AND abs(open - low) <= 0.0051 AS one,
      CAST(CASE WHEN is_st THEN 0.05 WHEN symbol LIKE '4%' OR symbol LIKE '8%' THEN 0.30
        WHEN symbol LIKE '688%' OR symbol LIKE '689%' THEN 0.20
        WHEN (symbol LIKE '300%' OR symbol LIKE '301%') AND trading_date >= DATE '2020-08-24'
          THEN 0.20 ELSE 0.10 END AS DECIMAL(4,2)) AS ratio FROM fgrid)""",
)
define_view(
    "frow",
    ("fstate", "liq"),
    """SELECT a.symbol, a.day_index, a.trading_date, a.sel,
      lead(sel) OVER w IS NOT NULL AS has_next,
      lead(mark, 2) OVER w / lead(mark, 1) OVER w - 1 AS raw_return,
      lead(status) OVER w AS status FROM (
        SELECT f.*, u.symbol IS NOT NULL AS sel FROM fstate f LEFT JOIN (
          SELECT day_index, symbol FROM (SELECT *, row_number() OVER (PARTITION BY day_index
            ORDER BY liquidity DESC, symbol DESC) AS rank FROM liq WHERE day_index >= 6
            AND day_index - first_index >= 8 AND observations >= 4 AND liquidity > 0)
          WHERE rank <= 8) u USING (symbol, day_index)) a
      WINDOW w AS (PARTITION BY a.symbol ORDER BY a.day_index)""",
)
define_view(
    "fdate",
    ("frow", "bret"),
    """SELECT c.day_index, c.trading_date, c.next_date AS label_date,
      c.next_next_date AS return_end_date, b.open_next_open AS benchmark_return,
      coalesce(n.candidates, 0) AS candidates,
      coalesce(n.candidates = 8 AND n.targets = 8, false) AND b.open_next_open IS NOT NULL
        AS complete
    FROM cal c LEFT JOIN (SELECT day_index, count(*) FILTER (WHERE sel) AS candidates,
      count(*) FILTER (WHERE sel AND raw_return IS NOT NULL) AS targets FROM frow
      GROUP BY day_index) n USING (day_index)
    LEFT JOIN bret b ON b.trading_date = c.next_date WHERE c.next_next_date IS NOT NULL""",
)
# The carried set, stated day by day: a symbol is carried on a complete date if it left the
# universe at some earlier-or-equal complete date, was not selected since, and no complete
# date in between offered a sale.
define_view(
    "fcarry",
    ("frow", "fdate"),
    """SELECT r.symbol, r.day_index FROM frow r JOIN fdate d USING (day_index)
    WHERE d.complete AND NOT r.sel AND EXISTS (
      SELECT 1 FROM frow x JOIN fdate dx USING (day_index)
      JOIN frow p ON p.symbol = x.symbol AND p.day_index = x.day_index - 1 AND p.sel
      WHERE x.symbol = r.symbol AND x.day_index <= r.day_index AND dx.complete AND NOT x.sel
        AND NOT EXISTS (
          SELECT 1 FROM frow y JOIN fdate dy USING (day_index) WHERE y.symbol = r.symbol
            AND dy.complete AND y.day_index >= x.day_index AND y.day_index < r.day_index
            AND (y.sel OR (y.raw_return IS NOT NULL
              AND y.status IN ('normal', 'one_price_limit_up')))))""",
)
define_view(
    "formal",
    ("fcarry",),
    """SELECT symbol, trading_date, label_date, return_end_date, in_universe, raw_return,
      target_return, execution_status, can_buy, can_sell,
      CASE WHEN NOT in_universe THEN 1 WHEN target_return < lo THEN 0
        WHEN target_return > hi THEN 2 ELSE 1 END AS label FROM (
      SELECT *, quantile_cont(target_return, 0.2) FILTER (WHERE in_universe)
          OVER (PARTITION BY trading_date) AS lo,
        quantile_cont(target_return, 0.8) FILTER (WHERE in_universe)
          OVER (PARTITION BY trading_date) AS hi FROM (
        SELECT r.symbol, d.trading_date, d.label_date, d.return_end_date, r.sel AS in_universe,
          r.raw_return, r.raw_return - d.benchmark_return AS target_return,
          r.status AS execution_status,
          r.status IN ('normal', 'one_price_limit_down') AS can_buy,
          r.status IN ('normal', 'one_price_limit_up') AS can_sell
        FROM frow r JOIN fdate d USING (day_index) WHERE d.complete AND r.raw_return IS NOT NULL
          AND (r.sel OR (r.symbol, r.day_index) IN (SELECT symbol, day_index FROM fcarry))))""",
)


def formal(spark, sf_dir):
    indexed, sessions, market = fx.panel(spark, sf_dir)
    flagged = indexed.withColumn("is_st", F.col("symbol").endswith("3"))
    return lab.formal_targets(flagged, sessions, market, **FORMAL)


@query(
    "L5_formal_targets",
    with_sql("formal")
    + """SELECT symbol, trading_date, label_date, return_end_date, in_universe, raw_return,
    target_return, execution_status, can_buy, can_sell, label FROM formal""",
)
def formal_query(spark, sf_dir):
    rows, _ = formal(spark, sf_dir)
    return rows.drop("benchmark_return", "portfolio_return")


@query(
    "L6_formal_report",
    with_sql("formal")
    + """SELECT count(*) AS requested_signal_dates,
      count(*) FILTER (WHERE complete) AS complete_signal_dates,
      count(*) FILTER (WHERE candidates <> 8) AS incomplete_universe_dates,
      count(*) FILTER (WHERE candidates = 8 AND NOT complete) AS missing_market_state_dates,
      any_value(f.candidate_targets) AS candidate_targets,
      any_value(f.status_only_targets) AS status_only_targets,
      any_value(f.suspended_rows) AS suspended_rows,
      any_value(f.one_price_limit_up_rows) AS one_price_limit_up_rows,
      any_value(f.one_price_limit_down_rows) AS one_price_limit_down_rows
    FROM fdate, (SELECT count(*) FILTER (WHERE in_universe) AS candidate_targets,
      count(*) FILTER (WHERE NOT in_universe) AS status_only_targets,
      count(*) FILTER (WHERE execution_status = 'suspended') AS suspended_rows,
      count(*) FILTER (WHERE execution_status = 'one_price_limit_up') AS one_price_limit_up_rows,
      count(*) FILTER (WHERE execution_status = 'one_price_limit_down')
        AS one_price_limit_down_rows FROM formal) f""",
)
def formal_report(spark, sf_dir):
    rows, dates = formal(spark, sf_dir)
    return lab.formal_report(rows, dates, FORMAL["top_n"])


@query(
    "L7_walk_forward_split",
    with_sql("hlab")
    + """SELECT symbol, trading_date, horizon,
    CASE WHEN trading_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'
        AND return_end_date <= DATE '1998-12-31' THEN 'train'
      WHEN trading_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'
        AND return_end_date <= DATE '1999-12-31' THEN 'val'
      WHEN trading_date BETWEEN DATE '2000-02-01' AND DATE '2001-06-30'
        AND return_end_date <= DATE '2001-06-30' THEN 'test' END AS split,
    CASE WHEN trading_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train'
      WHEN trading_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'val'
      WHEN trading_date BETWEEN DATE '2000-02-01' AND DATE '2001-06-30' THEN 'test' END
      AS signal_split FROM hlab""",
)
def walk_forward(spark, sf_dir):
    rows = fx.horizon_labels(spark, sf_dir)
    return lab.assign_split(rows, SPLIT, entry="entry_date", end="return_end_date").select(
        "symbol", "trading_date", "horizon", "split", "signal_split"
    )


@query(
    "L8_fold_split_counts",
    with_sql("hlab", "folds")
    + """SELECT fold_id, split, horizon,
      count(*) FILTER (WHERE entry_date BETWEEN a AND b AND return_end_date BETWEEN a AND b)
        AS accepted,
      count(*) FILTER (WHERE NOT (entry_date BETWEEN a AND b
        AND return_end_date BETWEEN a AND b)) AS purged
    FROM hlab JOIN (SELECT fold_id, 'train' AS split, train_start AS a, train_end AS b FROM folds
      UNION ALL SELECT fold_id, 'val', val_start, val_end FROM folds
      UNION ALL SELECT fold_id, 'test', oos_start, oos_end FROM folds) f
    ON trading_date BETWEEN a AND b GROUP BY fold_id, split, horizon""",
)
def fold_counts(spark, sf_dir):
    indexed, sessions, market = fx.panel(spark, sf_dir)
    rows = lab.horizon_targets(
        indexed, sessions, market, (1, 2, 3), min_cross_section=fx.MIN_CROSS_SECTION
    )
    return lab.fold_split_counts(rows, cal.split_ranges(folds(sessions)))


@query(
    "L9_relabel",
    with_sql("hlab", "targets")
    + """SELECT symbol, trading_date, h.label AS new_label, h.target_return AS new_return,
      CASE WHEN t.open IS NULL THEN 'extra' WHEN h.label IS NULL THEN 'missing'
        ELSE 'relabelled' END AS status
    FROM targets t
    FULL JOIN (SELECT * FROM hlab WHERE horizon = 3) h USING (symbol, trading_date)""",
)
def relabel(spark, sf_dir):
    indexed, sessions, market = fx.panel(spark, sf_dir)
    samples = lab.next_day_targets(indexed, market)
    side = lab.horizon_targets(
        indexed, sessions, market, (3,), min_cross_section=fx.MIN_CROSS_SECTION
    )
    return lab.relabel(samples, side)


define_view(
    "wz",
    ("targets",),
    """SELECT t.*, median, mad, least(greatest(target_return, median - 5 * mad), median + 5 * mad)
      AS clipped, target_return < median - 5 * mad OR target_return > median + 5 * mad AS cut
    FROM targets t JOIN (SELECT trading_date, any_value(m) AS median,
      quantile_cont(abs(target_return - m), 0.5) AS mad FROM targets JOIN (
        SELECT trading_date, quantile_cont(target_return, 0.5) AS m FROM targets
        GROUP BY trading_date) USING (trading_date) GROUP BY trading_date) q USING (trading_date)""",
)


@query(
    "L10_daily_winsorized_z",
    with_sql("wz")
    + """SELECT symbol, trading_date, round((clipped - avg(clipped) OVER d) / stddev_pop(clipped)
      OVER d, 8) AS z FROM wz WHERE mad > 1e-12 WINDOW d AS (PARTITION BY trading_date)""",
)
def winsorized_z(spark, sf_dir):
    rows, _ = lab.daily_winsorized_z(fx.preds(spark, sf_dir))
    return rows.select("symbol", "trading_date", rounded("z", 8).alias("z"))


@query(
    "L10_winsorized_day_statistics",
    with_sql("wz")
    + """SELECT trading_date, count(*) AS symbols, round(any_value(median), 9) AS median,
      round(any_value(mad), 9) AS mad, CAST(count(*) FILTER (WHERE cut) AS BIGINT)
      AS clipped_symbols, round(avg(clipped), 9) AS winsorized_mean,
      round(stddev_pop(clipped), 9) AS winsorized_std FROM wz WHERE mad > 1e-12 GROUP BY trading_date""",
)
def winsorized_stats(spark, sf_dir):
    _, stats = lab.daily_winsorized_z(fx.preds(spark, sf_dir))
    numbers = ("median", "mad", "winsorized_mean", "winsorized_std")
    return stats.select(
        "trading_date",
        "symbols",
        "clipped_symbols",
        *[rounded(c).alias(c) for c in numbers],
    )


@query(
    "L11_graded_relevance",
    with_sql("targets")
    + """SELECT symbol, trading_date, CAST(least(4, (row_number() OVER w - 1) * 5 // count(*) OVER
      (PARTITION BY trading_date)) AS INTEGER) AS relevance FROM targets
    WINDOW w AS (PARTITION BY trading_date ORDER BY target_return, symbol)""",
)
def relevance(spark, sf_dir):
    return lab.graded_relevance(fx.preds(spark, sf_dir), levels=5).select(
        "symbol", "trading_date", "relevance"
    )


@query(
    "L12_class_weights",
    with_sql("labelled")
    + """SELECT label, count(*) AS count,
      round((SELECT count(*) FROM labelled) / (3.0 * count(*)), 9) AS weight
    FROM labelled GROUP BY label""",
)
def class_weights(spark, sf_dir):
    weights = lab.class_weights(labelled(spark, sf_dir))
    return weights.withColumn("weight", rounded("weight"))


@query(
    "L13_standardize_target",
    with_sql("targets")
    + """SELECT symbol, trading_date, round((target_return - m) / s, 8) AS z,
      round(target_return, 9) AS restored FROM targets, (SELECT avg(target_return) AS m,
        stddev_pop(target_return) AS s FROM targets WHERE trading_date <= DATE '1998-12-31')""",
)
def standardized(spark, sf_dir):
    train = F.col("trading_date") <= F.lit("1998-12-31").cast("date")
    rows = lab.standardize_target(fx.preds(spark, sf_dir), train)
    restored = lab.expected_return(F.col("z"), F.col("target_mean"), F.col("target_std"))
    return rows.select(
        "symbol", "trading_date", rounded("z", 8).alias("z"), rounded(restored).alias("restored")
    )
