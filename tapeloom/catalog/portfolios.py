"""Queries over portfolio tables (P), their sinks (K4, K5) and cost functions (F14, F17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog import fixtures as fx
from tapeloom.catalog.fixtures import define_view, with_sql
from tapeloom.catalog.panel import attributes, scratch
from tapeloom.catalog.ranks import EXPOSURES, corr, exposures, round_columns
from tapeloom.catalog.registry import query, rounded
from tapeloom.functions.scalars import impact_rate, open_execution_state
from tapeloom.operators import labels as lab
from tapeloom.operators import portfolio as pf
from tapeloom.operators import ranking as rk
from tapeloom.plans.shared import settle
from tapeloom.sinks import tables as sink

K, MIN = 10, 20


def predictions(spark, sf_dir):
    """Prediction rows whose return is the raw one, which never falls below -100 %."""
    return fx.preds(spark, sf_dir).withColumn("target_return", F.col("raw_return"))


define_view(
    "pp",
    ("preds",),
    "SELECT * REPLACE (raw_return AS target_return) FROM preds",
)
define_view(
    "sess",
    ("pp",),
    """SELECT *, row_number() OVER (ORDER BY label_date) - 1 AS session FROM (
      SELECT label_date, any_value(trading_date) AS trading_date,
        count(*) FILTER (WHERE in_universe) AS universe_size FROM pp GROUP BY label_date)
    WHERE universe_size >= 20""",
)
define_view(
    "urank",
    ("sess",),
    """SELECT p.*, s.session, row_number() OVER (PARTITION BY p.label_date
        ORDER BY score DESC, symbol) AS rank,
      row_number() OVER (PARTITION BY p.label_date ORDER BY target_return DESC, symbol) AS realized
    FROM pp p JOIN sess s USING (label_date) WHERE in_universe""",
)
define_view(
    "hold",
    ("urank",),
    """SELECT *, 1.0 / count(*) OVER (PARTITION BY label_date) AS weight FROM urank
    WHERE rank <= 10""",
)


def trade_sql(hold: str, keys: str) -> str:
    """Trades of a holdings view; ``keys`` is a comma-terminated list of policy columns."""
    using = f"{keys}symbol, session"
    return f"""SELECT {keys}t.label_date, t.trading_date, symbol, session, old_weight, new_weight,
      new_weight - old_weight AS weight_change, abs(new_weight - old_weight) AS notional,
      CASE WHEN new_weight > old_weight THEN 'buy' ELSE 'sell' END AS action,
      CASE WHEN old_weight = 0 THEN 'entry_rank' WHEN new_weight = 0 AND EXISTS (
          SELECT 1 FROM urank u WHERE u.symbol = j.symbol AND u.session = j.session)
          THEN 'rank_exit'
        WHEN new_weight = 0 THEN 'universe_exit' ELSE 'equal_weight_rebalance' END AS reason
    FROM (SELECT {keys}symbol, session, coalesce(old_weight, 0.0) AS old_weight,
        coalesce(new_weight, 0.0) AS new_weight FROM
      (SELECT {using}, weight AS new_weight FROM {hold}) n FULL JOIN
      (SELECT {keys}symbol, session + 1 AS session, weight * (1 + target_return) / (1 + g)
          AS old_weight FROM {hold} JOIN (SELECT {keys}session, sum(weight * target_return) AS g
          FROM {hold} GROUP BY {keys}session) USING ({keys}session)) o USING ({using})) j
    JOIN sess t USING (session) WHERE abs(new_weight - old_weight) > 1e-15"""


define_view("trade", ("hold",), trade_sql("hold", ""))


def daily_sql(hold: str, trade: str, keys: str, k: str, cost: str, extra: str = "") -> str:
    on = f"{keys}session"
    return f"""SELECT {keys}{extra}session, s.trading_date, s.label_date, s.universe_size,
      positions, coalesce(buy, 0.0) AS buy_turnover, coalesce(sell, 0.0) AS sell_turnover,
      (coalesce(buy, 0.0) + coalesce(sell, 0.0)) / 2 AS one_way_turnover,
      gross AS gross_return, coalesce(cost, 0.0) AS transaction_cost,
      gross - coalesce(cost, 0.0) AS net_return, universe_return,
      gross - universe_return AS active_return,
      gross - coalesce(cost, 0.0) - universe_return AS net_active_return,
      hits / positions AS top_k_realized_overlap, ic AS selected_rank_ic,
      exposure AS gross_exposure, exposure AS net_exposure, 1 - exposure AS cash_weight,
      max_weight, hhi AS concentration_hhi
    FROM (SELECT {on}, count(*) AS positions, sum(weight * target_return) AS gross,
        count(*) FILTER (WHERE realized <= {k}) AS hits, sum(weight) AS exposure,
        max(weight) AS max_weight, sum(weight * weight) AS hhi,
        CASE WHEN stddev_pop(score) > 0 AND stddev_pop(target_return) > 0
          THEN {corr('a', 'b')} END AS ic FROM (
        SELECT *, row_number() OVER (PARTITION BY {on} ORDER BY score, symbol) AS a,
          row_number() OVER (PARTITION BY {on} ORDER BY target_return, symbol) AS b FROM {hold})
        GROUP BY {on}) h
    LEFT JOIN (SELECT {keys}{extra}session, sum(notional) FILTER (WHERE action = 'buy') AS buy,
        sum(notional) FILTER (WHERE action = 'sell') AS sell, sum(notional * CASE WHEN action = 'buy'
          THEN {cost} ELSE {cost} + 5.0 END / 10000.0) AS cost FROM {trade}
        GROUP BY {keys}{extra}session) t USING ({on})
    JOIN (SELECT session, avg(target_return) AS universe_return FROM urank GROUP BY session) u
      USING (session)
    JOIN sess s USING (session)"""


define_view("pday", ("trade",), daily_sql("hold", "trade", "", "10", "10.0"))


def base(spark, sf_dir):
    """Predictions, sessions, holdings, charged trades and the daily table."""
    preds = predictions(spark, sf_dir)
    sessions = pf.eligible_sessions(preds, MIN)
    holdings = settle(pf.select_top_k(preds, sessions, K), "holdings")
    charged = settle(pf.charge(pf.build_trades(holdings, preds, sessions)), "trades")
    daily = settle(pf.daily_table(preds, holdings, charged, sessions, (), K), "daily")
    return preds, sessions, holdings, charged, daily


@query(
    "P1_top_k_selection",
    with_sql("hold")
    + "SELECT label_date, symbol, rank, score, round(weight, 9) AS weight FROM hold",
)
def top_k(spark, sf_dir):
    preds = predictions(spark, sf_dir)
    chosen = pf.select_top_k(preds, pf.eligible_sessions(preds, MIN), K)
    return chosen.select("label_date", "symbol", "rank", "score", rounded("weight").alias("weight"))


define_view(
    "marked",
    ("pp",),
    """SELECT trading_date, label_date, symbol, in_universe,
      CASE WHEN volume % 10 = 0 THEN 'nan'::DOUBLE ELSE score END AS score,
      CASE WHEN volume % 10 = 1 THEN NULL WHEN volume % 10 = 2 THEN false ELSE can_buy END AS can_buy,
      CASE WHEN volume % 10 = 3 THEN NULL ELSE target_return END AS target_return
    FROM (SELECT pp.*, b.volume FROM pp JOIN bars b USING (trading_date, symbol))""",
)


def marked(spark, sf_dir):
    """Predictions with defects put in by the last digit of the volume; no row is left out."""
    volume = fx.bars(spark, sf_dir).select("trading_date", "symbol", "volume")
    last = F.col("volume") % 10
    return predictions(spark, sf_dir).join(volume, ["trading_date", "symbol"]).select(
        "trading_date",
        "label_date",
        "symbol",
        "in_universe",
        F.when(last == 0, F.lit(float("nan"))).otherwise(F.col("score")).alias("score"),
        F.when(last == 1, F.lit(None)).when(last == 2, False).otherwise(F.col("can_buy")).alias("can_buy"),
        F.when(last != 3, F.col("target_return")).alias("target_return"),
    )


@query(
    "P1_tradable_selection",
    with_sql("marked", "sess")
    + f"""SELECT label_date, symbol, rank, score FROM (
      SELECT m.*, row_number() OVER (PARTITION BY m.label_date ORDER BY score DESC, symbol) AS rank
      FROM marked m JOIN (SELECT label_date FROM sess) s USING (label_date)
      WHERE in_universe AND can_buy AND NOT isnan(score)) WHERE rank <= {K}""",
)
def tradable(spark, sf_dir):
    """Top-K where scores may be NaN and rows may not be bought, or nobody knows."""
    rows = marked(spark, sf_dir)
    chosen = pf.select_top_k(rows, pf.eligible_sessions(rows, MIN), K)
    return chosen.select("label_date", "symbol", "rank", "score")


@query(
    "P1_selection_violations",
    with_sql("marked")
    + """SELECT label_date, symbol, reason FROM marked, (SELECT unnest(['score not finite',
        'tradability unknown', 'return missing']) AS reason)
      WHERE (reason = 'score not finite' AND isnan(score))
        OR (reason = 'tradability unknown' AND can_buy IS NULL)
        OR (reason = 'return missing' AND target_return IS NULL AND in_universe AND can_buy
          AND NOT isnan(score))""",
)
def selection_violations(spark, sf_dir):
    return pf.selection_violations(marked(spark, sf_dir))


@query(
    "P1_top_k_selection_with_cash",
    with_sql("urank")
    + """SELECT label_date, symbol, rank, round(0.1, 9)::DOUBLE AS weight FROM urank
    WHERE rank <= 10 AND score >= 0.95""",
)
def top_k_cash(spark, sf_dir):
    preds = predictions(spark, sf_dir)
    sessions = pf.eligible_sessions(preds, MIN)
    chosen = pf.select_top_k(preds, sessions, K, min_score=0.95, allow_cash=True)
    return chosen.select("label_date", "symbol", "rank", rounded("weight").alias("weight"))


define_view(
    "band",
    ("urank",),
    """SELECT *, 1.0 / count(*) OVER (PARTITION BY top_k, exit_buffer, label_date) AS weight FROM (
      SELECT *, max(CASE WHEN rank <= top_k THEN 1 ELSE 0 END) OVER (PARTITION BY top_k,
        exit_buffer, symbol, island ORDER BY session) AS member FROM (
        SELECT u.*, top_k, exit_buffer, session - row_number() OVER (PARTITION BY top_k,
          exit_buffer, symbol ORDER BY session) AS island
        FROM urank u, (VALUES (5, 0), (5, 10), (10, 0), (10, 10)) g(top_k, exit_buffer)
        WHERE rank <= top_k + exit_buffer)) WHERE member = 1""",
)
POLICIES = [(5, 0), (5, 10), (10, 0), (10, 10)]


@query(
    "P2_hysteresis_members",
    with_sql("band")
    + """SELECT top_k, exit_buffer, label_date, symbol, rank, round(weight, 9) AS weight FROM band""",
)
def hysteresis(spark, sf_dir):
    preds = predictions(spark, sf_dir)
    rows = pf.hysteresis_members(preds, pf.eligible_sessions(preds, MIN), POLICIES)
    return rows.select(
        "top_k", "exit_buffer", "label_date", "symbol", "rank", rounded("weight").alias("weight")
    )


@query(
    "P3_trades",
    with_sql("trade")
    + """SELECT label_date, symbol, action, reason, round(old_weight, 9) AS old_weight,
      round(new_weight, 9) AS new_weight, round(weight_change, 9) + 0.0 AS weight_change,
      round(notional, 9) AS notional FROM trade""",
)
def trades(spark, sf_dir):
    preds = predictions(spark, sf_dir)
    sessions = pf.eligible_sessions(preds, MIN)
    holdings = settle(pf.select_top_k(preds, sessions, K), "holdings")
    rows = pf.build_trades(holdings, preds, sessions)
    return rows.select(
        "label_date",
        "symbol",
        "action",
        "reason",
        *[rounded(c).alias(c) for c in ("old_weight", "new_weight", "weight_change", "notional")],
    )


@query(
    "P4_directional_cost",
    with_sql("trade")
    + """SELECT label_date, symbol, CASE WHEN action = 'buy' THEN 10.0 ELSE 15.0 END / 10000.0
      AS cost_rate, round(notional * CASE WHEN action = 'buy' THEN 10.0 ELSE 15.0 END / 10000.0, 12)
      AS transaction_cost FROM trade""",
)
def costs(spark, sf_dir):
    *_, charged, _ = base(spark, sf_dir)
    return charged.select(
        "label_date", "symbol", "cost_rate", rounded("transaction_cost", 12).alias("transaction_cost")
    )


DAILY_VALUES = (
    "buy_turnover",
    "sell_turnover",
    "one_way_turnover",
    "gross_return",
    "transaction_cost",
    "net_return",
    "universe_return",
    "active_return",
    "net_active_return",
    "top_k_realized_overlap",
    "selected_rank_ic",
    "gross_exposure",
    "net_exposure",
    "cash_weight",
    "max_weight",
    "concentration_hhi",
)


def rounded_sql(names, places=8):
    return ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in names)


@query(
    "P5_portfolio_daily",
    with_sql("pday")
    + f"""SELECT trading_date, label_date, universe_size, positions, {rounded_sql(DAILY_VALUES)}
    FROM pday""",
)
def portfolio_daily(spark, sf_dir):
    *_, daily = base(spark, sf_dir)
    return daily.select(
        "trading_date",
        "label_date",
        "universe_size",
        "positions",
        *[rounded(c, 8).alias(c) for c in DAILY_VALUES],
    )


@query(
    "P5_portfolio_daily_with_cash",
    with_sql("urank")
    + """SELECT s.label_date, count(u.symbol) AS positions,
      round(coalesce(sum(0.1 * u.target_return), 0.0), 8) AS gross_return,
      round(1 - count(u.symbol) * 0.1, 8) + 0.0 AS cash_weight
    FROM sess s LEFT JOIN (SELECT * FROM urank WHERE rank <= 10 AND score >= 0.95) u
      USING (label_date) GROUP BY s.label_date""",
)
def portfolio_daily_cash(spark, sf_dir):
    """A threshold that leaves some sessions without a holding."""
    preds = predictions(spark, sf_dir)
    sessions = pf.eligible_sessions(preds, MIN)
    holdings = settle(
        pf.select_top_k(preds, sessions, K, min_score=0.95, allow_cash=True), "holdings"
    )
    charged = pf.charge(pf.build_trades(holdings, preds, sessions))
    daily = pf.daily_table(preds, holdings, charged, sessions, (), K)
    return daily.select(
        "label_date",
        "positions",
        rounded("gross_return", 8).alias("gross_return"),
        rounded("cash_weight", 8).alias("cash_weight"),
    )


@query(
    "P6_holdings_detail",
    with_sql("hold")
    + """SELECT trading_date, label_date, symbol, rank, score, target_return,
      round(weight, 9) AS weight, round(weight * target_return, 9) + 0.0 AS gross_contribution,
      can_buy, can_sell, in_universe FROM hold""",
)
def holdings_detail(spark, sf_dir):
    preds = predictions(spark, sf_dir)
    chosen = pf.select_top_k(preds, pf.eligible_sessions(preds, MIN), K)
    rows = pf.holdings_detail(chosen)
    return rows.withColumns({c: rounded(c) for c in ("weight", "gross_contribution")})


define_view(
    "curve",
    ("pday",),
    """SELECT *, exp(sum(ln(1 + net_return)) OVER (ORDER BY label_date)) AS c FROM pday""",
)


@query(
    "P7_return_summary",
    with_sql("curve")
    + """SELECT count(*) AS days, round(avg(net_return), 8) AS mean_daily,
      round(stddev_samp(net_return), 8) AS std_daily,
      round(avg(net_return) * 244, 6) AS annualized_return,
      round(stddev_samp(net_return) * sqrt(244), 6) AS annualized_volatility,
      round(avg(net_return) / stddev_samp(net_return) * sqrt(244), 6) AS sharpe,
      round(sum(ln(1 + net_return)), 6) AS log_cumulative, round(min(c / peak - 1), 8) + 0.0
        AS max_drawdown,
      round(avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END), 8) AS positive_days_ratio
    FROM (SELECT *, greatest(1, max(c) OVER (ORDER BY label_date)) AS peak FROM curve)""",
)
def return_summary(spark, sf_dir):
    *_, daily = base(spark, sf_dir)
    out = pf.return_summary(daily, "net_return")
    return out.select(
        "days",
        rounded("mean_daily", 8).alias("mean_daily"),
        rounded("std_daily", 8).alias("std_daily"),
        rounded("annualized_return", 6).alias("annualized_return"),
        rounded("annualized_volatility", 6).alias("annualized_volatility"),
        rounded("sharpe", 6).alias("sharpe"),
        rounded(F.log1p("cumulative_return"), 6).alias("log_cumulative"),
        rounded("max_drawdown", 8).alias("max_drawdown"),
        rounded("positive_days_ratio", 8).alias("positive_days_ratio"),
    )


@query(
    "P8_returns_by_period",
    with_sql("pday")
    + """SELECT strftime(label_date, '%Y') AS month, count(*) AS days,
      round(avg(gross_return), 8) AS gross_mean, round(avg(net_return), 8) AS net_mean,
      round(avg(active_return), 8) + 0.0 AS active_mean,
      round(avg(net_active_return), 8) + 0.0 AS net_active_mean,
      round(sum(ln(1 + gross_return)), 6) AS gross_log, round(sum(ln(1 + net_return)), 6) AS net_log,
      round(avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END), 8) AS positive_net_days_ratio,
      round(avg(CASE WHEN net_active_return > 0 THEN 1.0 ELSE 0.0 END), 8)
        AS positive_net_active_days_ratio FROM pday GROUP BY month""",
)
def monthly(spark, sf_dir):
    *_, daily = base(spark, sf_dir)
    out = pf.monthly_returns(daily, period=F.date_format("label_date", "yyyy"))
    means = ("gross_mean", "net_mean", "active_mean", "net_active_mean")
    ratios = ("positive_net_days_ratio", "positive_net_active_days_ratio")
    return out.select(
        "month",
        "days",
        *[rounded(c, 8).alias(c) for c in means + ratios],
        rounded(F.log1p("gross_cumulative"), 6).alias("gross_log"),
        rounded(F.log1p("net_cumulative"), 6).alias("net_log"),
    )


@query(
    "P9_extreme_days",
    with_sql("pday")
    + "SELECT "
    + ", ".join(
        f"round(sum(abs(active_return)) FILTER (WHERE r <= {n}) / sum(abs(active_return)), 8)"
        f" AS top_{n}_absolute_contribution"
        for n in (1, 5, 10)
    )
    + """ FROM (SELECT *, row_number() OVER (ORDER BY abs(active_return) DESC, label_date) AS r
      FROM pday)""",
)
def extremes(spark, sf_dir):
    *_, daily = base(spark, sf_dir)
    return round_columns(pf.extreme_days(daily, "active_return"), (), 8)


@query(
    "P9_largest_days",
    with_sql("pday")
    + """SELECT place, label_date, round(gross_return, 8) AS gross_return,
      round(net_return, 8) AS net_return FROM (SELECT *, row_number() OVER (
      ORDER BY abs(gross_return) DESC, label_date) AS place FROM pday) WHERE place <= 10""",
)
def largest_days(spark, sf_dir):
    *_, daily = base(spark, sf_dir)
    rows = pf.largest_days(daily, "gross_return")
    return rows.select(
        "place",
        "label_date",
        rounded("gross_return", 8).alias("gross_return"),
        rounded("net_return", 8).alias("net_return"),
    )


def means_sql() -> str:
    return ", ".join(
        f"round(avg({c}), 8) + 0.0 AS {name}" for name, c in pf.SUMMARY_MEANS.items()
    )


@query(
    "P10_portfolio_summary",
    with_sql("pday")
    + f"""SELECT count(*) AS evaluated_dates, min(label_date) AS first_date,
      max(label_date) AS last_date, {means_sql()},
      round(avg(CASE WHEN active_return > 0 THEN 1.0 ELSE 0.0 END), 8)
        AS positive_active_days_ratio FROM pday""",
)
def summary(spark, sf_dir):
    *_, daily = base(spark, sf_dir)
    out = pf.portfolio_summary(daily)
    return round_columns(out, ("evaluated_dates", "first_date", "last_date"), 8)


@query(
    "P11_long_short",
    with_sql("pp")
    + """, s AS (SELECT *, row_number() OVER (ORDER BY label_date) - 1 AS session FROM (
      SELECT label_date, count(*) AS n FROM pp GROUP BY label_date) WHERE n >= 20),
    r AS (SELECT p.*, session, session // 3 * 3 AS rb FROM pp p JOIN s USING (label_date)),
    t AS (SELECT rb, symbol, place, n FROM (SELECT rb, symbol, row_number() OVER (PARTITION BY rb
      ORDER BY score DESC, symbol) AS place, count(*) OVER (PARTITION BY rb) AS n FROM r
      WHERE session = rb)),
    m AS (SELECT rb, symbol, 'long' AS side FROM t
        WHERE place <= greatest(1, CAST(floor(n * 0.1) AS BIGINT))
      UNION ALL SELECT rb, symbol, 'short' FROM t
        WHERE place > n - greatest(1, CAST(floor(n * 0.1) AS BIGINT))),
    o AS (SELECT rb, avg(v) AS turnover FROM (SELECT a.rb, a.side,
      avg(CASE WHEN b.symbol IS NULL THEN 1.0 ELSE 0.0 END) AS v FROM m a LEFT JOIN m b
      ON b.symbol = a.symbol AND b.side = a.side AND b.rb = a.rb - 3 GROUP BY a.rb, a.side)
      GROUP BY rb)
    SELECT label_date, session, round(g, 8) + 0.0 AS gross_return, round(v, 9) AS turnover,
      round(v * (2 * 10.0 / 10000.0 + 0.0005), 12) AS transaction_cost,
      round(g - v * (2 * 10.0 / 10000.0 + 0.0005), 8) + 0.0 AS net_return FROM (
      SELECT label_date, session, CASE WHEN session = rb THEN turnover ELSE 0.0 END AS v,
        avg(target_return) FILTER (WHERE side = 'long')
          - avg(target_return) FILTER (WHERE side = 'short') AS g
      FROM r JOIN m USING (rb, symbol) JOIN o USING (rb)
      GROUP BY label_date, session, rb, turnover) WHERE g IS NOT NULL""",
)
def long_short(spark, sf_dir):
    rows = pf.long_short_daily(
        predictions(spark, sf_dir), quantile=0.1, rebalance_days=3, min_symbols=MIN
    )
    return rows.select(
        "label_date",
        "session",
        rounded("gross_return", 8).alias("gross_return"),
        rounded("turnover").alias("turnover"),
        rounded("transaction_cost", 12).alias("transaction_cost"),
        rounded("net_return", 8).alias("net_return"),
    )


# ---- grid ------------------------------------------------------------------

define_view("btrade", ("band",), trade_sql("band", "top_k, exit_buffer, "))
define_view(
    "ctrade",
    ("btrade",),
    "SELECT * FROM btrade, (SELECT unnest([5.0, 10.0, 20.0])::DOUBLE AS cost_bps)",
)
define_view(
    "gday",
    ("ctrade",),
    daily_sql("band", "ctrade", "top_k, exit_buffer, ", "top_k", "cost_bps", "cost_bps, "),
)
define_view(
    "grid_sum",
    ("gday",),
    """SELECT top_k, exit_buffer, cost_bps, count(*) AS evaluated_dates,
      min(label_date) AS first_date, max(label_date) AS last_date,
      avg(buy_turnover) AS mean_buy, avg(sell_turnover) AS mean_sell,
      avg(one_way_turnover) AS mean_one_way, avg(transaction_cost) AS mean_transaction_cost,
      avg(active_return) AS mean_active_return, avg(net_active_return) AS mean_net_active_return,
      avg(positions) AS mean_positions, avg(gross_return) AS gross_mean_daily,
      avg(net_return) AS net_mean_daily,
      avg(net_return) / stddev_samp(net_return) * sqrt(244) AS net_sharpe,
      count(*) AS month_count,
      avg(CASE WHEN net_active_return > 0 THEN 1.0 ELSE 0.0 END) AS positive_net_active_month_ratio,
      sum(abs(active_return)) FILTER (WHERE r <= 5) / sum(abs(active_return))
        AS top_5_absolute_active_contribution
    FROM (SELECT *, row_number() OVER (PARTITION BY top_k, exit_buffer, cost_bps
      ORDER BY abs(active_return) DESC, label_date) AS r FROM gday)
    GROUP BY top_k, exit_buffer, cost_bps""",
)
GRID_VALUES = (
    "mean_buy",
    "mean_sell",
    "mean_one_way",
    "mean_transaction_cost",
    "mean_active_return",
    "mean_net_active_return",
    "mean_positions",
    "gross_mean_daily",
    "net_mean_daily",
    "net_sharpe",
    "positive_net_active_month_ratio",
    "top_5_absolute_active_contribution",
)


def grid(spark, sf_dir):
    preds = predictions(spark, sf_dir)
    return settle(
        pf.policy_grid(preds, (5, 10), (0, 10), (5.0, 10.0, 20.0), min_symbols=MIN), "grid"
    )


@query(
    "P12_policy_grid",
    with_sql("grid_sum")
    + f"""SELECT top_k, exit_buffer, cost_bps, evaluated_dates, month_count, first_date, last_date,
      {rounded_sql(GRID_VALUES, 7)} FROM grid_sum""",
)
def policy_grid(spark, sf_dir):
    out = grid(spark, sf_dir)
    return out.select(
        "top_k",
        "exit_buffer",
        "cost_bps",
        "evaluated_dates",
        "month_count",
        "first_date",
        "last_date",
        *[rounded(c, 7).alias(c) for c in GRID_VALUES],
    )


define_view(
    "cand",
    ("grid_sum",),
    """SELECT *, enough_dates AND positive_net_sharpe AND positive_net_active AND stable_months
        AND limited_concentration AND buffer_efficient AS passes FROM (
      SELECT *, evaluated_dates >= 60 AS enough_dates, net_sharpe > 0 AS positive_net_sharpe,
        net_active_mean_daily > 0 AS positive_net_active,
        positive_net_active_month_ratio >= 0.5 AS stable_months,
        top_5_absolute_active_contribution <= 0.5 AS limited_concentration,
        exit_buffer = 0 OR (turnover_reduction > 1e-12 AND net_delta >= -1e-12)
          AS buffer_efficient FROM (
        SELECT c.*, c.mean_active_return AS gross_active_mean_daily,
          c.mean_active_return - c.mean_transaction_cost AS net_active_mean_daily,
          CASE WHEN c.exit_buffer <> 0 THEN b.mean_one_way - c.mean_one_way ELSE 0.0 END
            AS turnover_reduction,
          CASE WHEN c.exit_buffer <> 0 THEN c.gross_mean_daily - b.gross_mean_daily ELSE 0.0 END
            AS gross_delta,
          CASE WHEN c.exit_buffer <> 0 THEN c.net_mean_daily - b.net_mean_daily ELSE 0.0 END
            AS net_delta,
          CASE WHEN c.exit_buffer <> 0 THEN b.mean_transaction_cost - c.mean_transaction_cost
            ELSE 0.0 END AS cost_saving
        FROM grid_sum c JOIN grid_sum b ON b.top_k = c.top_k AND b.exit_buffer = 0
          AND b.cost_bps = 10.0 WHERE c.cost_bps = 10.0))""",
)
CRITERIA = (
    "enough_dates, positive_net_sharpe, positive_net_active, stable_months,"
    " limited_concentration, buffer_efficient, passes"
)
CANDIDATE_VALUES = (
    "net_mean_daily",
    "net_sharpe",
    "gross_active_mean_daily",
    "net_active_mean_daily",
    "positive_net_active_month_ratio",
    "top_5_absolute_active_contribution",
    "mean_one_way",
    "turnover_reduction",
    "gross_delta",
    "net_delta",
    "cost_saving",
)


@query(
    "P13_grid_candidates",
    with_sql("cand")
    + f"""SELECT row_number() OVER (ORDER BY passes DESC, net_active_mean_daily DESC,
        net_sharpe DESC, mean_one_way, top_k, exit_buffer) AS place, top_k, exit_buffer, cost_bps,
      evaluated_dates, month_count, {rounded_sql(CANDIDATE_VALUES, 7)}, {CRITERIA} FROM cand""",
)
def candidates(spark, sf_dir):
    out = pf.grid_candidates(grid(spark, sf_dir))
    return out.withColumns({c: rounded(c, 7) for c in CANDIDATE_VALUES})


@query(
    "P13_breakeven",
    with_sql("grid_sum")
    + """SELECT top_k, exit_buffer,
      round((gross_mean_daily * 10000 - 5.0 * mean_sell) / (mean_buy + mean_sell), 4)
        AS absolute_breakeven_bps,
      round((mean_active_return * 10000 - 5.0 * mean_sell) / (mean_buy + mean_sell), 4) + 0.0
        AS active_breakeven_bps FROM grid_sum WHERE cost_bps = 10.0""",
)
def breakeven(spark, sf_dir):
    return round_columns(
        pf.breakeven_table(grid(spark, sf_dir), 10.0), ("top_k", "exit_buffer"), 4
    )


@query(
    "P13_grid_verdict",
    with_sql("cand")
    + """SELECT CASE WHEN count(*) FILTER (WHERE passes) > 0 THEN 'TRADEABLE_REGION_FOUND'
        ELSE 'NO_TRADEABLE_REGION' END AS status, count(*) FILTER (WHERE passes) AS sweet_spots,
      arg_min(top_k, place) FILTER (WHERE passes) AS best_top_k,
      arg_min(exit_buffer, place) FILTER (WHERE passes) AS best_exit_buffer
    FROM (SELECT *, row_number() OVER (ORDER BY passes DESC, net_active_mean_daily DESC,
      net_sharpe DESC, mean_one_way, top_k, exit_buffer) AS place FROM cand)""",
)
def verdict(spark, sf_dir):
    return pf.grid_verdict(pf.grid_candidates(grid(spark, sf_dir)))


@query(
    "P13_grid_completeness",
    with_sql("grid_sum")
    + """SELECT count(*) AS combinations, count(DISTINCT evaluated_dates) = 1
      AND count(DISTINCT (first_date, last_date)) = 1 AS same_date_sample,
      (SELECT count(*) FROM (SELECT DISTINCT top_k FROM grid_sum),
        (SELECT DISTINCT exit_buffer FROM grid_sum), (SELECT DISTINCT cost_bps FROM grid_sum))
      - count(DISTINCT (top_k, exit_buffer, cost_bps)) AS missing FROM grid_sum""",
)
def completeness(spark, sf_dir):
    out = grid(spark, sf_dir)
    missing = pf.grid_missing(out).agg(F.count(F.lit(1)).alias("missing"))
    return pf.grid_comparable(out).withColumn("missing", missing.scalar())


# ---- staggered cohorts -----------------------------------------------------

define_view(
    "stag_m",
    ("hlab", "signals"),
    """SELECT * FROM (SELECT s.trading_date, s.symbol, s.score, h.return_end_date, h.raw_return,
      h.benchmark_return, cohort, count(*) OVER (PARTITION BY s.trading_date) AS n,
      row_number() OVER (PARTITION BY s.trading_date ORDER BY s.score DESC, s.symbol) AS rank
    FROM signals s JOIN (SELECT *, row_number() OVER (ORDER BY trading_date) - 1 AS cohort
      FROM (SELECT DISTINCT trading_date FROM signals)) USING (trading_date)
    JOIN (SELECT * FROM hlab WHERE horizon = 3) h USING (trading_date, symbol)) WHERE n >= 20""",
)
define_view(
    "stag",
    ("stag_m",),
    """SELECT *, raw - bench AS active_return, raw - cost AS net_return,
      raw - bench - cost AS net_active_return FROM (
      SELECT CAST(cohort AS INTEGER) AS cohort, CAST(cohort % 5 AS INTEGER) AS sleeve, trading_date,
        min(return_end_date) AS return_end_date, count(*) FILTER (WHERE sel) AS positions,
        count(*) FILTER (WHERE sel) / 50.0 AS gross_exposure,
        0.2 - count(*) FILTER (WHERE sel) / 50.0 AS cash_weight,
        coalesce(count(*) FILTER (WHERE sel) / 50.0 * avg(raw_return) FILTER (WHERE sel), 0.0)
          AS raw,
        coalesce(count(*) FILTER (WHERE sel) / 50.0 * avg(benchmark_return) FILTER (WHERE sel), 0.0)
          AS bench,
        count(*) FILTER (WHERE sel) / 50.0 * (2 * 10.0 + 5.0) / 10000.0 AS cost
      FROM (SELECT *, rank <= 10 AND score >= 0.6 AS sel FROM stag_m) GROUP BY cohort, trading_date)""",
)


def staggered(spark, sf_dir):
    indexed, sessions, market = fx.panel(spark, sf_dir)
    targets = lab.horizon_returns(indexed, sessions, market, (3,))
    chosen = pf.staggered_selection(
        fx.signals_of(indexed, sessions), targets, K, min_score=0.6, min_symbols=MIN
    )
    return chosen, indexed


@query(
    "P14_staggered_cohorts",
    with_sql("stag")
    + """SELECT cohort, sleeve, trading_date, return_end_date, positions,
      round(gross_exposure, 9) AS gross_exposure, round(cash_weight, 9) + 0.0 AS cash_weight,
      round(raw, 8) + 0.0 AS raw_return, round(bench, 8) + 0.0 AS benchmark_return,
      round(cost, 12) AS transaction_cost, round(active_return, 8) + 0.0 AS active_return,
      round(net_return, 8) + 0.0 AS net_return, round(net_active_return, 8) + 0.0
        AS net_active_return FROM stag""",
)
def staggered_cohorts(spark, sf_dir):
    (cohorts, members), _ = staggered(spark, sf_dir)
    out = pf.staggered_cohorts(cohorts, members, K)
    eight = ("raw_return", "benchmark_return", "active_return", "net_return", "net_active_return")
    return out.withColumns(
        {c: rounded(c, 8) for c in eight}
        | {"gross_exposure": rounded("gross_exposure"), "cash_weight": rounded("cash_weight")}
        | {"transaction_cost": rounded("transaction_cost", 12)}
    )


@query(
    "P14_staggered_summary",
    with_sql("stag")
    + """SELECT count(*) AS evaluated_cohorts, round(avg(positions), 8) AS mean_positions,
      round(avg(gross_exposure) * 5, 8) AS mean_gross_exposure,
      round(avg(gross_exposure), 8) AS mean_one_way_turnover,
      round(avg(active_return), 8) + 0.0 AS mean_active_return,
      round(avg(net_active_return), 8) + 0.0 AS mean_net_active_return,
      round(ln(abs(product(1 + raw))), 6) + 0.0 AS log_raw,
      round(ln(abs(product(1 + bench))), 6) + 0.0 AS log_benchmark,
      round(ln(abs(product(1 + net_return))), 6) + 0.0 AS log_net,
      round(ln(abs(product(1 + net_active_return))), 6) + 0.0 AS log_net_active FROM stag""",
)
def staggered_summary(spark, sf_dir):
    (cohorts, members), _ = staggered(spark, sf_dir)
    out = pf.staggered_summary(pf.staggered_cohorts(cohorts, members, K))
    log = lambda c: F.round(F.log(F.abs(1 + F.col(c))), 6)
    means = (
        "mean_positions",
        "mean_gross_exposure",
        "mean_one_way_turnover",
        "mean_active_return",
        "mean_net_active_return",
    )
    return out.select(
        "evaluated_cohorts",
        *[rounded(c, 8).alias(c) for c in means],
        log("cumulative_raw_return").alias("log_raw"),
        log("cumulative_benchmark_return").alias("log_benchmark"),
        log("cumulative_net_return").alias("log_net"),
        log("cumulative_net_active_return").alias("log_net_active"),
    )


@query(
    "P14_sleeve_returns",
    with_sql("stag")
    + """SELECT sleeve, count(*) AS cohorts, round(ln(abs(product(1 + 5 * net_active_return))), 6)
      + 0.0 AS log_net_active FROM stag GROUP BY sleeve""",
)
def sleeves(spark, sf_dir):
    (cohorts, members), _ = staggered(spark, sf_dir)
    out = pf.sleeve_returns(pf.staggered_cohorts(cohorts, members, K))
    grown = F.log(F.abs(1 + F.col("cumulative_net_active_return")))
    return out.select("sleeve", "cohorts", F.round(grown, 6).alias("log_net_active"))


# ---- risk and cost ---------------------------------------------------------


def priced(spark, sf_dir):
    """Portfolio tables next to signals and attributes of the same panel."""
    indexed, sessions, market = fx.panel(spark, sf_dir)
    rows = lab.next_day_targets(indexed, market, keep=["open", "close", "volume"])
    preds = settle(
        rows.select(
            "symbol",
            "trading_date",
            "label_date",
            (1 - F.col("close") / F.col("open")).alias("score"),
            F.col("raw_return").alias("target_return"),
            (F.col("volume") >= 100).alias("in_universe"),
        ),
        "predictions",
    )
    dates = pf.eligible_sessions(preds, MIN)
    holdings = settle(pf.select_top_k(preds, dates, K), "holdings")
    charged = settle(pf.charge(pf.build_trades(holdings, preds, dates)), "trades")
    daily = pf.daily_table(preds, holdings, charged, dates, (), K)
    return fx.signals_of(indexed, sessions), attributes(indexed), holdings, charged, daily


FIELDS = ("log_size", "adv", "volatility")
define_view(
    "risk",
    ("hold", "attrs", "signals"),
    "SELECT trading_date, universe_coverage, holding_coverage, "
    + ", ".join(f"({f}_x / w - {f}_m) / {f}_s AS {f}_z" for f in FIELDS)
    + """ FROM (SELECT trading_date, count(a.symbol) / count(*) AS holding_coverage,
      sum(weight) FILTER (WHERE a.symbol IS NOT NULL) AS w, """
    + ", ".join(f"sum(weight * a.{f}) AS {f}_x" for f in FIELDS)
    + """ FROM hold h LEFT JOIN attrs a USING (trading_date, symbol) GROUP BY trading_date) x
    JOIN (SELECT trading_date, count(a.symbol) / count(*) AS universe_coverage,
      count(a.symbol) AS pool, """
    + ", ".join(f"avg(a.{f}) AS {f}_m, stddev_samp(a.{f}) AS {f}_s" for f in FIELDS)
    + """ FROM signals s LEFT JOIN attrs a USING (trading_date, symbol) GROUP BY trading_date) y
    USING (trading_date) WHERE pool >= 60 AND holding_coverage > 0""",
)


@query(
    "P15_risk_attribution",
    with_sql("risk")
    + f"""SELECT trading_date, round(universe_coverage, 9) AS universe_coverage,
      round(holding_coverage, 9) AS holding_coverage,
      {rounded_sql([f'{f}_z' for f in FIELDS], 7)} FROM risk""",
)
def risk(spark, sf_dir):
    signals, attrs, holdings, *_ = priced(spark, sf_dir)
    out = pf.risk_attribution(holdings, signals, attrs, min_pool=60)
    return out.select(
        "trading_date",
        rounded("universe_coverage").alias("universe_coverage"),
        rounded("holding_coverage").alias("holding_coverage"),
        *[rounded(f"{f}_z", 7).alias(f"{f}_z") for f in FIELDS],
    )


@query(
    "P15_risk_summary",
    with_sql("risk")
    + """SELECT count(*) AS evaluated_dates,
      round(avg(universe_coverage), 8) AS mean_universe_coverage,
      round(avg(holding_coverage), 8) AS mean_holding_coverage, """
    + ", ".join(f"round(avg({f}_z), 7) + 0.0 AS mean_{f}_z" for f in FIELDS)
    + " FROM risk",
)
def risk_summary(spark, sf_dir):
    signals, attrs, holdings, *_ = priced(spark, sf_dir)
    out = pf.risk_summary(pf.risk_attribution(holdings, signals, attrs, min_pool=60))
    return out.select(
        "evaluated_dates",
        rounded("mean_universe_coverage", 8).alias("mean_universe_coverage"),
        rounded("mean_holding_coverage", 8).alias("mean_holding_coverage"),
        *[rounded(f"mean_{f}_z", 7).alias(f"mean_{f}_z") for f in FIELDS],
    )


VALUE = 1_000_000.0


def impact_sql(weight: str) -> str:
    return (
        f"CASE WHEN adv > 0 THEN least(50.0, 10.0 * sqrt(greatest({weight} * {VALUE} / adv, 0.0)))"
        " / 10000.0 ELSE 50.0 / 10000.0 END"
    )


@query(
    "F17_impact_rate",
    with_sql("trade", "attrs")
    + f"""SELECT label_date, symbol, round({impact_sql('notional')}, 10) AS impact
    FROM trade LEFT JOIN attrs USING (trading_date, symbol)""",
)
def impact(spark, sf_dir):
    _, attrs, _, charged, _ = priced(spark, sf_dir)
    rows = charged.join(attrs.select("trading_date", "symbol", "adv"), ["trading_date", "symbol"], "left")
    rate = impact_rate(F.col("notional"), F.col("adv"), VALUE)
    return rows.select("label_date", "symbol", rounded(rate, 10).alias("impact"))


define_view(
    "reprice",
    ("pday", "attrs"),
    f"""SELECT label_date, cost AS dynamic_transaction_cost, gross_return - cost AS net_return,
      gross_return - cost - universe_return AS net_active_return, trades, known_trades
    FROM pday JOIN (SELECT t.label_date, count(*) AS trades, count(adv) AS known_trades,
      sum(notional * CASE WHEN action = 'buy' THEN 10.0 ELSE 15.0 END / 10000.0
        + notional * {impact_sql('notional')}) AS cost
      FROM trade t LEFT JOIN attrs a USING (trading_date, symbol) GROUP BY t.label_date)
    USING (label_date)""",
)


@query(
    "P16_reprice_trades",
    with_sql("reprice")
    + """SELECT label_date, round(dynamic_transaction_cost, 10) AS dynamic_transaction_cost,
      round(net_return, 8) + 0.0 AS net_return, round(net_active_return, 8) + 0.0
        AS net_active_return, trades, known_trades FROM reprice""",
)
def reprice(spark, sf_dir):
    _, attrs, _, charged, daily = priced(spark, sf_dir)
    out = pf.reprice_trades(charged, daily, attrs, portfolio_value=VALUE)
    return out.withColumns(
        {
            "dynamic_transaction_cost": rounded("dynamic_transaction_cost", 10),
            "net_return": rounded("net_return", 8),
            "net_active_return": rounded("net_active_return", 8),
        }
    )


def repriced_sql(view: str, total: str, known: str) -> str:
    return f"""SELECT round(sum({known}) / sum({total}), 9) AS coverage,
      round(avg(dynamic_transaction_cost), 9) AS mean_transaction_cost,
      round(avg(net_active_return), 8) + 0.0 AS mean_net_active_return,
      round(ln(abs(product(1 + net_active_return))), 6) + 0.0 AS log_net_active,
      round(sum(abs(net_active_return)) FILTER (WHERE r <= 5) / sum(abs(net_active_return)), 8)
        AS top_5_absolute_active_contribution
    FROM (SELECT *, row_number() OVER (ORDER BY abs(net_active_return) DESC) AS r FROM {view})"""


def repriced_columns(out):
    grown = F.log(F.abs(1 + F.col("cumulative_net_active_return")))
    return out.select(
        rounded("coverage").alias("coverage"),
        rounded("mean_transaction_cost").alias("mean_transaction_cost"),
        rounded("mean_net_active_return", 8).alias("mean_net_active_return"),
        F.round(grown, 6).alias("log_net_active"),
        rounded("top_5_absolute_active_contribution", 8).alias(
            "top_5_absolute_active_contribution"
        ),
    )


@query("P16_repriced_summary", with_sql("reprice") + repriced_sql("reprice", "trades", "known_trades"))
def repriced_summary(spark, sf_dir):
    _, attrs, _, charged, daily = priced(spark, sf_dir)
    rows = pf.reprice_trades(charged, daily, attrs, portfolio_value=VALUE)
    return repriced_columns(
        pf.repriced_summary(rows, "trades", "known_trades", "label_date")
    )


define_view(
    "recohort",
    ("stag", "attrs"),
    f"""SELECT s.cohort, s.trading_date, coalesce(c.cost, 0.0) AS dynamic_transaction_cost,
      s.active_return - coalesce(c.cost, 0.0) AS net_active_return, coalesce(m, 0) AS members,
      coalesce(k, 0) AS known_members
    FROM stag s LEFT JOIN (SELECT trading_date, count(*) AS m, count(adv) AS k,
      sum(0.02 * ((2 * 10.0 + 5.0) / 10000.0 + 2.0 * ({impact_sql('0.02')}))) AS cost
      FROM stag_m LEFT JOIN attrs USING (trading_date, symbol) WHERE rank <= 10 AND score >= 0.6
      GROUP BY trading_date) c USING (trading_date)""",
)


def recohort(spark, sf_dir):
    (cohorts, members), indexed = staggered(spark, sf_dir)
    rows = pf.staggered_cohorts(cohorts, members, K)
    return pf.reprice_cohorts(rows, members, attributes(indexed), K, portfolio_value=VALUE)


@query(
    "P16_reprice_cohorts",
    with_sql("recohort")
    + """SELECT cohort, trading_date, round(dynamic_transaction_cost, 10)
      AS dynamic_transaction_cost, round(net_active_return, 8) + 0.0 AS net_active_return, members,
      known_members FROM recohort""",
)
def reprice_cohorts(spark, sf_dir):
    out = recohort(spark, sf_dir).drop("return_end_date")
    return out.withColumns(
        {
            "dynamic_transaction_cost": rounded("dynamic_transaction_cost", 10),
            "net_active_return": rounded("net_active_return", 8),
        }
    )


@query(
    "P16_repriced_cohort_summary",
    with_sql("recohort") + repriced_sql("recohort", "members", "known_members"),
)
def recohort_summary(spark, sf_dir):
    rows = recohort(spark, sf_dir)
    return repriced_columns(
        pf.repriced_summary(rows, "members", "known_members", "trading_date")
    )


# ---- candidates ------------------------------------------------------------


@query(
    "P17_make_predictions",
    with_sql("ema", "hlab")
    + """SELECT h.symbol, h.trading_date, h.return_end_date AS label_date,
      round(e.score, 9) AS score, h.target_return, true AS can_buy, true AS can_sell,
      true AS in_universe
    FROM hlab h JOIN ema e USING (trading_date, symbol) WHERE h.horizon = 2""",
)
def make_predictions(spark, sf_dir):
    indexed, sessions, market = fx.panel(spark, sf_dir)
    signals = settle(fx.signals_of(indexed, sessions), "signals")
    targets = lab.horizon_returns(indexed, sessions, market, (2,))
    out = pf.make_predictions(signals, rk.percentile_ranks(signals, 0.5), targets)
    return out.withColumn("score", rounded("score"))


CANDIDATES = ((1.0, None), (1.0, 0.95), (0.5, None), (0.5, 0.95))
candidate_name = pf.candidate_name


def candidate_matrix(spark, sf_dir):
    """Portfolio figures of each (smoothing, threshold) on both partitions."""
    indexed, sessions, market = fx.panel(spark, sf_dir)
    signals = settle(fx.signals_of(indexed, sessions), "signals")
    alphas = sorted({a for a, _ in CANDIDATES})
    scores = rk.smoothed_ranks(signals, alphas, "partition")
    targets = lab.horizon_returns(indexed, sessions, market, (1,))
    preds = scores.join(
        targets.select(
            "trading_date",
            "symbol",
            F.col("return_end_date").alias("label_date"),
            F.col("raw_return").alias("target_return"),
        ),
        ["trading_date", "symbol"],
    ).withColumn("in_universe", F.lit(True))
    preds = settle(preds.withColumnRenamed("partition", "window"), "predictions")
    return settle(pf.candidate_matrix(preds, CANDIDATES, K, MIN), "matrix")


def _candidate_views() -> str:
    """One daily view per candidate and window, stacked into the matrix."""
    selects = []
    for alpha, threshold in CANDIDATES:
        for window in ("validation", "oos"):
            name = candidate_name(alpha, threshold)
            low = "NULL" if threshold is None else str(threshold)
            selects.append(f"('{name}', CAST({low} AS DOUBLE), {alpha}, '{window}')")
    return ", ".join(selects)


define_view(
    "emas",
    ("signals",),
    """WITH RECURSIVE x AS (SELECT symbol, trading_date, day, partition,
        (row_number() OVER (PARTITION BY trading_date ORDER BY score, symbol) - 1)
          / greatest(1, count(*) OVER (PARTITION BY trading_date) - 1) AS c FROM (
        SELECT *, dense_rank() OVER (ORDER BY trading_date) AS day FROM signals)),
      e AS (SELECT symbol, trading_date, day, partition, alpha, c AS v FROM x a,
          (SELECT unnest([1.0, 0.5])::DOUBLE AS alpha) WHERE NOT EXISTS (
          SELECT 1 FROM x b WHERE b.symbol = a.symbol AND b.day = a.day - 1
            AND b.partition = a.partition)
        UNION ALL SELECT x.symbol, x.trading_date, x.day, x.partition, e.alpha,
          e.alpha * x.c + (1.0 - e.alpha) * e.v
          FROM e JOIN x ON x.symbol = e.symbol AND x.day = e.day + 1
            AND x.partition = e.partition)
    SELECT trading_date, symbol, partition, alpha, v AS score FROM e""",
)
define_view(
    "cpred",
    ("emas", "hraw"),
    f"""SELECT c.name, c.low, c."window", e.symbol, e.trading_date, h.return_end_date AS label_date,
      e.score, h.raw_return AS target_return
    FROM (VALUES {_candidate_views()}) c(name, low, alpha, "window")
    JOIN emas e ON e.alpha = c.alpha AND e.partition = c."window"
    JOIN (SELECT * FROM hraw WHERE horizon = 1) h USING (trading_date, symbol)""",
)
define_view(
    "csess",
    ("cpred",),
    """SELECT *, row_number() OVER (PARTITION BY name, "window" ORDER BY label_date) - 1 AS session
    FROM (SELECT name, "window", label_date, any_value(low) AS low, count(*) AS n,
      avg(target_return) AS universe_return FROM cpred GROUP BY name, "window", label_date)
    WHERE n >= 20""",
)
define_view(
    "chold",
    ("csess",),
    """SELECT *, CASE WHEN low IS NULL THEN 1.0 / count(*) OVER w ELSE 0.1 END AS weight FROM (
      SELECT p.*, s.session, row_number() OVER (PARTITION BY p.name, p."window", p.label_date
        ORDER BY score DESC, symbol) AS rank
      FROM cpred p JOIN csess s USING (name, "window", label_date))
    WHERE rank <= 10 AND (low IS NULL OR score >= low)
    WINDOW w AS (PARTITION BY name, "window", label_date)""",
)
define_view(
    "cday",
    ("chold",),
    """SELECT s.name, s."window", s.low, s.session, coalesce(g, 0.0) AS gross,
      coalesce(g, 0.0) - universe_return AS active, coalesce(x, 0.0) AS exposure,
      coalesce(buy, 0.0) AS buy, coalesce(sell, 0.0) AS sell,
      (coalesce(buy, 0.0) * 10.0 + coalesce(sell, 0.0) * 15.0) / 10000.0 AS cost
    FROM csess s LEFT JOIN (SELECT name, "window", session, sum(weight * target_return) AS g,
      sum(weight) AS x FROM chold GROUP BY ALL) h USING (name, "window", session)
    LEFT JOIN (SELECT name, "window", session, sum(greatest(n - o, 0)) AS buy,
        sum(greatest(o - n, 0)) AS sell FROM (
      SELECT name, "window", symbol, session, coalesce(n, 0.0) AS n, coalesce(o, 0.0) AS o FROM
        (SELECT name, "window", symbol, session, weight AS n FROM chold) FULL JOIN
        (SELECT name, "window", symbol, session + 1 AS session,
          weight * (1 + target_return) / (1 + g) AS o FROM chold JOIN (
            SELECT name, "window", session, sum(weight * target_return) AS g FROM chold GROUP BY ALL)
            USING (name, "window", session)) USING (name, "window", symbol, session))
      GROUP BY name, "window", session) t USING (name, "window", session)""",
)
define_view(
    "matrix",
    ("cday",),
    """SELECT name, "window", any_value(low) AS min_score, count(*) AS evaluated_dates,
      avg(active) AS mean_active_return, avg(active - cost) AS mean_net_active_return,
      avg((buy + sell) / 2) AS mean_one_way, avg(cost) AS mean_transaction_cost,
      avg(1 - exposure) AS mean_cash_weight,
      sum(abs(active)) FILTER (WHERE r <= 5) / sum(abs(active)) AS top_5_absolute_active_contribution
    FROM (SELECT *, row_number() OVER (PARTITION BY name, "window" ORDER BY abs(active) DESC) AS r
      FROM cday) GROUP BY name, "window" """,
)
MATRIX_VALUES = (
    "mean_active_return",
    "mean_net_active_return",
    "mean_one_way",
    "mean_transaction_cost",
    "mean_cash_weight",
    "top_5_absolute_active_contribution",
)


@query(
    "P18_candidate_matrix",
    with_sql("matrix")
    + f"""SELECT name, "window", min_score, evaluated_dates, {rounded_sql(MATRIX_VALUES, 7)}
    FROM matrix""",
)
def matrix(spark, sf_dir):
    keep = ("name", "window", "min_score", "evaluated_dates")
    rows = candidate_matrix(spark, sf_dir).drop("mean_selected_rank_ic")
    return round_columns(rows, keep, 7)


@query(
    "P18_choose_candidates",
    with_sql("matrix")
    + """SELECT * FROM (SELECT row_number() OVER (ORDER BY mean_net_active_return DESC,
      mean_one_way, min_score IS NOT NULL, name) AS place, name FROM matrix
      WHERE "window" = 'validation') WHERE place <= 3""",
)
def choose(spark, sf_dir):
    return pf.choose_candidates(candidate_matrix(spark, sf_dir), 3)


IMPACT = 0.0005


def _daily_z_sql() -> str:
    return ", ".join(
        f"(avg({e}) FILTER (WHERE place <= {K}) - avg({e})) / stddev_pop({e}) AS {e}_z"
        for e in EXPOSURES
    )


def _widest_sql() -> str:
    return ", ".join(f"abs(avg({e}_z))" for e in EXPOSURES)


@query(
    "P18_gate_report",
    with_sql("matrix", "exr")
    + f""", daily_z AS (SELECT partition, trading_date, {_daily_z_sql()}
      FROM exr GROUP BY partition, trading_date),
    wide AS (SELECT partition AS w, greatest({_widest_sql()}) AS widest FROM daily_z
      GROUP BY partition)
    SELECT windows, a AS positive_in_both, e AS positive_under_dynamic_cost, b AS improves_by_1bp,
      c AS turnover_at_most_80_percent, d AS top_5_below_half, f AS risk_within_one_z,
      CASE WHEN a AND b AND c AND d AND e AND f THEN 'PASS' ELSE 'HOLD' END AS decision FROM (
      SELECT count(*) AS windows, bool_and(x.mean_net_active_return > 0) AS a,
        bool_and(x.mean_net_active_return - y.mean_net_active_return >= 0.0001) AS b,
        bool_and(x.mean_one_way / greatest(1e-12, y.mean_one_way) <= 0.8) AS c,
        bool_and(x.top_5_absolute_active_contribution < 0.5) AS d,
        bool_and(x.mean_net_active_return - x.mean_one_way * {IMPACT} > 0) AS e,
        bool_and(widest <= 1.0) AS f
      FROM matrix x JOIN matrix y USING ("window") JOIN wide ON w = "window"
      WHERE x.name = 'ema0.5-minnone' AND y.name = 'ema1-minnone')""",
)
def gate(spark, sf_dir):
    """Dynamic cost is a flat impact on turnover here; risk is that of the daily Top-K."""
    rows = candidate_matrix(spark, sf_dir)
    mine = rows.where("name = 'ema0.5-minnone'")
    cost = F.col("mean_one_way") * IMPACT
    dynamic = mine.select(
        "window", (F.col("mean_net_active_return") - cost).alias("mean_net_active_return")
    )
    indexed, sessions, _ = fx.panel(spark, sf_dir)
    signals = fx.signals_of(indexed, sessions)
    daily = rk.exposure_daily(signals, exposures(indexed), EXPOSURES, K)
    risks = (
        daily.join(signals.select("trading_date", "partition").distinct(), "trading_date")
        .groupBy(F.col("partition").alias("window"))
        .agg(*[F.avg(f"{e}_z").alias(e) for e in EXPOSURES])
        .unpivot(["window"], list(EXPOSURES), "exposure", "z")
    )
    return pf.gate_report(
        rows, "ema0.5-minnone", "ema1-minnone", ("validation", "oos"), dynamic, risks
    )


@query(
    "P19_separation",
    with_sql("signals")
    + """SELECT a AS validation_end, b AS oos_start, a < b AS separated FROM (
      SELECT max(trading_date) FILTER (WHERE partition = 'validation') AS a,
        min(trading_date) FILTER (WHERE partition = 'oos') AS b FROM signals)""",
)
def separation(spark, sf_dir):
    return pf.separation(fx.signals(spark, sf_dir))


# ---- sinks -----------------------------------------------------------------


@query(
    "K4_portfolio_artifacts",
    with_sql("pday", "hold", "trade")
    + """SELECT 'daily' AS name, count(*) AS rows FROM pday
    UNION ALL SELECT 'holdings', count(*) FROM hold UNION ALL SELECT 'trades', count(*) FROM trade
    UNION ALL SELECT 'summary', 1""",
)
def artifacts(spark, sf_dir):
    _, _, holdings, charged, daily = base(spark, sf_dir)
    tables = {"daily": daily, "holdings": pf.holdings_detail(holdings), "trades": charged}
    written = sink.write_portfolio(tables, pf.portfolio_summary(daily), scratch(spark, "portfolio"))
    out = None
    for name, path in written.items():
        read = spark.read.json(path) if name == "summary" else spark.read.parquet(path)
        counted = read.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        out = counted if out is None else out.unionByName(counted)
    return out


@query(
    "K5_prediction_contract_metadata",
    with_sql("preds")
    + """SELECT 'next_open_to_following_open' AS contract, count(*) AS rows,
      round(avg(score), 9) + 0.0 AS mean_score FROM preds""",
)
def contract_metadata(spark, sf_dir):
    path = scratch(spark, "contract")
    contract = {"target_return_contract": "next_open_to_following_open"}
    sink.write_predictions(fx.preds(spark, sf_dir), path, contract)
    found = sink.read_contract(spark, path)["target_return_contract"]
    return spark.read.parquet(path).agg(
        F.lit(found).alias("contract"),
        F.count(F.lit(1)).alias("rows"),
        rounded(F.avg("score")).alias("mean_score"),
    )


@query(
    "F14_open_execution_state",
    """WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS open,
      CASE WHEN l_linenumber <= 4 THEN l_extendedprice ELSE l_extendedprice + 1 END AS high,
      CASE WHEN l_returnflag = 'R' AND l_discount = 0 THEN 0.0 ELSE l_quantity END AS volume,
      CASE l_linenumber % 4 WHEN 1 THEN round(l_extendedprice * 10 / 11, 2)
        WHEN 2 THEN round(l_extendedprice * 10 / 9, 2) WHEN 3 THEN
          round(l_extendedprice * 20 / 21, 2) ELSE CASE WHEN l_discount = 0.1 THEN 0.0
          ELSE l_extendedprice END END AS pc,
      l_tax = 0 AS st, CASE WHEN length(CAST(l_suppkey AS VARCHAR)) >= 6
        THEN CAST(l_suppkey AS VARCHAR) ELSE lpad(CAST(l_suppkey AS VARCHAR), 6, '0') END AS symbol
      FROM lineitem),
    r AS (SELECT *, CAST(CASE WHEN st THEN 0.05 WHEN symbol LIKE '4%' OR symbol LIKE '8%' THEN 0.30
      WHEN symbol LIKE '688%' OR symbol LIKE '689%' THEN 0.20 ELSE 0.10 END AS DECIMAL(4,2)) AS ratio
      FROM b),
    s AS (SELECT *, CASE WHEN volume <= 0 THEN 'suspended' WHEN abs(open - high) <= 0.0051 AND
        abs(open - round(CAST(pc AS DECIMAL(22,10)) * (1 + ratio), 2)) <= 0.0051
        THEN 'one_price_limit_up' WHEN abs(open - high) <= 0.0051 AND
        abs(open - round(CAST(pc AS DECIMAL(22,10)) * (1 - ratio), 2)) <= 0.0051
        THEN 'one_price_limit_down' ELSE 'normal' END AS status FROM r WHERE pc > 0)
    SELECT status, st, count(*) AS rows, count(*) FILTER (WHERE status IN ('normal',
      'one_price_limit_down')) AS can_buy, count(*) FILTER (WHERE status IN ('normal',
      'one_price_limit_up')) AS can_sell,
      CAST(sum(CAST(CASE WHEN status = 'suspended' THEN pc ELSE open END AS DECIMAL(18,2))) AS DOUBLE)
        AS marks FROM s GROUP BY status, st""",
)
def execution_states(spark, sf_dir):
    """Lines as opening bars: the line number decides how the previous close relates."""
    price = F.col("l_extendedprice")
    case = F.col("l_linenumber") % 4
    flat = F.when(F.col("l_discount") == 0.1, 0.0).otherwise(price)
    previous = (
        F.when(case == 1, F.round(price * 10 / 11, 2))
        .when(case == 2, F.round(price * 10 / 9, 2))
        .when(case == 3, F.round(price * 20 / 21, 2))
        .otherwise(flat)
    )
    dead = (F.col("l_returnflag") == "R") & (F.col("l_discount") == 0)
    state = open_execution_state(
        fx.pad_symbol(F.col("l_suppkey")),
        F.to_date("l_shipdate"),
        price,
        F.when(F.col("l_linenumber") <= 4, price).otherwise(price + 1),
        price,
        F.when(dead, 0.0).otherwise(F.col("l_quantity")),
        previous,
        F.col("l_tax") == 0,
    )
    rows = fx.table(spark, sf_dir, "lineitem").select((F.col("l_tax") == 0).alias("st"), state.alias("s"))
    marks = F.sum(F.col("s.mark_price").cast("decimal(18,2)")).cast("double")
    return (
        rows.where(F.col("s").isNotNull())
        .groupBy(F.col("s.status").alias("status"), "st")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(F.when(F.col("s.can_buy"), 1)).alias("can_buy"),
            F.count(F.when(F.col("s.can_sell"), 1)).alias("can_sell"),
            marks.alias("marks"),
        )
    )
