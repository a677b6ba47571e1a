"""Top-K and long-short portfolio tables: selection, trades, costs, returns, risk.

Selections are ranked limits (pruned before the shuffle) and hold at most K + buffer rows
per date. Whole cross-sections are only ever aggregated or range-sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalars import impact_rate, month_key
from tapeloom.functions.stats import is_finite, safe_corr, safe_ratio, share
from tapeloom.plans.ordering import first_rows, ordinal
from tapeloom.plans.shared import sized

# Fixed values.
ANNUALIZATION_DAYS = 244
NO_TRADE = 1e-15
SLEEVES = 5
EXTREME_DAYS = (1, 5, 10)


def eligible_sessions(
    predictions: DataFrame,
    min_symbols: int,
    universe_only: bool = True,
    segment: str | None = None,
) -> DataFrame:
    """Label dates with enough rows, numbered in order; one row per session.

    Between two values of ``segment`` the numbering skips one, so nothing is carried from
    the last session of one evaluation window into the next window.
    """
    counted = F.when(F.col("in_universe"), 1) if universe_only else F.lit(1)
    extra = [] if segment is None else [F.first(segment).alias(segment)]
    per_date = predictions.groupBy("label_date").agg(
        F.count(counted).alias("universe_size"),
        F.first("trading_date").alias("trading_date"),
        *extra,
    )
    along = Window.orderBy("label_date")
    number = F.row_number().over(along) - 1
    if segment is not None:
        border = F.coalesce(F.col(segment) != F.lag(segment).over(along), F.lit(False))
        marked = per_date.where(F.col("universe_size") >= min_symbols).withColumn(
            "_border", border.cast("int")
        )
        number = number + F.sum("_border").over(along)
    else:
        marked = per_date.where(F.col("universe_size") >= min_symbols).withColumn(
            "_border", F.lit(0)
        )
    return sized(marked.withColumn("session", number.cast("long")).drop("_border"), "sessions")


def rankable() -> Column:
    """Rows that take part in a ranking: in the universe, with a finite score."""
    return F.col("in_universe") & is_finite("score")


def enterable(predictions: DataFrame) -> Column:
    """Rankable rows that may be bought; without a ``can_buy`` column all may."""
    can_buy = F.col("can_buy") if "can_buy" in predictions.columns else F.lit(True)
    return rankable() & can_buy


def selection_violations(predictions: DataFrame) -> DataFrame:
    """Rows and dates that no selection may be built on, one row per (key, reason).

    Rows: a score that is not finite, unknown tradability or membership, a return that is
    missing for a row that may be bought. Dates: two signal dates on one label date.
    """
    reasons = {
        "score not finite": ~is_finite("score"),
        "tradability unknown": F.col("can_buy").isNull(),
        "membership unknown": F.col("in_universe").isNull(),
        "return missing": F.coalesce(enterable(predictions), F.lit(False)) & ~is_finite("target_return"),
    }
    named = F.array_compact(F.array(*[F.when(bad, name) for name, bad in reasons.items()]))
    by_row = predictions.select("label_date", "symbol", F.explode(named).alias("reason"))
    by_date = (
        predictions.groupBy("label_date")
        .agg(F.min("trading_date").alias("_lo"), F.max("trading_date").alias("_hi"))
        .where("_lo < _hi")
        .select(
            "label_date",
            F.lit(None).cast("string").alias("symbol"),
            F.lit("several signal dates").alias("reason"),
        )
    )
    return by_row.unionByName(by_date)


def rank_limit(predictions: DataFrame, sessions: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` rows of each eligible date, score desc then symbol."""
    best = [F.desc("score"), F.col("symbol")]
    return first_rows(predictions, ["label_date"], best, limit, "rank").join(
        sessions.select("label_date", "session"), "label_date"
    )


def select_top_k(
    predictions: DataFrame,
    sessions: DataFrame,
    k: int,
    min_score: float | None = None,
    allow_cash: bool = False,
) -> DataFrame:
    """Equal-weight Top-K holdings; with a minimum score the rest may stay in cash."""
    chosen = rank_limit(predictions.where(enterable(predictions)), sessions, k)
    if min_score is not None:
        chosen = chosen.where(F.col("score") >= min_score)
    day = Window.partitionBy("label_date")  # at most k rows
    n = F.count(F.lit(1)).over(day)
    exposure = n / F.lit(float(k)) if allow_cash else F.lit(1.0)
    return chosen.withColumn("weight", exposure / n)


def hysteresis_members(
    predictions: DataFrame, sessions: DataFrame, policies: Sequence[tuple[int, int]]
) -> DataFrame:
    """Equal-weight members of (top_k, exit_buffer) bands, all policies in one plan.

    A symbol that may be bought enters at rank <= top_k, stays while its rank is within top_k + buffer on
    consecutive eligible dates, and leaves otherwise. The position count varies.
    """
    reach = max(k + b for k, b in policies)
    grid = F.array(
        *[F.struct(F.lit(k).alias("top_k"), F.lit(b).alias("exit_buffer")) for k, b in policies]
    )
    ranked = rank_limit(predictions.where(rankable()), sessions, reach).withColumn(
        "_may_enter", F.coalesce(enterable(predictions), F.lit(False))
    )
    by_policy = (
        ranked.withColumn("_p", F.explode(grid))
        .select("*", "_p.*")
        .drop("_p")
        .where(F.col("rank") <= F.col("top_k") + F.col("exit_buffer"))
    )
    along = Window.partitionBy("top_k", "exit_buffer", "symbol").orderBy("session")
    island = F.col("session") - F.row_number().over(along)
    inside = (
        Window.partitionBy("top_k", "exit_buffer", "symbol", "_island")
        .orderBy("session")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    enters = (F.col("rank") <= F.col("top_k")) & F.col("_may_enter")
    entered = F.max(enters.cast("int")).over(inside)
    day = Window.partitionBy("top_k", "exit_buffer", "label_date")  # at most k + buffer rows
    return (
        by_policy.withColumn("_island", island)
        .withColumn("_in", entered)
        .where("_in = 1")
        .withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(day))
        .drop("_island", "_in", "_may_enter")
    )


def build_trades(
    holdings: DataFrame,
    predictions: DataFrame,
    sessions: DataFrame,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Trades between consecutive sessions against weights drifted by the realized return."""
    by_day = [*keys, "session"]
    gross = holdings.groupBy(*by_day).agg(
        F.sum(F.col("weight") * F.col("target_return")).alias("_gross")
    )
    drifted = holdings.join(gross, by_day).select(
        *keys,
        "symbol",
        (F.col("session") + 1).alias("session"),
        (F.col("weight") * (1 + F.col("target_return")) / (1 + F.col("_gross"))).alias(
            "old_weight"
        ),
    )
    current = holdings.select(*keys, "symbol", "session", F.col("weight").alias("new_weight"))
    zero = F.lit(0.0)
    joined = current.join(drifted, [*keys, "symbol", "session"], "full_outer").select(
        *keys,
        "symbol",
        "session",
        F.coalesce("old_weight", zero).alias("old_weight"),
        F.coalesce("new_weight", zero).alias("new_weight"),
    )
    change = F.col("new_weight") - F.col("old_weight")
    dated = joined.join(
        sessions.select("session", "label_date", "trading_date"), "session"
    ).where(F.abs(change) > NO_TRADE)
    exits = sized(
        dated.where("new_weight = 0").select("label_date", "symbol").distinct(), "exits"
    )
    still_listed = (
        predictions.where("in_universe")
        .select("label_date", "symbol")
        .join(exits, ["label_date", "symbol"], "left_semi")
        .withColumn("_listed", F.lit(True))
    )
    reason = (
        F.when(F.col("old_weight") == 0, "entry_rank")
        .when((F.col("new_weight") == 0) & F.col("_listed"), "rank_exit")
        .when(F.col("new_weight") == 0, "universe_exit")
        .otherwise("equal_weight_rebalance")
    )
    return (
        dated.join(still_listed, ["label_date", "symbol"], "left")
        .withColumns(
            {
                "action": F.when(change > 0, "buy").otherwise("sell"),
                "reason": reason,
                "weight_change": change,
                "notional": F.abs(change),
            }
        )
        .drop("_listed")
    )


def cost_rate(action: Column, per_side_bps: Column | float, stamp_bps: float) -> Column:
    side = per_side_bps if isinstance(per_side_bps, Column) else F.lit(float(per_side_bps))
    return F.when(action == "buy", side).otherwise(side + stamp_bps) / 10_000.0


def charge(
    trades: DataFrame, per_side_bps: Column | float = 10.0, stamp_bps: float = 5.0
) -> DataFrame:
    """Directional cost per trade: both sides pay the side rate, sells the stamp tax."""
    rate = cost_rate(F.col("action"), per_side_bps, stamp_bps)
    return trades.withColumn("cost_rate", rate).withColumn(
        "transaction_cost", F.col("notional") * F.col("cost_rate")
    )


def selected_ic(holdings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ordinal rank correlation inside the selection; null where a side is constant."""
    by_day = [*keys, "session"]

    def place(c: str) -> Column:
        return F.row_number().over(Window.partitionBy(*by_day).orderBy(c, "symbol"))

    ranks = holdings.select(
        *by_day,
        "score",
        "target_return",
        place("score").cast("double").alias("_s"),
        place("target_return").cast("double").alias("_r"),
    )
    varied = (F.stddev_pop("score") > 0) & (F.stddev_pop("target_return") > 0)
    return ranks.groupBy(*by_day).agg(
        F.when(varied, safe_corr("_s", "_r")).alias("selected_rank_ic")
    )


def daily_table(
    predictions: DataFrame,
    holdings: DataFrame,
    charged: DataFrame,
    sessions: DataFrame,
    keys: Sequence[str] = (),
    k: Column | int = 50,
    policies: Sequence[Sequence[object]] = (),
    costs: Sequence[float] = (),
    largest_k: int | None = None,
) -> DataFrame:
    """Return, cost, turnover, overlap and exposure of every session.

    ``k`` may be a column of the holdings, with ``largest_k`` as its greatest value: the
    realized Top-K is then still a literal rank limit, which Spark applies before the
    shuffle. ``keys`` name the policy of a holding and ``policies`` lists their values; ``costs``
    lists the ``cost_bps`` values of the charged trades when there are several. A session
    whose selection is empty still has its row, all in cash.
    """
    by_day = [*keys, "session"]
    if isinstance(k, Column):
        if largest_k is None:
            raise ValueError("a column k needs largest_k")
    else:
        largest_k, k = k, F.lit(k)
    listed = predictions.where("in_universe").join(
        sessions.select("label_date", "session"), "label_date"
    )
    finite = listed.where(is_finite("target_return"))
    universe = finite.groupBy("session").agg(F.avg("target_return").alias("universe_return"))
    # The realized Top-K is only asked for symbols held that day.
    held_symbols = sized(holdings.select("session", "symbol").distinct(), "held")
    best = [F.desc("target_return"), F.col("symbol")]
    realized = (
        first_rows(finite, ["session"], best, largest_k, "_realized")
        .join(held_symbols, ["session", "symbol"], "left_semi")
        .select("session", "symbol", "_realized")
    )
    held = holdings.join(realized, ["session", "symbol"], "left")
    per_day = held.groupBy(*by_day).agg(
        F.count(F.lit(1)).alias("positions"),
        F.sum(F.col("weight") * F.col("target_return")).alias("gross_return"),
        (F.count(F.when(F.col("_realized") <= k, 1)) / F.count(F.lit(1))).alias(
            "top_k_realized_overlap"
        ),
        F.sum(F.abs("weight")).alias("gross_exposure"),
        F.sum("weight").alias("net_exposure"),
        F.max("weight").alias("max_weight"),
        F.sum(F.col("weight") * F.col("weight")).alias("concentration_hhi"),
    )
    per_day = per_day.join(selected_ic(holdings, keys), by_day)
    base = sessions.join(universe, "session")
    if keys:
        every = [
            F.struct(*[F.lit(v).alias(n) for n, v in zip(keys, values, strict=True)])
            for values in policies
        ]
        base = base.select("*", F.inline(F.array(*every)))
    base = base.join(per_day, by_day, "left")
    on = list(by_day)
    if costs:
        base = base.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
        on.append("cost_bps")
    side = lambda a: F.sum(F.when(F.col("action") == a, F.col("notional")).otherwise(0.0))
    traded = charged.groupBy(*on).agg(
        side("buy").alias("buy_turnover"),
        side("sell").alias("sell_turnover"),
        F.sum("transaction_cost").alias("transaction_cost"),
    )
    amounts = (
        "buy_turnover", "sell_turnover", "transaction_cost", "gross_return",
        "top_k_realized_overlap", "gross_exposure", "net_exposure", "max_weight",
        "concentration_hhi",
    )
    rows = base.join(traded, on, "left").withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in amounts}
        | {"positions": F.coalesce("positions", F.lit(0))}
    )
    net = F.col("gross_return") - F.col("transaction_cost")
    return rows.withColumns(
        {
            "cash_weight": 1.0 - F.col("net_exposure"),
            "one_way_turnover": (F.col("buy_turnover") + F.col("sell_turnover")) / 2.0,
            "net_return": net,
            "active_return": F.col("gross_return") - F.col("universe_return"),
            "net_active_return": net - F.col("universe_return"),
        }
    )


def holdings_detail(holdings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return holdings.select(
        *keys,
        "trading_date",
        "label_date",
        "symbol",
        "rank",
        "score",
        "target_return",
        "weight",
        (F.col("weight") * F.col("target_return")).alias("gross_contribution"),
        "can_buy",
        "can_sell",
        "in_universe",
    )


def return_summary(
    daily: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    day: str = "label_date",
    annualization: int = ANNUALIZATION_DAYS,
) -> DataFrame:
    """Mean, deviation, annualized figures, Sharpe, compounded return and drawdown.

    The drawdown peak starts at 1. A daily table has one row per session and policy.
    """
    along = Window.partitionBy(*keys).orderBy(day)
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = F.product(1.0 + F.col(value)).over(so_far)
    curved = daily.withColumn("_curve", curve).withColumn(
        "_peak", F.greatest(F.lit(1.0), F.max("_curve").over(so_far))
    )
    mean, std = F.avg(value), F.stddev_samp(value)
    root = float(annualization) ** 0.5
    return curved.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        mean.alias("mean_daily"),
        std.alias("std_daily"),
        (mean * annualization).alias("annualized_return"),
        (std * root).alias("annualized_volatility"),
        (F.try_divide(mean, std) * root).alias("sharpe"),
        (F.product(1.0 + F.col(value)) - 1.0).alias("cumulative_return"),
        F.min(F.col("_curve") / F.col("_peak") - 1.0).alias("max_drawdown"),
        share(F.col(value) > 0).alias("positive_days_ratio"),
    )


def monthly_returns(
    daily: DataFrame, keys: Sequence[str] = (), period: Column | None = None
) -> DataFrame:
    month = month_key(F.col("label_date")) if period is None else period
    compound = lambda c: F.product(1.0 + F.col(c)) - 1.0
    return daily.groupBy(*keys, month.alias("month")).agg(
        F.count(F.lit(1)).alias("days"),
        F.avg("gross_return").alias("gross_mean"),
        F.avg("net_return").alias("net_mean"),
        F.avg("active_return").alias("active_mean"),
        F.avg("net_active_return").alias("net_active_mean"),
        compound("gross_return").alias("gross_cumulative"),
        compound("net_return").alias("net_cumulative"),
        share(F.col("net_return") > 0).alias("positive_net_days_ratio"),
        share(F.col("net_active_return") > 0).alias("positive_net_active_days_ratio"),
    )


def extreme_days(
    daily: DataFrame, value: str, keys: Sequence[str] = (), day: str = "label_date"
) -> DataFrame:
    """Share of absolute return earned on the largest 1, 5 and 10 days."""
    largest = Window.partitionBy(*keys).orderBy(F.desc(F.abs(value)), day)
    placed = daily.withColumn("_place", F.row_number().over(largest))
    size = F.abs(F.col(value))
    shares = [
        F.coalesce(
            F.try_divide(F.sum(F.when(F.col("_place") <= n, size)), F.sum(size)), F.lit(0.0)
        ).alias(f"top_{n}_absolute_contribution")
        for n in EXTREME_DAYS
    ]
    return placed.groupBy(*keys).agg(*shares)


def largest_days(daily: DataFrame, value: str, count: int = 10, day: str = "label_date") -> DataFrame:
    largest = Window.orderBy(F.desc(F.abs(value)), day)  # one row per session
    return daily.withColumn("place", F.row_number().over(largest)).where(F.col("place") <= count)


SUMMARY_MEANS = {
    "mean_buy": "buy_turnover",
    "mean_sell": "sell_turnover",
    "mean_one_way": "one_way_turnover",
    "mean_transaction_cost": "transaction_cost",
    "mean_top_k_realized_overlap": "top_k_realized_overlap",
    "mean_active_return": "active_return",
    "mean_net_active_return": "net_active_return",
    "mean_selected_rank_ic": "selected_rank_ic",
    "mean_positions": "positions",
    "mean_gross_exposure": "gross_exposure",
    "mean_net_exposure": "net_exposure",
    "mean_cash_weight": "cash_weight",
    "mean_max_weight": "max_weight",
    "mean_concentration_hhi": "concentration_hhi",
}


def portfolio_summary(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluated_dates"),
        F.min("label_date").alias("first_date"),
        F.max("label_date").alias("last_date"),
        *[F.avg(c).alias(name) for name, c in SUMMARY_MEANS.items()],
        share(F.col("active_return") > 0).alias("positive_active_days_ratio"),
    )


# ---- long-short ------------------------------------------------------------


def long_short_daily(
    predictions: DataFrame,
    quantile: float = 0.1,
    rebalance_days: int = 1,
    cost_bps: float = 10.0,
    stamp: float = 0.0005,
    min_symbols: int = 50,
) -> DataFrame:
    """Quantile long-short returns, membership turnover and cost per evaluated date."""
    dates = eligible_sessions(predictions, min_symbols, universe_only=False).select(
        "label_date",
        "session",
        (F.floor(F.col("session") / rebalance_days) * rebalance_days).alias("rebalance"),
    )
    rows = predictions.select("label_date", "symbol", "score", "target_return").join(
        dates, "label_date"
    )
    placed = ordinal(
        rows.where(F.col("session") == F.col("rebalance")).select("rebalance", "symbol", "score"),
        ["rebalance"],
        [F.desc("score"), F.col("symbol")],
        pos="_place",
        size="_n",
    )
    tail = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(quantile))))
    # A symbol of a tiny cross-section can be in both tails.
    sides = F.array_compact(
        F.array(
            F.when(F.col("_place") <= tail, F.lit("long")),
            F.when(F.col("_place") > F.col("_n") - tail, F.lit("short")),
        )
    )
    members = placed.select("rebalance", "symbol", F.explode(sides).alias("side"))
    held_before = F.lag("rebalance").over(
        Window.partitionBy("symbol", "side").orderBy("rebalance")
    )
    kept = F.coalesce(held_before == F.col("rebalance") - rebalance_days, F.lit(False))
    turnover = (
        members.withColumn("_new", (~kept).cast("int"))
        .groupBy("rebalance", "side")
        .agg(F.avg("_new").alias("_side_turnover"))
        .groupBy("rebalance")
        .agg(F.avg("_side_turnover").alias("_turnover"))
    )
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col("target_return")))
    daily = (
        rows.join(members, ["rebalance", "symbol"])
        .groupBy("label_date", "session", "rebalance")
        .agg((mean("long") - mean("short")).alias("gross_return"))
        .where(F.col("gross_return").isNotNull())
        .join(turnover, "rebalance")
    )
    on_day = F.when(F.col("session") == F.col("rebalance"), F.col("_turnover")).otherwise(0.0)
    rate = 2 * cost_bps / 10_000.0 + stamp
    return (
        daily.withColumn("turnover", on_day)
        .withColumn("transaction_cost", F.col("turnover") * rate)
        .withColumn("net_return", F.col("gross_return") - F.col("transaction_cost"))
        .drop("_turnover", "rebalance")
    )


# ---- grid and diagnosis ----------------------------------------------------


def policy_grid(
    predictions: DataFrame,
    top_ks: Sequence[int],
    buffers: Sequence[int],
    costs: Sequence[float],
    stamp_bps: float = 5.0,
    min_symbols: int | None = None,
) -> DataFrame:
    """Summary row of every (top_k, exit_buffer, cost) on one prediction table."""
    sessions = eligible_sessions(predictions, min_symbols or max(top_ks))
    policy = ["top_k", "exit_buffer"]
    policies = [(k, b) for k in top_ks for b in buffers]
    holdings = sized(hysteresis_members(predictions, sessions, policies), "members")
    trades = build_trades(holdings, predictions, sessions, policy)
    every_cost = F.explode(F.array(*[F.lit(float(c)) for c in costs]))
    charged = charge(trades.withColumn("cost_bps", every_cost), F.col("cost_bps"), stamp_bps)
    daily = sized(
        daily_table(
            predictions,
            holdings,
            charged,
            sessions,
            policy,
            F.col("top_k"),
            policies,
            costs,
            max(top_ks),
        ),
        "daily",
    )
    keys = [*policy, "cost_bps"]
    figures = ["mean_daily", "sharpe", "cumulative_return"]
    gross = return_summary(daily, "gross_return", keys).select(
        *keys, *[F.col(c).alias(f"gross_{c}") for c in figures]
    )
    net = return_summary(daily, "net_return", keys).select(
        *keys, *[F.col(c).alias(f"net_{c}") for c in figures]
    )
    months = (
        monthly_returns(daily, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("month_count"),
            share(F.col("net_active_mean") > 0).alias("positive_net_active_month_ratio"),
        )
    )
    extremes = extreme_days(daily, "active_return", keys).select(
        *keys, F.col("top_5_absolute_contribution").alias("top_5_absolute_active_contribution")
    )
    out = portfolio_summary(daily, keys)
    for part in (gross, net, months, extremes):
        out = out.join(part, keys)
    return out.withColumn("sell_stamp_tax_bps", F.lit(float(stamp_bps)))


def grid_missing(summary: DataFrame) -> DataFrame:
    """Combinations of the grid's own axes that have no summary row."""
    axes = ("top_k", "exit_buffer", "cost_bps")
    # Three short axes of parameter values, gathered into one row and opened again.
    full = summary.agg(*[F.collect_set(a).alias(a) for a in axes])
    for a in axes:
        full = full.withColumn(a, F.explode(a))
    return full.join(summary.select(*axes), list(axes), "left_anti")


def grid_comparable(summary: DataFrame) -> DataFrame:
    """Whether all cells cover the same dates."""
    return summary.agg(
        F.count(F.lit(1)).alias("combinations"),
        (
            (F.count_distinct("evaluated_dates") == 1)
            & (F.count_distinct("first_date", "last_date") == 1)
        ).alias("same_date_sample"),
    )


def breakeven(summary: DataFrame, gross: str) -> Column:
    """Per-side cost in basis points at which the mean return is used up; null untraded."""
    notional = F.col("mean_buy") + F.col("mean_sell")
    earned = F.col(gross) * 10_000.0 - F.col("sell_stamp_tax_bps") * F.col("mean_sell")
    return F.when(notional > 0, earned / notional)


def breakeven_table(summary: DataFrame, decision_cost: float) -> DataFrame:
    at_cost = summary.where(F.abs(F.col("cost_bps") - decision_cost) <= 1e-12)
    return at_cost.select(
        "top_k",
        "exit_buffer",
        breakeven(summary, "gross_mean_daily").alias("absolute_breakeven_bps"),
        breakeven(summary, "mean_active_return").alias("active_breakeven_bps"),
    )


#: Figures of a cell that are compared with the cell of the same K without a buffer,
#: and the sign that makes an improvement positive.
AGAINST_ZERO_BUFFER = {
    "turnover_reduction": ("mean_one_way", -1),
    "gross_delta": ("gross_mean_daily", 1),
    "net_delta": ("net_mean_daily", 1),
    "cost_saving": ("mean_transaction_cost", -1),
}


def grid_candidates(
    summary: DataFrame,
    decision_cost: float = 10.0,
    min_dates: int = 60,
    min_positive_months: float = 0.5,
    max_top5: float = 0.5,
) -> DataFrame:
    """Every cell at the decision cost next to its zero-buffer cell, judged and ranked."""
    cells = summary.where(F.abs(F.col("cost_bps") - decision_cost) <= 1e-12)
    plain = cells.where("exit_buffer = 0").select(
        "top_k", F.struct(*[c for c, _ in AGAINST_ZERO_BUFFER.values()]).alias("zero")
    )
    buffered = F.col("exit_buffer") != 0
    deltas = {
        name: F.when(
            buffered, F.coalesce((F.col(c) - F.col("zero")[c]) * sign, F.lit(0.0))
        ).otherwise(F.lit(0.0))
        for name, (c, sign) in AGAINST_ZERO_BUFFER.items()
    }
    figures = cells.join(plain, "top_k", "left").withColumns(
        deltas
        | {
            "gross_active_mean_daily": F.col("mean_active_return"),
            "net_active_mean_daily": F.col("mean_active_return") - F.col("mean_transaction_cost"),
        }
    )
    criteria = {
        "enough_dates": F.col("evaluated_dates") >= min_dates,
        "positive_net_sharpe": F.coalesce(F.col("net_sharpe") > 0, F.lit(False)),
        "positive_net_active": F.col("net_active_mean_daily") > 0,
        "stable_months": F.col("positive_net_active_month_ratio") >= min_positive_months,
        "limited_concentration": F.col("top_5_absolute_active_contribution") <= max_top5,
        "buffer_efficient": ~buffered
        | (
            F.col("zero").isNotNull()
            & (F.col("turnover_reduction") > 1e-12)
            & (F.col("net_delta") >= -1e-12)
        ),
    }
    judged = figures.withColumn(
        "checks", F.struct(*[holds.alias(name) for name, holds in criteria.items()])
    ).withColumn("passes", F.forall(F.array("checks.*"), lambda holds: holds))
    best = Window.orderBy(  # one row per grid cell
        F.desc("passes"),
        F.desc("net_active_mean_daily"),
        F.desc("net_sharpe"),
        "mean_one_way",
        "top_k",
        "exit_buffer",
    )
    return judged.withColumn("place", F.row_number().over(best)).select(
        "place",
        "top_k",
        "exit_buffer",
        "cost_bps",
        "evaluated_dates",
        "month_count",
        "net_mean_daily",
        "net_sharpe",
        "gross_active_mean_daily",
        "net_active_mean_daily",
        "positive_net_active_month_ratio",
        "top_5_absolute_active_contribution",
        "mean_one_way",
        *AGAINST_ZERO_BUFFER,
        "checks.*",
        "passes",
    )


def grid_verdict(candidates: DataFrame) -> DataFrame:
    found = F.count(F.when(F.col("passes"), 1))
    first = lambda c: F.min_by(c, F.when(F.col("passes"), F.col("place")))
    return candidates.agg(
        F.when(found > 0, "TRADEABLE_REGION_FOUND").otherwise("NO_TRADEABLE_REGION").alias("status"),
        found.alias("sweet_spots"),
        first("top_k").alias("best_top_k"),
        first("exit_buffer").alias("best_exit_buffer"),
    )


# ---- staggered cohorts -----------------------------------------------------


def staggered_selection(
    signals: DataFrame,
    targets: DataFrame,
    k: int,
    min_score: float | None = None,
    min_symbols: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """Numbered cohorts with enough scored targets, and their Top-K members.

    Every signal date takes a cohort number, also one skipped for its size.
    """
    along = Window.orderBy("trading_date")  # one row per session
    numbered = (
        signals.select("trading_date")
        .distinct()
        .withColumn("cohort", (F.row_number().over(along) - 1).cast("int"))
    )
    aligned = signals.select("trading_date", "symbol", "score").join(
        targets.select(
            "trading_date", "symbol", "return_end_date", "raw_return", "benchmark_return"
        ),
        ["trading_date", "symbol"],
    )
    sizes = aligned.groupBy("trading_date").agg(
        F.count(F.lit(1)).alias("_n"), F.min("return_end_date").alias("return_end_date")
    )
    cohorts = sized(
        numbered.join(sizes.where(F.col("_n") >= min_symbols), "trading_date").drop("_n"),
        "cohorts",
    )
    best = [F.desc("score"), F.col("symbol")]
    members = (
        first_rows(aligned.where(is_finite("score")), ["trading_date"], best, k, "rank")
        .join(cohorts.select("trading_date", "cohort"), "trading_date")
    )
    if min_score is not None:
        members = members.where(F.col("score") >= min_score)
    return cohorts, members


def staggered_cohorts(
    cohorts: DataFrame,
    members: DataFrame,
    k: int,
    per_side_bps: float = 10.0,
    stamp_bps: float = 5.0,
) -> DataFrame:
    """One fifth of the capital per cohort: contributions, cost and cash."""
    chosen = members.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("raw_return").alias("_raw"),
        F.avg("benchmark_return").alias("_bench"),
    )
    n = F.coalesce("_n", F.lit(0))
    exposure = n / F.lit(float(k)) / float(SLEEVES)
    rate = (2 * per_side_bps + stamp_bps) / 10_000.0
    rows = cohorts.join(chosen, "cohort", "left").select(
        "cohort",
        F.pmod("cohort", F.lit(SLEEVES)).alias("sleeve"),
        "trading_date",
        "return_end_date",
        n.alias("positions"),
        exposure.alias("gross_exposure"),
        (1.0 / SLEEVES - exposure).alias("cash_weight"),
        (exposure * F.coalesce("_raw", F.lit(0.0))).alias("raw_return"),
        (exposure * F.coalesce("_bench", F.lit(0.0))).alias("benchmark_return"),
        (exposure * rate).alias("transaction_cost"),
    )
    active = F.col("raw_return") - F.col("benchmark_return")
    return rows.withColumns(
        {
            "active_return": active,
            "net_return": F.col("raw_return") - F.col("transaction_cost"),
            "net_active_return": active - F.col("transaction_cost"),
        }
    )


def staggered_summary(rows: DataFrame) -> DataFrame:
    compound = lambda c: F.product(1.0 + F.col(c)) - 1.0
    return rows.agg(
        F.count(F.lit(1)).alias("evaluated_cohorts"),
        F.avg("positions").alias("mean_positions"),
        (F.avg("gross_exposure") * SLEEVES).alias("mean_gross_exposure"),
        F.avg("gross_exposure").alias("mean_one_way_turnover"),
        F.avg("active_return").alias("mean_active_return"),
        F.avg("net_active_return").alias("mean_net_active_return"),
        compound("raw_return").alias("cumulative_raw_return"),
        compound("benchmark_return").alias("cumulative_benchmark_return"),
        compound("net_return").alias("cumulative_net_return"),
        compound("net_active_return").alias("cumulative_net_active_return"),
    )


def sleeve_returns(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sleeve").agg(
        F.count(F.lit(1)).alias("cohorts"),
        (F.product(1.0 + SLEEVES * F.col("net_active_return")) - 1.0).alias(
            "cumulative_net_active_return"
        ),
    )


# ---- risk and dynamic cost -------------------------------------------------


def risk_attribution(
    holdings: DataFrame,
    signals: DataFrame,
    attributes: DataFrame,
    fields: Sequence[str] = ("log_size", "adv", "volatility"),
    min_pool: int = 100,
) -> DataFrame:
    """Weighted z exposure of the holdings against the day's pool, with coverages."""
    key = ["trading_date", "symbol"]
    known = attributes.select(*key, *fields).withColumn("_has", F.lit(1))
    stats = [
        c for f in fields for c in (F.avg(f).alias(f"{f}_m"), F.stddev_samp(f).alias(f"{f}_s"))
    ]
    pool = (
        signals.select(*key)
        .join(known, key, "left")
        .groupBy("trading_date")
        .agg(
            F.count("_has").alias("_pool"),
            (F.count("_has") / F.count(F.lit(1))).alias("universe_coverage"),
            *stats,
        )
        .where(F.col("_pool") >= min_pool)
    )
    held = holdings.select(*key, "weight").join(known, key, "left")
    weight = F.when(F.col("_has") == 1, F.col("weight"))
    chosen = held.groupBy("trading_date").agg(
        (F.count("_has") / F.count(F.lit(1))).alias("holding_coverage"),
        F.sum(weight).alias("_w"),
        *[F.sum(weight * F.col(f)).alias(f"{f}_x") for f in fields],
    )
    # sum(w (x - m) / s) / sum(w) = (sum(w x) / sum(w) - m) / s
    z = [
        F.when(
            F.col(f"{f}_s") > 0, (F.col(f"{f}_x") / F.col("_w") - F.col(f"{f}_m")) / F.col(f"{f}_s")
        ).alias(f"{f}_z")
        for f in fields
    ]
    return (
        chosen.where("holding_coverage > 0")
        .join(pool, "trading_date")
        .select("trading_date", "universe_coverage", "holding_coverage", *z)
    )


def risk_summary(daily: DataFrame, fields: Sequence[str] = ("log_size", "adv", "volatility")) -> DataFrame:
    return daily.agg(
        F.count(F.lit(1)).alias("evaluated_dates"),
        F.avg("universe_coverage").alias("mean_universe_coverage"),
        F.avg("holding_coverage").alias("mean_holding_coverage"),
        *[F.avg(f"{f}_z").alias(f"mean_{f}_z") for f in fields],
    )


def reprice_trades(charged: DataFrame, daily: DataFrame, attributes: DataFrame, **impact: float) -> DataFrame:
    """Net returns with square-root impact on top of the fixed cost, and the coverage."""
    key = ["trading_date", "symbol"]
    priced = charged.join(attributes.select(*key, "adv"), key, "left").withColumn(
        "_impact", impact_rate(F.col("notional"), F.col("adv"), **impact)
    )
    per_day = priced.groupBy("label_date").agg(
        F.sum(F.col("transaction_cost") + F.col("notional") * F.col("_impact")).alias("_cost"),
        F.count(F.lit(1)).alias("trades"),
        F.count("adv").alias("known_trades"),
    )
    cost = F.coalesce("_cost", F.lit(0.0))
    net = F.col("gross_return") - cost
    return daily.join(per_day, "label_date", "left").select(
        "label_date",
        cost.alias("dynamic_transaction_cost"),
        net.alias("net_return"),
        (net - F.col("universe_return")).alias("net_active_return"),
        F.coalesce("trades", F.lit(0)).alias("trades"),
        F.coalesce("known_trades", F.lit(0)).alias("known_trades"),
    )


def reprice_cohorts(
    cohort_rows: DataFrame,
    members: DataFrame,
    attributes: DataFrame,
    k: int,
    per_side_bps: float = 10.0,
    stamp_bps: float = 5.0,
    **impact: float,
) -> DataFrame:
    """Staggered cohorts with impact on entry and exit of every member."""
    key = ["trading_date", "symbol"]
    weight = 1.0 / k / SLEEVES
    priced = members.join(attributes.select(*key, "adv"), key, "left")
    rate = impact_rate(F.lit(weight), F.col("adv"), **impact)
    fixed = (2 * per_side_bps + stamp_bps) / 10_000.0
    per_cohort = priced.groupBy("cohort").agg(
        F.sum(weight * (fixed + 2.0 * rate)).alias("_cost"),
        F.count(F.lit(1)).alias("members"),
        F.count("adv").alias("known_members"),
    )
    cost = F.coalesce("_cost", F.lit(0.0))
    return cohort_rows.join(per_cohort, "cohort", "left").select(
        "cohort",
        "trading_date",
        "return_end_date",
        cost.alias("dynamic_transaction_cost"),
        (F.col("active_return") - cost).alias("net_active_return"),
        F.coalesce("members", F.lit(0)).alias("members"),
        F.coalesce("known_members", F.lit(0)).alias("known_members"),
    )


def repriced_summary(rows: DataFrame, total: str, known: str, day: str) -> DataFrame:
    """Liquidity coverage, mean and compounded net active return, top-5 concentration."""
    largest = Window.orderBy(F.desc(F.abs("net_active_return")), day)  # one row per session
    placed = rows.withColumn("_place", F.row_number().over(largest))
    size = F.abs("net_active_return")
    top = F.sum(F.when(F.col("_place") <= 5, size))
    return placed.agg(
        F.coalesce(safe_ratio(F.sum(known), F.sum(total)), F.lit(1.0)).alias("coverage"),
        F.avg("dynamic_transaction_cost").alias("mean_transaction_cost"),
        F.avg("net_active_return").alias("mean_net_active_return"),
        (F.product(1.0 + F.col("net_active_return")) - 1.0).alias("cumulative_net_active_return"),
        F.coalesce(F.try_divide(top, F.sum(size)), F.lit(0.0)).alias(
            "top_5_absolute_active_contribution"
        ),
    )


# ---- predictions and candidate choice --------------------------------------


def make_predictions(signals: DataFrame, scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Signals that have both a score and a target, as prediction rows."""
    key = ["trading_date", "symbol"]
    return (
        signals.select(*key)
        .join(scores.select(*key, "score"), key)
        .join(targets.select(*key, F.col("return_end_date").alias("label_date"), "target_return"), key)
        .withColumns(
            {"can_buy": F.lit(True), "can_sell": F.lit(True), "in_universe": F.lit(True)}
        )
    )


def candidate_name(alpha: float, min_score: float | None) -> str:
    return f"ema{alpha:g}-min{'none' if min_score is None else format(min_score, 'g')}"


def candidate_holdings(
    predictions: DataFrame,
    sessions: DataFrame,
    candidates: Sequence[tuple[float, float | None]],
    k: int,
) -> DataFrame:
    """Top-K holdings of every (alpha, minimum score) candidate, named, in one plan.

    ``predictions`` has one row per alpha; a candidate with a minimum score keeps the
    unused part in cash.
    """
    best = [F.desc("score"), F.col("symbol")]
    ranked = (
        first_rows(
            predictions.where(enterable(predictions)), ["alpha", "label_date"], best, k, "rank"
        )
        .join(sessions.select("label_date", "session"), "label_date")
    )
    options = F.array(
        *[
            F.struct(
                F.lit(candidate_name(a, m)).alias("name"),
                F.lit(float(a)).alias("_alpha"),
                F.lit(m).cast("double").alias("min_score"),
            )
            for a, m in candidates
        ]
    )
    named = ranked.select("*", F.inline(options)).where(
        (F.col("alpha") == F.col("_alpha"))
        & (F.col("min_score").isNull() | (F.col("score") >= F.col("min_score")))
    )
    day = Window.partitionBy("name", "label_date")  # at most k rows
    equal = F.lit(1.0) / F.count(F.lit(1)).over(day)
    weight = F.when(F.col("min_score").isNull(), equal).otherwise(1.0 / k)
    return named.withColumn("weight", weight).drop("_alpha", "alpha")


def candidate_matrix(
    predictions: DataFrame,
    candidates: Sequence[tuple[float, float | None]],
    k: int,
    min_symbols: int,
    window: str = "window",
) -> DataFrame:
    """Comparable portfolio figures of every candidate in every evaluation window."""
    one_alpha = predictions.where(F.col("alpha") == float(candidates[0][0]))
    sessions = eligible_sessions(one_alpha, min_symbols, segment=window)
    holdings = sized(candidate_holdings(predictions, sessions, candidates, k), "holdings")
    names = [(candidate_name(a, m),) for a, m in candidates]
    charged = charge(build_trades(holdings, one_alpha, sessions, ["name"]))
    daily = sized(
        daily_table(one_alpha, holdings, charged, sessions, ["name"], k, names), "daily"
    )
    keys = ["name", window]
    limits = F.create_map(
        *[F.lit(x).cast(t) for a, m in candidates for x, t in ((candidate_name(a, m), "string"), (m, "double"))]
    )
    extremes = extreme_days(daily, "active_return", keys).select(
        *keys, F.col("top_5_absolute_contribution").alias("top_5_absolute_active_contribution")
    )
    return (
        portfolio_summary(daily, keys)
        .join(extremes, keys)
        .select(
            *keys,
            limits[F.col("name")].alias("min_score"),
            "evaluated_dates",
            "mean_selected_rank_ic",
            "mean_active_return",
            "mean_net_active_return",
            "mean_one_way",
            "mean_transaction_cost",
            "mean_cash_weight",
            "top_5_absolute_active_contribution",
        )
    )


def choose_candidates(matrix: DataFrame, count: int = 3, window: str = "validation") -> DataFrame:
    """Best candidates by validation net active return, then turnover, then simplicity."""
    best = Window.orderBy(  # one row per candidate
        F.desc("mean_net_active_return"),
        "mean_one_way",
        F.col("min_score").isNotNull(),
        "name",
    )
    return (
        matrix.where(F.col("window") == window)
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= count)
        .select("place", "name")
    )


def gate_report(
    matrix: DataFrame,
    candidate: str,
    baseline: str,
    windows: Sequence[str],
    dynamic: DataFrame,
    risks: DataFrame,
) -> DataFrame:
    """The six checks of a candidate against the baseline in every window, and the decision.

    ``matrix`` has the static figures by (name, window); ``dynamic`` the candidate's
    mean_net_active_return by window under dynamic cost; ``risks`` its mean exposure z by
    window, one row per exposure (window, exposure, z). A window without risk rows is not
    judged for risk; one without dynamic figures fails.
    """
    fields = ("mean_net_active_return", "mean_one_way", "top_5_absolute_active_contribution")
    chosen = matrix.where(F.col("window").isin(*windows))

    def of(name: str, label: str) -> DataFrame:
        return chosen.where(F.col("name") == name).select("window", F.struct(*fields).alias(label))

    widest = risks.groupBy("window").agg(F.max(F.abs("z")).alias("widest_z"))
    priced = dynamic.select("window", F.col("mean_net_active_return").alias("dynamic_active"))
    both = (
        of(candidate, "mine")
        .join(of(baseline, "base"), "window")
        .join(priced, "window", "left")
        .join(widest, "window", "left")
    )
    mine, base = F.col("mine"), F.col("base")
    ratio = mine["mean_one_way"] / F.greatest(F.lit(1e-12), base["mean_one_way"])
    gain = mine["mean_net_active_return"] - base["mean_net_active_return"]
    checks = {
        "positive_in_both": mine["mean_net_active_return"] > 0,
        "positive_under_dynamic_cost": F.coalesce(F.col("dynamic_active") > 0, F.lit(False)),
        "improves_by_1bp": gain >= 0.0001,
        "turnover_at_most_80_percent": ratio <= 0.8,
        "top_5_below_half": mine["top_5_absolute_active_contribution"] < 0.5,
        "risk_within_one_z": F.coalesce(F.col("widest_z") <= 1.0, F.lit(True)),
    }
    report = both.agg(
        F.count(F.lit(1)).alias("windows"),
        *[F.bool_and(check).alias(name) for name, check in checks.items()],
    )
    complete = F.col("windows") == len(set(windows))
    passed = F.forall(F.array(*checks), lambda holds: holds)
    return report.withColumn("decision", F.when(complete & passed, "PASS").otherwise("HOLD"))


def separation(signals: DataFrame) -> DataFrame:
    """One row: last validation day, first oos day and whether they are in that order."""
    last = F.max(F.when(F.col("partition") == "validation", F.col("trading_date")))
    first = F.min(F.when(F.col("partition") == "oos", F.col("trading_date")))
    return signals.agg(
        last.alias("validation_end"),
        first.alias("oos_start"),
        F.coalesce(last < first, F.lit(False)).alias("separated"),
    )
