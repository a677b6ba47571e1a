"""Trading calendars, panel windows, point-in-time universes and rolling folds.

A (symbol, date) key is unique, so the rows of one symbol are bounded by the number of
sessions and per-symbol windows are safe. A date holds every symbol, so nothing here
gathers a date: top-N per date is a ranked limit that Spark prunes before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tapeloom.functions.scalars import month_end, open_execution_state, shift_month
from tapeloom.functions.stats import is_finite, is_positive
from tapeloom.plans.ordering import first_rows

def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("day_index")


def trading_calendar(days: DataFrame, date: str = "trading_date") -> DataFrame:
    """Distinct sessions with a zero-based index and the next two sessions.

    The only unpartitioned window of the package: its input has one row per session.
    """
    w = Window.orderBy("trading_date")
    return (
        days.select(F.col(date).alias("trading_date"))
        .where(F.col("trading_date").isNotNull())
        .distinct()
        .select(
            "trading_date",
            (F.row_number().over(w) - 1).cast("long").alias("day_index"),
            F.lead("trading_date", 1).over(w).alias("next_date"),
            F.lead("trading_date", 2).over(w).alias("next_next_date"),
        )
    )


def with_day_index(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    return rows.join(calendar.select("trading_date", "day_index", "next_date"), "trading_date")


def session_after(rows: DataFrame, calendar: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """For each indexed row, the session ``h`` positions later for every horizon."""
    ends = calendar.select(
        F.col("day_index").alias("end_index"), F.col("trading_date").alias("end_date")
    )
    return (
        rows.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
        .withColumn("end_index", F.col("day_index") + F.col("horizon"))
        .join(ends, "end_index")
    )


def previous_valid_close(bars: DataFrame, close: str = "close") -> DataFrame:
    """Last finite positive close strictly before each row of the symbol."""
    earlier = by_symbol().rowsBetween(Window.unboundedPreceding, -1)
    valid = F.when(is_positive(close), F.col(close))
    return bars.withColumn("previous_close", F.last(valid, ignorenulls=True).over(earlier))


def latest_close_before(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """As-of join: latest valid close strictly before the requested day, 0 when none.

    Requests sort before the bar of the same day, so one window per symbol answers all
    requests; a symbol has at most two rows per session.
    """
    asked = requests.select(
        "symbol", "trading_date", F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_v")
    ).distinct()
    known = bars.where(is_positive("close")).select(
        "symbol", "trading_date", F.lit(1).alias("_kind"), F.col("close").alias("_v")
    )
    w = (
        Window.partitionBy("symbol")
        .orderBy("trading_date", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        asked.unionByName(known)
        .withColumn("prev_close", F.coalesce(F.last("_v", ignorenulls=True).over(w), F.lit(0.0)))
        .where("_kind = 0")
        .select("symbol", "trading_date", "prev_close")
    )


def valid_bar() -> Column:
    return is_positive("open") & is_positive("close") & is_positive("volume")


def first_valid_day(bars: DataFrame) -> DataFrame:
    """First session with a fully valid bar per symbol."""
    return bars.where(valid_bar()).groupBy("symbol").agg(
        F.min("day_index").alias("first_index")
    )


def symbol_grid(bars: DataFrame, calendar: DataFrame, tail: int | None = None) -> DataFrame:
    """Every session of each symbol from its first bar on, bars left-joined in.

    ``tail`` ends the span that many sessions after the symbol's last bar; without it the
    span runs to the end of the calendar. Sessions without a bar have null prices.
    """
    end = calendar.agg(F.max("day_index")).scalar()
    spans = bars.groupBy("symbol").agg(
        F.min("day_index").alias("_first"), F.max("day_index").alias("_last")
    )
    stop = end if tail is None else F.least(end, F.col("_last") + tail)
    grid = (
        spans.select("symbol", "_first", stop.alias("_stop"))
        .select("symbol", F.explode(F.sequence("_first", "_stop")).alias("day_index"))
        .join(calendar.select("day_index", "trading_date"), "day_index")
    )
    values = bars.drop("trading_date", "next_date")
    return grid.join(values, ["symbol", "day_index"], "left")


def trailing_liquidity(grid: DataFrame, lookback: int) -> DataFrame:
    """Valid sessions and mean turnover over the previous ``lookback`` sessions."""
    window = by_symbol().rangeBetween(-lookback, -1)
    turnover = F.when(valid_bar(), F.col("close") * F.col("volume"))
    everything = Window.partitionBy("symbol")
    return grid.withColumns(
        {
            "observations": F.count(turnover).over(window),
            "liquidity": F.avg(turnover).over(window),
            "first_index": F.min(F.when(valid_bar(), F.col("day_index"))).over(everything),
        }
    ).where(F.col("day_index") >= lookback)


def dynamic_universe(
    bars: DataFrame,
    calendar: DataFrame,
    top_n: int,
    min_history_days: int = 60,
    lookback: int = 20,
    min_observations: int = 15,
) -> DataFrame:
    """Point-in-time Top-N by trailing liquidity; equal liquidity keeps the larger symbol."""
    scored = trailing_liquidity(symbol_grid(bars, calendar, tail=lookback), lookback)
    eligible = scored.where(
        (F.col("day_index") - F.col("first_index") >= min_history_days)
        & (F.col("observations") >= min_observations)
        & is_positive("liquidity")
    )
    best = [F.desc("liquidity"), F.desc("symbol")]
    return (
        first_rows(eligible, ["trading_date"], best, top_n, "rank")
        .select("trading_date", "day_index", "symbol", "liquidity", "observations", "rank")
    )


def benchmark_returns(bench: DataFrame, calendar: DataFrame) -> DataFrame:
    """Open-to-close return of the session and open-to-next-open return by calendar."""
    valid = bench.where(is_positive("open")).select("trading_date", "open", "close")
    w = Window.orderBy("day_index")  # one row per session
    return (
        calendar.select("trading_date", "day_index")
        .join(valid, "trading_date", "left")
        .withColumn("next_open", F.lead("open").over(w))
        .select(
            "trading_date",
            F.when(is_positive("close"), F.col("close") / F.col("open") - 1).alias("open_close"),
            (F.col("next_open") / F.col("open") - 1).alias("open_next_open"),
        )
    )


def carried_status(rows: DataFrame) -> DataFrame:
    """Rows of symbols that left the universe, up to the first row they can be sold on.

    Input: one row per symbol and evaluated date with ``in_universe`` and ``can_sell``.
    """
    so_far = by_symbol().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    episodes = rows.withColumn(
        "episode", F.sum(F.col("in_universe").cast("int")).over(so_far)
    )
    before = (
        Window.partitionBy("symbol", "episode")
        .orderBy("day_index")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sold = F.coalesce(
        F.sum(F.when(~F.col("in_universe") & F.col("can_sell"), 1).otherwise(0)).over(before),
        F.lit(0),
    )
    return (
        episodes.withColumn("_sold", sold)
        .where(~F.col("in_universe") & (F.col("episode") > 0) & (F.col("_sold") == 0))
        .drop("_sold")
    )


def comparison_universe(selected: DataFrame, targets: DataFrame, sessions: DataFrame) -> DataFrame:
    """Selected symbols plus those of the previous evaluated session that dropped out.

    ``sessions`` numbers the evaluated dates (trading_date, day_index); dropped symbols
    carry score 0 and ``in_universe`` false. Rows without a target are left out.
    """
    indexed = selected.join(sessions.select("trading_date", "day_index"), "trading_date")
    following = F.lead("day_index").over(by_symbol())
    dropped = (
        indexed.withColumn("_next", following)
        .where(F.col("_next").isNull() | (F.col("_next") > F.col("day_index") + 1))
        .select("symbol", (F.col("day_index") + 1).alias("day_index"))
        .join(sessions.select("trading_date", "day_index"), "day_index")
        .select(
            "trading_date", "symbol", F.lit(0.0).alias("score"), F.lit(False).alias("in_universe")
        )
    )
    current = indexed.select("trading_date", "symbol", "score", F.lit(True).alias("in_universe"))
    return current.unionByName(dropped).join(targets, ["trading_date", "symbol"])


def market_attributes(
    bars: DataFrame,
    size: str = "size",
    lookback: int = 20,
    lot: float = 100.0,
    slack: int = 5,
) -> DataFrame:
    """Log size, lot-scaled average turnover and return volatility up to the row's session.

    Volatility needs all ``lookback + 1`` closes; turnover allows ``slack`` missing days.
    """
    closes = by_symbol().rangeBetween(-lookback, 0)
    days = by_symbol().rangeBetween(-lookback + 1, 0)
    close_ok = is_positive("close")
    turnover = F.when(close_ok & is_positive("volume"), F.col("close") * F.col("volume"))
    previous = F.lag(F.struct("day_index", "close")).over(by_symbol())
    stepped = bars.withColumn("_prev", previous).withColumn(
        "_ret",
        F.when(
            (F.col("_prev.day_index") == F.col("day_index") - 1)
            & close_ok
            & is_positive("_prev.close"),
            F.log("close") - F.log("_prev.close"),
        ),
    )
    return (
        stepped.withColumns(
            {
                "_closes": F.count(F.when(close_ok, 1)).over(closes),
                "_days": F.count(turnover).over(days),
                "adv": F.avg(turnover).over(days) * lot,
                "volatility": F.stddev_samp("_ret").over(days),
                "log_size": F.when(is_positive(size), F.log(size)),
            }
        )
        .where(
            (F.col("day_index") >= lookback)
            & (F.col("_closes") == lookback + 1)
            & (F.col("_days") >= lookback - slack)
            & F.col("log_size").isNotNull()
            & is_positive("adv")
            & is_finite("volatility")
        )
        .select("symbol", "trading_date", "day_index", "log_size", "adv", "volatility")
    )


def rolling_folds(
    bounds: DataFrame,
    train_months: int = 3,
    validation_months: int = 1,
    oos_months: int = 1,
    step_months: int = 1,
) -> DataFrame:
    """Rolling train / validation / out-of-sample months between two month bounds.

    ``bounds`` has one row with ``start_month`` and ``end_month``.
    """
    total = train_months + validation_months + oos_months
    step = F.make_ym_interval(F.lit(0), F.lit(step_months))
    starts = bounds.select(
        F.trunc("start_month", "month").alias("_start"),
        F.add_months(F.trunc("end_month", "month"), -(total - 1)).alias("_last"),
    ).where("_start <= _last")
    folds = starts.select(
        F.posexplode(F.sequence("_start", "_last", step)).alias("fold_index", "train_start")
    )
    start = F.col("train_start")
    out = folds.select(
        "fold_index",
        "train_start",
        month_end(shift_month(start, train_months - 1)).alias("train_end"),
        shift_month(start, train_months).alias("val_start"),
        month_end(shift_month(start, train_months + validation_months - 1)).alias("val_end"),
        shift_month(start, train_months + validation_months).alias("oos_start"),
        month_end(shift_month(start, total - 1)).alias("oos_end"),
    )
    return out.withColumn(
        "fold_id",
        F.format_string("fold-%02d-oos-%s", "fold_index", F.date_format("oos_start", "yyyyMM")),
    )


def split_ranges(folds: DataFrame) -> DataFrame:
    """Long form of fold bounds: (fold_id, split, start, end)."""
    parts = [
        F.struct(
            F.lit(name).alias("split"),
            F.col(f"{prefix}_start").alias("start"),
            F.col(f"{prefix}_end").alias("end"),
        )
        for name, prefix in (("train", "train"), ("val", "val"), ("test", "oos"))
    ]
    return folds.select("fold_id", F.explode(F.array(*parts)).alias("r")).select(
        "fold_id", "r.split", "r.start", "r.end"
    )


def ranges_frame(spark: SparkSession, ranges: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Split ranges from parameters (name, first day, last day)."""
    return spark.createDataFrame(list(ranges), "split string, start string, end string").select(
        "split", F.to_date("start").alias("start"), F.to_date("end").alias("end")
    )


def days_outside_one_range(days: DataFrame, ranges: DataFrame, locked_from: str) -> DataFrame:
    """Days that match no range, several ranges, or reach the locked period.

    Ranges are dealt to the months that they touch, so that days meet only those of their month, in
    a join on the month with an exact test behind it, however many ranges there are.
    """
    month = F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("INTERVAL 1 MONTH"))
    binned = ranges.where("start <= end").select(
        "split", "start", "end", F.explode(month).alias("_month")
    )
    own = days.withColumn("_day_month", F.trunc("trading_date", "month"))
    hits = own.join(
        binned,
        (F.col("_day_month") == F.col("_month"))
        & F.col("trading_date").between(F.col("start"), F.col("end")),
        "left",
    )
    counted = hits.groupBy("trading_date").agg(F.count("split").alias("ranges"))
    locked = F.col("trading_date") >= F.lit(locked_from).cast("date")
    return counted.select(
        "trading_date",
        "ranges",
        F.when(locked, "locked")
        .when(F.col("ranges") == 0, "no range")
        .when(F.col("ranges") > 1, "several ranges")
        .otherwise("ok")
        .alias("status"),
    )


def execution_states(grid: DataFrame) -> DataFrame:
    """Execution state of every grid session that has a previous valid close."""
    with_close = previous_valid_close(grid)
    return (
        with_close.withColumn(
            "state",
            open_execution_state(
                F.col("symbol"),
                F.col("trading_date"),
                F.col("open"),
                F.col("high"),
                F.col("low"),
                F.col("volume"),
                F.col("previous_close"),
                F.coalesce(F.col("is_st"), F.lit(False)),
            ),
        )
        .select("symbol", "trading_date", "day_index", "previous_close", "state")
    )
