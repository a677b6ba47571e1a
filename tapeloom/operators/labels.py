"""Leak-free labels, quantile classes, walk-forward splits and target transforms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalars import DOWN, NEUTRAL, UP, fixed_label
from tapeloom.functions.stats import is_finite, is_positive
from tapeloom.operators.calendar import (
    benchmark_returns,
    by_symbol,
    dynamic_universe,
    execution_states,
    symbol_grid,
)
from tapeloom.plans.ordering import exact_quantiles, quantiles_at
from tapeloom.plans.scans import ordered_scan
from tapeloom.plans.shared import settle, sized

# Fixed values.
MAD_MULTIPLIER = 5.0
MIN_SCALE = 1e-12


def next_day_targets(
    bars: DataFrame, bench: DataFrame | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Next-session open-to-close return, benchmark-excess; gaps are never bridged.

    ``bars`` carries ``day_index`` and ``next_date``. The current bar must exist, and the
    symbol's next row must be the next calendar session.
    """
    nxt = F.lead(F.struct("day_index", "open", "close")).over(by_symbol())
    rows = (
        bars.withColumn("_nxt", nxt)
        .where(F.col("_nxt.day_index") == F.col("day_index") + 1)
        .select(
            "symbol",
            "trading_date",
            F.col("next_date").alias("label_date"),
            "day_index",
            (F.col("_nxt.close") / F.col("_nxt.open") - 1).alias("raw_return"),
            *keep,
        )
    )
    return _excess(rows, bench)


def next_day_targets_in_universe(
    universe: DataFrame, bars: DataFrame, bench: DataFrame | None = None
) -> DataFrame:
    """As above for a dated universe: the current bar may be absent, the next may not.

    ``universe`` has symbol, trading_date, day_index and label_date.
    """
    following = bars.select(
        "symbol",
        F.col("trading_date").alias("label_date"),
        (F.col("close") / F.col("open") - 1).alias("raw_return"),
    )
    rows = universe.select("symbol", "trading_date", "label_date", "day_index").join(
        following, ["symbol", "label_date"]
    )
    return _excess(rows, bench)


def _excess(rows: DataFrame, bench: DataFrame | None) -> DataFrame:
    if bench is None:
        return rows.withColumn("target_return", F.col("raw_return"))
    by_day = bench.select(
        F.col("trading_date").alias("label_date"),
        (F.col("close") / F.col("open") - 1).alias("_bench"),
    )
    return (
        rows.join(by_day, "label_date")
        .withColumn("target_return", F.col("raw_return") - F.col("_bench"))
        .drop("_bench")
    )


def quantile_labels(
    rows: DataFrame,
    group: Sequence[str],
    value: str = "target_return",
    lower: float = 0.2,
    upper: float = 0.8,
    min_cross_section: int = 20,
    tie: str = "symbol",
) -> DataFrame:
    """Three classes per cross-section; values equal to a cut stay neutral.

    Cross-sections below the minimum size are dropped. ``tie`` only spreads equal values
    over the sort, it does not change a label.
    """
    order = [F.col(value), F.col(tie)]
    scanned = ordered_scan(rows, group, order, pos="_pos", size="_n")
    placed = settle(scanned.where(F.col("_n") >= min_cross_section), "placed")
    cuts = quantiles_at(
        placed, group, value, {"_lower": lower, "_upper": upper}, pos="_pos"
    )
    label = (
        F.when(F.col(value) < F.col("_lower"), DOWN)
        .when(F.col(value) > F.col("_upper"), UP)
        .otherwise(NEUTRAL)
    )
    return (
        placed.join(sized(cuts, "cuts"), list(group))
        .withColumn("label", label)
        .drop("_pos", "_n", "_lower", "_upper")
    )


def threshold_labels(rows: DataFrame, threshold: float = 0.002) -> DataFrame:
    return rows.withColumn("label", fixed_label(F.col("target_return"), threshold))


def horizon_returns(
    samples: DataFrame,
    calendar: DataFrame,
    bench: DataFrame,
    horizons: Sequence[int] = (1, 3, 5),
    sample: Column | None = None,
) -> DataFrame:
    """T+1 open to T+H close returns and benchmark returns, one row per horizon.

    ``samples`` holds the indexed bars; ``sample`` marks the rows that are signals. All
    horizons share one sort per symbol: a range frame [h, h] over calendar positions
    reads exactly the session h steps ahead and is null across a gap.
    """

    def at(offset: int, column: str) -> Column:
        frame = by_symbol().rangeBetween(offset, offset)
        return F.max(F.when(is_positive(column), F.col(column))).over(frame)

    flag = F.lit(True) if sample is None else sample
    exits = F.array(
        *[
            F.struct(F.lit(int(h)).alias("horizon"), at(h, "close").alias("exit"))
            for h in horizons
        ]
    )
    rows = (
        samples.withColumns({"_entry": at(1, "open"), "_exits": exits})
        .where(flag)
        .select("symbol", "trading_date", "day_index", "_entry", F.inline("_exits"))
        .where(F.col("_entry").isNotNull() & F.col("exit").isNotNull())
    )
    market = calendar.join(bench, "trading_date").where(
        is_positive("open") & is_positive("close")
    )
    entry = market.select(
        (F.col("day_index") - 1).alias("day_index"),
        F.col("trading_date").alias("entry_date"),
        F.col("open").alias("_bench_open"),
    )
    end = market.select(
        F.col("day_index").alias("_end_index"),
        F.col("trading_date").alias("return_end_date"),
        F.col("close").alias("_bench_close"),
    )
    raw = F.col("exit") / F.col("_entry") - 1
    market_return = F.col("_bench_close") / F.col("_bench_open") - 1
    return (
        rows.join(entry, "day_index")
        .withColumn("_end_index", F.col("day_index") + F.col("horizon"))
        .join(end, "_end_index")
        .select(
            "symbol",
            "trading_date",
            "entry_date",
            "return_end_date",
            "horizon",
            raw.alias("raw_return"),
            market_return.alias("benchmark_return"),
            (raw - market_return).alias("target_return"),
        )
    )


def horizon_targets(
    samples: DataFrame,
    calendar: DataFrame,
    bench: DataFrame,
    horizons: Sequence[int] = (1, 3, 5),
    lower: float = 0.2,
    upper: float = 0.8,
    min_cross_section: int = 20,
    sample: Column | None = None,
) -> DataFrame:
    rows = horizon_returns(samples, calendar, bench, horizons, sample)
    return quantile_labels(
        rows, ["horizon", "trading_date"], "target_return", lower, upper, min_cross_section
    )


def horizon_sidecar(next_day: DataFrame, longer: DataFrame) -> DataFrame:
    """Horizon 1 copied from labelled next-day targets, other horizons as computed."""
    first = next_day.select(
        "symbol",
        "trading_date",
        F.col("label_date").alias("entry_date"),
        F.col("label_date").alias("return_end_date"),
        F.lit(1).alias("horizon"),
        "raw_return",
        (F.col("raw_return") - F.col("target_return")).alias("benchmark_return"),
        "target_return",
        "label",
    )
    return longer.where(F.col("horizon") != 1).unionByName(first)


def formal_targets(
    bars: DataFrame,
    calendar: DataFrame,
    bench: DataFrame,
    top_n: int,
    min_history_days: int = 60,
    lookback: int = 20,
    min_observations: int = 15,
    lower: float = 0.2,
    upper: float = 0.8,
) -> tuple[DataFrame, DataFrame]:
    """Open-to-following-open targets of complete Top-N dates, and the date report rows.

    A date counts only if the universe has exactly ``top_n`` symbols, the benchmark
    return exists and every candidate has a target. Symbols dropped since the previous
    signal date stay as status rows until the first complete date they can be sold on.
    """
    universe = settle(
        dynamic_universe(bars, calendar, top_n, min_history_days, lookback, min_observations)
        .select("symbol", "day_index", F.lit(True).alias("selected")),
        "universe",
    )
    ahead = {
        f"_{name}": F.lead(F.struct("day_index", "state"), step).over(by_symbol())
        for name, step in (("start", 1), ("end", 2))
    }
    # Only symbols that are ever chosen, from their first choice on, can be candidates or carried.
    entered = universe.groupBy("symbol").agg(F.min("day_index").alias("_entered"))
    entered = sized(entered, "entered")
    traded = bars.join(entered.select("symbol"), "symbol", "left_semi")
    states = execution_states(symbol_grid(traded, calendar)).withColumns(ahead)
    states = states.join(entered, "symbol").where(F.col("day_index") >= F.col("_entered"))
    raw = F.col("_end.state.mark_price") / F.col("_start.state.mark_price") - 1
    rows = states.join(universe, ["symbol", "day_index"], "left").select(
        "symbol",
        "day_index",
        F.coalesce("selected", F.lit(False)).alias("in_universe"),
        raw.alias("raw_return"),
        F.col("_start.state.can_buy").alias("can_buy"),
        F.col("_start.state.can_sell").alias("can_sell"),
        F.col("_start.state.status").alias("execution_status"),
    )
    # Read twice below: for the date counts and for the rows themselves.
    rows = settle(rows, "states")
    market = benchmark_returns(bench, calendar).select(
        F.col("trading_date").alias("label_date"), F.col("open_next_open").alias("benchmark_return")
    )
    dates = (
        calendar.where(F.col("next_next_date").isNotNull())
        .select(
            "day_index",
            "trading_date",
            F.col("next_date").alias("label_date"),
            F.col("next_next_date").alias("return_end_date"),
        )
        .join(market, "label_date", "left")
    )
    chosen = F.col("in_universe")
    counts = rows.groupBy("day_index").agg(
        F.count(F.when(chosen, 1)).alias("candidates"),
        F.count(F.when(chosen & is_finite("raw_return"), 1)).alias("targets"),
    )
    complete = (F.col("candidates") == top_n) & (F.col("targets") == top_n)
    dated = dates.join(counts, "day_index", "left").select(
        *dates.columns,
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
        (F.coalesce(complete, F.lit(False)) & is_finite("benchmark_return")).alias("complete"),
    )
    dated = sized(dated, "dates")

    member = rows.join(dated, "day_index").withColumn(
        "_was_in", F.coalesce(F.lag("in_universe").over(by_symbol()), F.lit(False))
    )
    live = _episodes(member.where("complete"))
    excess = live.withColumns(
        {
            "portfolio_return": F.col("raw_return"),
            "target_return": F.col("raw_return") - F.col("benchmark_return"),
        }
    ).drop("complete", "candidates", "day_index")
    excess = settle(excess.where(is_finite("raw_return")), "formal")
    labelled = quantile_labels(
        excess.where("in_universe"), ["trading_date"], "target_return", lower, upper, 1
    )
    status = excess.where("NOT in_universe").withColumn("label", F.lit(NEUTRAL))
    return labelled.unionByName(status), dated


def _episodes(member: DataFrame) -> DataFrame:
    """Candidates, plus carried rows until the first row that can be sold."""
    chosen = F.col("in_universe")
    left = ~chosen & F.col("_was_in")
    so_far = by_symbol().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = member.withColumn("_run", F.sum((chosen | left).cast("int")).over(so_far))
    by_run = Window.partitionBy("symbol", "_run").orderBy("day_index")
    earlier = by_run.rowsBetween(Window.unboundedPreceding, -1)
    sellable = is_finite("raw_return") & F.col("can_sell")
    marked = numbered.withColumns(
        {
            "_opened_by_exit": F.first(left).over(by_run),
            "_sold": F.coalesce(F.max(F.when(sellable, 1)).over(earlier), F.lit(0)),
        }
    )
    carried = F.col("_opened_by_exit") & (F.col("_sold") == 0)
    return marked.where(chosen | ((F.col("_run") > 0) & carried)).drop(
        "_was_in", "_run", "_opened_by_exit", "_sold"
    )


def formal_report(targets: DataFrame, dates: DataFrame, top_n: int) -> DataFrame:
    """One row: requested, complete and incomplete dates and execution-state counts."""
    per_date = dates.agg(
        F.count(F.lit(1)).alias("requested_signal_dates"),
        F.count(F.when(F.col("complete"), 1)).alias("complete_signal_dates"),
        F.count(F.when(F.col("candidates") != top_n, 1)).alias("incomplete_universe_dates"),
        F.count(F.when((F.col("candidates") == top_n) & ~F.col("complete"), 1)).alias(
            "missing_market_state_dates"
        ),
    )
    state = F.col("execution_status")
    per_row = targets.agg(
        F.count(F.when(F.col("in_universe"), 1)).alias("candidate_targets"),
        F.count(F.when(~F.col("in_universe"), 1)).alias("status_only_targets"),
        F.count(F.when(state == "suspended", 1)).alias("suspended_rows"),
        F.count(F.when(state == "one_price_limit_up", 1)).alias("one_price_limit_up_rows"),
        F.count(F.when(state == "one_price_limit_down", 1)).alias("one_price_limit_down_rows"),
    )
    # Two one-row results side by side.
    return per_date.withColumn("_one", F.lit(1)).join(
        per_row.withColumn("_one", F.lit(1)), "_one"
    ).drop("_one")


def assign_split(
    rows: DataFrame,
    ranges: Mapping[str, tuple[str, str]],
    signal: str = "trading_date",
    entry: str = "label_date",
    end: str | None = None,
) -> DataFrame:
    """Split whose closed range holds signal, entry and return-end date; else null."""
    columns = [signal, entry, end or entry]
    split = F.lit(None).cast("string")
    signal_split = F.lit(None).cast("string")
    for name, (first, last) in ranges.items():
        bounds = F.lit(first).cast("date"), F.lit(last).cast("date")
        holds = F.lit(True)
        for c in columns:
            holds = holds & F.col(c).between(*bounds)
        split = F.when(holds, name).otherwise(split)
        signal_split = F.when(F.col(signal).between(*bounds), name).otherwise(signal_split)
    return rows.withColumns({"split": split, "signal_split": signal_split})


def fold_split_counts(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Accepted and purged rows by fold, split and horizon.

    The signal date alone decides which split counts the row; entry and return-end date
    outside that range make it purged. ``ranges`` are expanded to one row per fold and day, so
    that the dates meet them in an equi-join.
    """
    fold_days = ranges.withColumn("trading_date", F.explode(F.sequence("start", "end")))
    held = F.col("entry_date").between(F.col("start"), F.col("end")) & F.col(
        "return_end_date"
    ).between(F.col("start"), F.col("end"))
    # Counting per distinct date triple first keeps the fold join off the full table.
    triples = rows.groupBy("trading_date", "entry_date", "return_end_date", "horizon").agg(
        F.count(F.lit(1)).alias("_rows")
    )
    return (
        triples.join(fold_days, "trading_date")
        .groupBy("fold_id", "split", "horizon")
        .agg(
            F.sum(F.when(held, F.col("_rows")).otherwise(0)).alias("accepted"),
            F.sum(F.when(held, 0).otherwise(F.col("_rows"))).alias("purged"),
        )
    )


def relabel(samples: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Samples with the sidecar's label and return; status names what did not match."""
    keys = ["symbol", "trading_date"]
    side = sidecar.select(
        *keys, F.col("label").alias("new_label"), F.col("target_return").alias("new_return")
    ).withColumn("_in_side", F.lit(True))
    mine = samples.select(*keys).withColumn("_in_samples", F.lit(True))
    return mine.join(side, keys, "full_outer").select(
        *keys,
        "new_label",
        "new_return",
        F.when(F.col("_in_samples").isNull(), "extra")
        .when(F.col("_in_side").isNull(), "missing")
        .otherwise("relabelled")
        .alias("status"),
    )


def daily_winsorized_z(
    rows: DataFrame, value: str = "target_return", day: str = "trading_date"
) -> tuple[DataFrame, DataFrame]:
    """Median ± 5 MAD clip, then population z per day; returns (rows, day statistics)."""
    medians = sized(exact_quantiles(rows, [day], value, {"median": 0.5}), "median")
    centred = rows.join(medians, day).withColumn("_gap", F.abs(F.col(value) - F.col("median")))
    mads = sized(exact_quantiles(centred, [day], "_gap", {"mad": 0.5}), "mad")
    low = F.col("median") - MAD_MULTIPLIER * F.col("mad")
    high = F.col("median") + MAD_MULTIPLIER * F.col("mad")
    clipped = rows.join(medians.join(mads, day), day).withColumns(
        {
            "_clipped": F.least(F.greatest(F.col(value), low), high),
            "_cut": ((F.col(value) < low) | (F.col(value) > high)).cast("int"),
        }
    )
    stats = (
        clipped.groupBy(day)
        .agg(
            F.count(F.lit(1)).alias("symbols"),
            F.first("median").alias("median"),
            F.first("mad").alias("mad"),
            F.sum("_cut").alias("clipped_symbols"),
            F.avg("_clipped").alias("winsorized_mean"),
            F.stddev_pop("_clipped").alias("winsorized_std"),
        )
        .where((F.col("symbols") >= 2) & (F.col("mad") > MIN_SCALE))
        .where(F.col("winsorized_std") > MIN_SCALE)
    )
    stats = sized(stats, "zstats")
    scale = stats.select(day, "winsorized_mean", "winsorized_std")
    z = (F.col("_clipped") - F.col("winsorized_mean")) / F.col("winsorized_std")
    out = clipped.join(scale, day).withColumn("z", z)
    return out.select(*rows.columns, "z"), stats


def relevance_grade(pos: Column, size: Column, levels: int) -> Column:
    """Grade 0..levels-1 of an ascending 1-based position."""
    return F.least(F.lit(levels - 1), F.floor((pos - 1) * levels / size)).cast("int")


def graded_relevance(
    rows: DataFrame,
    levels: int = 5,
    value: str = "target_return",
    day: str = "trading_date",
    tie: str = "symbol",
) -> DataFrame:
    """Relevance 0..levels-1 from the ascending ordinal rank of the day's returns."""
    placed = ordered_scan(rows, [day], [F.col(value), F.col(tie)], pos="_pos", size="_n")
    grade = relevance_grade(F.col("_pos"), F.col("_n"), levels)
    return placed.withColumn("relevance", grade).drop("_pos", "_n")


def class_weights(rows: DataFrame, label: str = "label", classes: int = 3) -> DataFrame:
    """n / (classes * count) per class."""
    total = F.sum("count").over(Window.partitionBy())  # one row per class
    return (
        rows.groupBy(label)
        .count()
        .withColumn("weight", total / (F.lit(float(classes)) * F.col("count")))
    )


def standardize_target(
    rows: DataFrame, train: Column, value: str = "target_return"
) -> DataFrame:
    """Population z with train-only mean and scale, kept on the row for the inverse."""
    fit = rows.where(train).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    mean = fit.select("m").scalar()
    std = fit.select("s").scalar()
    scale = F.when(std > MIN_SCALE, std)
    return rows.withColumns({"target_mean": mean, "target_std": scale}).withColumn(
        "z", (F.col(value) - F.col("target_mean")) / F.col("target_std")
    )


def expected_return(score: Column, mean: Column, std: Column) -> Column:
    return score * std + mean
