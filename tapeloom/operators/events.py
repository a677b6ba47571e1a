"""Order, trade and snapshot streams: links, deltas, merged order, features, windows.

A stock-day can hold any share of the rows, so ordered work is a scan that cuts large ones into
parts and mends their edges (``plans/scans.py``): places, changes, the time before and the reference
price come from one shuffle of the rows. Closing windows are ranked limits that Spark prunes before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalars import (
    AGE_UNKNOWN_MS,
    bps_distance,
    day_phase,
    is_cancel,
    level_features,
    log1p_clamped,
    order_side,
    order_type_id,
    signed_log1p,
    top_of_book,
)
from tapeloom.functions.stats import is_positive
from tapeloom.plans.ordering import first_rows, neighbours, ordinal, prefix_sum
from tapeloom.plans.scans import ordered_scan
from tapeloom.plans.shared import sized

# Merge order of simultaneous events and stream identifiers.
STREAM_RANK = {"order": 0, "trade": 1, "snap": 2}
STREAM_IDS = {"snap": 1, "order": 2, "trade": 3}
LEVELS = 10

STOCK_DAY = ("day", "ticker")


def in_universe(rows: DataFrame, universe: DataFrame, keys: Sequence[str] = STOCK_DAY) -> DataFrame:
    """Rows whose key is listed, for a static (ticker) or a per-day (day, ticker) list."""
    return rows.join(universe.select(*keys).distinct(), list(keys), "left_semi")


def link_cancels(orders: DataFrame, keys: Sequence[str] = STOCK_DAY) -> DataFrame:
    """Age and original volume of cancelled orders; -1 and 0 when the original is unknown.

    Only cancels are joined, by a plain left join: a cancel whose order id was added twice
    links twice. Every other order passes once, with zeros.
    """
    cancel = F.coalesce(is_cancel(F.col("order_type")), F.lit(False))
    others = orders.where(~cancel)
    adds = others.select(
        *keys, "order_id", F.col("time_ms").alias("_time"), F.col("volume").alias("_volume")
    )
    age = F.coalesce(F.col("time_ms") - F.col("_time"), F.lit(AGE_UNKNOWN_MS))
    linked = (
        orders.where(cancel)
        .join(adds, [*keys, "order_id"], "left")
        .withColumns(
            {"cancel_age_ms": age, "cancel_orig_vol": F.coalesce("_volume", F.lit(0))}
        )
        .drop("_time", "_volume")
    )
    zeros = {"cancel_age_ms": F.lit(0), "cancel_orig_vol": F.lit(0)}
    return linked.unionByName(others.withColumns(zeros))


def link_trades(trades: DataFrame, orders: DataFrame, keys: Sequence[str] = STOCK_DAY) -> DataFrame:
    """Age of the buy and the sell order of each trade; -1 when the order is unknown."""
    adds = orders.where(~is_cancel(F.col("order_type")))
    out = trades
    for side in ("buy", "sell"):
        arrivals = adds.select(
            *keys, F.col("order_id").alias(f"{side}_id"), F.col("time_ms").alias("_time")
        )
        age = F.coalesce(F.col("time_ms") - F.col("_time"), F.lit(AGE_UNKNOWN_MS))
        out = (
            out.join(arrivals, [*keys, f"{side}_id"], "left")
            .withColumn(f"{side}_age_ms", age)
            .drop("_time")
        )
    return out


def counter_deltas(
    snaps: DataFrame,
    counters: Sequence[str],
    order: Sequence[str] = ("time_ms", "seq"),
    group: Sequence[str] = STOCK_DAY,
    part_rows: int | None = None,
) -> DataFrame:
    """Cumulative counters to per-row changes; the first row keeps its value."""
    lags = {f"_before_{c}": c for c in counters}
    stepped = ordered_scan(
        snaps, group, [F.col(c) for c in order], pos="_pos", lag=lags, part_rows=part_rows
    )
    deltas = {f"d_{c}": F.col(c) - F.coalesce(f"_before_{c}", F.lit(0)) for c in counters}
    return stepped.withColumns(deltas).drop("_pos", *lags)


def stream_index(rows: DataFrame) -> DataFrame:
    """Events per (day, stream, ticker) with the offset of the ticker in its day stream."""
    counts = rows.groupBy("day", "stream", "ticker").agg(F.count(F.lit(1)).alias("length"))
    placed = prefix_sum(counts, ["day", "stream"], [F.col("ticker")], "length")
    return placed.select(
        "day", "stream", "ticker", (F.col("upto") - F.col("length")).alias("offset"), "length"
    )


def stream_rank(stream: Column) -> Column:
    pairs = [F.lit(x) for pair in STREAM_RANK.items() for x in pair]
    return F.create_map(*pairs)[stream]


def event_order() -> list[Column]:
    """Time, then order, trade, snapshot, then seq."""
    return [F.col("time_ms"), stream_rank(F.col("stream")), F.col("seq")]


def merge_streams(rows: DataFrame, part_rows: int | None = None) -> DataFrame:
    """Position of every event in its stock-day; ties go order, trade, snapshot, then seq."""
    return ordered_scan(
        rows, STOCK_DAY, event_order(), pos="pos", size="events", part_rows=part_rows
    )


def snapshot_mid(bid: Column, ask: Column) -> Column:
    """Mid of the best level, the existing side alone, or null."""
    both = (bid > 0) & (ask > 0)
    mid = F.when(both, (bid + ask) / 2.0).otherwise(F.greatest(bid, ask).cast("double"))
    return F.when(mid > 0, mid)


def opening_reference(rows: DataFrame, prev_close: DataFrame) -> DataFrame:
    """(day, ticker, _opening): what holds before the first snapshot, one row per stock-day."""
    largest = rows.groupBy(*STOCK_DAY).agg(F.max("mid").alias("_largest"))
    known = prev_close.where(is_positive("prev_close")).select(*STOCK_DAY, "prev_close")
    return largest.join(known, list(STOCK_DAY), "left").select(
        *STOCK_DAY, F.coalesce("prev_close", "_largest", F.lit(1.0)).alias("_opening")
    )


def place_events(
    rows: DataFrame, prev_close: DataFrame, part_rows: int | None = None
) -> DataFrame:
    """Events with position, time of the event before, and reference price ``ref``.

    The reference is the last valid snapshot mid, the event's own included; before the first one the
    previous close; without that the largest mid of the stock-day; else 1. ``rows`` carries ``mid``
    (null unless a valid snapshot), ``prev_close`` is in cents. The rows, with their levels, are
    shuffled once; what the scan needs besides has one row per stock-day.
    """
    placed = ordered_scan(
        rows,
        STOCK_DAY,
        event_order(),
        pos="pos",
        lag={"prev_time_ms": "time_ms"},
        carry={"_held": "mid"},
        part_rows=part_rows,
    )
    opening = sized(opening_reference(rows, prev_close), "opening")
    return (
        placed.join(opening, list(STOCK_DAY))
        .withColumn("ref", F.coalesce("_held", "_opening"))
        .drop("_held", "_opening")
    )


HEAD = (
    "dt_log", "price_bps", "volume_log", "side", "cancel", "age_log", "sell_age_log",
    "orig_volume_log", "notional_log", "spread_bps", "imbalance", "micro_bias",
)
LEVEL_KINDS = ("bid_bps", "ask_bps", "bid_volume", "ask_volume", "bid_count", "ask_count")
TAIL = (
    "total_bid_log", "total_ask_log", "wbid_bps", "wask_bps", "deals_log",
    "phase_sin", "phase_cos", "auction",
)


def level_names() -> list[str]:
    return [f"{kind}_{level}" for kind in LEVEL_KINDS for level in range(1, LEVELS + 1)]


def feature_names() -> list[str]:
    """The 80 feature names in their fixed order."""
    return [*HEAD, *level_names(), *TAIL]


def featurize(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Features of merged events that carry ``ref`` and ``prev_time_ms``.

    Event-wide features are columns of their own; the ten book levels of the six level
    features are one array, ``levels``, zero outside snapshots.
    """
    c = F.col
    ref = c("ref")

    def by_stream(**values: Column) -> Column:
        out = F.lit(0.0)
        for stream, value in values.items():
            out = F.when(c("stream") == stream, value).otherwise(out)
        return F.coalesce(out, F.lit(0.0))

    def seconds(name: str) -> Column:
        return log1p_clamped(F.greatest(c(name), F.lit(0)) / 1000.0)

    dt = c("time_ms") - F.coalesce(c("prev_time_ms"), c("time_ms"))
    best = top_of_book(
        c("bid_px")[0].cast("double"),
        c("ask_px")[0].cast("double"),
        c("bid_vol")[0].cast("double"),
        c("ask_vol")[0].cast("double"),
        ref,
    )
    bid = level_features(c("bid_px"), c("bid_vol"), c("bid_cnt"), ref)
    ask = level_features(c("ask_px"), c("ask_vol"), c("ask_cnt"), ref)
    sin, cos, auction = day_phase(c("time_ms"))
    values: dict[str, Column] = {
        "dt_log": log1p_clamped(dt / 1000.0),
        "price_bps": by_stream(
            order=bps_distance(c("price"), ref),
            trade=bps_distance(c("price"), ref),
            snap=bps_distance(c("last"), ref),
        ),
        "volume_log": by_stream(
            order=log1p_clamped(c("volume")),
            trade=log1p_clamped(c("volume")),
            snap=signed_log1p(c("d_volume")),
        ),
        "side": by_stream(
            order=order_side(c("order_type")),
            trade=F.when(c("bsflag") == 1, 1.0).otherwise(-1.0),
        ),
        "cancel": by_stream(order=is_cancel(c("order_type")).cast("double")),
        "age_log": by_stream(order=seconds("cancel_age_ms"), trade=seconds("buy_age_ms")),
        "sell_age_log": by_stream(trade=seconds("sell_age_ms")),
        "orig_volume_log": by_stream(order=log1p_clamped(c("cancel_orig_vol"))),
        "notional_log": by_stream(
            trade=log1p_clamped(c("price") * c("volume")),
            snap=log1p_clamped(F.abs(c("d_turnover"))),
        ),
        "spread_bps": by_stream(snap=best["spread_bps"]),
        "imbalance": by_stream(snap=best["imbalance"]),
        "micro_bias": by_stream(snap=best["micro_bias"]),
    }
    by_level = F.concat(
        bid["price_bps"],
        ask["price_bps"],
        bid["volume_log"],
        ask["volume_log"],
        bid["count_log"],
        ask["count_log"],
    )
    nothing = F.array_repeat(F.lit(0.0), LEVELS * len(LEVEL_KINDS))
    values |= {
        "total_bid_log": by_stream(snap=log1p_clamped(c("total_bidvol"))),
        "total_ask_log": by_stream(snap=log1p_clamped(c("total_askvol"))),
        "wbid_bps": by_stream(snap=bps_distance(c("wbid"), ref)),
        "wask_bps": by_stream(snap=bps_distance(c("wask"), ref)),
        "deals_log": by_stream(snap=log1p_clamped(c("d_dealnum"))),
        "phase_sin": sin,
        "phase_cos": cos,
        "auction": auction,
    }
    return rows.select(
        *STOCK_DAY,
        "pos",
        "stream",
        order_type_code().alias("order_type_id"),
        *keep,
        *[value.alias(name) for name, value in values.items()],
        F.when(c("stream") == "snap", by_level).otherwise(nothing).alias("levels"),
    )


def feature_array() -> Column:
    """The 80 features in their fixed order as one array, the shape of the sink."""
    return F.concat(F.array(*HEAD), F.col("levels"), F.array(*TAIL))


def spread_levels(features: DataFrame) -> DataFrame:
    """The level array as named columns."""
    named = {name: F.get("levels", F.lit(i)) for i, name in enumerate(level_names())}
    return features.withColumns(named).drop("levels")


def order_type_code() -> Column:
    return F.when(F.col("stream") == "order", order_type_id(F.col("order_type"))).otherwise(0)


def stream_id(stream: Column) -> Column:
    pairs = [F.lit(x) for pair in STREAM_IDS.items() for x in pair]
    return F.create_map(*pairs)[stream]


def next_event_targets(features: DataFrame) -> DataFrame:
    """What the following event is: stream, order type, price, waiting time, volume.

    Every event but the first is the target of the place before its own, so no row has to look at
    another one. The last event of a stock-day is only a target.
    """
    return features.where(F.col("pos") > 1).select(
        *STOCK_DAY,
        (F.col("pos") - 1).alias("pos"),
        stream_id(F.col("stream")).alias("next_stream"),
        F.col("order_type_id").alias("next_order_type"),
        F.col("price_bps").alias("next_price_bps"),
        F.col("dt_log").alias("next_dt_log"),
        F.col("volume_log").alias("next_volume_log"),
    )


def closing_window(rows: DataFrame, events: int) -> DataFrame:
    """Last ``events`` + 1 events of each stock-day; the very last is only a target."""
    backwards = [F.desc("time_ms"), F.desc(stream_rank(F.col("stream"))), F.desc("seq")]
    return first_rows(rows, STOCK_DAY, backwards, events + 1, "from_end").withColumn(
        "is_target_only", F.col("from_end") == 1
    )


def labelled_stock_days(
    rows: DataFrame, labels: DataFrame, min_events: int
) -> DataFrame:
    """Stock-days with enough events, with their label where one exists."""
    counts = rows.groupBy(*STOCK_DAY).agg(F.count(F.lit(1)).alias("events"))
    return counts.where(F.col("events") >= min_events).join(
        labels.select(*STOCK_DAY, "label"), list(STOCK_DAY), "left"
    )


def label_coverage(stock_days: DataFrame) -> DataFrame:
    return stock_days.agg(
        F.count(F.lit(1)).alias("stock_days"),
        F.count("label").alias("labelled"),
        F.try_divide(F.count("label"), F.count(F.lit(1))).alias("coverage"),
    )


def seeded_number(seed: int, parts: Sequence[Column]) -> Column:
    """Non-negative 48-bit number fixed by the seed and the key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def weighted_picks(counts: DataFrame, picks: int, seed: int, weight: str = "events") -> DataFrame:
    """``picks`` draws with replacement per day, tickers weighted by their event count.

    Draws and ticker starts are put in one order along the cumulative weight; each draw
    takes the ticker that started last, so no draw meets every ticker of its day.
    """
    starts = prefix_sum(counts, ["day"], [F.col("ticker")], weight).select(
        "day",
        (F.col("upto") - F.col(weight)).alias("_at"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("int").alias("pick"),
        "ticker",
    )
    totals = counts.groupBy("day").agg(F.sum(weight).alias("_total"))
    draws = totals.select(
        "day", "_total", F.explode(F.sequence(F.lit(1), F.lit(picks))).alias("pick")
    ).select(
        "day",
        F.pmod(seeded_number(seed, [F.col("day"), F.col("pick")]), F.col("_total")).alias("_at"),
        F.lit(1).alias("_kind"),
        "pick",
        F.lit(None).cast("string").alias("ticker"),
    )
    line = ordinal(
        starts.unionByName(draws),
        ["day"],
        [F.col("_at"), F.col("_kind"), F.col("pick")],
        pos="_pos",
    )
    held = neighbours(line, ["day"], "_pos", carry={"_ticker": "ticker"})
    return held.where("_kind = 1").select("day", "pick", F.col("_ticker").alias("ticker"))


def seeded_subset(counts: DataFrame, tickers: int, seed: int) -> DataFrame:
    """Fixed choice of at most ``tickers`` stock-days per day."""
    by_number = [seeded_number(seed, [F.col("day"), F.col("ticker")]), F.col("ticker")]
    return first_rows(counts, ["day"], by_number, tickers, "_place").drop("_place")


def window_starts(stock_days: DataFrame, length: int, seed: int, closing: bool = False) -> DataFrame:
    """Zero-based start of a window of ``length`` + 1 events, clamped to what exists."""
    need = length + 1
    slack = F.col("events") - need
    drawn = F.pmod(seeded_number(seed, [F.col("day"), F.col("ticker")]), slack + 1)
    start = F.when(slack < 0, 0).when(F.lit(closing), slack).otherwise(drawn)
    return stock_days.withColumns(
        {"start": start, "stop": F.least(start + need, F.col("events"))}
    )


def window_events(merged: DataFrame, starts: DataFrame) -> DataFrame:
    """Events of the chosen windows."""
    bounds = sized(starts.select(*STOCK_DAY, "start", "stop"), "starts")
    return merged.join(bounds, list(STOCK_DAY)).where(
        (F.col("pos") - 1 >= F.col("start")) & (F.col("pos") - 1 < F.col("stop"))
    )


def month_inventory(rows: DataFrame, size: str = "bytes") -> DataFrame:
    """Per month: days in both streams, order-only, trade-only, snapshots, sizes, events."""
    has = lambda s: F.max((F.col("stream") == s).cast("int"))
    days = (
        rows.withColumn("month", F.date_format("day", "yyyy-MM"))
        .groupBy("month", "day")
        .agg(
            has("order").alias("o"),
            has("trade").alias("t"),
            has("snap").alias("s"),
            F.count(F.when(F.col("stream") == "order", 1)).alias("orders"),
            F.count(F.when(F.col("stream") == "trade", 1)).alias("trades"),
            F.count(F.when(F.col("stream") == "snap", 1)).alias("snaps"),
            F.sum(size).alias("bytes"),
        )
    )
    count = lambda cond: F.count(F.when(cond, 1))
    o, t = F.col("o") == 1, F.col("t") == 1
    counted = days.groupBy("month").agg(
        count(o & t).alias("common_days"),
        count(o & ~t).alias("order_only_days"),
        count(~o & t).alias("trade_only_days"),
        F.max("s").alias("_snap"),
        F.sum("orders").alias("orders"),
        F.sum("trades").alias("trades"),
        F.sum("snaps").alias("snaps"),
        F.sum("bytes").alias("bytes"),
    )
    complete = (
        (F.col("common_days") > 0)
        & (F.col("order_only_days") == 0)
        & (F.col("trade_only_days") == 0)
        & (F.col("_snap") == 1)
    )
    status = F.when(complete, "complete").otherwise("incomplete")
    return counted.withColumn("status", status).drop("_snap")


def daily_universe(samples: DataFrame) -> DataFrame:
    """Distinct (day, ticker) rows of the samples."""
    return samples.select(*STOCK_DAY).distinct()


def universe_sizes(universe: DataFrame) -> DataFrame:
    """One row: days, smallest, median and largest daily universe, union size."""
    per_day = universe.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_day.agg(
        F.count(F.lit(1)).alias("days"),
        F.min("n").alias("smallest"),
        F.percentile("n", 0.5).alias("median"),
        F.max("n").alias("largest"),
    )
    union = universe.agg(F.count_distinct("ticker").alias("union_size"))
    return sizes.withColumn("union_size", union.scalar())


def identity_rows(
    rows: DataFrame, partition: str, order: Sequence[str]
) -> DataFrame:
    """Zero-based row index per partition in the given unique order."""
    placed = ordinal(rows, [partition], [F.col(c) for c in order], pos="_pos")
    return placed.withColumn("row_index", F.col("_pos") - 1).drop("_pos")


def identity_mismatches(
    identity: DataFrame, materialized: DataFrame, value: str, tolerance: Mapping[str, float]
) -> DataFrame:
    """Materialized rows whose day or value disagrees with the identity row."""
    on = ["partition", "row_index"]
    mine = identity.select(*on, F.col("day").alias("_day"), F.col(value).alias("_value"))
    theirs = materialized.select(*on, "day", value)
    gap = F.abs(F.col(value) - F.col("_value"))
    close = gap <= tolerance["relative"] * F.greatest(
        F.abs(F.col(value)), F.abs(F.col("_value"))
    ) + tolerance["absolute"]
    status = (
        F.when(F.col("_day").isNull() | F.col("day").isNull(), "row missing")
        .when(F.col("day") != F.col("_day"), "day differs")
        .when(~close, "value differs")
    )
    joined = theirs.join(mine, on, "full_outer").withColumn("status", status)
    return joined.where(F.col("status").isNotNull()).select(*on, "status")
