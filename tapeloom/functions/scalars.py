"""Column expressions: predicates, parsing, unit conversion, book and array helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.stats import is_finite, is_positive
from tapeloom.plans.shared import settle

# Fixed values.
STOCK_CODE_PATTERN = r"^(?:000|001|002|003|300|301|600|601|603|605|688|689)\d{3}$"
SESSION_START_MS = -300_000
MARKET_END_MS = 19_620_000
AGE_UNKNOWN_MS = -1
CANCEL_ORDER_TYPES = (-1, -11)
ORDER_TYPE_IDS = {0: 1, 10: 2, 1: 3, 2: 4, 3: 5, 11: 6, 12: 7, 13: 8, -1: 9, -11: 10}
TICK_TOLERANCE = 0.0051
DOWN, NEUTRAL, UP = 0, 1, 2


def in_session(
    time_ms: Column, start_ms: int = SESSION_START_MS, end_ms: int = MARKET_END_MS
) -> Column:
    return (time_ms >= start_ms) & (time_ms < end_ms)


def is_stock_code(symbol: Column, pattern: str = STOCK_CODE_PATTERN) -> Column:
    return symbol.rlike(pattern)


def price_limit_ratio(symbol: Column, day: Column, is_st: Column) -> Column:
    """Daily price limit by board; the 300/301 board widened on 2020-08-24."""
    wide = F.lit("0.20").cast("decimal(4,2)")
    growth = symbol.startswith("300") | symbol.startswith("301")
    return (
        F.when(is_st, F.lit("0.05").cast("decimal(4,2)"))
        .when(symbol.startswith("4") | symbol.startswith("8"), F.lit("0.30").cast("decimal(4,2)"))
        .when(symbol.startswith("688") | symbol.startswith("689"), wide)
        .when(growth & (day >= F.lit("2020-08-24").cast("date")), wide)
        .otherwise(F.lit("0.10").cast("decimal(4,2)"))
    )


def all_finite(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for name in columns:
        out = out & is_finite(name)
    return out


def valid_book(prices: Sequence[str], volumes: Sequence[str]) -> Column:
    """All entries finite, prices above zero, volumes not below zero."""
    out = F.lit(True)
    for name in prices:
        out = out & is_positive(name)
    for name in volumes:
        out = out & is_finite(name) & (F.col(name) >= 0)
    return out


def valid_book_arrays(prices: Column, volumes: Column) -> Column:
    """Array form of :func:`valid_book`."""
    return F.forall(prices, lambda x: is_positive(x)) & F.forall(
        volumes, lambda x: is_finite(x) & (x >= 0)
    )


def pad_symbol(value: Column, width: int = 6) -> Column:
    """Left-pad with zeros, never truncating a longer code."""
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def strip_suffix(code: Column) -> Column:
    return F.split(code, r"\.").getItem(0)


def parse_day(value: Column) -> Column:
    """Date from yyyymmdd (number or text) or ISO text; null where neither fits."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")).otherwise(
        F.try_to_date(text, "yyyy-MM-dd")
    )


def day_number(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def shift_month(day: Column, offset: Column | int) -> Column:
    return F.add_months(F.trunc(day, "month"), offset)


def month_end(day: Column) -> Column:
    return F.last_day(day)


def session_timestamp(day: Column, time_ms: Column) -> Column:
    """Naive timestamp of a millisecond offset from 09:30 (negative in the auction)."""
    opening = F.to_timestamp_ntz(
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 09:30:00"))
    )
    seconds = (time_ms.cast("decimal(18,3)") / 1000).cast("decimal(18,6)")
    return opening + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def to_cents(price: Column) -> Column:
    """Currency units to integer cents with half-even rounding; null becomes 0."""
    return F.coalesce(F.bround(price * 100.0, 0).cast("long"), F.lit(0).cast("long"))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def clip_uint16(value: Column) -> Column:
    return F.least(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)), F.lit(65535)).cast("int")


def log1p_clamped(value: Column) -> Column:
    return F.log1p(F.greatest(value.cast("double"), F.lit(0.0)))


def signed_log1p(value: Column) -> Column:
    return F.signum(value.cast("double")) * F.log1p(F.abs(value.cast("double")))


def bps_distance(price: Column, reference: Column, scale: float = 100.0) -> Column:
    """Basis-point distance divided by ``scale``, clipped to ±50; undefined becomes 0."""
    raw = (F.try_divide(price.cast("double"), reference) - 1.0) * 1e4 / scale
    return clip(F.coalesce(F.nanvl(raw, F.lit(0.0)), F.lit(0.0)), -50.0, 50.0)


def day_phase(time_ms: Column, session_ms: int = MARKET_END_MS) -> tuple[Column, Column, Column]:
    """Sine and cosine of the session phase, and the auction flag."""
    angle = F.lit(2.0) * F.pi() * (time_ms / 1000.0) / (session_ms / 1000.0)
    return F.sin(angle), F.cos(angle), F.when(time_ms < 0, 1.0).otherwise(0.0)


def is_cancel(order_type: Column) -> Column:
    return order_type.isin(*CANCEL_ORDER_TYPES)


def order_side(order_type: Column) -> Column:
    """+1 buy, -1 sell, from the raw order type."""
    return (
        F.when(order_type == -1, 1.0)
        .when(order_type == -11, -1.0)
        .when(order_type >= 10, -1.0)
        .otherwise(1.0)
    )


def map_codes(value: Column, codes: Mapping[int, int], default: int = 0) -> Column:
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[value.cast("int")], F.lit(default))


def order_type_id(order_type: Column) -> Column:
    return map_codes(order_type, ORDER_TYPE_IDS)


def top_of_book(
    bid: Column, ask: Column, bid_volume: Column, ask_volume: Column, reference: Column
) -> dict[str, Column]:
    """Spread, imbalance and micro-price bias of the best level."""
    both = (bid > 0) & (ask > 0)
    depth = bid_volume + ask_volume
    floor = F.greatest(depth, F.lit(1.0))
    micro = F.when(depth > 0, (ask * bid_volume + bid * ask_volume) / floor).otherwise(0.0)
    return {
        "spread_bps": F.when(both, F.try_divide(ask - bid, reference) * 100.0).otherwise(0.0),
        "imbalance": F.when(depth > 0, (bid_volume - ask_volume) / floor).otherwise(0.0),
        "micro_bias": F.when(
            both, (F.try_divide(micro, reference) - 1.0) * 100.0
        ).otherwise(0.0),
    }


def level_features(
    prices: Column, volumes: Column, counts: Column, reference: Column
) -> dict[str, Column]:
    """Per-level price distance, log volume and log count over level arrays."""
    return {
        "price_bps": F.transform(prices, lambda x: bps_distance(x, reference)),
        "volume_log": F.transform(volumes, log1p_clamped),
        "count_log": F.transform(counts, log1p_clamped),
    }


def limit_price(previous_close: Column, ratio: Column, upper: bool) -> Column:
    """Limit price rounded half-up to the cent in decimal arithmetic."""
    base = previous_close.cast("decimal(22,10)")
    one = F.lit(1).cast("decimal(4,2)")
    multiplier = one + ratio if upper else one - ratio
    return F.round(base * multiplier, 2).cast("double")


def open_execution_state(
    symbol: Column,
    day: Column,
    open_: Column,
    high: Column,
    low: Column,
    volume: Column,
    previous_close: Column,
    is_st: Column,
) -> Column:
    """Struct (status, can_buy, can_sell, mark_price); null without a previous close."""

    def same_tick(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= TICK_TOLERANCE

    valid = is_positive(open_) & is_positive(high) & is_positive(low) & is_positive(volume)
    one_price = same_tick(open_, high) & same_tick(open_, low)
    ratio = price_limit_ratio(symbol, day, is_st)
    at_upper = one_price & same_tick(open_, limit_price(previous_close, ratio, True))
    at_lower = one_price & same_tick(open_, limit_price(previous_close, ratio, False))
    status = (
        F.when(~valid, "suspended")
        .when(at_upper, "one_price_limit_up")
        .when(at_lower, "one_price_limit_down")
        .otherwise("normal")
    )
    state = F.struct(
        status.alias("status"),
        status.isin("normal", "one_price_limit_down").alias("can_buy"),
        status.isin("normal", "one_price_limit_up").alias("can_sell"),
        F.when(valid, open_).otherwise(previous_close).alias("mark_price"),
    )
    return F.when(is_positive(previous_close), state)


def fixed_label(value: Column, threshold: float) -> Column:
    return (
        F.when(value > threshold, UP).when(value < -threshold, DOWN).otherwise(NEUTRAL)
    )


def direction_score(probabilities: Column) -> Column:
    """P(up) - P(down) of a three-class probability array."""
    return probabilities.getItem(2) - probabilities.getItem(0)


def predicted_class(probabilities: Column) -> Column:
    """First position of the maximum, zero-based."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def impact_rate(
    weight: Column,
    adv: Column,
    portfolio_value: float = 100_000_000.0,
    coefficient_bps: float = 10.0,
    max_impact_bps: float = 50.0,
) -> Column:
    """Square-root impact as a rate; unknown liquidity costs the maximum."""
    participation = F.greatest(F.try_divide(weight * portfolio_value, adv), F.lit(0.0))
    known = F.least(F.lit(max_impact_bps), coefficient_bps * F.sqrt(participation))
    return F.when(is_positive(adv), known / 10_000.0).otherwise(max_impact_bps / 10_000.0)


def to_bool(value: Column) -> Column:
    """Boolean from boolean, 0/1 or true/false/yes/no text; null where it does not fit."""
    text = F.lower(F.trim(value.cast("string")))
    return (
        F.when(text.isin("true", "1", "yes"), True)
        .when(text.isin("false", "0", "no"), False)
        .otherwise(F.lit(None).cast("boolean"))
    )


def modality_columns(names: Sequence[str], modality: str) -> list[str]:
    """Feature columns of one modality; the validity flag is not a feature."""
    prefix = f"{modality}__"
    return [n for n in names if n.startswith(prefix) and n != f"{prefix}valid"]


def pack_events(events: Column, chunks: int, chunk_size: int) -> Column:
    """Last chunks*chunk_size elements, left-padded with the first kept one, in chunks."""
    total = chunks * chunk_size
    kept = F.when(
        F.size(events) > total, F.slice(events, F.lit(-total), F.lit(total))
    ).otherwise(events)
    missing = F.greatest(F.lit(total) - F.size(events), F.lit(0))
    filled = F.concat(F.array_repeat(F.element_at(kept, 1), missing), kept)
    return F.transform(
        F.sequence(F.lit(0), F.lit(chunks - 1)),
        lambda i: F.slice(filled, i * chunk_size + 1, F.lit(chunk_size)),
    )


def last_chunks(chunks: Column, k: int) -> Column:
    return F.when(F.size(chunks) > k, F.slice(chunks, F.lit(-k), F.lit(k))).otherwise(chunks)


def pad_to_window(rows: Column, window: int, filler: Column) -> Column:
    """Append ``filler`` at the end until the array has ``window`` elements."""
    missing = F.greatest(F.lit(window) - F.size(rows), F.lit(0))
    return F.concat(rows, F.array_repeat(filler, missing))


def flatten_numeric(df: DataFrame, keys: Sequence[str], json_column: str) -> DataFrame:
    """Dotted paths and finite numeric leaves of a JSON text column.

    Levels are opened one by one until nothing is nested any more, each from the written containers
    of the one before; objects contribute their keys and arrays their positions. Booleans and text
    are not numbers.
    """
    level = df.select(
        *keys, F.lit(None).cast("string").alias("path"), F.try_parse_json(json_column).alias("v")
    )
    leaves = None
    while True:
        children = df.sparkSession.tvf.variant_explode(F.col("v").outer())
        opened = level.lateralJoin(children).select(
            *keys,
            F.concat_ws(".", "path", F.coalesce("key", F.col("pos").cast("string"))).alias("path"),
            F.col("value").alias("v"),
        )
        kind = F.schema_of_variant("v")
        numeric = kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
        found = opened.where(numeric).select(
            *keys, "path", F.try_variant_get("v", "$", "double").alias("number")
        )
        leaves = found if leaves is None else leaves.unionByName(found)
        level = settle(
            opened.where(kind.startswith("OBJECT") | kind.startswith("ARRAY")), "containers"
        )
        if level.isEmpty():
            return leaves.where(is_finite("number"))
