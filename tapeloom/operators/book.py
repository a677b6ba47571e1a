"""Book snapshots: closing tails, normalization, sequence summaries, sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalars import clip, valid_book
from tapeloom.plans.ordering import DEFAULT_CHUNK_ROWS, first_rows, ordinal

STOCK_DAY = ("trading_date", "symbol")

# Folds of the two published protocols.
SETUP2_TRAIN_FOLDS = (7,)
SETUP2_TEST_FOLDS = (7, 8, 9)


def target_window(rows: DataFrame, targets: DataFrame, start_ms: int, signal_ms: int) -> DataFrame:
    """Rows of the wanted stock-days inside the half-open time window."""
    timed = rows.where((F.col("time_ms") >= start_ms) & (F.col("time_ms") < signal_ms))
    wanted = targets.select(*STOCK_DAY).distinct()
    return timed.join(wanted, list(STOCK_DAY), "left_semi")


def tail_events(
    rows: DataFrame,
    events: int,
    prices: Sequence[str] = (),
    volumes: Sequence[str] = (),
    seq: str = "seq",
) -> DataFrame:
    """Last ``events`` valid snapshots per stock-day, ``place`` 1 being the latest.

    A stock-day of any size brings at most ``events`` rows per input partition together.
    """
    backwards = [F.desc("time_ms"), F.desc(seq)]
    return first_rows(rows.where(valid_book(prices, volumes)), STOCK_DAY, backwards, events)


def normalize_tail(
    tail: DataFrame,
    prices: Sequence[str],
    volumes: Sequence[str],
    bid: str,
    ask: str,
    price_scale_bps: float = 100.0,
    volume_log_scale: float = 16.0,
    limit: float = 32.0,
) -> DataFrame:
    """Prices as scaled basis points from the tail's first mid, volumes as scaled logs.

    A tail is bounded by the number of events kept, so its window stays small.
    """
    forwards = Window.partitionBy(*STOCK_DAY).orderBy(F.desc("place"))
    mid = F.first((F.col(ask) + F.col(bid)) / 2.0).over(forwards)
    based = tail.withColumn("_mid", mid)
    scaled = {
        c: clip((F.col(c) / F.col("_mid") - 1.0) * 10_000.0 / price_scale_bps, -limit, limit)
        for c in prices
    }
    scaled |= {c: clip(F.log1p(F.col(c)) / volume_log_scale, -limit, limit) for c in volumes}
    return based.withColumns(scaled).drop("_mid")


def sequence_summary(
    rows: DataFrame, columns: Sequence[str], order: Column, keys: Sequence[str] = STOCK_DAY
) -> DataFrame:
    """Mean, population deviation, last and last-minus-first of each column per key."""
    return rows.groupBy(*keys).agg(*summary_aggregates(columns, order))


def summary_aggregates(columns: Sequence[str], order: Column) -> list[Column]:
    out: list[Column] = []
    for c in columns:
        last = F.max_by(c, order)
        out += [
            F.avg(c).alias(f"{c}__mean"),
            F.stddev_pop(c).alias(f"{c}__std"),
            last.alias(f"{c}__last"),
            (last - F.min_by(c, order)).alias(f"{c}__change"),
        ]
    return out


def extraction_report(
    targets: DataFrame, rows: DataFrame, tail: DataFrame, min_events: int, invalid: Column
) -> DataFrame:
    """One row: stock-days requested, written, missing and short, and invalid snapshots.

    ``rows`` are the snapshots of the targets inside the window, ``tail`` their valid tails.
    """
    counts = tail.groupBy(*STOCK_DAY).agg(F.count(F.lit(1)).alias("_events"))
    joined = targets.select(*STOCK_DAY).distinct().join(counts, list(STOCK_DAY), "left")
    n = F.col("_events")
    per_target = joined.agg(
        F.count(F.lit(1)).alias("requested"),
        F.count(F.when(n >= min_events, 1)).alias("written"),
        F.count(F.when(n.isNull(), 1)).alias("missing"),
        F.count(F.when(n < min_events, 1)).alias("insufficient"),
    )
    bad = rows.agg(F.count(F.when(invalid, 1)).alias("n"))
    return per_target.withColumn("invalid_rows", bad.scalar())


def leakage_violations(samples: DataFrame) -> DataFrame:
    """Samples whose input reaches past the signal or whose label does not follow it."""
    last, signal = F.col("last_event_timestamp"), F.col("signal_timestamp")
    day = F.col("trading_date")
    reason = (
        F.when(last > signal, "event after signal")
        .when(F.to_date(last) != day, "event on another day")
        .when(F.to_date(signal) != day, "signal on another day")
        .when(F.col("label_date") <= day, "label not after input")
    )
    return samples.withColumn("reason", reason).where(F.col("reason").isNotNull())


def select_segments(rows: DataFrame, protocol: str, split: str, test_fold: int | None = None) -> DataFrame:
    """Segments of one split under the published fold protocols."""
    role = "test" if split == "test" else "train"
    if protocol == "setup1":
        folds = (test_fold,)
    else:
        folds = SETUP2_TRAIN_FOLDS if role == "train" else SETUP2_TEST_FOLDS
    return rows.where((F.col("role") == role) & F.col("fold").isin(*folds))


def normalise_label(raw: Column) -> Column:
    """Labels 1..3 to 0..2; anything else is null and meant for a constraint check."""
    return F.when(raw.isin(1.0, 2.0, 3.0), (raw - 1).cast("int"))


def sliding_windows(
    rows: DataFrame,
    segment: Sequence[str],
    order: Sequence[Column],
    value: Column,
    label: Column,
    window: int,
    validation_share: float | None = None,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Count-based windows of a segment with the label of their last row.

    With ``validation_share`` the last windows are validation and the ``window`` - 1
    windows before them, which share rows with them, are left out. Long segments are cut
    into chunks whose first ``window`` - 1 rows are repeated from the chunk before.
    """
    if chunk_rows < window:
        raise ValueError("a chunk must hold at least one window")
    placed = ordinal(
        rows.select(*segment, value.alias("_value"), label.alias("label"), *order_columns(order)),
        segment,
        [F.col(f"_o{i}") for i in range(len(order))],
        pos="_pos",
        size="_n",
    )
    own = F.floor((F.col("_pos") - 1) / chunk_rows)
    into_next = F.pmod(F.col("_pos") - 1, F.lit(chunk_rows)) >= chunk_rows - (window - 1)
    chunked = placed.withColumn(
        "_chunk", F.explode(F.when(into_next, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    frame = (
        Window.partitionBy(*segment, "_chunk").orderBy("_pos").rowsBetween(-(window - 1), 0)
    )
    windows = (
        chunked.withColumn("values", F.collect_list("_value").over(frame))
        .where((F.size("values") == window) & (F.col("_chunk") == own))
        .withColumn("window_index", F.col("_pos") - window)
    )
    role = F.lit("train")
    if validation_share is not None:
        total = F.col("_n") - window + 1
        held = F.greatest(F.lit(1), F.floor(total * validation_share))
        start = total - held
        role = (
            F.when(F.col("window_index") >= start, "val")
            .when(F.col("window_index") < start - (window - 1), "train")
            .otherwise("gap")
        )
    return (
        windows.withColumn("role", role)
        .where(F.col("role") != "gap")
        .select(*segment, "window_index", "role", "values", "label")
    )


def order_columns(order: Sequence[Column]) -> list[Column]:
    return [c.alias(f"_o{i}") for i, c in enumerate(order)]
