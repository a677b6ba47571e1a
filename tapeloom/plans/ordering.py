"""Exact positions, prefix sums, quantiles and neighbours inside groups of any size.

``Window.partitionBy(group)`` sends a whole group to one task, which does not hold
when one date or one stock-day owns a third of all rows. The functions here use a
range sort instead: Spark samples the composite key, so a hot group is spread over
as many partitions as its share of the rows deserves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.plans.shared import settle, sized

DEFAULT_CHUNK_ROWS = 1_000_000


def _sorted_slots(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    keys = [F.col(name).asc() for name in group]
    rows = settle(
        df.orderBy(*keys, *order).withColumn("_slot", F.monotonically_increasing_id()),
        "sorted",
    )
    # The upper bits of the id are the partition, the lower 33 the row inside it.
    return rows.withColumn("_part", F.shiftright("_slot", 33))


def _attach(
    rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on keys where null equals null, so that no row gets lost."""
    named = side.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(named, condition, how).drop(*[f"_key_{k}" for k in keys])


def ordinal(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    pos: str = "pos",
    size: str | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group, and optionally the group size.

    ``order`` must end in a unique key where the position of ties matters.
    """
    rows = _sorted_slots(df, group, order)
    runs = rows.groupBy(*group, "_part").agg(
        F.min("_slot").alias("_head"), F.count(F.lit(1)).alias("_rows")
    )
    # One row per (group, partition): at most groups + partitions rows.
    over_group = Window.partitionBy(*group)
    before = F.sum("_rows").over(
        over_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    picked = [
        *group,
        "_part",
        (F.coalesce(before, F.lit(0)) + 1 - F.col("_head")).alias("_shift"),
    ]
    if size is not None:
        picked.append(F.sum("_rows").over(over_group).alias(size))
    runs = sized(runs.select(*picked), "runs")
    return (
        _attach(rows, runs, [*group, "_part"])
        .withColumn(pos, F.col("_slot") + F.col("_shift"))
        .drop("_slot", "_part", "_shift")
    )


#: Spark applies a rank limit up to this one before the shuffle by itself.
LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"


def first_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    limit: int,
    place: str = "place",
) -> DataFrame:
    """First ``limit`` rows of each group with their place from 1.

    Whatever the limit, at most ``limit`` rows of a group per input partition meet in one
    task: above the limit that Spark handles itself, each input partition's share of a group
    is ranked and cut first. ``order`` should end in a unique key.
    """
    rows = df
    if limit > int(df.sparkSession.conf.get(LIMIT_SETTING, "1000")):
        share = Window.partitionBy(*group, "_share").orderBy(*order)
        rows = (
            df.withColumn("_share", F.spark_partition_id())
            .withColumn("_in_share", F.row_number().over(share))
            .where(F.col("_in_share") <= limit)
            .drop("_share", "_in_share")
        )
    whole = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(place, F.row_number().over(whole)).where(F.col(place) <= limit)


def prefix_sum(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    weight: str,
    upto: str = "upto",
    total: str = "total",
) -> DataFrame:
    """Add the inclusive running sum of ``weight`` in group order, and the group total."""
    rows = _sorted_slots(df, group, order)
    runs = rows.groupBy(*group, "_part").agg(F.sum(weight).alias("_sum"))
    over_group = Window.partitionBy(*group)
    before = F.sum("_sum").over(
        over_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = sized(
        runs.select(
            *group,
            "_part",
            F.coalesce(before, F.lit(0)).alias("_before"),
            F.sum("_sum").over(over_group).alias(total),
        ),
        "runs",
    )
    inside = Window.partitionBy(*group, "_part").orderBy("_slot").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        _attach(rows.withColumn("_inside", F.sum(weight).over(inside)), runs, [*group, "_part"])
        .withColumn(upto, F.col("_inside") + F.col("_before"))
        .drop("_slot", "_part", "_inside", "_before")
    )


def prefix_xor(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], sources: Mapping[str, str]
) -> DataFrame:
    """Running exclusive or of long columns in group order; ``sources`` maps output to source."""
    rows = _sorted_slots(df, group, order)
    runs = rows.groupBy(*group, "_part").agg(
        *[F.bit_xor(src).alias(f"_run_{out}") for out, src in sources.items()]
    )
    earlier = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("long")
    runs = sized(
        runs.select(
            *group,
            "_part",
            *[
                F.coalesce(F.bit_xor(f"_run_{out}").over(earlier), zero).alias(f"_before_{out}")
                for out in sources
            ],
        ),
        "runs",
    )
    inside = (
        Window.partitionBy(*group, "_part")
        .orderBy("_slot")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _attach(
            rows.withColumns(
                {f"_in_{out}": F.bit_xor(src).over(inside) for out, src in sources.items()}
            ),
            runs,
            [*group, "_part"],
        )
        .withColumns(
            {out: F.col(f"_in_{out}").bitwiseXOR(F.col(f"_before_{out}")) for out in sources}
        )
        .drop("_slot", "_part", *[f"{p}_{out}" for out in sources for p in ("_in", "_before")])
    )


def quantiles_at(
    rows: DataFrame,
    group: Sequence[str],
    value: str,
    cuts: Mapping[str, float],
    pos: str = "pos",
    size: str = "_n",
) -> DataFrame:
    """Linear-interpolated quantiles read off rows that already carry positions."""
    aggregates = []
    wanted = F.lit(False)
    for name, q in cuts.items():
        spot = (F.col(size) - 1) * F.lit(float(q))
        low = F.col(pos) - 1 == F.floor(spot)
        high = F.col(pos) - 1 == F.ceil(spot)
        wanted = wanted | low | high
        low_value = F.max(F.when(low, F.col(value)))
        high_value = F.max(F.when(high, F.col(value)))
        share = F.max(spot - F.floor(spot))
        aggregates.append((low_value + (high_value - low_value) * share).alias(name))
    return rows.where(wanted).groupBy(*group).agg(*aggregates)


#: Spark's percentile sketch errs by at most one rank in so many.
SKETCH_RANKS = 10_000


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, cuts: Mapping[str, float]
) -> DataFrame:
    """Exact linear quantiles per group, without sorting the rows. Null values do not count.

    A sketch with a proven rank error brackets each quantile between two values. A second scan counts
    what lies below the bracket and, by value, what lies inside; only these few values are ordered.
    """
    rows = df.select(*group, F.col(value).alias("_value")).where("_value IS NOT NULL")
    margin = 3.0 / SKETCH_RANKS
    named = list(cuts.items())
    ends = [
        end for _, q in named for end in (max(0.0, q - margin), min(1.0, q + margin))
    ]
    sketch = F.percentile_approx(
        "_value", F.array(*[F.lit(float(e)) for e in ends]), F.lit(SKETCH_RANKS)
    )
    sketched = sized(
        rows.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("_value").alias("_least"),
            F.max("_value").alias("_most"),
            sketch.alias("_ends"),
        ),
        "brackets",
    )
    # Ranks within the margin of an end are bracketed by the end itself; in a group of fewer rows
    # than the sketch has ranks, a margin is under a row, and the bracket is the group.
    few = F.col("_n") <= SKETCH_RANKS
    spots = []
    for i, (name, q) in enumerate(named):
        low = F.when(few | F.lit(q <= margin), F.col("_least")).otherwise(F.col("_ends")[2 * i])
        high = F.when(few | F.lit(q >= 1.0 - margin), F.col("_most")).otherwise(
            F.col("_ends")[2 * i + 1]
        )
        spots.append(F.struct(F.lit(name).alias("cut"), low.alias("low"), high.alias("high")))
    spread = _attach(rows, sketched.select(*group, F.array(*spots).alias("_spots")), group)
    near = F.transform(
        F.filter("_spots", lambda s: F.col("_value") <= s["high"]),
        lambda s: F.struct(
            s["cut"].alias("cut"), F.when(F.col("_value") >= s["low"], F.col("_value")).alias("v")
        ),
    )
    counted = settle(
        spread.select(*group, F.explode(near).alias("x"))
        .groupBy(*group, "x.cut", "x.v")
        .agg(F.count(F.lit(1)).alias("_rows")),
        "near",
    )
    # A bracket holds few different values; what lies below it is one row without a value.
    along = Window.partitionBy(*group, "cut").orderBy(F.col("v").asc_nulls_first())
    placed = _attach(
        counted.withColumn("_upto", F.sum("_rows").over(along)), sketched.select(*group, "_n"), group
    )
    below = F.col("_upto") - F.col("_rows")
    aggregates = []
    for name, q in named:
        spot = (F.col("_n") - 1) * F.lit(float(q))
        mine = (F.col("cut") == name) & F.col("v").isNotNull()
        holds = lambda at: mine & (below <= at) & (at < F.col("_upto"))  # noqa: E731, B023
        low_value = F.max(F.when(holds(F.floor(spot)), F.col("v")))
        high_value = F.max(F.when(holds(F.ceil(spot)), F.col("v")))
        share = F.max(spot - F.floor(spot))
        aggregates.append((low_value + (high_value - low_value) * share).alias(name))
    return placed.groupBy(*group).agg(*aggregates)


def neighbours(
    rows: DataFrame,
    group: Sequence[str],
    pos: str,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    carry: Mapping[str, str] | None = None,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Previous, next and last non-null values along positions 1..n of each group.

    ``lag``, ``lead`` and ``carry`` map an output column to its source column. Windows
    run inside chunks of ``chunk_rows`` positions; groups longer than one chunk get
    the values that cross a chunk edge from a table with one row per chunk.
    """
    lag, lead, carry = lag or {}, lead or {}, carry or {}
    place = F.col(pos)
    base = rows.withColumn("_chunk", F.floor((place - 1) / chunk_rows))
    keys = [*group, "_chunk"]

    summaries = [F.count(F.lit(1)).alias("_rows")]
    summaries += [F.max_by(src, place).alias(f"_tail_{out}") for out, src in lag.items()]
    summaries += [F.min_by(src, place).alias(f"_head_{out}") for out, src in lead.items()]
    summaries += [
        F.max_by(src, F.when(F.col(src).isNotNull(), place)).alias(f"_last_{out}")
        for out, src in carry.items()
    ]
    along = Window.partitionBy(*group).orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        base.groupBy(*keys)
        .agg(*summaries)
        .withColumn("_chunks", F.count(F.lit(1)).over(Window.partitionBy(*group)))
        .select(
            *keys,
            "_chunks",
            *[F.lag(f"_tail_{out}").over(along).alias(f"_prev_{out}") for out in lag],
            *[F.lead(f"_head_{out}").over(along).alias(f"_next_{out}") for out in lead],
            *[
                F.last(f"_last_{out}", ignorenulls=True).over(earlier).alias(f"_held_{out}")
                for out in carry
            ],
        )
        .where("_chunks > 1")
        .drop("_chunks")
    )

    inside = Window.partitionBy(*keys).orderBy(pos)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {f"_in_{name}": F.lag(src).over(inside) for name, src in lag.items()}
    columns |= {f"_in_{name}": F.lead(src).over(inside) for name, src in lead.items()}
    columns |= {
        f"_in_{name}": F.last(src, ignorenulls=True).over(so_far) for name, src in carry.items()
    }
    out = _attach(base.withColumns(columns), sized(edges, "edges"), keys, "left")
    first = (place - 1) % chunk_rows == 0
    last = place % chunk_rows == 0
    final = {n: F.when(first, F.col(f"_prev_{n}")).otherwise(F.col(f"_in_{n}")) for n in lag}
    final |= {n: F.when(last, F.col(f"_next_{n}")).otherwise(F.col(f"_in_{n}")) for n in lead}
    final |= {n: F.coalesce(f"_in_{n}", f"_held_{n}") for n in carry}
    out = out.withColumns(final)
    helpers = [c for c in out.columns if c.startswith(("_in_", "_prev_", "_next_", "_held_"))]
    return out.drop("_chunk", *helpers)
