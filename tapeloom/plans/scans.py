"""Ordered scans: places, lags, carried values and tie bounds in one shuffle of the rows.

A group of more than ``PART_ROWS`` rows is cut into parts at points taken from a bounded sample of
its order keys; all other groups are one part. Windows run inside (group, part), so the rows are
shuffled once, by that pair, and sorted there. What crosses the edges of parts comes from a table
with one row per part of a cut group. Where no group is cut, there are no edges to mend.

The order must end in a unique key, and every key sorts ascending with null first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.plans.shared import settle, sized

#: Rows of a group that one task sorts at most, up to MOST_PARTS parts.
PART_ROWS = 1_000_000
MOST_PARTS = 4096
#: Rows from which cutting points are chosen.
SAMPLE_ROWS = 1_000_000
#: A row looks for its part among so many points, then among those between two of them.
COARSE = 64


def same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    condition = F.lit(True)
    for a, b in zip(left, right, strict=True):
        condition = condition & F.col(a).eqNullSafe(F.col(b))
    return condition


def _beside(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys where null equals null."""
    named = [f"_side_{k}" for k in keys]
    renamed = side.withColumnsRenamed(dict(zip(keys, named, strict=True)))
    return rows.join(renamed, same_keys(keys, named), how).drop(*named)


def cutting_points(
    rows: DataFrame, group: Sequence[str], order: Column, part_rows: int
) -> DataFrame | None:
    """(group, cuts): for each group of over ``part_rows`` rows, arrays of ascending order keys."""
    large = settle(
        rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).where(f"_rows > {part_rows}"),
        "large",
    )
    total = large.agg(F.sum("_rows")).first()[0]
    if total is None:
        return None
    every = max(1, total // SAMPLE_ROWS)
    picked = rows.select(*group, order.alias("_key")).where(
        F.pmod(F.xxhash64("_key"), F.lit(every)) == 0
    )
    along = Window.partitionBy(*group).orderBy("_key")
    parts = F.least(F.ceil(F.col("_rows") / part_rows), F.lit(MOST_PARTS))
    step = F.greatest(F.floor(F.col("_sampled") / parts), F.lit(1))
    points = (
        _beside(picked, large, group, "inner")
        .withColumns(
            {
                "_place": F.row_number().over(along),
                "_sampled": F.count(F.lit(1)).over(Window.partitionBy(*group)),
            }
        )
        .where(F.col("_place") % step == 0)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_set("_key")).alias("_cuts"))
    )
    at = F.sequence(F.lit(1), F.size("_cuts"), F.lit(COARSE))
    fine = F.transform(at, lambda i: F.slice("_cuts", i, COARSE))
    return sized(
        points.select(*group, F.col("_cuts"), fine.alias("_fine")).select(
            *group,
            F.transform("_fine", lambda c: F.element_at(c, -1)).alias("_last"),
            "_fine",
        ),
        "cuts",
    )


def _part(key: Column) -> Column:
    """Number of cutting points before the key; 0 in a group without any."""
    whole = F.size(F.filter("_last", lambda c: c < key))
    inner = F.size(F.filter(F.get("_fine", whole), lambda c: c < key))
    # Behind the last point of all there is no further array.
    return F.coalesce(whole * COARSE + F.coalesce(F.when(inner >= 0, inner), F.lit(0)), F.lit(0))


def ordered_scan(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    pos: str = "pos",
    size: str | None = None,
    lag: Mapping[str, str] | None = None,
    carry: Mapping[str, str] | None = None,
    ties: tuple[str, str, str] | None = None,
    part_rows: int | None = None,
) -> DataFrame:
    """Add the place from 1, and optionally the group size, lags and last non-null values.

    ``lag`` and ``carry`` map an output column to its source. ``ties`` is (value, first, last): for
    rows with an equal ``value``, the first key of ``order``, the places of the first and the last;
    a null value ties with nothing.
    """
    lag, carry = lag or {}, carry or {}
    group = list(group)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    cuts = cutting_points(rows, group, key, part_rows or PART_ROWS)
    if cuts is None:
        named = [pos, *([size] if size else []), *lag, *carry, *(ties[1:] if ties else [])]
        scanned = _inside(rows, group, order, pos, size, lag, carry, ties)
        return scanned.select(*rows.columns, *named)
    parted = (
        _beside(rows, cuts, group, "left").withColumn("_part", _part(key)).drop("_last", "_fine")
    )
    keys = [*group, "_part"]
    edges = sized(_edges(parted, group, key, lag, carry, ties), "edges")
    scanned = _inside(
        parted,
        keys,
        order,
        "_pos",
        None,
        {f"_in_{n}": src for n, src in lag.items()},
        {f"_in_{n}": src for n, src in carry.items()},
        ties and (ties[0], "_first", "_last"),
    )
    joined = _beside(scanned, edges, keys, "inner")
    before = F.col("_before")
    out = {pos: F.col("_pos") + before}
    if size:
        out[size] = F.col("_total")
    out |= {
        n: F.when(F.col("_pos") == 1, F.col(f"_edge_{n}")).otherwise(F.col(f"_in_{n}")) for n in lag
    }
    out |= {n: F.coalesce(f"_in_{n}", f"_edge_{n}") for n in carry}
    if ties:
        value, first, last = ties
        at_low, at_high = F.col(value) == F.col("_low"), F.col(value) == F.col("_high")
        out[first] = (
            F.when(at_low, F.col("_low_first"))
            .when(at_high, F.col("_high_first"))
            .otherwise(F.col("_first") + before)
        )
        out[last] = (
            F.when(at_high, F.col("_high_last"))
            .when(at_low, F.col("_low_last"))
            .otherwise(F.col("_last") + before)
        )
    return joined.select(*rows.columns, *[value.alias(n) for n, value in out.items()])


def _inside(
    rows: DataFrame,
    keys: list[str],
    order: Sequence[Column],
    pos: str,
    size: str | None,
    lag: Mapping[str, str],
    carry: Mapping[str, str],
    ties: tuple[str, str, str] | None,
) -> DataFrame:
    """The same within groups that are one part, over one sort."""
    along = Window.partitionBy(*keys).orderBy(*order)
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    added = {pos: F.row_number().over(along).cast("long")}
    added |= {n: F.lag(src).over(along) for n, src in lag.items()}
    added |= {n: F.last(src, ignorenulls=True).over(so_far) for n, src in carry.items()}
    out = rows.withColumns(added)
    if ties:
        value, first, last = ties
        equal = Window.partitionBy(*keys, value)
        low = F.min(pos).over(equal)
        alone = F.col(value).isNull()
        out = out.withColumns(
            {
                first: F.when(alone, F.col(pos)).otherwise(low),
                last: F.when(alone, F.col(pos)).otherwise(low + F.count(F.lit(1)).over(equal) - 1),
            }
        )
    return out.withColumn(size, whole) if size else out


def _edges(
    parted: DataFrame,
    group: list[str],
    key: Column,
    lag: Mapping[str, str],
    carry: Mapping[str, str],
    ties: tuple[str, str, str] | None,
) -> DataFrame:
    """One row per (group, part): rows before it, group size, and what its first rows lack."""
    keys = [*group, "_part"]
    sums = [F.count(F.lit(1)).alias("_rows")]
    sums += [F.max_by(src, key).alias(f"_tail_{n}") for n, src in lag.items()]
    sums += [
        F.max_by(src, F.when(F.col(src).isNotNull(), key)).alias(f"_held_{n}")
        for n, src in carry.items()
    ]
    if ties:
        sums += [F.min(ties[0]).alias("_low"), F.max(ties[0]).alias("_high")]
    along = Window.partitionBy(*group).orderBy("_part")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        parted.groupBy(*keys)
        .agg(*sums)
        .select(
            *keys,
            "_rows",
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_rows").over(Window.partitionBy(*group)).alias("_total"),
            *[F.lag(f"_tail_{n}").over(along).alias(f"_edge_{n}") for n in lag],
            *[
                F.last(f"_held_{n}", ignorenulls=True).over(earlier).alias(f"_edge_{n}")
                for n in carry
            ],
            *(["_low", "_high"] if ties else []),
        )
    )
    if not ties:
        return edges.drop("_rows")
    return _tie_edges(settle(edges, "edges"), parted, group, ties[0]).drop("_rows")


def _tie_edges(edges: DataFrame, parted: DataFrame, group: list[str], value: str) -> DataFrame:
    """Add the bounds of the ties of the lowest and the highest value of each part.

    Only these can go on in another part.
    """
    keys = [*group, "_part"]
    own = parted.select(*keys, value)
    counted = (
        _beside(own, edges.select(*keys, "_low", "_high"), keys, "inner")
        .groupBy(*keys)
        .agg(
            F.count_if(F.col(value).isNull()).alias("_nulls"),
            F.count_if(F.col(value) == F.col("_low")).alias("_n_low"),
            F.count_if(F.col(value) == F.col("_high")).alias("_n_high"),
        )
    )
    known = settle(_beside(edges, counted, keys, "inner"), "known")
    low_at = F.col("_before") + F.col("_nulls")
    high_to = F.col("_before") + F.col("_rows")
    ends = F.array(
        F.struct(
            F.col("_low").alias("v"),
            (low_at + 1).alias("first"),
            (low_at + F.col("_n_low")).alias("last"),
        ),
        F.struct(
            F.col("_high").alias("v"),
            (high_to - F.col("_n_high") + 1).alias("first"),
            high_to.alias("last"),
        ),
    )
    bounds = (
        known.select(*group, F.explode(ends).alias("e"))
        .where("e.v is not null")
        .groupBy(*group, "e.v")
        .agg(F.min("e.first").alias("_first"), F.max("e.last").alias("_last"))
    )
    bounds = settle(bounds, "bounds")
    out = known.drop("_nulls", "_n_low", "_n_high")
    for end in ("_low", "_high"):
        named = bounds.withColumnsRenamed(
            {"v": end, "_first": f"{end}_first", "_last": f"{end}_last"}
        )
        out = _beside(out, named, [*group, end], "left")
    return out
