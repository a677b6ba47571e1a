"""Connected components of a table of links, by alternating large and small stars.

Every step works on the link table as a whole: no group is gathered, and a node with very many links
is one row of a pre-aggregated minimum that meets its links in a join whose large partitions Spark
splits. Each round is written to the shared folder, which also ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.shared import settle


def _both_ways(links: DataFrame) -> DataFrame:
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.select("a", "b").unionByName(back)


def _large_star(links: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the smallest one."""
    around = _both_ways(links)
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m")
    )
    return around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link the smaller neighbours of each node, and the node, to the smallest of them."""
    down = links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where("a > b").distinct()


def _state(links: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), mark).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each component, for every node of ``links`` (a, b)."""
    now = settle(_small_star(links), "links")
    state = _state(now)
    while True:
        now = settle(_small_star(_large_star(now)), "links")
        new = _state(now)
        if new == state:
            break
        state = new
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = stars.select("component").distinct().select(
        F.col("component").alias("node"), "component"
    )
    return stars.unionByName(centres)


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links behind ``groups`` (node, component) and of ``links`` together.

    Only the links between different groups go through the rounds, each pair of groups once; the
    links that made the groups are not read again.
    """
    left, right = (
        groups.select(F.col("node").alias(end), F.col("component").alias(f"grp_{end}"))
        for end in ("a", "b")
    )
    own_a, own_b = F.coalesce("grp_a", "a"), F.coalesce("grp_b", "b")
    between = settle(
        links.join(left, "a", "left")
        .join(right, "b", "left")
        .where(own_a != own_b)
        .select(F.least(own_a, own_b).alias("a"), F.greatest(own_a, own_b).alias("b"))
        .distinct(),
        "between",
    )
    if between.isEmpty():
        return groups
    joined = settle(components(between), "joined")
    new = joined.select(F.col("node").alias("component"), F.col("component").alias("into"))
    moved = groups.join(new, "component", "left").select(
        "node", F.coalesce("into", "component").alias("component")
    )
    # Nodes without a group before.
    added = joined.join(groups.select("node"), "node", "left_anti")
    return settle(moved.unionByName(added), "merged")
