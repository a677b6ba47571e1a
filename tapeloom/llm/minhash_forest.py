"""Near-duplicate groups by an LSH forest over MinHash signatures.

A forest is several sorted orders of the signatures, one per tree, each reading the hash values in
its own sequence. Texts with a long common prefix in some order are candidates:

1. Equal shingle sets are one node from the start.
2. In the first trees every node is paired with its neighbour in the sorted order if their common
   prefix is at least ``LEAST_DEPTH`` long. Pairs that hold up give a first grouping.
3. In all trees, regions (nodes with a common prefix of ``LEAST_DEPTH``) that hold several groups are
   looked at again. A region of at most ``REGION`` nodes pairs all nodes of different groups. In a larger
   one every node is paired with its neighbour of another group in the sorted order, so with one of the
   longest common prefix, however long: at most one pair for each node and tree.
4. All nodes of the larger regions meet in an exact join on their rarest shingles (prefix, length and
   position filter), which loses no pair: the neighbours of step 3 only find groups early, whose members
   need not meet again. The work grows with the pairs of different groups that share rare shingles and
   may be similar enough.

Without ``exact_crowds``, a larger region is split by the next values of its tree until its parts hold
``REGION`` nodes, down to ``DEPTHS``, and step 4 is instead: each node of such a region meets its nearest
neighbours by common prefix, the last ``WINDOW`` other groups before it in the sorted order of every tree,
in rounds: groups that were joined count as one, and others come into the window, until nothing new is
found. Each round has at most a constant times as many pairs as nodes, but among very many texts just under
the threshold, links just over it can be missed.

A candidate of steps 2 and 3 whose signatures agree in too few values (seven standard deviations under
the least similarity) is left out, and so is one whose set sizes alone rule the similarity out, which
loses nothing; the others are decided exactly, on the full shingle sets of the whole texts.

Two texts with similarity 0.8 share a region in at least one tree with probability 1 - 5e-8; in a region
of any size, they are then compared.

Words are runs of characters other than space and U+0009..U+000D, with A-Z lower-cased. With fewer
words than a shingle has, all words are one shingle; without words or text the set is empty, and the
document is alone. A null id is larger than any other. Repeated rows are linked; an empty table gives
an empty result. Columns other than id and text are only carried by :func:`drop_near_copies`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.carried import carried, restored
from tapeloom.llm.components import components, merged
from tapeloom.plans.shared import settle

TREES = 32
LEAST_DEPTH = 4
VALUES = TREES * LEAST_DEPTH
FIRST_TREES = 3
#: A tree takes its values after the fourth from the trees so many and twice as many places on.
DEEPER = 11
REGION = 16
#: Numbers of values by which crowded regions are split, one after the other.
DEPTHS = (5, 6, 7, 8, 10, 12)
#: Groups that a node of a crowded region meets in the sorted order of a tree.
WINDOW = 16
#: Below this similarity, too few pairs would share a region.
LEAST_PERCENT = 60
STEP = 512
#: Nodes that meet others under one shingle together.
CELL = 256
#: Slots by which the shingles of a crowd are counted.
SLOTS = 1 << 20
BLANKS = "\t\n\x0b\x0c\r "
#: A side of a join with at most this many narrow rows is broadcast.
BROADCAST_ROWS = 500_000

_RNG = np.random.default_rng(20_240_229)
FACTORS = _RNG.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, VALUES, np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: Sequence[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The exact set; empty without words."""
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return set(zip(*[words[i:] for i in range(size)], strict=False))


def _shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text, from the hashes of its words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : n - width + 1 + i]) * MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values as 32 numbers of four 16-bit values each."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), STEP):
        part = shingles[at : at + STEP, None] * FACTORS
        part += SHIFTS
        np.minimum(least, part.min(0), out=least)
    least ^= least >> np.uint64(29)
    return ((least * MIX) >> np.uint64(48)).astype("<u2").view("<i8")


def _sign(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                cut = [words_of(t) for t in part["text"]]
                flat = np.empty(sum(map(len, cut)), object)
                flat[:] = [w for words in cut for w in words]
                hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else flat
                rows, low = [], 0
                for words in cut:
                    own = np.asarray(hashes[low : low + len(words)], np.uint64)
                    low += len(words)
                    found = _shingle_hashes(own, size)
                    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    rows.append((len(found), digest, signature(found) if len(found) else None))
                out = pd.DataFrame(rows, columns=["n_shingles", "digest", "sign"])
                yield pd.concat(
                    [part[["doc_id", "text_hash", "row"]].reset_index(drop=True), out], axis=1
                ).astype({"doc_id": "Int64"})

    return run


def sign_documents(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, row, n_shingles, digest, sign), written once."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    return settle(
        rows.mapInPandas(
            _sign(size),
            "doc_id long, text_hash long, row long, n_shingles long, digest binary, "
            "sign array<bigint>",
        ),
        "signatures",
    )


def small_side(rows: DataFrame) -> DataFrame:
    """Broadcast a table of ids and hashes (some 32 bytes a row) if its counted rows are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def least_agreeing(percent: int) -> int:
    """Values that two signatures must share; at the least similarity one in 10^11 shares fewer."""
    share = percent / 100
    return math.floor(VALUES * share - 7 * math.sqrt(VALUES * share * (1 - share)))


def _forest(nodes: DataFrame, trees: int = TREES) -> DataFrame:
    """(tree, p, q, r, node, grp): p holds the first four values in the tree's sequence, q and r
    four more each.

    q and r are other trees' p, and no two trees have each other's: 32 different sequences.
    """
    rows = nodes.select("node", "grp", "sign", F.posexplode("sign").alias("tree", "p"))
    return rows.where(F.col("tree") < trees).select(
        "tree",
        "p",
        F.get("sign", (F.col("tree") + DEEPER) % TREES).alias("q"),
        F.get("sign", (F.col("tree") + 2 * DEEPER) % TREES).alias("r"),
        "node",
        "grp",
    )


def _neighbours(window: int, percent: int):
    """Pair the first row of each run of a group with the last rows of the ``window`` other groups
    before it in its region. Where rows carry signatures and set sizes, these must allow a link."""
    least = least_agreeing(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        region, before = None, {}
        for batch in batches:
            pairs = []
            signs, sizes = [None] * len(batch), [0] * len(batch)
            if "sign" in batch:
                sizes = batch["n"]
                signs = np.array(batch["sign"].tolist(), "<i8").reshape(len(batch), -1).view("<u2")
            rows = batch[["tree", "p", "node", "grp"]].itertuples(index=False, name=None)
            for (tree, p, node, grp), sign, n in zip(rows, signs, sizes, strict=True):
                if (tree, p) != region:
                    region, before = (tree, p), {}
                if next(reversed(before), None) != grp:
                    # Groups in the order of their last rows; that of this one moves to the end.
                    before.pop(grp, None)
                    for other, other_sign, m in before.values():
                        if sign is None or (
                            100 * min(n, m) >= percent * max(n, m)
                            and (sign == other_sign).sum() >= least
                        ):
                            pairs.append((min(other, node), max(other, node)))
                    if len(before) >= window:
                        del before[next(iter(before))]
                before[grp] = (node, sign, n)
            yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return run


def _sorted_pairs(rows: DataFrame, window: int, percent: int) -> DataFrame:
    """Pairs of neighbours by common prefix, of different groups."""
    order = ["tree", "p", "q", "r", "node"]
    return (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInPandas(_neighbours(window, percent), "a long, b long")
        .distinct()
    )


def _pairs_within(rows: DataFrame, region: list[str]) -> DataFrame:
    """All pairs of different groups in regions of at most REGION nodes."""
    left, right = (
        rows.select(*region, F.col("node").alias(x), F.col("grp").alias(f"grp_{x}"))
        for x in ("a", "b")
    )
    return (
        left.join(right, region)
        .where("grp_a < grp_b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )


def _sizes(rows: DataFrame, region: list[str]) -> DataFrame:
    """Nodes of each region that holds several groups."""
    return (
        rows.groupBy(*region)
        .agg(F.count(F.lit(1)).alias("n"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
        .where("lo < hi")
        .select(*region, "n")
    )


def _regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs of nodes of different groups in regions of at most REGION nodes, and the rows
    (tree, p, q, r, node, grp) of the larger regions that hold several groups."""
    region = ["tree", "p"]
    rows = _forest(nodes)
    found = settle(rows.join(_sizes(rows, region), region), "regions")
    pairs = _pairs_within(found.where(F.col("n") <= REGION), region)
    return pairs, found.where(F.col("n") > REGION).drop("n")


def _split_pairs(crowded: DataFrame) -> DataFrame:
    """Pairs of nodes of different groups that share a part of a large region, split until it holds
    at most REGION nodes."""
    region = ["tree", "p"]
    pairs = crowded.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    left = crowded
    for depth in DEPTHS:
        if left.isEmpty():
            break
        # The first values of q, and of r once q is used up, are those of the upper bits.
        source, shift = ("q", 16 * (8 - depth)) if depth <= 8 else ("r", 16 * (12 - depth))
        part = [*region, "cut"] if depth <= 8 else [*region, "q", "cut"]
        cut = left.withColumn("cut", F.shiftright(source, shift))
        sized_parts = settle(cut.join(_sizes(cut, part), part), "parts")
        pairs = pairs.unionByName(_pairs_within(sized_parts.where(F.col("n") <= REGION), part))
        left = sized_parts.where(F.col("n") > REGION).drop("n", "cut")
    return pairs


def _hashes_of(texts: pd.Series, size: int) -> Iterator[np.ndarray]:
    for text in texts:
        words = np.array([*words_of(text), None], object)[:-1]
        own = pd.util.hash_array(words, categorize=False) if len(words) else words
        yield _shingle_hashes(np.asarray(own, np.uint64), size)


def _weigh(size: int):
    """Counts of the shingles of a partition's texts, by the slot of their hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for hashes in _hashes_of(batch["text"], size):
                np.add.at(counts, (hashes % np.uint64(SLOTS)).astype(np.int64), 1)
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": used, "n": counts[used]})

    return run


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row of bytes for each batch: as rows, the counts take some 300 bytes each in the driver."""
    for batch in batches:
        slots, counts = batch["slot"].to_numpy("<i4"), batch["n"].to_numpy("<i8")
        yield pd.DataFrame({"slots": [slots.tobytes()], "counts": [counts.tobytes()]})


def _slot_weights(texts: DataFrame, size: int) -> np.ndarray:
    """How many texts have a shingle in each slot."""
    counted = texts.select("text").mapInPandas(_weigh(size), "slot long, n long")
    summed = counted.groupBy("slot").agg(F.sum("n").alias("n"))
    weight = np.zeros(SLOTS, np.int64)
    # 12 bytes for each of at most SLOTS slots, for any input.
    for row in summed.mapInPandas(_packed, "slots binary, counts binary").collect():
        weight[np.frombuffer(row["slots"], "<i4")] = np.frombuffer(row["counts"], "<i8")
    return weight


def _prefixes(size: int, percent: int, weights):
    """The rarest shingles of each text, by which a pair that is similar enough must meet.

    Of such a pair the larger set shows one of its ``n - ceil(t n) + 1`` rarest shingles, and the
    smaller one, marked ``short``, one of its ``n - ceil(2 t n / (1 + t)) + 1`` rarest.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = weights.value
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100]
                out = []
                for node, grp, hashes in zip(
                    part["node"], part["grp"], _hashes_of(part["text"], size), strict=True
                ):
                    n = len(hashes)
                    order = np.lexsort((hashes, weight[(hashes % np.uint64(SLOTS)).astype(np.int64)]))
                    long = n + percent * n // -100 + 1
                    short = n + 2 * percent * n // -(100 + percent) + 1
                    out.append(
                        pd.DataFrame(
                            {
                                "token": hashes[order[:long]].view(np.int64),
                                "node": node,
                                "grp": grp,
                                "n": n,
                                "at": np.arange(long),
                                "short": np.arange(long) < short,
                            }
                        )
                    )
                yield pd.concat(out)

    return run


def _crowd_pairs(
    crowd: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int
) -> DataFrame:
    """All pairs of crowd nodes of different groups that may be similar enough, by a prefix filter.

    Nothing is left out: two sets that hold up share one of their rarest shingles (in any one order
    of all shingles; the order decides the work only), and have lengths that allow it. Under a
    shingle, nodes meet in cells of about ``CELL`` nodes, which hold small groups as wholes or a part
    of one larger group, so the members of a large group never meet each other.
    """
    spark = crowd.sparkSession
    read = _texts_of(crowd, nodes, texts).join(nodes.select("node", "grp"), "node")
    weight = _slot_weights(read, size)
    prefixes = settle(
        read.mapInPandas(
            _prefixes(size, percent, spark.sparkContext.broadcast(weight)),
            "token long, node long, grp long, n long, at long, short boolean",
        ),
        "prefixes",
    )
    shared = (
        prefixes.groupBy("token")
        .agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.max("short").alias("any"))
        .where("lo < hi and any")
        .select("token")
    )
    met = settle(prefixes.join(shared, "token"), "met")
    counts = met.groupBy("token", "grp").agg(F.count(F.lit(1)).alias("of_grp"))
    pools = counts.where(F.col("of_grp") <= CELL).groupBy("token").agg(
        F.ceil(F.sum("of_grp") / CELL).cast("long").alias("pools")
    )
    # Small groups share cells, as wholes; a larger one has cells of its own, under its number.
    large = F.col("of_grp") > CELL
    within = F.expr(f"pmod(xxhash64(node), cast(ceil(of_grp / {CELL}) as long))")
    cells = settle(
        met.join(counts, ["token", "grp"])
        .join(pools, "token", "left")
        .withColumn("home", F.when(large, F.col("grp")).otherwise(F.lit(-1)))
        .withColumn("part", F.when(large, within).otherwise(F.expr("pmod(xxhash64(grp), pools)")))
        .groupBy("token", "home", "part")
        .agg(
            F.collect_list(F.struct("node", "grp", "n", "at", "short")).alias("rows"),
            F.max("short").alias("any"),
            F.min("n").alias("least"),
            F.max("n").alias("most"),
        ),
        "cells",
    )
    left, right = (
        cells.select("token", *(F.col(c).alias(f"{c}_{x}") for c in cells.columns if c != "token"))
        for x in ("a", "b")
    )
    allowed = f"""
        (other or x.grp < y.grp)
        and ((x.n <= y.n and x.short) or (y.n <= x.n and y.short))
        and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
        -- What can still be common from here on, if this is the first common shingle.
        and {100 + percent} * least(x.n - x.at, y.n - y.at) >= {percent} * (x.n + y.n)"""
    pairs = (
        left.join(right, "token")
        .where("struct(home_a, part_a) <= struct(home_b, part_b) and (any_a or any_b)")
        .where("home_a < 0 or home_a <> home_b")
        .where(f"100 * most_a >= {percent} * least_b and 100 * most_b >= {percent} * least_a")
        .withColumn("other", F.expr("home_a <> home_b or part_a <> part_b"))
        .select("other", F.explode("rows_a").alias("x"), "rows_b")
        .select("x", F.explode(F.expr(f"filter(rows_b, y -> {allowed})")).alias("y"))
    )
    a, b = F.col("x.node"), F.col("y.node")
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    left = np.array(a.tolist(), "<i8").reshape(len(a), -1).view("<u2")
    right = np.array(b.tolist(), "<i8").reshape(len(b), -1).view("<u2")
    return pd.Series((left == right).sum(1), dtype="int32")


def _similar(size: int, percent: int):
    """Keep the pairs whose full sets are similar enough; each text is cut once per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            last, own = None, set()
            rows = batch[["a", "b", "text_a", "text_b"]].itertuples(index=False, name=None)
            for a, b, text_a, text_b in rows:
                if a != last:
                    last, own = a, shingle_set(words_of(text_a), size)
                other = shingle_set(words_of(text_b), size)
                both = len(own & other)
                kept.append(100 * both >= percent * (len(own) + len(other) - both))
            yield batch.loc[np.array(kept, bool), ["a", "b"]]

    return run


def _texts_of(ends: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the nodes in ``ends``, written once."""
    keys = settle(nodes.join(ends, "node").select("node", "doc_id", "text_hash"), "ends")
    used = (
        texts.join(
            small_side(keys.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})),
            F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")),
        )
        .groupBy("node")
        .agg(F.first("text").alias("text"))
    )
    return settle(used, "texts")


def _close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose set sizes allow a link and whose signatures agree in enough values."""
    agree = F.pandas_udf(_agreeing, "int")
    sign_a, sign_b = (
        nodes.select(
            F.col("node").alias(end), F.col("sign").alias(f"sign_{end}"), F.col("n").alias(f"n_{end}")
        )
        for end in ("a", "b")
    )
    return settle(
        pairs.distinct()
        .join(sign_a, "a")
        .join(sign_b, "b")
        .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        .where(agree("sign_a", "sign_b") >= least_agreeing(percent))
        .select("a", "b"),
        "candidates",
    )


def _verified(
    close: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int
) -> DataFrame:
    """The pairs (a, b) of a written table that hold on the full sets."""
    # Only texts in a candidate pair move.
    ends = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
    used = _texts_of(ends, nodes, texts)
    first = used.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = used.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return settle(
        close.join(second, "b").join(first, "a").mapInPandas(
            _similar(size, percent), "a long, b long"
        ),
        "verified",
    )


def _with_groups(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    return nodes.drop("grp").join(groups, "node", "left").withColumn(
        "grp", F.coalesce("component", "node")
    ).drop("component")


def near_copies(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    exact_crowds: bool = True,
) -> DataFrame:
    """One row per document: doc_id, row, text_hash, n_shingles, grp, component_id, kept.

    ``grp`` numbers the groups; a group's ``component_id`` is its smallest id.

    ``size`` is the words of a shingle, ``percent`` the least share of common shingles, 60 at least.
    ``exact_crowds`` joins the nodes of crowded regions on their rarest shingles; without it they
    meet in windows only.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100")
    rows = sign_documents(docs, size, id_col, text_col)
    sets = rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("label")
    )
    sets = settle(sets, "sets")
    heads = rows.select(
        F.col("row").alias("node"), "doc_id", "text_hash", F.col("n_shingles").alias("n"), "sign"
    )
    nodes = settle(
        sets.join(heads, "node").withColumn("grp", F.col("node")).drop("digest"), "nodes"
    )
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
    )
    chain = _close(_sorted_pairs(_forest(nodes, FIRST_TREES), 1, percent), nodes, percent)
    groups = settle(components(_verified(chain, nodes, texts, size, percent)), "groups")
    grouped = settle(_with_groups(nodes, groups), "nodes")
    pairs, crowded = _regions(grouped)
    crowd = settle(crowded.select("node").distinct(), "crowd")
    if not crowd.isEmpty():
        # The exact join decides all pairs of a crowd, so neighbours are enough to find groups early.
        inside = _sorted_pairs(crowded, 1, percent) if exact_crowds else _split_pairs(crowded)
        pairs = pairs.unionByName(inside)
    tested = _close(pairs, grouped, percent)
    groups = merged(groups, _verified(tested, grouped, texts, size, percent))
    if exact_crowds and not crowd.isEmpty():
        now = settle(_with_groups(nodes, groups), "nodes")
        met = settle(_crowd_pairs(crowd, now, texts, size, percent), "crowd-pairs")
        # Those of two nodes that the forest already paired are decided.
        more = settle(met.join(tested, ["a", "b"], "left_anti"), "crowd-pairs")
        groups = merged(groups, _verified(more, now, texts, size, percent))
    while not exact_crowds and not crowd.isEmpty():
        own = settle(crowd.join(_with_groups(nodes, groups), "node"), "own")
        again = crowded.drop("grp").join(own.select("node", "grp", "n", "sign"), "node")
        met = _sorted_pairs(again, WINDOW, percent)
        new = settle(met.join(tested, ["a", "b"], "left_anti"), "windows")
        found = _verified(new, nodes, texts, size, percent)
        if found.isEmpty():
            break
        tested = tested.unionByName(new)
        groups = merged(groups, found)
    final = settle(_with_groups(nodes, groups).select("node", "label", "grp"), "groups")
    least = final.groupBy("grp").agg(F.min("label").alias("component_id"))
    by_node = final.join(least, "grp").select("node", "grp", "component_id")
    by_digest = settle(
        sets.join(by_node, "node").select("digest", "grp", "component_id"), "by-digest"
    )
    linked = rows.where("n_shingles > 0").join(by_digest, "digest")
    alone = rows.where("n_shingles = 0").withColumns(
        {"component_id": F.col("doc_id"), "grp": F.col("row")}
    )
    wanted = ["doc_id", "row", "text_hash", "n_shingles", "grp", "component_id"]
    out = linked.select(*wanted).unionByName(alone.select(*wanted))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id.

    Documents without words all stay.
    """
    copies = near_copies(docs, size, percent, id_col, text_col)
    stay = settle(
        copies.where("kept and n_shingles > 0")
        .groupBy("grp")
        .agg(
            F.min(F.struct("row", "doc_id", "text_hash")).alias("one"),
        )
        .select(F.col("one")["doc_id"].alias("_keep"), F.col("one")["text_hash"].alias("_hash")),
        "stay",
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = carried(
        docs,
        _id=F.col(id_col).cast("long"),
        _own=F.xxhash64(text),
        _wordless=F.translate(text, BLANKS, "") == "",
    )
    match = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_own") == F.col("_hash"))
    found = rows.where(~F.col("_wordless")).join(small_side(stay), match)
    # Rows that repeat an id and its text: only these are brought together.
    again = settle(
        copies.groupBy("doc_id", "text_hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("doc_id").alias("_twice"), F.col("text_hash").alias("_twice_hash")),
        "again",
    )
    if not again.isEmpty():
        repeated = F.col("_keep").eqNullSafe(F.col("_twice")) & (
            F.col("_hash") == F.col("_twice_hash")
        )
        marked = found.join(again, repeated, "left")
        once = marked.where("_twice_hash is null")
        found = once.unionByName(
            marked.where("_twice_hash is not null").dropDuplicates(["_keep", "_hash"])
        )
    return restored(rows.where("_wordless").select("_doc").unionByName(found.select("_doc")))
