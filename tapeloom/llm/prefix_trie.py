"""A trie of conversation prefixes with subtree totals, by time-forward processing.

A node is a distinct sequence of first turns; its members are the conversations that start with it.
The smallest member names a node: ``(conv_id, depth)`` is unique, and the parent of a node has a
smaller or equal ``conv_id`` at a smaller depth. Nodes are therefore dealt into shards by ranges of
``(conv_id, depth)``, which hold as many rows as they should whatever turn, node or conversation is
frequent, and a walk to the root passes each shard once.

Totals go up in two sweeps over the shards. In each, Spark sorts the nodes of a shard by level from
the deepest (an external sort), and a node's total is sent to its parent through a priority queue
that spills sorted runs:

1. The first sweep sends totals inside the shards. What leaves a shard is summed by the node it goes
   to. The nodes that receive from other shards, each linked to the next such node above it, are a
   smaller tree, the shard roots, whose totals are found in the same way.
2. The second sweep repeats the first with the totals that came from other shards put in.

Prefixes are told apart by 128 bits: the exclusive or of a hash of each (depth, turn), a running
value that needs no conversation in one place. Digests of the conversations that end at a node are
taken from blocks of sorted ids, so a node with very many of them is read as few rows.

Null roles and texts count as empty. Turns come in the order of ``turn`` with null first; equal ones
are ordered by a digest of role and text, so repeated rows stay and have a defined place. A null
``conv_id`` is one conversation as any other, which borrows no turns; it is the smallest member only
where it is alone, and has the empty string among the ids of a digest, last. An empty table gives an
empty one. Texts of any length are read whole; other columns are left behind, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.ordering import ordinal, prefix_xor
from tapeloom.plans.shared import settle

#: Conversations of a block borrow their first turns from its first one.
BLOCK = 20
BORROWED = 4
#: Messages that a queue holds in memory before it spills a sorted run.
QUEUE_ROWS = 200_000
#: Trees of at most this many shard roots are one shard.
ROOT_ROWS = 100_000
#: Ids of a block from which a digest is taken; a block is some kilobytes.
IDS_A_BLOCK = 1_000
BLANKS = "\t\n\x0b\x0c\r "


class SpillingQueue:
    """A priority queue of tuples that keeps ``limit`` of them and spills the others as sorted runs.

    Runs are scratch files without a name; they belong to the task that wrote them and go with it.
    """

    def __init__(self, limit: int = QUEUE_ROWS) -> None:
        self.limit = limit
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # (next tuple of a run, number of the run, its file)
        self.spilled = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        """Write the later half of the heap as a run, in blocks that are read one at a time."""
        self.heap.sort()
        half = len(self.heap) // 2
        run = self.heap[half:]
        del self.heap[half:]
        file = tempfile.TemporaryFile()
        for at in range(0, len(run), 1000):
            pickle.dump(run[at : at + 1000], file)
        file.seek(0)
        self.spilled += 1
        self._next(iter(()), self.spilled, file)

    def _next(self, rest: Iterator[tuple], number: int, file) -> None:
        for item in rest:
            heapq.heappush(self.runs, (item, number, rest, file))
            return
        try:
            block = iter(pickle.load(file))
        except EOFError:
            file.close()
            return
        self._next(block, number, file)

    def first(self) -> tuple | None:
        """The smallest tuple, left in place."""
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, number, rest, file = heapq.heappop(self.runs)
            self._next(rest, number, file)
            return item
        return heapq.heappop(self.heap)


def words_in(text: Column) -> Column:
    """Runs of characters other than space and U+0009..U+000D: places where one starts."""
    spaced = F.translate(text, BLANKS[:-1], " " * (len(BLANKS) - 1))
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_a, turn_b, n_words): turns by digest, numbered from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        told.alias("digest"),
        words_in(text).alias("n_words"),
    )
    return ordinal(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], "place")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, n_words) of the rebuilt conversations, and (conv_id, size) of each.

    A conversation takes the first ``h`` turns of the first conversation of its block, then its own
    turns after its first ``h``; ``h`` comes from a checksum of its id.
    """
    turns = settle(
        numbered_turns(conversations).select("conv_id", "place", "digest", "n_words"), "turns"
    )
    crc = F.crc32(F.col("conv_id").cast("string"))
    own = (
        turns.groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("n_own"))
        .select(
            "conv_id",
            "n_own",
            F.coalesce(crc % BORROWED, F.lit(0)).alias("h"),
            (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("first_id"),
        )
    )
    first = own.select(F.col("conv_id").alias("first_id"), F.col("n_own").alias("n_first"))
    plan = settle(
        own.join(first, "first_id", "left")
        .withColumn("taken", F.least("h", F.coalesce("n_first", F.lit(0))))
        .withColumn("size", F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
        .select("conv_id", "first_id", "h", "taken", "size"),
        "plan",
    )
    heads = turns.where(
        (F.col("place") < BORROWED) & (F.col("conv_id") % BLOCK == 0)
    ).withColumnRenamed("conv_id", "first_id")
    borrowed = (
        heads.join(plan.where("taken > 0"), "first_id")
        .where("place <= taken")
        .select("conv_id", F.col("place").alias("depth"), "digest", "n_words")
    )
    late = plan.select(F.col("conv_id").alias("_conv"), "h", "taken")
    kept = (
        turns.join(late, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .where("place > h")
        .select(
            "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest",
            "n_words",
        )
    )
    return borrowed.unionByName(kept), plan.select("conv_id", "size")


def prefix_keys(turns: DataFrame) -> DataFrame:
    """Add ``key_a``, ``key_b`` of the prefix that ends with each turn, and of the one before."""
    own = {
        "own_a": F.xxhash64("depth", "digest"),
        "own_b": F.xxhash64(F.lit("b"), "digest", "depth"),
    }
    rows = prefix_xor(
        turns.withColumns(own), ["conv_id"], [F.col("depth")], {"key_a": "own_a", "key_b": "own_b"}
    )
    return rows.select(
        "conv_id",
        "depth",
        "n_words",
        "key_a",
        "key_b",
        F.col("key_a").bitwiseXOR(F.col("own_a")).alias("up_a"),
        F.col("key_b").bitwiseXOR(F.col("own_b")).alias("up_b"),
    )


def trie_nodes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per node: key, conv_id, depth, key of its parent, n_convs, n_words, shard."""
    nodes = rows.groupBy("depth", "key_a", "key_b").agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.first("n_words").alias("n_words"),
        F.first("up_a").alias("up_a"),
        F.first("up_b").alias("up_b"),
    )
    zero = F.lit(0).cast("long")
    root = (
        sizes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
        .where("n_convs > 0")
        .select(
            zero.alias("depth"),
            zero.alias("key_a"),
            zero.alias("key_b"),
            "conv_id",
            "n_convs",
            zero.alias("n_words"),
            F.lit(None).cast("long").alias("up_a"),
            F.lit(None).cast("long").alias("up_b"),
        )
    )
    return nodes.unionByName(root)


def sharded(tree: DataFrame) -> DataFrame:
    """Add ``shard``: the number of a row's range of (conv_id, depth), written once."""
    ordered = tree.repartitionByRange(F.col("conv_id").asc_nulls_last(), "depth")
    return settle(ordered.withColumn("shard", F.spark_partition_id()), "shards")


def _by_level(tree: DataFrame) -> DataFrame:
    """Each shard in one task, from its deepest level up."""
    return tree.repartition("shard").sortWithinPartitions(
        "shard", F.col("depth").desc(), F.col("conv_id").desc()
    )


# In the sweeps the place of a node is (-depth, -conv_id): a parent's place is always later. The
# parent of a root has the depth -1.
def _sweep_inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First sweep: what leaves each shard, and the links between nodes marked as receivers.

    Rows out: a receiver (conv_id, depth) with sums that reach it from another shard, or with
    (child_conv, child_depth), a receiver below it and no other receiver between; else -1.
    """
    shard, queue = None, SpillingQueue()
    columns = ["conv_id", "depth", "leaves", "saved", "child_conv", "child_depth"]

    def leave(out: list[tuple], until: tuple | None) -> None:
        """Send off what is for places before ``until``: they lie in other shards."""
        last, leaves, saved = None, 0, 0
        while (first := queue.first()) is not None and (until is None or first[0] < until):
            place, child, more_leaves, more_saved = queue.pop()
            if place != last:
                if last is not None:
                    out.append((-last[1], -last[0], leaves, saved, 0, -1))
                last, leaves, saved = place, 0, 0
            leaves, saved = leaves + more_leaves, saved + more_saved
            if child:
                out.append((-place[1], -place[0], 0, 0, -child[1], -child[0]))
        if last is not None:
            out.append((-last[1], -last[0], leaves, saved, 0, -1))

    for batch in batches:
        out: list[tuple] = []
        for part, conv_id, depth, up_conv, up_depth, leaves, saved, receives in zip(
            *(batch[c].tolist() for c in _SWEPT), batch["receives"], strict=True
        ):
            if part != shard:
                leave(out, None)
                shard = part
            here = (-depth, -conv_id)
            leave(out, here)
            below = []
            while (first := queue.first()) is not None and first[0] == here:
                _, child, more_leaves, more_saved = queue.pop()
                leaves, saved = leaves + more_leaves, saved + more_saved
                if child:
                    below.append(child)
            if receives:
                out.extend((conv_id, depth, 0, 0, -c[1], -c[0]) for c in below)
                below = [here]
            if up_depth < 0:
                continue
            up = (-up_depth, -up_conv)
            queue.push((up, (), leaves, saved))
            for child in below:
                queue.push((up, child, 0, 0))
        yield pd.DataFrame(out, columns=columns, dtype="int64")
    out = []
    leave(out, None)
    yield pd.DataFrame(out, columns=columns, dtype="int64")


_SWEPT = ["shard", "conv_id", "depth", "up_conv", "up_depth", "leaves", "saved"]


def _sweep_totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Second sweep: the totals of every node, with those from other shards put in."""
    shard, queue = None, SpillingQueue()
    for batch in batches:
        totals = []
        for part, conv_id, depth, up_conv, up_depth, leaves, saved, inside, receives, *far in zip(
            *(batch[c].tolist() for c in _SWEPT),
            *(batch[c].tolist() for c in ("inside", "receives", "far_leaves", "far_saved")),
            strict=True,
        ):
            if part != shard:
                shard, queue = part, SpillingQueue()
            here = (-depth, -conv_id)
            # Sums inside the shard, and what receivers below have got from outside it.
            far_leaves, far_saved = 0, 0
            while (first := queue.first()) is not None and first[0] == here:
                _, a, b, c, d = queue.pop()
                leaves, saved = leaves + a, saved + b
                far_leaves, far_saved = far_leaves + c, far_saved + d
            if receives:
                # The total of a receiver holds those of the receivers below it.
                far_leaves, far_saved = far
            totals.append((leaves + far_leaves, saved + far_saved))
            if inside:
                queue.push(((-up_depth, -up_conv), leaves, saved, far_leaves, far_saved))
        out = batch[["conv_id", "depth"]].reset_index(drop=True)
        out[["leaves", "saved"]] = pd.DataFrame(totals, columns=["leaves", "saved"], dtype="int64")
        yield out


def subtree_totals(tree: DataFrame, one_shard: bool = False) -> DataFrame:
    """(conv_id, depth, leaves, saved): sums over the subtree of every node.

    ``tree`` has (conv_id, depth, up_conv, up_depth, leaves, saved), one row per node; the parent
    of a root has the depth -1. Every other parent is a row, with a smaller (conv_id, depth).
    """
    fields = ["conv_id", "depth", "up_conv", "up_depth", "leaves", "saved"]
    rows = tree.select(*fields)
    if one_shard:
        rows = settle(rows.withColumn("shard", F.lit(0)), "shards")
    else:
        rows = sharded(rows)
    home = rows.select(
        F.col("conv_id").alias("up_conv"),
        F.col("depth").alias("up_depth"),
        F.col("shard").alias("up_shard"),
    )
    linked = settle(
        rows.join(home, ["up_conv", "up_depth"], "left").withColumn(
            "inside", F.coalesce(F.col("shard") == F.col("up_shard"), F.lit(False))
        ),
        "linked",
    )
    receivers = settle(
        linked.where("up_depth >= 0 and not inside")
        .select(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth"))
        .distinct()
        .withColumn("receives", F.lit(True)),
        "receivers",
    )
    marked = linked.join(receivers, ["conv_id", "depth"], "left").withColumn(
        "receives", F.coalesce("receives", F.lit(False))
    )
    n_receivers = receivers.count()
    zero = F.lit(0).cast("long")
    if n_receivers:
        sent = settle(
            _by_level(marked).mapInPandas(
                _sweep_inside,
                "conv_id long, depth long, leaves long, saved long, child_conv long, "
                "child_depth long",
            ),
            "sent",
        )
        sums = sent.where("child_depth < 0").groupBy("conv_id", "depth").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        above = sent.where("child_depth >= 0").select(
            F.col("child_conv").alias("conv_id"),
            F.col("child_depth").alias("depth"),
            F.col("conv_id").alias("up_conv"),
            F.col("depth").alias("up_depth"),
        )
        roots = sums.join(above, ["conv_id", "depth"], "left").select(
            "conv_id",
            "depth",
            F.coalesce("up_conv", zero).alias("up_conv"),
            F.coalesce("up_depth", F.lit(-1).cast("long")).alias("up_depth"),
            "leaves",
            "saved",
        )
        far = subtree_totals(settle(roots, "roots"), n_receivers <= ROOT_ROWS)
    else:
        far = receivers.select("conv_id", "depth", zero.alias("leaves"), zero.alias("saved"))
    totals = far.withColumnsRenamed({"leaves": "far_leaves", "saved": "far_saved"})
    whole = marked.join(totals, ["conv_id", "depth"], "left").fillna(0, ["far_leaves", "far_saved"])
    return _by_level(whole).mapInPandas(
        _sweep_totals, "conv_id long, depth long, leaves long, saved long"
    )


def _join_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of comma-joined ids of one node each, in the order of the rows."""
    node, ids, number = None, [], 0
    out: list[tuple] = []
    for batch in batches:
        for place, a, b, conv_id in zip(
            batch["_slot"], batch["key_a"], batch["key_b"], batch["id"], strict=True
        ):
            if (a, b) != node or len(ids) >= IDS_A_BLOCK:
                if ids:
                    out.append((*node, number, ",".join(ids)))
                node, ids, number = (a, b), [], place
            ids.append(conv_id)
        yield pd.DataFrame(out, columns=["key_a", "key_b", "number", "ids"])
        out = []
    if ids:
        yield pd.DataFrame([(*node, number, ",".join(ids))], columns=["key_a", "key_b", "number", "ids"])


def _digest_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the blocks of each node, in order of their number."""
    node, told, n = None, None, 0
    columns = ["key_a", "key_b", "ends_sha256"]
    for batch in batches:
        out = []
        for a, b, ids in zip(batch["key_a"], batch["key_b"], batch["ids"], strict=True):
            if (a, b) != node:
                if node is not None:
                    out.append((*node, told.hexdigest()))
                node, told, n = (a, b), hashlib.sha256(), 0
            told.update(f",{ids}".encode() if n else ids.encode())
            n += 1
        yield pd.DataFrame(out, columns=columns)
    if node is not None:
        yield pd.DataFrame([(*node, told.hexdigest())], columns=columns)


def end_digests(ends: DataFrame) -> DataFrame:
    """(key_a, key_b, ends_sha256) of the conversations (key_a, key_b, conv_id) that end at a node.

    The ids are range-sorted, so those of a frequent node lie in several tasks; each writes blocks of
    ``IDS_A_BLOCK`` ids, and only the blocks of a node meet.
    """
    order = ["key_a", "key_b", F.col("conv_id").asc_nulls_last()]
    blocks = (
        ends.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "key_a",
            "key_b",
            F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("id"),
            F.monotonically_increasing_id().alias("_slot"),
        )
        .mapInPandas(_join_ids, "key_a long, key_b long, number long, ids string")
    )
    return (
        settle(blocks, "blocks")
        .repartition("key_a", "key_b")
        .sortWithinPartitions("key_a", "key_b", "number")
        .mapInPandas(_digest_blocks, "key_a long, key_b long, ends_sha256 string")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    turns, sizes = rebuilt_turns(conversations)
    rows = settle(prefix_keys(turns), "prefixes")
    nodes = settle(trie_nodes(rows, sizes), "nodes")
    up = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("key_a").alias("up_a"),
        F.col("key_b").alias("up_b"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("up_a").alias("key_a"), F.col("up_b").alias("key_b")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    placed = settle(
        nodes.join(up, ["depth", "up_a", "up_b"], "left")
        .join(children, ["depth", "key_a", "key_b"], "left")
        .select(
            "conv_id",
            "depth",
            "key_a",
            "key_b",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"),
        ),
        "placed",
    )
    # A null id is the largest; inside the tree it needs a number.
    top = F.lit((1 << 63) - 1)
    tree = placed.select(
        F.coalesce("conv_id", top).alias("conv_id"),
        "depth",
        F.coalesce("parent_conv_id", top).alias("up_conv"),
        (F.col("depth") - 1).alias("up_depth"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        "saved",
    )
    totals = subtree_totals(tree).select(
        F.col("conv_id").alias("_conv"),
        F.col("depth").alias("_depth"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
    )
    ends = (
        sizes.join(
            rows.select(F.col("conv_id").alias("_conv"), "depth", "key_a", "key_b"),
            F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("size") == F.col("depth")),
        ).select("key_a", "key_b", "conv_id")
    )
    zero = F.lit(0).cast("long")
    turnless = sizes.where("size = 0").select(zero.alias("key_a"), zero.alias("key_b"), "conv_id")
    digests = end_digests(ends.unionByName(turnless))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        placed.join(
            totals,
            (F.coalesce("conv_id", top) == F.col("_conv")) & (F.col("depth") == F.col("_depth")),
        )
        .join(digests, ["key_a", "key_b"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )
