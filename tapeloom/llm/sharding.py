"""Sharding by extendible hashing: a bucket splits on one more hash bit while it is too large.

The directory is indexed by the leading bits of the id's hash. All buckets start at depth 0; only
those above the byte limit split, so shards differ in depth. Several bits are counted at once (one
histogram per round) and each bucket then takes the smallest depth at which it fits.

Rows with the same id share all hash bits. They stay together while they fit; beyond that the
directory goes on along a second hash, of the row, so that a hot id is split as well. A bucket of a
single row is never split: a document above the limit has a shard of its own. Null texts have zero
bytes, a null id hashes like an empty one, an empty table has no shards. Only the id and the text are
read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.carried import carried
from tapeloom.plans.shared import settle

KEY_BITS = 60
ALL_BITS = 2 * KEY_BITS
ROUND_BITS = 8


def hash_key(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def _prefix(bits: int) -> tuple[Column, Column]:
    """The leading ``bits`` of (key, row hash) as two numbers."""
    own = F.shiftright("key", KEY_BITS - min(bits, KEY_BITS))
    rest = F.shiftright("tie", ALL_BITS - bits) if bits > KEY_BITS else F.lit(0).cast("long")
    return own, rest


def _directory(rows: DataFrame, done: int, bits: int, limit: int) -> DataFrame:
    """Prefixes of ``bits`` bits with the depth of their shard, null while it is too large."""
    p, q = _prefix(bits)
    cells = settle(
        rows.groupBy(p.alias("p"), q.alias("q")).agg(
            F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")
        ),
        "cells",
    )
    depth = F.col("depth")
    own_depth = F.least(depth, F.lit(KEY_BITS))
    own = F.call_function("shiftright", F.col("p"), F.lit(min(bits, KEY_BITS)) - own_depth)
    rest = F.when(
        depth > KEY_BITS, F.call_function("shiftright", F.col("q"), F.lit(bits) - depth)
    ).otherwise(F.lit(0))
    levels = cells.withColumn(
        "depth", F.explode(F.sequence(F.lit(done), F.lit(bits)))
    ).withColumns({"at_p": own, "at_q": rest})
    bucket = ["depth", "at_p", "at_q"]
    fitting = (
        levels.groupBy(*bucket)
        .agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        .where((F.col("b") <= limit) | (F.col("n") == 1) | (depth == ALL_BITS))
        .select(*bucket)
    )
    leaves = levels.join(fitting, bucket).groupBy("p", "q").agg(F.min("depth").alias("depth"))
    return settle(cells.select("p", "q").join(leaves, ["p", "q"], "left"), "directory")


def assign_shards(
    docs: DataFrame,
    limit_bytes: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, row, n_bytes, shard (its hash bits), depth.

    ``row`` numbers the rows; ``row_col`` names such a column if the input already has one.
    """
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    rows = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            hash_key(F.col(id_col)).alias("key"),
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
            size.alias("n_bytes"),
        ),
        "shard-keys",
    ).withColumn("tie", F.shiftrightunsigned(F.xxhash64("row"), 64 - KEY_BITS))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    done, bits = 0, min(ALL_BITS, max(1, math.ceil(math.log2(max(1, total / limit_bytes))) + 3))
    placed = []
    while True:
        cells = _directory(rows, done, bits, limit_bytes)
        p, q = _prefix(bits)
        found = rows.withColumns({"p": p, "q": q}).join(cells, ["p", "q"]).drop("p", "q")
        placed.append(found.where("depth is not null"))
        if bits >= ALL_BITS or cells.where("depth is null").isEmpty():
            break
        rows = settle(found.where("depth is null").drop("depth"), "too-large")
        done, bits = bits, min(ALL_BITS, bits + ROUND_BITS)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    text_bits = F.concat(*[F.lpad(F.bin(c), KEY_BITS, "0") for c in ("key", "tie")])
    return out.select(
        "doc_id", "row", "n_bytes", F.substring(text_bits, F.lit(1), F.col("depth")).alias("shard"), "depth"
    )


def with_shard_sizes(assigned: DataFrame) -> DataFrame:
    """Add the rows and bytes of each document's shard."""
    sizes = assigned.groupBy("shard").agg(
        F.count(F.lit(1)).alias("shard_docs"), F.sum("n_bytes").alias("shard_bytes")
    )
    return assigned.join(sizes, "shard")


def write_shards(
    docs: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the documents under one folder per shard, named b and its bits.

    The folders' column is ``shard``, behind as many underscores as it takes to differ from the
    columns of the documents.
    """
    folder = "shard"
    while folder in docs.columns:
        folder = f"_{folder}"
    rows = carried(
        docs,
        _id=F.col(id_col),
        _text=F.col(text_col),
        _row=F.monotonically_increasing_id(),
    )
    rows = settle(rows, "shard-rows")
    shards = assign_shards(rows, limit_bytes, "_id", "_text", "_row").select(
        F.col("row").alias("_row"), F.concat(F.lit("b"), "shard").alias("_folder")
    )
    named = rows.join(shards, "_row").select("_doc.*", F.col("_folder").alias(folder))
    named.repartition(folder).write.partitionBy(folder).parquet(path)
