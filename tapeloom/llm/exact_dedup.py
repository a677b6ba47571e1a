"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

The index is a table of one row per distinct text: its SHA-256 and the id that stays. New data is
reduced to one row per digest, sort-merge anti-joined with the index (whose side needs no shuffle,
since it is stored in the buckets of the join) and the unknown digests are appended.

A null text counts as the empty text. Of rows with equal text the largest id stays; a null id is
smaller than any other. Of repeated rows (same id and text) one stays. Empty tables give empty
results. Only the id and the text are read; :func:`drop_copies` carries all other columns along.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.carried import carried, restored
from tapeloom.plans.shared import new_path, settle

ENTRY = "digest binary, keep_id bigint"


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


@dataclass(frozen=True)
class DigestIndex:
    """A bucketed table at ``path``; the name is only known to this session's catalog."""

    spark: SparkSession
    path: str
    buckets: int
    name: str

    @classmethod
    def at(cls, spark: SparkSession, path: str, buckets: int) -> DigestIndex:
        """Open the index stored at ``path``, or start an empty one; ``buckets`` must not change."""
        name = f"digest_index_{uuid.uuid4().hex}"
        fields = "digest BINARY, keep_id BIGINT"
        spark.sql(
            f"CREATE TABLE {name} ({fields}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return cls(spark, path, buckets, name)

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def unknown(self, entries: DataFrame) -> DataFrame:
        """Entries whose digest the index does not hold."""
        known = self.rows().select("digest").hint("merge")
        return entries.join(known, "digest", "left_anti")

    def append(self, entries: DataFrame) -> None:
        """Add entries that :meth:`unknown` let through, one sorted file per bucket and batch."""
        (
            entries.select("digest", F.col("keep_id").cast("bigint").alias("keep_id"))
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.name)
        )


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, row) written once, so that ``row`` tells repeated rows apart for good."""
    return settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            digest_of(F.col(text_col)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )


def ingest(index: DigestIndex, batch: DataFrame) -> None:
    """Append the digests of ``batch`` (doc_id, digest) that are new, with their largest id."""
    entries = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    index.append(index.unknown(entries))


def ingest_descending(index: DigestIndex, rows: DataFrame, batches: int = 2) -> None:
    """Ingest in batches of falling ids, so that the first entry of a digest has the largest."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        ingest(index, rows)
        return
    step = (high - low) // batches + 1
    place = F.coalesce(F.floor((F.lit(high) - F.col("doc_id")) / step), F.lit(batches - 1))
    for b in range(batches):
        ingest(index, rows.where(place == b))


def _index_for(docs: DataFrame, buckets: int | None) -> DigestIndex:
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex.at(spark, new_path(spark, "digest-index"), buckets)


def _keepers(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Per digest: the id that stays, its row among repeated ones, and the size of the group."""
    last = F.max(F.struct("doc_id", "row"))
    groups = rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), last["row"].alias("keep_row")
    )
    return settle(index.rows().join(groups, "digest"), "keepers")


def mark_copies(
    docs: DataFrame,
    index: DigestIndex | None = None,
    buckets: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    With an ``index`` of earlier data, a text that it holds is a copy of what stays there.
    """
    rows = digest_rows(docs, id_col, text_col)
    index = index or _index_for(docs, buckets)
    ingest_descending(index, rows)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))
    return rows.join(_keepers(rows, index), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        kept.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame,
    index: DigestIndex | None = None,
    buckets: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents that stay, with all their columns.

    Joined on (digest, id), so that the copies of one text are not dealt to one task.
    """
    rows = digest_rows(docs, id_col, text_col)
    index = index or _index_for(docs, buckets)
    ingest_descending(index, rows)
    same = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("_same"))
    stay = settle(
        index.rows()
        .join(same, "digest")
        .where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep"), "_same"),
        "stay",
    )
    match = (F.col("_mine") == F.col("_digest")) & F.col("_id").eqNullSafe(F.col("_keep"))
    rows = carried(docs, _mine=digest_of(F.col(text_col)), _id=F.col(id_col))
    found = rows.join(stay, match)
    once = found.where("_same = 1")
    repeated = found.where("_same > 1").dropDuplicates(["_digest", "_id"])
    return restored(once.unionByName(repeated))
