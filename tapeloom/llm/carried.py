"""Rows carried beside helper columns, so that no name of theirs can clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def carried(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns as one struct, ``_doc``, and the named ones beside it."""
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    return docs.select(whole.alias("_doc"), *[c.alias(n) for n, c in columns.items()])


def restored(rows: DataFrame) -> DataFrame:
    """The columns that were carried."""
    return rows.select("_doc.*")
