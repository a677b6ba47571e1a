"""A corpus pipeline over ``documents``: each stage works on all that the one before it kept.

1. toxicity: documents whose score reaches the threshold go;
2. exact dedup: of equal texts the row with the largest id stays;
3. near dedup: of each group of near copies (shingles of five words, similarity 0.8) one stays;
4. substring dedup: passages that an earlier document holds are cut out of the later ones;
5. packing: what is left is tokenized and packed into sequences of 1024 tokens.

Stages 1 to 4 return the columns of ``documents`` (``n_chars`` follows the text in stage 4). Every
stage's result is written as Parquet to the shared folder and read again by the next, so a lost
executor repeats a part of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.catalog.registry import query
from tapeloom.llm import exact_dedup, minhash_forest, queries, substring_dedup, toxicity
from tapeloom.plans.shared import new_path

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents that are not held out, then drop what scores as toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model, queries.TOXIC_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_forest.drop_near_copies(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(docs)
    length = F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packed_pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack),
]

#: No SQL can state a trained model, content-defined chunks or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


@query("pipeline", ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
