"""Baseline models on Spark ML: fit on one split, score keyed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.scalars import direction_score, predicted_class
from tapeloom.operators.labels import class_weights
from tapeloom.plans.shared import sized

FEATURE_SETS = ("minute", "embedding", "combined")


def with_class_weights(rows: DataFrame, label: str = "label", classes: int = 3) -> DataFrame:
    """Balanced weights: one row per class joined back."""
    weights = sized(class_weights(rows, label, classes).select(label, "weight"), "weights")
    return rows.join(weights, label)


def fit_logistic(
    train: DataFrame, features: Sequence[str], label: str = "label", max_iter: int = 100
) -> PipelineModel:
    """Standardized, class-balanced multinomial logistic regression."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="error"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="_x",
            labelCol=label,
            weightCol="weight",
            family="multinomial",
            maxIter=max_iter,
            probabilityCol="_p",
            rawPredictionCol="_r",
            predictionCol="_c",
        ),
    ]
    return Pipeline(stages=stages).fit(with_class_weights(train, label))


def fit_forest(
    train: DataFrame,
    features: Sequence[str],
    label: str = "label",
    trees: int = 60,
    depth: int = 5,
    min_leaf: int = 40,
    seed: int = 0,
) -> PipelineModel:
    """Three-class tree ensemble."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error"),
        RandomForestClassifier(
            featuresCol="_x",
            labelCol=label,
            numTrees=trees,
            maxDepth=depth,
            minInstancesPerNode=min_leaf,
            seed=seed,
            probabilityCol="_p",
            rawPredictionCol="_r",
            predictionCol="_c",
        ),
    ]
    return Pipeline(stages=stages).fit(train)


def fit_boosted(
    train: DataFrame,
    features: Sequence[str],
    label: str = "label",
    rounds: int = 20,
    depth: int = 5,
    min_leaf: int = 40,
    seed: int = 0,
) -> PipelineModel:
    """Boosted trees, one model per class; gives a class but no joint probability."""
    boosted = GBTClassifier(
        featuresCol="_x",
        labelCol=label,
        maxIter=rounds,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        stepSize=0.05,
        seed=seed,
    )
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error"),
        OneVsRest(classifier=boosted, featuresCol="_x", labelCol=label, predictionCol="_c"),
    ]
    return Pipeline(stages=stages).fit(train)


def score_rows(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Class probabilities, direction score and class of each row."""
    probabilities = vector_to_array("_p")
    return (
        model.transform(rows)
        .withColumn("probabilities", probabilities)
        .select(
            *keep,
            "probabilities",
            direction_score(F.col("probabilities")).alias("score"),
            predicted_class(F.col("probabilities")).alias("predicted"),
        )
    )


def prediction_rows(scored: DataFrame) -> DataFrame:
    """The prediction schema: key, dates, label, return, class probabilities, score."""
    p = F.col("probabilities")
    return scored.select(
        "symbol",
        "trading_date",
        "label_date",
        "label",
        "target_return",
        p[0].alias("prob_down"),
        p[1].alias("prob_neutral"),
        p[2].alias("prob_up"),
        "score",
    )


def feature_set(
    rows: DataFrame,
    embeddings: DataFrame,
    minute: Sequence[str],
    name: str,
    keys: Sequence[str] = ("trading_date", "symbol"),
) -> DataFrame:
    """Rows with a feature array of one set; the embedding joins on the stock-day key.

    Stock-days without an embedding drop out of every set, so that sets stay comparable.
    """
    if name not in FEATURE_SETS:
        raise ValueError(f"feature set should be one of {FEATURE_SETS}")
    joined = rows.join(embeddings.select(*keys, "embedding"), list(keys))
    numbers = F.array(*[F.col(c).cast("double") for c in minute])
    vectors = {
        "minute": numbers,
        "embedding": F.col("embedding").cast("array<double>"),
        "combined": F.concat(numbers, F.col("embedding").cast("array<double>")),
    }
    return joined.withColumn("features", vectors[name])


def as_vector(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vector", array_to_vector("features"))
