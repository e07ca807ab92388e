"""Classifiers over text features, trained with pyspark.ml and scored out of fold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.sources.scratch import materialise

from .features import hash_bucket

FEATURES = ("log_chars", "symbol_share", "digit_share", "distinct_share", "mean_word")
#: The classifiers that can be asked for by name.
MODELS = {
    "forest": lambda: RandomForestClassifier(numTrees=50, maxDepth=6, seed=7, featuresCol="features", labelCol="quality", weightCol="weight"),
    "logistic": lambda: LogisticRegression(featuresCol="features", labelCol="quality", weightCol="weight"),
    "boosted": lambda: GBTClassifier(maxIter=20, seed=7, featuresCol="features", labelCol="quality", weightCol="weight"),
    "svm": lambda: LinearSVC(featuresCol="features", labelCol="quality", weightCol="weight"),
}


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id, source and the features; built-in expressions only."""
    words = F.split("text", r"\s+")
    n = F.greatest(F.length("text"), F.lit(1))
    share = lambda rx: F.regexp_count("text", F.lit(rx)) / n
    return docs.select("doc_id", "source", F.log1p(F.length("text")).alias("log_chars"), share("[#*$%&|<>]").alias("symbol_share"), share("[0-9]").alias("digit_share"), (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_share"), (n / F.size(words)).alias("mean_word"))


def _ready(docs: DataFrame, labels: DataFrame, folds: int) -> DataFrame:
    """Labelled rows with features, a weight that balances the classes, and folds by source."""
    rows = text_features(docs).join(labels.select("doc_id", "quality"), "doc_id").withColumn("fold", hash_bucket("fold", F.col("source"), folds))
    rows = materialise(rows, "text_features")  # texts are read once, whatever a model's passes
    share = rows.agg(F.avg("quality")).first()[0]
    weight = F.when(F.col("quality") == 1, 0.5 / max(share or 0.5, 1e-6)).otherwise(0.5 / max(1 - (share or 0.5), 1e-6))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.withColumn("weight", weight))


def _score(out: DataFrame) -> Column:
    return vector_to_array("probability")[1] if "probability" in out.columns else vector_to_array("rawPrediction")[1]


def out_of_fold(docs: DataFrame, labels: DataFrame, folds: int = 3, model: str = "forest") -> DataFrame:
    """(doc_id, quality, fold, score, predicted): each labelled document scored by a model that saw no document of its fold's sources."""
    ready, parts = _ready(docs, labels, folds), []
    for k in range(folds):
        out = MODELS[model]().fit(ready.where(F.col("fold") != k)).transform(ready.where(F.col("fold") == k))
        parts.append(out.select("doc_id", "quality", "fold", F.round(_score(out), 6).alias("score"), F.col("prediction").cast("int").alias("predicted")))
    return reduce(DataFrame.union, parts)


def soft_vote(docs: DataFrame, labels: DataFrame, folds: int = 3, models: Sequence[str] = ("forest", "logistic")) -> DataFrame:
    """(doc_id, quality, fold, score, predicted) with the mean probability of several models, out of fold. All fitted models of a fold score its rows in one pass."""
    ready, parts = _ready(docs, labels, folds), []
    for k in range(folds):
        out, train = ready.where(F.col("fold") == k), ready.where(F.col("fold") != k)
        for name in models:
            out = MODELS[name]().fit(train).transform(out).withColumn(f"p_{name}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
        mean = reduce(lambda a, b: a + b, [F.col(f"p_{name}") for name in models]) / len(models)
        parts.append(out.select("doc_id", "quality", "fold", F.round(mean, 6).alias("score"), (mean >= 0.5).cast("int").alias("predicted")))
    return reduce(DataFrame.union, parts)
