"""Confusion matrix, scores and reports of a classifier."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.clean import named
from tallyframe.operators.profile import literal_rows


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, count) of the pairs that occur."""
    return df.groupBy(named(label).alias("label"), named(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count")
    )


def confusion_wide(confusion: DataFrame, classes: Sequence[Any]) -> DataFrame:
    """One row per label and one column ``predicted_<class>`` per given class; 0 for pairs that do not occur."""
    cells = [
        F.coalesce(F.sum(F.when(F.col("prediction") == k, F.col("count"))), F.lit(0)).alias(f"predicted_{k}")
        for k in classes
    ]
    return confusion.groupBy("label").agg(*cells)


def class_scores(confusion: DataFrame) -> DataFrame:
    """(class, support, predicted, tp, precision, recall, f1) per class; a score without a base is 0."""
    zero = F.lit(0).cast("bigint")
    n = F.col("count")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(zero)
    as_label = F.struct(F.col("label").alias("class"), n.alias("s"), zero.alias("p"), hit.alias("t"))
    as_prediction = F.struct(F.col("prediction").alias("class"), zero.alias("s"), n.alias("p"), zero.alias("t"))
    sums = (
        confusion.select(F.inline(F.array(as_label, as_prediction)))
        .groupBy("class")
        .agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("tp"))
    )

    def part(hits: Any, base: Any) -> Any:
        return F.coalesce(hits / F.nullif(base, zero), F.lit(0.0))

    return sums.select(
        "*",
        part(F.col("tp"), F.col("predicted")).alias("precision"),
        part(F.col("tp"), F.col("support")).alias("recall"),
        part(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def weighted_f1(confusion: DataFrame) -> DataFrame:
    """(f1): the F1 scores of the classes, weighted by how many rows belong to each."""
    scores = class_scores(confusion)
    return scores.agg((F.sum(F.col("support") * F.col("f1")) / F.sum("support")).alias("f1"))


def model_report(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(param, value) of the fitted forest."""
    forest = model.stages[-1]
    params = {"numTrees": forest.getNumTrees, "maxDepth": forest.getOrDefault("maxDepth")}
    params |= {"numFeatures": forest.numFeatures, "numClasses": forest.numClasses}
    return literal_rows(spark, ["param", "value"], [[F.lit(k), F.lit(int(v))] for k, v in params.items()])


def label_mapping(spark: SparkSession, model: PipelineModel, names: Mapping[str, str]) -> DataFrame:
    """(index, original, name): what each label index stands for; ``Unknown`` if ``names`` lacks it."""
    indexer = next(s for s in model.stages if isinstance(s, StringIndexerModel))
    rows = [
        [F.lit(float(i)), F.lit(original), F.lit(names.get(original, "Unknown"))]
        for i, original in enumerate(indexer.labels)
    ]
    return literal_rows(spark, ["index", "original", "name"], rows)
