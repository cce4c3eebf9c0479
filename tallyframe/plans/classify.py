"""Random-forest classification of an unbalanced label.

``spark-submit run.py classify <table> <folder for results>``
"""

from __future__ import annotations

import argparse
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe import presets as P
from tallyframe.functions.hashing import hash_percent, hash_unit
from tallyframe.operators import features
from tallyframe.operators.balance import balance_by_draws, balance_by_unit, class_ratios, split_random
from tallyframe.operators.clean import drop_incomplete, named, present_columns, to_double
from tallyframe.operators.evaluate import class_scores, confusion_matrix, label_mapping, model_report, weighted_f1
from tallyframe.plans.prepare import prepare_model, read_table, session
from tallyframe.sources.tables import cached, write_result
from tallyframe.workspace import settle

_ROWS_IN_TASK = 200_000  # of training; the forest keeps four bytes of a row for each feature, and some for each tree


@dataclass(frozen=True)
class ModelConfig:
    """Columns and parameters of a model.

    ``key`` names the columns that identify a row for the split; without it all columns used do, so equal
    rows stay on one side. ``reference_order`` drops every incomplete row and balances *before* a random
    split, drawing rows of small classes with replacement: then copies of one row are in both parts and the score is too good. By default the split comes
    first, only the training part is balanced, and only rows without a label are dropped. ``forest_params``
    are further parameters of the forest, such as ``maxMemoryInMB`` or ``subsamplingRate`` for large tables.
    """

    label: str = P.LABEL_COLUMN
    target: Any = P.TARGET_CLASS
    categorical: Sequence[str] = tuple(P.MODEL_CATEGORICAL)
    numeric: Sequence[str] = tuple(P.MODEL_NUMERIC)
    key: Sequence[str] = ()
    seed: int = P.SEED
    train_percent: int = P.TRAIN_PERCENT
    num_trees: int = P.NUM_TREES
    max_depth: int = P.MAX_DEPTH
    reference_order: bool = False
    forest_params: Mapping[str, Any] = field(default_factory=dict)
    label_names: Mapping[str, str] = field(default_factory=lambda: dict(P.SEVERITY_NAMES))


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    train: DataFrame
    test: DataFrame


def _model_columns(df: DataFrame, cfg: ModelConfig) -> tuple[list[str], list[str], list[str]]:
    categorical, _ = present_columns(df, cfg.categorical)
    numeric, _ = present_columns(df, cfg.numeric)
    return categorical, numeric, list(cfg.key) or [cfg.label, *categorical, *numeric]


def model_rows(df: DataFrame, cfg: ModelConfig) -> DataFrame:
    """The columns the model needs, numbers as doubles, rows that cannot be used left out."""
    categorical, numeric, key = _model_columns(df, cfg)
    wanted = list(dict.fromkeys([*cfg.key, cfg.label, *categorical, *numeric]))
    rows = to_double(df.select(*[named(c) for c in wanted]), numeric)
    return drop_incomplete(rows, [cfg.label, *categorical, *numeric] if cfg.reference_order else [cfg.label])


def train_test(df: DataFrame, cfg: ModelConfig) -> tuple[DataFrame, DataFrame]:
    """Balanced training rows and test rows. Raises ``ValueError`` if the target class has no rows.

    The rows are first written to the shared folder with the numbers that place them: counting, balancing and
    training read them many times, and a hash of derived columns in a filter would derive them anew each time.
    """
    rows = model_rows(df, cfg)
    if cfg.reference_order:
        rows = settle(rows.hint("rebalance").withColumn("_row", F.monotonically_increasing_id()), "rows")
        balanced = balance_by_draws(rows, ["_row"], cfg.label, cfg.target, cfg.seed, thin=True).drop("_row", "copy")
        return split_random(balanced, cfg.train_percent, cfg.seed)
    key = _model_columns(df, cfg)[2]
    placed = rows.withColumns({"_percent": hash_percent(key, cfg.seed), "_unit": hash_unit(key, cfg.seed)})
    placed = settle(placed, "rows")
    train = placed.filter(F.col("_percent") < cfg.train_percent)
    test = placed.filter(F.col("_percent") >= cfg.train_percent)
    balanced = balance_by_unit(train, F.col("_unit"), cfg.label, cfg.target)
    return balanced.drop("_percent", "_unit", "copy"), test.drop("_percent", "_unit")


def forest_pipeline(df: DataFrame, cfg: ModelConfig) -> Pipeline:
    """Label index, imputation, scaling, category indices, one-hot, assembly, random forest."""
    categorical, numeric, _ = _model_columns(df, cfg)
    order = "frequencyDesc" if cfg.reference_order else "alphabetAsc"
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol="label",
        seed=cfg.seed,
        numTrees=cfg.num_trees,
        maxDepth=cfg.max_depth,
        **cfg.forest_params,
    )
    return Pipeline(
        stages=[
            features.label_indexer(cfg.label, "label", order),
            features.mean_imputer(numeric),
            features.numeric_assembler(numeric),
            features.standard_scaler(),
            features.category_indexer(categorical),
            features.one_hot_encoder(categorical),
            features.feature_assembler(categorical),
            forest,
        ]
    )


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly to as many tasks as keep each at ``_ROWS_IN_TASK`` at most, however the source is split.

    A row of the forest is many times as large as the stored one, so a split of so many bytes of a file would hold too
    many; and balancing repeats rows where they are.
    """
    tasks = math.ceil(rows.count() / _ROWS_IN_TASK)
    return rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism))


def train(df: DataFrame, cfg: ModelConfig) -> Trained:
    """Split, balance and fit."""
    train_rows, test_rows = train_test(df, cfg)
    with cached(spread(train_rows)) as rows:
        model = forest_pipeline(df, cfg).fit(rows)
    return Trained(model, train_rows, test_rows)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with label index, features, probabilities and prediction."""
    return model.transform(df)


def f1_evaluator() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="f1")


def tune(
    df: DataFrame, cfg: ModelConfig, grid: Mapping[str, Sequence[Any]], folds: int = 3, parallelism: int = 2
) -> CrossValidatorModel:
    """Grid search by cross-validated F1 over parameters of the forest, such as ``{"maxDepth": [5, 10]}``.

    Folds go by the row's key, so the copies made by balancing never meet themselves.
    """
    pipeline = forest_pipeline(df, cfg)
    forest = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(forest.getParam(name), list(values))
    fold = (hash_percent(_model_columns(df, cfg)[2], cfg.seed + 1) % folds).cast("int")
    rows = train_test(df, cfg)[0].withColumn("fold", fold)
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=builder.build(),
        evaluator=f1_evaluator(),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
        seed=cfg.seed,
    )
    with cached(spread(rows)) as rows:
        return search.fit(rows)


def evaluate(df: DataFrame, trained: Trained, cfg: ModelConfig) -> dict[str, DataFrame]:
    """Class counts and ratios before balancing, scores on the test part, and the reports of the model."""
    confusion = settle(confusion_matrix(predict(trained.model, trained.test)), "confusion")
    return {
        "classes": class_ratios(model_rows(df, cfg), cfg.label, cfg.target),
        "confusion": confusion,
        "class_scores": class_scores(confusion),
        "weighted_f1": weighted_f1(confusion),
        "parameters": model_report(df.sparkSession, trained.model),
        "labels": label_mapping(df.sparkSession, trained.model, cfg.label_names),
    }


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("table")
    parser.add_argument("results")
    parser.add_argument("--label", default=P.LABEL_COLUMN)
    parser.add_argument("--target", default=str(P.TARGET_CLASS), help="class whose size the others are brought to")
    parser.add_argument("--categorical", nargs="*", default=P.MODEL_CATEGORICAL)
    parser.add_argument("--numeric", nargs="*", default=P.MODEL_NUMERIC)
    parser.add_argument("--key", nargs="*", default=[])
    parser.add_argument("--seed", type=int, default=P.SEED)
    parser.add_argument("--train-percent", type=int, default=P.TRAIN_PERCENT)
    parser.add_argument("--max-memory-mb", type=int, help="maxMemoryInMB of the forest")
    parser.add_argument("--subsampling-rate", type=float, help="subsamplingRate of the forest")
    parser.add_argument("--num-trees", type=int, default=P.NUM_TREES)
    parser.add_argument("--max-depth", type=int, default=P.MAX_DEPTH)
    parser.add_argument("--reference-order", action="store_true")
    args = parser.parse_args(argv)
    forest = {"maxMemoryInMB": args.max_memory_mb, "subsamplingRate": args.subsampling_rate}
    cfg = ModelConfig(
        label=args.label,
        target=int(args.target) if args.target.lstrip("-").isdigit() else args.target,
        categorical=tuple(args.categorical),
        numeric=tuple(args.numeric),
        key=tuple(args.key),
        seed=args.seed,
        train_percent=args.train_percent,
        forest_params={name: value for name, value in forest.items() if value is not None},
        num_trees=args.num_trees,
        max_depth=args.max_depth,
        reference_order=args.reference_order,
    )
    spark = session("classify")
    df = prepare_model(read_table(spark, args.table))
    trained = train(df, cfg)
    trained.model.write().overwrite().save(f"{args.results}/model")
    for name, table in evaluate(df, trained, cfg).items():
        write_result(table, f"{args.results}/{name}", mode="overwrite")
