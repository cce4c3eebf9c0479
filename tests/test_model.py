"""Feature preparation, training and evaluation."""

import pytest
from pyspark.sql import functions as F

from tallyframe.catalog.accidents import accidents
from tallyframe import presets as P
from tallyframe.operators import features
from tallyframe.operators.evaluate import class_scores, confusion_matrix, confusion_wide, weighted_f1
from tallyframe.plans import classify, explore, quality, store
from tallyframe.plans.classify import ModelConfig
from tallyframe.plans.prepare import prepare_model

SF = "/root/testdata/sf0.001"
SMALL = ModelConfig(num_trees=5, max_depth=4, forest_params={"maxMemoryInMB": 512})


@pytest.fixture(scope="module")
def rows(spark):
    return prepare_model(accidents(spark, SF))


@pytest.fixture(scope="module")
def trained(rows):
    return classify.train(rows, SMALL)


def test_no_row_is_in_both_parts(rows):
    cols = [SMALL.label, *classify._model_columns(rows, SMALL)[0], *classify._model_columns(rows, SMALL)[1]]
    train, test = classify.train_test(rows, SMALL)
    assert train.select(cols).intersect(test.select(cols)).count() == 0


def test_only_training_is_balanced(rows):
    train, test = classify.train_test(rows, SMALL)
    sizes = [r["count"] for r in train.groupBy(SMALL.label).count().collect()]
    assert max(sizes) < 1.15 * min(sizes)
    sizes = [r["count"] for r in test.groupBy(SMALL.label).count().collect()]
    assert max(sizes) > 2 * min(sizes)


def test_copies_leak_in_the_reference_order(rows):
    cfg = ModelConfig(reference_order=True)
    train, test = classify.train_test(rows, cfg)
    cols = train.columns
    assert train.select(cols).intersect(test.select(cols)).count() > 0


def test_score_is_that_of_the_evaluator(trained):
    predictions = classify.predict(trained.model, trained.test)
    ours = weighted_f1(confusion_matrix(predictions)).first()["f1"]
    assert ours == pytest.approx(classify.f1_evaluator().evaluate(predictions), abs=1e-9)


def test_reports(rows, trained):
    tables = classify.evaluate(rows, trained, SMALL)
    params = {r["param"]: r["value"] for r in tables["parameters"].collect()}
    assert (params["numTrees"], params["maxDepth"], params["numClasses"]) == (5, 4, 3)
    assert [tuple(r) for r in tables["labels"].orderBy("index").collect()] == [
        (0.0, "1", "Fatal"), (1.0, "2", "Serious"), (2.0, "3", "Slight"),
    ]
    assert tables["confusion"].agg(F.sum("count")).first()[0] == trained.test.count()
    assert tables["classes"].agg(F.sum("n")).first()[0] == classify.model_rows(rows, SMALL).count()


def test_unknown_label_has_a_name(spark, trained):
    names = {r["name"] for r in classify.label_mapping(spark, trained.model, {"1": "Fatal"}).collect()}
    assert names == {"Fatal", "Unknown"}


def test_same_model_twice(rows, trained):
    again = classify.train(rows, SMALL)
    a, c = (classify.predict(t.model, t.test).agg(F.sum("prediction")).first()[0] for t in (trained, again))
    assert a == c


def test_rows_with_gaps_are_predicted(trained):
    gaps = trained.test.withColumns({"Road_Type": F.lit(None).cast("string"), "Longitude": F.lit(None).cast("double")})
    assert classify.predict(trained.model, gaps).filter("prediction IS NULL").count() == 0
    assert classify.predict(trained.model, gaps).count() == trained.test.count()


def test_empty_table_raises(rows):
    with pytest.raises(ValueError, match="no rows of class"):
        classify.train(rows.limit(0), SMALL)


def test_saved_model(trained, tmp_path):
    from pyspark.ml import PipelineModel

    trained.model.write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    n = [classify.predict(m, trained.test).agg(F.sum("prediction")).first()[0] for m in (trained.model, loaded)]
    assert n[0] == n[1]


def test_training_rows_are_spread_by_number(rows, monkeypatch):
    fitted = []

    class Seen(classify.Pipeline):
        def fit(self, dataset, params=None):
            fitted.extend(r["n"] for r in dataset.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
            return super().fit(dataset, params)

    monkeypatch.setattr(classify, "Pipeline", Seen)
    monkeypatch.setattr(classify, "_ROWS_IN_TASK", 100, raising=False)
    again = classify.train(rows, SMALL)
    assert sum(fitted) == again.train.count() > 2000 and max(fitted) < 120


def test_tuning(rows):
    search = classify.tune(rows, ModelConfig(num_trees=2), {"maxDepth": [1, 3]}, folds=2)
    assert len(search.avgMetrics) == 2 and all(0 < m < 1 for m in search.avgMetrics)


def test_scores_without_predictions_are_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a")], "label string, prediction string")
    confusion = confusion_matrix(df)
    rows = class_scores(confusion).select("class", "support", "predicted", "tp", "precision", "f1").collect()
    scores = {r[0]: tuple(r[1:]) for r in rows}
    assert scores == {"a": (2, 3, 2, 2 / 3, 0.8), "b": (1, 0, 0, 0.0, 0.0)}
    wide = {r["label"]: (r["predicted_a"], r["predicted_b"]) for r in confusion_wide(confusion, ["a", "b"]).collect()}
    assert wide == {"a": (2, 0), "b": (1, 0)}


def test_imputer_and_scaler(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("nan"),)], "x double")
    assert [r["x_imputed"] for r in features.impute_mean(df, ["x"]).collect()] == [1.0, 3.0, 2.0, 2.0]
    scaled = features.standardise(df, ["x"]).agg(F.avg("x_scaled"), F.stddev("x_scaled")).first()
    assert scaled[0] == pytest.approx(0.0) and scaled[1] == pytest.approx(1.0)


def test_unseen_category_has_its_own_slot(spark):
    seen = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    model = features.category_indexer(["c"]).fit(seen)
    new = spark.createDataFrame([("z",), (None,), ("b",)], "c string")
    assert [r["c_idx"] for r in model.transform(new).collect()] == [2.0, 2.0, 1.0]


def read_classes(spark, path):
    return {r["class"] for r in spark.read.parquet(str(path / "classify/classes")).collect()}


def test_command_lines(spark, tmp_path, monkeypatch):
    rows = accidents(spark, SF)
    source, table = str(tmp_path / "table.csv"), str(tmp_path / "table")
    rows.write.option("header", True).option("escape", '"').csv(source)
    for plan in (store, quality, explore, classify):
        monkeypatch.setattr(plan, "session", lambda name: spark)
    store.main([source, table])
    quality.main([source, str(tmp_path / "quality")])
    explore.main([table, str(tmp_path / "explore")])
    classify.main([table, str(tmp_path / "classify"), "--num-trees", "2", "--max-depth", "3",
                   "--seed", "7", "--train-percent", "60", "--subsampling-rate", "0.8", "--max-memory-mb", "512"])
    assert read_classes(spark, tmp_path) == {1, 2, 3}
    read = spark.read.parquet
    assert "Year=1996" in {p.name for p in (tmp_path / "table").iterdir()}
    assert read(str(tmp_path / "quality/row_count")).first()[0] == rows.count()
    assert read(str(tmp_path / "quality/head")).count() == P.HEAD_ROWS
    assert read(str(tmp_path / "quality/categories")).filter("column = 'Road_Type'").count() == 3
    assert read(str(tmp_path / "quality/absent")).count() == len(P.PROFILE_COLUMNS) - 15
    assert {p.name for p in (tmp_path / "explore").iterdir()} == set(explore.ANALYSES)
    assert 0 < read(str(tmp_path / "classify/weighted_f1")).first()[0] < 1
