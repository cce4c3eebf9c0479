"""Balancing, splitting, sampling, feature preparation, classification."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.catalog import Query, big, rounded, table
from tallyframe.catalog.accidents import CTE, accidents
from tallyframe import presets as P
from tallyframe.operators import balance as b
from tallyframe.operators import evaluate, features
from tallyframe.operators.dictionary import category_dictionary, index_values
from tallyframe.operators.clean import sentinel_to_null
from tallyframe.plans import classify
from tallyframe.plans.prepare import prepare_model


def _class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return b.class_counts(table(spark, sf, "labels"), "quality")


def _class_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return b.class_ratios(table(spark, sf, "labels"), "quality", 0).withColumn("ratio", rounded("ratio"))


_UNIT_SQL = "('0x' || substr(md5('42:' || {key}::VARCHAR), 9, 8))::BIGINT / 4294967296::DOUBLE"
_COPIES_SQL = """WITH counts AS (SELECT {label} AS class, count(*) AS n FROM {table} GROUP BY ALL),
  ratios AS (SELECT class, (SELECT n FROM counts WHERE class = {target})::DOUBLE / n AS ratio FROM counts),
  copies AS (SELECT t.*, floor(ratio)::BIGINT + CASE WHEN {unit} < ratio - floor(ratio) THEN 1 ELSE 0 END AS copies
    FROM {table} t JOIN ratios ON {label} = class)"""


def _copies_sql(table_: str, key: str, label: str, target: str) -> str:
    return _COPIES_SQL.format(table=table_, label=label, target=target, unit=_UNIT_SQL.format(key=key))


def _copies_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return b.copies_by_hash(labels, ["doc_id"], "quality", 1)


def _balance_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "event_type")
    return b.balance_by_hash(events, ["event_id"], "event_type", "click")


def _balance_small_class(spark: SparkSession, sf: str) -> DataFrame:
    # The smaller class is drawn several times over, the larger one stays whole.
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return b.balance_by_hash(labels, ["doc_id"], "quality", 1).groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"), F.max("copy").alias("most")
    )


def _balance(spark: SparkSession, sf: str) -> DataFrame:
    # Per class, the rows of the table, and whether the balanced rows are as many as the target's, but for chance.
    labels = table(spark, sf, "labels")
    before = b.class_counts(labels, "quality")
    after = b.class_counts(b.balance(labels, "quality", 0, P.SEED), "quality").withColumnRenamed("n", "n_after")
    target = before.filter(F.col("class") == 0).agg(F.first("n")).scalar()
    near = F.abs(F.col("n_after") - target) <= 2 * F.sqrt("n")  # four standard deviations of n draws, or more
    return before.join(after, "class", "left").select("class", "n", F.coalesce(near, F.lit(False)).alias("near_target"))


def _draws_with_replacement(spark: SparkSession, sf: str) -> DataFrame:
    return b.draws_by_hash(table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"], "quality", 0)


def _draws_of_rare_class(spark: SparkSession, sf: str) -> DataFrame:
    # Each toxic row is drawn many times, as the sum of several draws; what comes out are the copies themselves.
    drawn = b.balance_by_draws(table(spark, sf, "labels").select("doc_id", "toxic"), ["doc_id"], "toxic", 0)
    return drawn.withColumn("copy", big("copy"))


def _draws_sql(label: str, target: int) -> str:
    return f"""WITH counts AS (SELECT {label} AS class, count(*) AS n FROM labels WHERE {label} IS NOT NULL GROUP BY ALL),
    ratios AS (SELECT class, (SELECT n FROM counts WHERE class = {target})::DOUBLE / n AS ratio FROM counts),
    parts AS (SELECT *, greatest(ceil(ratio / 8), 1)::BIGINT AS parts FROM ratios),
    upto AS (SELECT class, parts, sum(exp(-ratio / parts) * pow(ratio / parts, k) / gamma(k + 1))
        OVER (PARTITION BY class ORDER BY k) AS upto FROM parts, range(41) r(k)),
    tables AS (SELECT class, any_value(parts) AS parts, list(upto) AS upto FROM upto GROUP BY class),
    units AS (SELECT doc_id, {label}, upto, unnest(range(1, parts + 1)) AS part FROM labels JOIN tables ON {label} = class),
    drawn AS (SELECT doc_id, {label}, sum(len(list_filter(upto, lambda x:
        x <= ('0x' || substr(md5('42:' || doc_id || ':' || part), 9, 8))::BIGINT / 4294967296::DOUBLE)))::BIGINT AS copies
      FROM units GROUP BY ALL),
    copied AS (SELECT doc_id, {label}, CASE {label} WHEN {target} THEN 1 ELSE copies END AS copies FROM drawn)"""


def _sample_capped(spark: SparkSession, sf: str) -> DataFrame:
    return b.sample_capped(table(spark, sf, "events").select("event_id", "value"), ["event_id"], 1000)


def _sample_capped_large(spark: SparkSession, sf: str) -> DataFrame:
    # A small bound on what tasks keep in heaps, so that the passes over the digits are taken.
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return b.sample_capped(items, ["l_orderkey", "l_linenumber"], 3000, in_task=100)


def _capped_sql(source: str, cols: str, key: list[str], cap: int) -> str:
    text = " || ':' || ".join(key)
    return f"""SELECT {cols} FROM {source}
    ORDER BY ('0x' || substr(md5('42:' || {text}), 17, 15))::BIGINT, {", ".join(key)} LIMIT {cap}"""


def _dictionary_index(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return index_values(orders, ["o_custkey", "o_orderpriority"]).select(
        "o_orderkey", "o_custkey_idx", "o_orderpriority_idx"
    )


def _category_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return category_dictionary(table(spark, sf, "lineitem"), ["l_partkey", "l_returnflag", "l_orderkey"])


def _split(parts: tuple[DataFrame, DataFrame], key: str) -> DataFrame:
    train, test = (df.select(key) for df in parts)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _split_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _split(b.split_by_hash(table(spark, sf, "orders"), ["o_orderkey"]), "o_orderkey")


def _split_random(spark: SparkSession, sf: str) -> DataFrame:
    parts = _split(b.split_random(table(spark, sf, "orders")), "o_orderkey")
    n, train = F.count(F.lit(1)), F.count_if(F.col("part") == "train")
    return parts.agg(
        n.alias("n"),
        F.countDistinct("o_orderkey").alias("orders"),
        (F.abs(train - n * 0.7) <= 4 * F.sqrt(n * 0.21)).alias("near_share"),
    )


def _sample_points(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "value")
    return sample_check(events, b.sample_points(events, ["event_id", "value"], P.SAMPLE_FRACTION, P.SEED))


def sample_check(df: DataFrame, sample: DataFrame) -> DataFrame:
    """(n, foreign, twice, near_size): rows of the table, sampled rows not in it or too often, and whether the size is right."""
    both = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).join(
        sample.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("s")), df.columns, "full"
    )
    n, s, part = F.sum("n"), F.coalesce(F.sum("s"), F.lit(0)), P.SAMPLE_FRACTION
    return both.agg(
        n.alias("n"),
        F.count_if(F.col("n").isNull()).alias("foreign"),
        F.count_if(F.col("s") > F.col("n")).alias("twice"),
        (F.abs(s - n * part) <= 4 * F.sqrt(n * (part * (1 - part)))).alias("near_size"),
    )


def _frequency_index_sql(source: str, col: str) -> str:
    return f"""(SELECT {col} AS v, (row_number() OVER (ORDER BY count(*) DESC, {col}::VARCHAR) - 1)::DOUBLE AS idx
      FROM {source} GROUP BY {col})"""


def _label_index(spark: SparkSession, sf: str) -> DataFrame:
    return features.index_label(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


def _category_index(spark: SparkSession, sf: str) -> DataFrame:
    return features.index_categories(
        table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"),
        ["o_orderstatus", "o_orderpriority"],
    ).select("o_orderkey", "o_orderstatus_idx", "o_orderpriority_idx")


def _impute_mean(spark: SparkSession, sf: str) -> DataFrame:
    items = sentinel_to_null(table(spark, sf, "lineitem"), ["l_discount", "l_tax"], 0.0)
    out = features.impute_mean(items, ["l_discount", "l_tax"])
    return out.select(
        "l_orderkey",
        "l_linenumber",
        rounded("l_discount_imputed").alias("l_discount_imputed"),
        rounded("l_tax_imputed").alias("l_tax_imputed"),
    )


def _standardise(spark: SparkSession, sf: str) -> DataFrame:
    out = features.standardise(table(spark, sf, "events"), ["value"])
    return out.select("event_id", rounded("value_scaled").alias("value_scaled"))


def _one_hot(spark: SparkSession, sf: str) -> DataFrame:
    out = features.one_hot(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])
    return out.select("o_orderkey", *[F.get("o_orderstatus_ohe", F.lit(i)).alias(f"slot{i}") for i in range(4)])


def _feature_vector(spark: SparkSession, sf: str) -> DataFrame:
    cfg = classify.ModelConfig(label="o_orderpriority", categorical=["o_orderstatus"], numeric=["o_totalprice"])
    orders = table(spark, sf, "orders")
    pipeline = classify.forest_pipeline(orders, cfg)
    steps = pipeline.getStages()[:-1]
    vectors = pipeline.copy().setStages(steps).fit(orders).transform(orders)
    out = features.vector_columns(vectors, "features", [f"f{i}" for i in range(5)])
    return out.select("o_orderkey", "label", rounded("f0").alias("f0"), "f1", "f2", "f3", "f4")


def _ruled(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    rule = F.when(price > 300000, "F").when(price > 150000, "O").otherwise("P")
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("label"), rule.alias("prediction"))


_RULED_SQL = """WITH ruled AS (SELECT o_orderstatus AS label,
  CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 150000 THEN 'O' ELSE 'P' END AS prediction FROM orders)"""
_SCORES_SQL = (
    _RULED_SQL
    + """, scores AS (SELECT c AS class, count(*) FILTER (WHERE label = c) AS support,
  count(*) FILTER (WHERE prediction = c) AS predicted, count(*) FILTER (WHERE label = c AND prediction = c) AS tp
  FROM ruled, (VALUES ('F'), ('O'), ('P')) v(c) GROUP BY c),
  rated AS (SELECT *, tp / predicted::DOUBLE AS precision, tp / support::DOUBLE AS recall,
    2 * tp / (support + predicted)::DOUBLE AS f1 FROM scores)"""
)


def _confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion_matrix(_ruled(spark, sf))


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    return prepare_model(accidents(spark, sf))


def _prepare_model(spark: SparkSession, sf: str) -> DataFrame:
    cfg = classify.ModelConfig(reference_order=True)
    rows = classify.model_rows(_prepared(spark, sf), cfg)
    return rows.groupBy("Accident_Severity", big("Urban_or_Rural_Area").alias("Area"), "Hour").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("Longitude"), 4).alias("longitude"), F.sum("Month").alias("months")
    )


_SMALL = classify.ModelConfig(key=["Accident_Index"], num_trees=10, max_depth=5)


def _trained(spark: SparkSession, sf: str) -> classify.Trained:
    return classify.train(_prepared(spark, sf), _SMALL)


def _random_forest(spark: SparkSession, sf: str) -> DataFrame:
    trained = _trained(spark, sf)
    cells = _confusion_of(trained)
    known = F.max(~F.col("prediction").isin(0.0, 1.0, 2.0))
    return cells.groupBy("label").agg(F.sum("count").alias("n"), (~known).alias("known_classes"))


def _confusion_of(trained: classify.Trained) -> DataFrame:
    return evaluate.confusion_matrix(classify.predict(trained.model, trained.test))


def _prediction_support(spark: SparkSession, sf: str) -> DataFrame:
    # Every test row is predicted once, whatever is missing in it.
    trained = _trained(spark, sf)
    predicted = classify.predict(trained.model, trained.test).filter(F.col("prediction").isNotNull())
    return predicted.groupBy("Accident_Severity", "label").agg(F.count(F.lit(1)).alias("n"))


def _model_f1(spark: SparkSession, sf: str) -> DataFrame:
    trained = _trained(spark, sf)
    predicted = classify.predict(trained.model, trained.test)
    theirs = classify.f1_evaluator().evaluate(predicted)
    f1 = F.col("f1")
    return evaluate.weighted_f1(evaluate.confusion_matrix(predicted)).select(
        (F.abs(f1 - F.lit(theirs)) < 1e-9).alias("as_evaluator"), ((f1 > 0) & (f1 <= 1)).alias("is_share")
    )


def _train_test(spark: SparkSession, sf: str) -> DataFrame:
    train, test = classify.train_test(_prepared(spark, sf), _SMALL)
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return parts.groupBy("part", "Accident_Severity").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("Accident_Index").alias("orders")
    )


_DIGEST_SQL = "('0x' || substr(md5('42:' || Accident_Index::VARCHAR), {start}, 8))::BIGINT"
_TRAIN_TEST_SQL = f"""WITH {CTE},
  placed AS (SELECT Accident_Severity, Accident_Index, {_DIGEST_SQL.format(start=1)} % 100 AS percent,
    {_DIGEST_SQL.format(start=9)} / 4294967296::DOUBLE AS unit FROM accidents),
  counts AS (SELECT Accident_Severity, count(*) AS n FROM placed WHERE percent < 70 GROUP BY ALL),
  ratios AS (SELECT Accident_Severity,
    (SELECT n FROM counts WHERE Accident_Severity = 2)::DOUBLE / n AS ratio FROM counts),
  rows AS (SELECT 'test' AS part, Accident_Severity, Accident_Index, 1 AS copies FROM placed WHERE percent >= 70
    UNION ALL SELECT 'train', Accident_Severity, Accident_Index,
      floor(ratio)::BIGINT + CASE WHEN unit < ratio - floor(ratio) THEN 1 ELSE 0 END
    FROM placed JOIN ratios USING (Accident_Severity) WHERE percent < 70)
  SELECT part, Accident_Severity, sum(copies)::BIGINT AS n, count(DISTINCT Accident_Index) AS orders
  FROM rows WHERE copies > 0 GROUP BY ALL"""


def _model_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.model_report(spark, _trained(spark, sf).model).withColumn("value", big("value"))


def _categories_sql(present: list[str]) -> str:
    # One slot per known value of the training rows, and one for all others.
    known = [f"""nullif("{c}"::VARCHAR, '{P.MISSING_CODE}')""" if c in P.MISSING_CODE_COLUMNS else f'"{c}"' for c in present]
    return " + ".join(f"count(DISTINCT {k}) + 1" for k in known)


_CATEGORIES = [
    "Day_of_Week", "Road_Type", "Light_Conditions", "Weather_Conditions", "Road_Surface_Conditions", "Urban_or_Rural_Area",
    "1st_Road_Class", "Carriageway_Hazards", "Police_Force",
]
_REPORT_SQL = f"""WITH {CTE},
  placed AS (SELECT *, {_DIGEST_SQL.format(start=1)} % 100 AS percent,
    {_DIGEST_SQL.format(start=9)} / 4294967296::DOUBLE AS unit FROM accidents),
  counts AS (SELECT Accident_Severity, count(*) AS n FROM placed WHERE percent < 70 GROUP BY ALL),
  ratios AS (SELECT Accident_Severity,
    (SELECT n FROM counts WHERE Accident_Severity = 2)::DOUBLE / n AS ratio FROM counts),
  train AS (SELECT * FROM placed JOIN ratios USING (Accident_Severity) WHERE percent < 70 AND (ratio >= 1 OR unit < ratio))
  SELECT 'numTrees' AS param, {_SMALL.num_trees}::BIGINT AS value
  UNION ALL SELECT 'maxDepth', {_SMALL.max_depth}
  UNION ALL SELECT 'numFeatures', {len(P.MODEL_NUMERIC)} + {_categories_sql(_CATEGORIES)} FROM train
  UNION ALL SELECT 'numClasses', count(DISTINCT Accident_Severity) FROM train"""


def _label_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.label_mapping(spark, _trained(spark, sf).model, P.SEVERITY_NAMES)


def _tune(spark: SparkSession, sf: str) -> DataFrame:
    cfg = classify.ModelConfig(
        label="o_orderstatus",
        target="F",
        categorical=["o_orderpriority"],
        numeric=["o_totalprice"],
        key=["o_orderkey"],
        num_trees=3,
    )
    depths = [2, 4]
    search = classify.tune(table(spark, sf, "orders"), cfg, {"maxDepth": depths}, folds=2)
    return spark.createDataFrame(
        [(d, bool(0 < f1 <= 1)) for d, f1 in zip(depths, search.avgMetrics, strict=True)], "max_depth int, is_share boolean"
    )


QUERIES: dict[str, Query] = {
    "draws_with_replacement": Query(
        _draws_with_replacement, _draws_sql("quality", 0) + " SELECT doc_id, quality, copies FROM copied"
    ),
    "draws_of_rare_class": Query(
        _draws_of_rare_class,
        _draws_sql("toxic", 0) + " SELECT doc_id, toxic, unnest(range(1, copies + 1)) AS copy FROM copied",
    ),
    "sample_capped": Query(_sample_capped, _capped_sql("events", "event_id, value", ["event_id"], 1000)),
    "sample_capped_large": Query(
        _sample_capped_large,
        _capped_sql("lineitem", "l_orderkey, l_linenumber, l_extendedprice", ["l_orderkey", "l_linenumber"], 3000),
    ),
    "dictionary_index": Query(
        _dictionary_index,
        f"""SELECT o_orderkey, c.idx AS o_custkey_idx, p.idx AS o_orderpriority_idx FROM orders
        JOIN {_frequency_index_sql("orders", "o_custkey")} c ON c.v = o_custkey
        JOIN {_frequency_index_sql("orders", "o_orderpriority")} p ON p.v = o_orderpriority""",
    ),
    "category_dictionary": Query(
        _category_dictionary,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS count,
            row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) - 1 AS "index" FROM lineitem GROUP BY {c}"""
            for c in ("l_partkey", "l_returnflag", "l_orderkey")
        ),
    ),
    "class_counts": Query(_class_counts, "SELECT quality AS class, count(*) AS n FROM labels GROUP BY ALL"),
    "class_ratios": Query(
        _class_ratios,
        """SELECT quality AS class, count(*) AS n,
        round((SELECT count(*) FROM labels WHERE quality = 0)::DOUBLE / count(*), 6) AS ratio FROM labels GROUP BY ALL""",
    ),
    "copies_by_hash": Query(
        _copies_by_hash,
        _copies_sql("labels", "doc_id", "quality", "1") + " SELECT doc_id, quality, copies FROM copies",
    ),
    "balance_by_hash": Query(
        _balance_by_hash,
        _copies_sql("events", "event_id", "event_type", "'click'")
        + " SELECT event_id, event_type, unnest(generate_series(1, copies)) AS copy FROM copies",
    ),
    "balance_small_class": Query(
        _balance_small_class,
        _copies_sql("labels", "doc_id", "quality", "1")
        + """ SELECT quality, count(*) AS n, count(DISTINCT doc_id) AS docs, max(copy) AS most
        FROM (SELECT doc_id, quality, unnest(generate_series(1, copies)) AS copy FROM copies) GROUP BY ALL""",
    ),
    # Of random draws and fitted models SQL can say what holds for any of them; the tests check more.
    "balance": Query(_balance, "SELECT quality AS class, count(*) AS n, true AS near_target FROM labels GROUP BY ALL"),
    "split_by_hash": Query(
        _split_by_hash,
        """SELECT o_orderkey, CASE WHEN ('0x' || substr(md5('42:' || o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 70
        THEN 'train' ELSE 'test' END AS part FROM orders""",
    ),
    "split_random": Query(
        _split_random, "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS orders, true AS near_share FROM orders"
    ),
    "sample_points": Query(
        _sample_points,
        """SELECT count(*) AS n, 0::BIGINT AS "foreign", 0::BIGINT AS twice, true AS near_size FROM events
        WHERE event_id IS NOT NULL AND value IS NOT NULL""",
    ),
    "label_index": Query(
        _label_index,
        f"""SELECT o_orderkey, o_orderpriority, idx AS label
        FROM orders JOIN {_frequency_index_sql("orders", "o_orderpriority")} ON v = o_orderpriority""",
    ),
    "category_index": Query(
        _category_index,
        f"""SELECT o_orderkey, s.idx AS o_orderstatus_idx, p.idx AS o_orderpriority_idx
        FROM orders JOIN {_frequency_index_sql("orders", "o_orderstatus")} s ON s.v = o_orderstatus
        JOIN {_frequency_index_sql("orders", "o_orderpriority")} p ON p.v = o_orderpriority""",
    ),
    "impute_mean": Query(
        _impute_mean,
        """WITH means AS (SELECT avg(nullif(l_discount, 0)) AS d, avg(nullif(l_tax, 0)) AS t FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(coalesce(nullif(l_discount, 0), d), 6) AS l_discount_imputed,
        round(coalesce(nullif(l_tax, 0), t), 6) AS l_tax_imputed FROM lineitem, means""",
    ),
    "standardise": Query(
        _standardise,
        """WITH m AS (SELECT avg(value) AS mean, stddev_samp(value) AS sd FROM events)
        SELECT event_id, round((value - mean) / sd, 6) + 0.0 AS value_scaled FROM events, m""",
    ),
    "one_hot": Query(
        _one_hot,
        f"""SELECT o_orderkey, {", ".join(f"(idx = {i})::INT::DOUBLE AS slot{i}" for i in range(4))}
        FROM orders JOIN {_frequency_index_sql("orders", "o_orderstatus")} ON v = o_orderstatus""",
    ),
    "feature_vector": Query(
        _feature_vector,
        f"""WITH m AS (SELECT avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd FROM orders),
        l AS (SELECT o_orderpriority AS p, (row_number() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS label
          FROM orders GROUP BY o_orderpriority)
        SELECT o_orderkey, label, round((o_totalprice - mean) / sd, 6) + 0.0 AS f0,
        {", ".join(f"(idx = {i})::INT::DOUBLE AS f{i + 1}" for i in range(4))}
        FROM orders JOIN {_frequency_index_sql("orders", "o_orderstatus")} ON v = o_orderstatus
        JOIN l ON p = o_orderpriority, m""",
    ),
    "confusion_matrix": Query(
        _confusion, _RULED_SQL + " SELECT label, prediction, count(*) AS count FROM ruled GROUP BY ALL"
    ),
    "confusion_wide": Query(
        lambda s, d: evaluate.confusion_wide(_confusion(s, d), ["F", "O", "P"]),
        _RULED_SQL
        + " SELECT label, "
        + ", ".join(f"count(*) FILTER (WHERE prediction = '{k}') AS predicted_{k}" for k in "FOP")
        + " FROM ruled GROUP BY ALL",
    ),
    "class_scores": Query(
        lambda s, d: evaluate.class_scores(_confusion(s, d)).withColumns(
            {c: rounded(c) for c in ("precision", "recall", "f1")}
        ),
        _SCORES_SQL
        + """ SELECT class, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(f1, 6) AS f1 FROM rated""",
    ),
    "weighted_f1": Query(
        lambda s, d: evaluate.weighted_f1(_confusion(s, d)).withColumn("f1", rounded("f1")),
        _SCORES_SQL + " SELECT round(sum(support * f1) / sum(support), 6) AS f1 FROM rated",
    ),
    "prepare_model": Query(
        _prepare_model,
        f"""WITH {CTE} SELECT Accident_Severity, Urban_or_Rural_Area::BIGINT AS Area, coalesce(Hour, 0)::DOUBLE AS Hour,
        count(*) AS n, round(avg(Longitude), 4) + 0.0 AS longitude, sum(Month)::DOUBLE AS months
        FROM labelled WHERE Urban_or_Rural_Area <> -1 AND Longitude <> -1 AND Latitude <> -1
        AND Light_Conditions <> '-1' AND Weather_Conditions <> '-1' GROUP BY ALL""",
    ),
    "train_test": Query(_train_test, _TRAIN_TEST_SQL),
    "random_forest": Query(
        _random_forest,
        f"""WITH {CTE} SELECT (Accident_Severity - 1)::DOUBLE AS label, count(*) AS n, true AS known_classes FROM accidents
        WHERE {_DIGEST_SQL.format(start=1)} % 100 >= 70 GROUP BY ALL""",
    ),
    "prediction_support": Query(
        _prediction_support,
        f"""WITH {CTE} SELECT Accident_Severity, (Accident_Severity - 1)::DOUBLE AS label, count(*) AS n FROM accidents
        WHERE {_DIGEST_SQL.format(start=1)} % 100 >= 70 GROUP BY ALL""",
    ),
    "model_f1": Query(_model_f1, "SELECT count(*) > 0 AS as_evaluator, count(*) > 0 AS is_share FROM lineitem"),
    "model_report": Query(_model_report, _REPORT_SQL),
    "label_mapping": Query(
        _label_mapping,
        f"""WITH {CTE}, c AS (SELECT DISTINCT Accident_Severity AS code, Severity_Label AS name FROM labelled)
        SELECT (row_number() OVER (ORDER BY code) - 1)::DOUBLE AS "index", code::VARCHAR AS original, name FROM c""",
    ),
    "tune": Query(_tune, "SELECT d AS max_depth, count(*) > 0 AS is_share FROM orders, (VALUES (2), (4)) v(d) GROUP BY d"),
}
