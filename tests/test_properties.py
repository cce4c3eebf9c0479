"""Operators on skewed, random and fitted input, against brute force or known bounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import label_of
from tallyframe.operators import balance as b
from tallyframe.operators.box import box_stats
from tallyframe.operators.explore import corr_matrix, counts_over_domain, geo_density, region_trend, share
from tallyframe.operators.profile import (
    categorical_profile,
    distinct_report,
    distributions,
    pair_counts,
    top_k,
    top_per_group,
)
from tallyframe.operators.quantile import exact_quantiles
from tallyframe.workspace import settle, shared_dir

SF = "/root/testdata/sf0.01"
PROBS = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds more than half of the rows, and one value most of the group."""
    rows = [("hot", float(i % 977) ** 2) for i in range(6000)] + [("hot", 7.0)] * 6000
    rows += [("cold", float(i)) for i in range(40)] + [("one", -3.5)] + [("none", None), (None, 1.0)]
    return settle(spark.createDataFrame(rows, "g string, y double"))


@pytest.mark.parametrize("in_task", [10, 300, 1_000_000])
def test_quantiles_are_exact(skewed, in_task):
    values = {}
    for g, y in skewed.dropna().collect():
        values.setdefault(g, []).append(y)
    found = {r["g"]: r for r in exact_quantiles(skewed, "g", "y", PROBS, in_task).collect()}
    assert set(found) == set(values)
    for g, ys in values.items():
        assert found[g]["n"] == len(ys)
        np.testing.assert_allclose(found[g]["quantiles"], np.quantile(ys, PROBS), rtol=1e-12)


def test_quantiles_of_many_shapes(spark):
    rng = np.random.default_rng(7)
    shapes = [
        lambda n: rng.integers(0, 3, n) * 1.0,
        lambda n: np.exp(rng.normal(size=n) * 20),
        lambda n: np.where(rng.random(n) < 0.5, 7.0, rng.integers(0, 1000, n)),
        lambda n: np.where(rng.random(n) < 0.25, -1.0, np.where(rng.random(n) < 0.5, 0.0, rng.normal(size=n))),
    ]
    values = {g: shapes[g % 4](int(rng.integers(1, 1500))) for g in range(40)}
    rows = [(g, float(y)) for g, ys in values.items() for y in ys]
    df = settle(spark.createDataFrame(rows, "g int, y double"))
    for r in exact_quantiles(df, "g", "y", PROBS, 25).collect():
        np.testing.assert_allclose(r["quantiles"], np.quantile(values[r["g"]], PROBS), rtol=1e-9, atol=1e-12)


def test_quantiles_of_equal_values(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.lit(2.5).alias("y"))
    assert exact_quantiles(df, "g", "y", [0.25, 0.9], 10).first()["quantiles"] == [2.5, 2.5]


@pytest.mark.parametrize("in_task", [50, 1_000_000])
def test_boxes_against_brute_force(skewed, in_task):
    for r in box_stats(skewed, "g", "y", in_task=in_task).collect():
        ys = np.array([x["y"] for x in skewed.dropna().filter(F.col("g") == r["group"]).collect()])
        q1, median, q3 = np.quantile(ys, [0.25, 0.5, 0.75])
        inside = ys[(ys >= q1 - 1.5 * (q3 - q1)) & (ys <= q3 + 1.5 * (q3 - q1))]
        expected = [q1, median, q3, min(inside.min(), q1), max(inside.max(), q3)]
        np.testing.assert_allclose([r["q1"], r["median"], r["q3"], r["whisker_lo"], r["whisker_hi"]], expected, rtol=1e-12)
        assert r["n_outliers"] == len(ys) - len(inside)


def test_approximate_boxes_are_near(spark):
    events = table(spark, "events")
    exact = {r["group"]: r for r in box_stats(events, "event_type", "value").collect()}
    for r in box_stats(events, "event_type", "value", approx=True).collect():
        for name in ("q1", "median", "q3"):
            assert r[name] == pytest.approx(exact[r["group"]][name], rel=0.05)


def test_trend_with_a_hot_key(spark):
    orders = table(spark, "orders").withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(7)).otherwise(F.col("o_custkey"))
    )
    customer = table(spark, "customer")
    got = region_trend(orders, "c_nationkey", "o_orderdate", via=[(customer, "o_custkey", "c_custkey")])
    plain = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy(F.col("c_nationkey").alias("region"), F.year("o_orderdate").cast("bigint").alias("year"))
        .count()
    )
    assert sorted(got.collect()) == sorted(plain.collect())


def test_counts_add_up(spark):
    orders = table(spark, "orders")
    n = orders.count()
    assert share(orders, "o_orderstatus").agg(F.sum("count")).first()[0] == n
    assert distributions(orders, {"o_orderstatus": "S"}).agg(F.sum("count")).first()[0] == n
    cells = geo_density(table(spark, "customer"), "c_acctbal", "c_nationkey", 100.0)
    assert cells.agg(F.sum("count")).first()[0] == table(spark, "customer").count()


def test_null_is_a_value(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", -0.0), (None, 1.0)], "s string, d double")
    rows = {r["column"]: (r["n_distinct"], r["n_distinct_not_null"]) for r in distinct_report(df, ["s", "d"]).collect()}
    assert rows == {"s": (2, 1), "d": (2, 2)}
    assert [tuple(r) for r in top_k(df, "s", 5).collect()] == [("a", 2), (None, 1)]


def test_domain_keeps_absent_members(spark):
    df = spark.createDataFrame([("x",), ("x",), ("other",), (None,)], "s string")
    assert [tuple(r) for r in counts_over_domain(df, "s", ["y", "x"]).collect()] == [(0, "y", None), (1, "x", 2)]


def test_approximate_distinct_is_near(spark):
    items = table(spark, "lineitem")
    cols = ["l_orderkey", "l_suppkey", "l_returnflag"]
    exact = {r["column"]: r["n_distinct"] for r in distinct_report(items, cols).collect()}
    for r in distinct_report(items, cols, approx=True).collect():
        assert r["n_distinct"] == pytest.approx(exact[r["column"]], rel=0.15)


def test_top_values_are_cut_before_the_shuffle(spark):
    plan = categorical_profile(table(spark, "lineitem"), ["l_orderkey", "l_tax"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_top_per_group_with_large_k(spark):
    counts = pair_counts(table(spark, "lineitem"), ["l_partkey", "l_returnflag"])
    order = [F.desc("count"), F.asc("value")]
    many = top_per_group(counts, ["column"], order, 1200).filter("rank <= 50")
    few = top_per_group(counts, ["column"], order, 50)
    assert sorted(many.collect()) == sorted(few.collect())


def test_one_scan_per_profile(spark):
    df = categorical_profile(table(spark, "lineitem"), ["l_suppkey", "l_tax"])
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_filter_and_columns_reach_the_scan(spark):
    from tallyframe.operators.clean import filter_isin, filter_positive

    plan = filter_positive(table(spark, "events").select("event_id", "value"), "value")._jdf.queryExecution().toString()
    assert "GreaterThan(value,0.0)" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan
    plan = filter_isin(table(spark, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])._jdf.queryExecution().toString()
    assert "In(o_orderpriority" in plan


def test_correlation_against_numpy(spark):
    items = table(spark, "lineitem").withColumn("twice", F.col("l_quantity") * 2 - F.col("l_tax") * 30)
    items = items.withColumn("gap", F.when(F.col("l_linenumber") > 2, F.col("l_discount")))
    cols = ["l_quantity", "twice", "gap"]
    rows = {(r["a"], r["b"]): r["r"] for r in corr_matrix(items, cols).collect()}
    data = np.array(items.select(*cols).dropna().collect(), dtype=float)
    expected = np.corrcoef(data.T)
    for i, x in enumerate(cols):
        for j, y in enumerate(cols):
            assert rows[x, y] == pytest.approx(expected[i, j], abs=1e-9)
            assert rows[x, y] == rows[y, x]


def test_correlation_of_almost_nothing(spark):
    df = spark.sql("SELECT 1.0D AS a, 2.0D AS b")
    assert [r["r"] for r in corr_matrix(df, ["a", "b"]).collect()] == [None] * 4
    assert [r["r"] for r in corr_matrix(df.limit(0), ["a", "b"]).collect()] == [None] * 4


def test_random_balance(spark):
    labels = table(spark, "events")
    counts = {r["class"]: r["n"] for r in b.class_counts(labels, "event_type").collect()}
    target = counts["view"]
    for r in b.class_counts(b.balance(labels, "event_type", "view"), "event_type").collect():
        assert abs(r["n"] - target) <= (0 if r["class"] == "view" else 4 * math.sqrt(target))


def test_balance_both_ways(spark):
    labels = table(spark, "labels")
    few, many = (labels.filter(F.col("quality") == q).count() for q in (0, 1))
    for target, size in ((0, few), (1, many)):
        for df in (b.balance(labels, "quality", target), b.balance_by_hash(labels, ["doc_id"], "quality", target)):
            for r in b.class_counts(df, "quality").collect():
                assert abs(r["n"] - size) <= 5 * math.sqrt(size) * math.sqrt(max(size / few, 1))


def test_unknown_target_raises(spark):
    for f in (b.balance, lambda d, c, t: b.balance_by_hash(d, ["doc_id"], c, t)):
        with pytest.raises(ValueError, match="no rows of class 9"):
            f(table(spark, "labels"), "quality", 9)


def test_balancing_does_not_shuffle_the_rows(spark):
    out = b.balance_by_hash(table(spark, "events"), ["event_id"], "event_type", "view")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_many_copies_of_one_row(spark):
    rows = spark.range(3001).select("id", F.when(F.col("id") == 0, "few").otherwise("many").alias("c"))
    out = b.balance_by_hash(rows, ["id"], "c", "many")
    few = out.filter(F.col("c") == "few")
    assert few.count() == 3000 and few.select("copy").distinct().count() == 3000
    assert few.agg(F.max("copy"), F.min("copy")).first() == (3000, 1)
    assert out.filter(F.col("c") == "many").count() == 3000


def test_hash_forms_do_not_depend_on_partitions(spark):
    events = table(spark, "events").select("event_id", "event_type")
    for f in (
        lambda d: b.balance_by_hash(d, ["event_id"], "event_type", "view"),
        lambda d: b.split_by_hash(d, ["event_id"])[0],
    ):
        assert sorted(f(events).collect()) == sorted(f(events.repartition(5)).collect())


def test_split_is_disjoint_and_complete(spark):
    orders = table(spark, "orders").select("o_orderkey")
    for train, test in (b.split_by_hash(orders, ["o_orderkey"]), b.split_random(orders)):
        n = train.count()
        assert train.intersect(test).count() == 0 and n + test.count() == orders.count()
        assert abs(n - 0.7 * orders.count()) <= 4 * math.sqrt(0.21 * orders.count())


def test_sample(spark):
    events = table(spark, "events")
    n = events.count()
    sample = b.sample_points(events, ["event_id", "value"], 0.1)
    assert abs(sample.count() - 0.1 * n) <= 4 * math.sqrt(0.09 * n)
    assert sample.join(events, "event_id").count() == sample.count()
    # Not the first partitions: the sample reaches over the whole table.
    assert sample.agg(F.max("event_id")).first()[0] > 0.8 * n


def test_balance_of_many_classes(spark):
    rows = spark.range(30_000).withColumn("label", F.when(F.col("id") < 5, F.lit(0)).otherwise(F.col("id") % 5000 + 1))
    counts = b.class_counts(b.balance(rows, "label", 0), "label")
    assert counts.count() > 4900 and counts.agg(F.max("n")).first()[0] <= 7


def test_quantiles_between_infinities(spark):
    rows = spark.createDataFrame([("a", v) for v in (1.0, math.inf, math.inf, math.inf)], "g string, v double")
    assert exact_quantiles(rows, "g", "v", [0.5, 0.9]).first()["quantiles"] == [math.inf, math.inf]


def test_trend_counts_rows_of_no_region(spark):
    orders, customer = table(spark, "orders"), table(spark, "customer")
    some = customer.filter("c_custkey % 3 <> 0")
    got = region_trend(orders, "c_nationkey", "o_orderdate", via=[(some, "o_custkey", "c_custkey")])
    assert got.agg(F.sum("count")).first()[0] == orders.count() and got.filter("region is null").count() > 0


def test_label_of_no_codes(spark):
    assert spark.range(1).select(label_of(F.col("id"), T.LongType(), {}, "other")).first()[0] == "other"


class _Session:
    def __init__(self, **settings):
        self.conf = {k.replace("_", "."): v for k, v in settings.items()}


def test_cluster_without_shared_dir_raises():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session(spark_master="yarn", spark_app_id="a"))
    assert shared_dir(_Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///tmp/x/")) == "hdfs:///tmp/x"
    local = _Session(spark_master="local[2]", spark_app_id="b")
    assert shared_dir(local) == shared_dir(local)


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
