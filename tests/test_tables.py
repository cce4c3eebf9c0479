"""Draws, capped samples, dictionaries, sketches, wide correlation, repeatable and bucketed storage, checked scans."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.catalog import exploration
from tallyframe.functions.columns import unused
from tallyframe.functions.hashing import hash_order
from tallyframe.operators import balance as b
from tallyframe.operators import sketches
from tallyframe.operators.dictionary import category_dictionary, index_by_dictionary, index_values
from tallyframe.operators.explore import corr_matrix, region_trend
from tallyframe.operators.features import index_categories
from tallyframe.operators.profile import categorical_profile
from tallyframe.operators.rank import with_position, with_running_total
from tallyframe.sources.csv import scan_checked
from tallyframe.sources.tables import bucketed, ingest, ingest_again, ingest_checked, open_bucketed
from tallyframe.workspace import shared_dir

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def classes(spark, n=40_000):
    return spark.range(n).withColumn("c", F.when(F.col("id") % 80 == 0, 1).when(F.col("id") % 7 == 0, 2).otherwise(3))


# positions


def test_positions(spark):
    rows = spark.range(5000).withColumn("v", F.col("id") * 7919 % 101)
    got = with_position(rows.repartition(7), [F.desc("v"), F.asc("id")]).collect()
    want = sorted(got, key=lambda r: (-r["v"], r["id"]))
    assert [r["position"] for r in want] == list(range(1, 5001))
    summed = sorted(with_running_total(rows, [F.asc("v"), F.asc("id")], "id", "before").collect(), key=lambda r: (r["v"], r["id"]))
    assert [r["before"] for r in summed] == [sum(r["id"] for r in summed[:n]) for n in range(5000)]
    assert with_position(rows.limit(0), [F.asc("v")]).collect() == []


def test_unused_names(spark):
    frame = spark.range(1).selectExpr("id", "id as At", "id as _at")
    assert unused(frame, "at", "at", "other") == ["__at", "___at", "other"]


# draws with replacement


def test_draws_are_poisson(spark):
    drawn = b.draws_by_hash(classes(spark), ["id"], "c", 3)
    ratios = {r["class"]: r["ratio"] for r in b.class_ratios(classes(spark), "c", 3).collect()}
    for c, n, mean, variance in drawn.groupBy("c").agg(F.count("*"), F.avg("copies"), F.variance("copies")).collect():
        if c == 3:
            assert (mean, variance) == (1, 0)
        else:
            assert abs(mean - ratios[c]) < 4 * math.sqrt(ratios[c] / n)
            assert abs(variance - ratios[c]) < 0.25 * ratios[c]
    # as in a draw with replacement, rows of class 2 may be missing or come often
    of_two = Counter(r["copies"] for r in drawn.filter("c = 2").collect())
    n, mean = sum(of_two.values()), ratios[2]
    for k in (0, 2, 5, 9):
        p = math.exp(-mean) * mean**k / math.factorial(k)
        assert abs(of_two[k] - n * p) < 5 * math.sqrt(n * p) + 1
    again = b.draws_by_hash(classes(spark).repartition(5), ["id"], "c", 3)
    assert again.exceptAll(drawn).isEmpty() and drawn.exceptAll(again).isEmpty()
    other = b.draws_by_hash(classes(spark), ["id"], "c", 3, seed=7)
    assert not other.exceptAll(drawn).isEmpty()


def test_draws_make_copies(spark):
    drawn = b.draws_by_hash(classes(spark), ["id"], "c", 3).filter("copies > 0")
    copies = b.balance_by_draws(classes(spark), ["id"], "c", 3)
    counted = copies.groupBy("id", "c").agg(F.count("*").alias("copies"), F.max("copy").alias("last"))
    assert counted.filter("copies <> last").isEmpty()
    assert counted.select("id", "c", "copies").exceptAll(drawn).isEmpty() and counted.count() == drawn.count()


def test_draws_of_a_very_rare_class(spark, monkeypatch):
    monkeypatch.setattr(b, "_COPIES_IN_TASK", 120)
    rows = spark.range(4000).withColumn("c", F.when(F.col("id") < 3, 1).otherwise(2))
    copies = b.balance_by_draws(rows, ["id"], "c", 2)
    per_row = {r["id"]: r["count"] for r in copies.filter("c = 1").groupBy("id").count().collect()}
    assert set(per_row) == {0, 1, 2} and abs(sum(per_row.values()) - 3997) < 5 * math.sqrt(3997)
    assert copies.filter("c = 2").count() == 3997


def test_draws_leave_out_rows_without_a_label(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "class long, parts string")
    drawn = b.draws_by_hash(rows, ["class"], "parts", "a")
    assert drawn.columns == ["class", "parts", "copies"] and {r["class"] for r in drawn.collect()} == {2, 3}
    with pytest.raises(ValueError, match="no rows of class"):
        b.draws_by_hash(rows, ["class"], "parts", "z")


# capped samples


@pytest.mark.parametrize("cap, in_task", [(0, 10), (7, 100), (7, 3), (2999, 50), (3000, 50), (9999, 50), (2990, 1)])
def test_capped_sample(spark, cap, in_task):
    rows = spark.range(3000).withColumn("at", F.lit("x"))
    got = b.sample_capped(rows.repartition(3), ["id"], cap, in_task=in_task)
    assert got.columns == rows.columns
    want = rows.orderBy(hash_order(["id"], 42), "id").limit(cap)
    assert got.count() == min(cap, 3000) and got.exceptAll(want).isEmpty()


def test_capped_sample_is_uniform(spark):
    got = [r["id"] for r in b.sample_capped(spark.range(100_000), ["id"], 5000, in_task=300).collect()]
    assert all(abs(sum(x // 10_000 == d for x in got) - 500) < 5 * math.sqrt(450) for d in range(10))


def test_capped_sample_of_equal_keys(spark):
    rows = spark.range(1000).withColumn("k", F.lit(1))
    got = b.sample_capped(rows, ["k"], 40, in_task=10)
    assert sorted(r["id"] for r in got.collect()) == list(range(40))


def test_points_with_a_cap(spark):
    rows = spark.range(10_000).selectExpr("id", "cast(id % 3 as double) as x", "if(id % 5 = 0, null, 1.0) as y")
    assert b.sample_points(rows, ["x", "y"], 0.5, cap=100).count() == 100
    assert b.sample_points(rows, ["x", "y"], 0.5, cap=100, key=["id"]).columns == ["x", "y"]
    assert b.sample_points(rows, ["x", "y"], 0.5, cap=10**6).count() > 3500


# dictionaries


def test_dictionary_of_a_million_values(spark):
    rows = spark.range(1_000_000).selectExpr("cast(id as string) as v").union(spark.range(500_000).selectExpr("'hot' as v"))
    made = category_dictionary(rows, ["v"])
    assert made.filter("value = 'hot'").first()["index"] == 0
    assert made.agg(F.count("*"), F.countDistinct("index"), F.max("index")).first()[:] == (1_000_001, 1_000_001, 1_000_000)
    indexed = index_by_dictionary(rows, made, ["v"])
    assert indexed.filter("v_idx = 0").count() == 500_000 and indexed.agg(F.countDistinct("v_idx")).first()[0] == 1_000_001
    some = made.filter("index between 1 and 5").orderBy("index").collect()
    assert [r["value"] for r in some] == ["0", "1", "10", "100", "1000"]


def test_dictionary_gives_the_indices_of_the_indexer(spark):
    orders = table(spark, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").alias("text"))
    cols = ["o_orderpriority", "text"]
    rows = orders.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderpriority")))
    theirs, ours = index_categories(rows, cols), index_values(rows, cols)
    assert ours.columns == theirs.columns
    assert ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty()
    seen = category_dictionary(rows.filter("text < 50"), ["text"])
    n = seen.count()
    assert index_by_dictionary(rows, seen, ["text"]).filter("text >= 50").select("text_idx").distinct().collect() == [(float(n),)]


# sketches


def test_quantile_sketches_merge(spark):
    rows = spark.range(200_000).selectExpr("id % 30 as day", "id % 2 as g", "pmod(id * 7919, 200000) / 2.0 as y")
    rows = rows.unionByName(spark.sql("select 1L as day, 0L as g, cast(null as double) as y union all select 1, 0, double('nan')"))
    daily = sketches.quantile_sketches(rows, ["day", "g"], "y")
    merged = sketches.merged_quantiles(daily, ["g"], [0.1, 0.5, 0.99])
    for r in merged.collect():
        assert r["n"] == 100_000
        for p, q in zip((0.1, 0.5, 0.99), r["quantiles"]):
            rank = rows.filter((F.col("g") == r["g"]) & (F.col("y") <= q) & ~F.isnan("y")).count() / 100_000
            assert abs(rank - p) < sketches.RANK_ERROR


def test_distinct_sketches_unite(spark):
    rows = spark.range(60_000).selectExpr("id % 20 as day", "id % 9000 as a", "if(id % 3 = 0, null, id % 11) as b")
    daily = sketches.distinct_sketches(rows, ["a", "b"], ["day"])
    assert daily.count() == 40
    got = {r["column"]: r for r in sketches.distinct_estimates(daily).collect()}
    assert abs(got["a"]["n_distinct"] - 9000) < 5 * 1.04 / 64 * 9000 and got["b"]["n_distinct"] == 12
    assert got["b"]["n_distinct_not_null"] == 11 and got["a"]["n_rows"] == 60_000
    more = daily.unionByName(daily.filter("day < 3"))  # a day that is united twice changes no estimate
    assert {r["column"]: r["n_distinct"] for r in sketches.distinct_estimates(more).collect()} == {
        c: r["n_distinct"] for c, r in got.items()
    }


def test_frequent_values_where_they_are_sure(spark):
    hot = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, "warm").when(F.col("id") % 11 == 0, F.lit(None))
    rows = spark.range(100_000).select(hot.otherwise(F.col("id").cast("string")).alias("many"), (F.col("id") % 4).alias("few"))
    got = sketches.frequent_values(rows, ["many", "few"], 3).collect()
    exact = categorical_profile(rows, ["many", "few"], 3).collect()
    want = {(r["column"], r["rank"], r["value"], r["count"]) for r in exact}
    assert {(r["column"], r["rank"], r["value"], r["count"]) for r in got} == want and all(r["certain"] for r in got)


def test_frequent_values_say_when_they_are_not_sure(spark):
    rows = spark.range(50_000).selectExpr("id as v", "'' as e")
    got = sketches.frequent_values(rows, ["v", "e"], 2, tracked=64).collect()
    assert {(r["n_rows"], r["certain"]) for r in got if r["column"] == "v"} == {(50_000, False)}
    assert [(r["value"], r["count"], r["certain"]) for r in got if r["column"] == "e"] == [("", 50_000, True)]


# correlation


def test_wide_correlation(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 120)) @ rng.normal(size=(120, 120)) + 1e6
    data[:, 7] = 0.1
    frame = spark.createDataFrame(data.tolist(), T.StructType([T.StructField(f"c{i}", T.DoubleType()) for i in range(120)]))
    got = {(r["a"], r["b"]): r["r"] for r in corr_matrix(frame, frame.columns).collect()}
    with np.errstate(invalid="ignore"):
        want = np.corrcoef(data.T)
    for i in range(120):
        for j in range(120):
            if 7 in (i, j):
                assert got[f"c{i}", f"c{j}"] is None
            else:
                assert got[f"c{i}", f"c{j}"] == pytest.approx(want[i, j], abs=1e-9)


def test_correlation_of_no_rows(spark):
    frame = spark.createDataFrame([(1.0, None), (None, 2.0)], "x double, y double")
    assert [r["r"] for r in corr_matrix(frame, ["x", "y"]).collect()] == [None] * 4
    one = spark.createDataFrame([(1.0, 3.0)], "x double, y double")
    assert [r["r"] for r in corr_matrix(one, ["x", "y"]).collect()] == [None] * 4


def test_correlation_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = spark.range(0, 5000, 1, 7).selectExpr("id + 1e6D AS x", "-2e0D * id AS y").mapInArrow(count, "x double, y double")
    got = {(r["a"], r["b"]): r["r"] for r in corr_matrix(frame, frame.columns).collect()}
    assert got["x", "y"] == pytest.approx(-1.0) and seen.value == 5000


def test_correlation_over_tasks_that_differ(spark):
    # Sorted, so that no task has the common mean; in other columns little spread, gaps, and one value without a bound.
    frame = spark.range(0, 4000, 1, 16).select(
        (F.col("id") + 1e6).alias("far"),
        (F.sin("id") * 1e-8).alias("small"),
        F.when(F.col("id") % 100 < 99, F.col("id") % 13).alias("gaps"),
        F.when(F.col("id") == 5, F.lit(math.inf)).otherwise(F.col("id")).alias("endless"),
    )
    frame = frame.filter("far < 1001000 OR far > 1003000")  # some tasks have no rows
    got = {(r["a"], r["b"]): r["r"] for r in corr_matrix(frame, frame.columns).collect()}
    data = np.array(frame.dropna().collect(), dtype=float)
    want = np.corrcoef(data[:, :3].T)
    for i, a in enumerate(frame.columns[:3]):
        assert [got[a, b] for b in frame.columns[:3]] == pytest.approx(list(want[i]), abs=1e-9)
        assert math.isnan(got[a, "endless"]) and math.isnan(got["endless", a])


# storage


def test_ingest_again_replaces_what_it_has(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(300).selectExpr("id", "id % 3 as year")
    ingest(rows, path, ["year"])
    files = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "year=0").iterdir()}
    for _ in range(2):
        again = ingest_again(rows.filter("year = 1"), path, ["year"])
        assert again.count() == 300
    new = ingest_again(spark.range(5).selectExpr("id", "if(id < 2, 2L, 9L) as year"), path, ["year"])
    assert {r["year"]: r["count"] for r in new.groupBy("year").count().collect()} == {0: 100, 1: 100, 2: 2, 9: 3}
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "year=0").iterdir()} == files


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    orders = bucketed(table(spark, "orders"), str(tmp_path / "o"), ["o_custkey"], 4)
    bucketed(table(spark, "customer"), str(tmp_path / "c"), ["c_custkey"], 4)
    customers = open_bucketed(spark, str(tmp_path / "c"), table(spark, "customer").schema, ["c_custkey"], 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        trend = region_trend(orders, "c_nationkey", "o_orderdate", via=[(customers, "o_custkey", "c_custkey")])
        plan = trend._jdf.queryExecution().executedPlan().toString()
        below_join = plan[plan.index("SortMergeJoin") :]
        assert "Exchange" not in below_join and "Exchange" in plan
        want = region_trend(
            table(spark, "orders"), "c_nationkey", "o_orderdate", via=[(table(spark, "customer"), "o_custkey", "c_custkey")]
        )
        assert trend.collect() == want.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


LINES = ["k,n,d,t", '1,2.5,2020-01-01,"a,b"', "x,1,2020-01-02,bad k", "3,,2020-01-03,empty n", "4,1,oops,bad d", "5,1", "6,1,,a,b"]


def test_good_and_bad_rows_side_by_side(spark, tmp_path):
    (tmp_path / "in.csv").write_text("\n".join(LINES))
    types = T.StructType.fromDDL("k int, n double, d date")
    checked = scan_checked(spark, str(tmp_path / "in.csv"), types)
    good, bad, counts = ingest_checked(checked, str(tmp_path / "out"))
    assert [(r["k"], r["n"], str(r["d"]), r["t"]) for r in good.orderBy("k").collect()] == [
        (1, 2.5, "2020-01-01", "a,b"), (3, None, "2020-01-03", "empty n"),
    ]
    assert good.schema["d"].dataType == T.DateType()
    assert counts == {"rows": 6, "line": 2, "k": 1, "d": 1}
    assert {(r["cause"], r["line"]) for r in bad.collect()} == {
        ("k", "x,1,2020-01-02,bad k"), ("d", "4,1,oops,bad d"), ("line", "5,1"), ("line", "6,1,,a,b"),
    }


def test_checked_scan_infers_types_in_spite_of_bad_fields(spark, tmp_path):
    lines = ["_line,row_status,when"] + [f"{n},{n / 4},2020-01-01 00:00:{n % 60:02d}" for n in range(500)]
    lines[7], lines[9] = "none,1.5,2020-01-01 00:00:00", "8,1.5,never"
    (tmp_path / "in.csv").write_text("\n".join(lines))
    checked = scan_checked(spark, str(tmp_path / "in.csv"), infer=True)
    good, bad, counts = ingest_checked(checked, str(tmp_path / "out"))
    assert [f.dataType.simpleString() for f in good.schema] == ["bigint", "double", "timestamp_ntz"]
    assert counts == {"rows": 500, "_line": 1, "when": 1} and good.count() == 498
    assert {r["cause"] for r in bad.collect()} == {"_line", "when"}
    strict = scan_checked(spark, str(tmp_path / "in.csv"), infer=True, tolerance=1.0)
    assert [f.dataType.simpleString() for f in strict.rows.schema][:3] == ["string", "double", "string"]


def test_checked_scan_of_no_bad_rows(spark, tmp_path):
    (tmp_path / "in.csv").write_text("k,t\n1,a\n")
    good, bad, counts = ingest_checked(scan_checked(spark, str(tmp_path / "in.csv")), str(tmp_path / "out"), ["t"])
    assert good.collect() == [("1", "a")] and bad.collect() == [] and counts == {"rows": 1}
    (tmp_path / "none.csv").write_text("k,t\n")
    good, bad, counts = ingest_checked(scan_checked(spark, str(tmp_path / "none.csv"), infer=True), str(tmp_path / "out2"))
    assert good.collect() == [] and bad.collect() == [] and counts == {"rows": 0}


def test_wide_correlation_writes_no_table(spark):
    folder = Path(shared_dir(spark))
    before = {p for p in folder.rglob("*") if p.is_file()}
    assert exploration.QUERIES["corr_wide"].run(spark, SF).count() == 200 * 200
    written = sum(p.stat().st_size for p in folder.rglob("*") if p.is_file() and p not in before)
    assert written < Path(f"{SF}/lineitem.parquet").stat().st_size


def test_gaps_of_derived_columns_leave_their_rows_out(spark):
    frame = spark.range(6).select(
        F.col("id").cast("double").alias("x"),
        F.when(F.col("id") != 2, F.when(F.col("id") == 3, float("nan")).otherwise(-2.0 * F.col("id"))).alias("y"),
        F.expr("CASE id WHEN 2 THEN 100 WHEN 3 THEN -100 ELSE id END").alias("z"),
    )
    got = {(r["a"], r["b"]): r["r"] for r in corr_matrix(frame, frame.columns).collect()}
    assert got["x", "z"] == pytest.approx(1.0) and got["y", "z"] == pytest.approx(-1.0)
