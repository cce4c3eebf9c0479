"""Profiles: counts, missing and distinct values, frequent values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.catalog import Query, big, rounded, table
from tallyframe.catalog.accidents import CTE, accidents
from tallyframe import presets as P
from tallyframe.operators import profile, sketches
from tallyframe.operators.clean import sentinel_to_null
from tallyframe.plans.quality import quality
from tallyframe.workspace import settle


def _null_report(spark: SparkSession, sf: str) -> DataFrame:
    items = sentinel_to_null(table(spark, sf, "lineitem"), ["l_discount", "l_tax"], 0.0)
    quantity = F.when(F.col("l_quantity") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return profile.null_report(items.withColumn("l_quantity", quantity)).withColumn("null_pct", rounded("null_pct"))


def _distinct_report(spark: SparkSession, sf: str, approx: bool = False) -> DataFrame:
    items = sentinel_to_null(table(spark, sf, "lineitem"), ["l_tax"], 0.0)
    return profile.distinct_report(items, ["l_orderkey", "l_suppkey", "l_tax", "l_shipdate", "l_returnflag"], approx)


def _distinct_report_approx(spark: SparkSession, sf: str) -> DataFrame:
    # Whether an estimate is within four of its standard deviations of 5 %.
    exact = _distinct_report(spark, sf).select("column", F.col("n_distinct").alias("n"))
    near = F.abs(F.col("n_distinct") - F.col("n")) <= 0.2 * F.col("n")
    return _distinct_report(spark, sf, approx=True).join(exact, "column").select("column", near.alias("near"))


_SKETCHED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def _distinct_stored(spark: SparkSession, sf: str) -> DataFrame:
    # One sketch a month, united; beside it the union of another division of the same rows, and the exact numbers.
    orders = table(spark, sf, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    of_months = settle(sketches.distinct_sketches(orders, _SKETCHED, ["month"]), "monthly")
    of_states = settle(sketches.distinct_sketches(orders, _SKETCHED, ["o_orderpriority"]), "by-priority")
    exact = profile.distinct_report(orders, _SKETCHED).select("column", F.col("n_distinct").alias("n"))
    other = sketches.distinct_estimates(of_states).select("column", F.col("n_distinct").alias("other"))
    joined = sketches.distinct_estimates(of_months).join(other, "column").join(exact, "column")
    # five standard errors of a union
    error = 5 * 1.04 / 2 ** (sketches.DISTINCT_LG_K / 2) * F.col("n")
    near, agrees = (F.abs(F.col("n_distinct") - F.col(c)) <= error for c in ("n", "other"))
    return joined.select("column", "n_rows", near.alias("near"), agrees.alias("agrees_with_other_division"))


def _quantiles_stored(spark: SparkSession, sf: str) -> DataFrame:
    # One sketch a day and type, merged by type; the exact rank of each answer is counted and compared.
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    daily = settle(sketches.quantile_sketches(events, ["day", "event_type"], "value"), "daily")
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    merged = settle(sketches.merged_quantiles(daily, ["event_type"], probs), "merged")
    known = events.select("event_type", F.col("value").cast("double").alias("y")).filter("y is not null and not isnan(y)")
    at = [F.get("quantiles", F.lit(i)) for i in range(len(probs))]
    ranks = known.join(merged, "event_type").groupBy("event_type", "n").agg(
        *[F.struct(F.count_if(F.col("y") < q), F.count_if(F.col("y") <= q)).alias(f"r{i}") for i, q in enumerate(at)]
    )
    error = sketches.RANK_ERROR * F.col("n")
    near = [
        F.col(f"r{i}.col1") <= p * F.col("n") + error if right else F.col(f"r{i}.col2") >= p * F.col("n") - error
        for i, p in enumerate(probs)
        for right in (True, False)
    ]
    inside = near[0]
    for n in near[1:]:
        inside = inside & n
    return ranks.select("event_type", "n", inside.alias("near"))


_FREQUENT = ["l_returnflag", "l_linenumber", "l_quantity", "l_suppkey", "l_orderkey"]


def _frequent_values(spark: SparkSession, sf: str) -> DataFrame:
    # Where the summary cannot be sure, the result says so, and the candidates are left out.
    top = sketches.frequent_values(table(spark, sf, "lineitem"), _FREQUENT)
    sure = [F.when(F.col("certain"), F.col(c)).alias(c) for c in ("rank", "value", "count")]
    return top.select("column", "n_rows", *sure, "certain").distinct().withColumn("rank", big("rank"))


def _frequent_sql(cols: list[str]) -> str:
    share = f"(1 / {sketches.TRACKED // 2}::DOUBLE + 7 / {sketches.TRACKED}::DOUBLE)"
    return f"""WITH pairs AS ({_pairs_sql("lineitem", cols)}),
    totals AS (SELECT "column", sum(count)::BIGINT AS n_rows, count(*) AS n_distinct FROM pairs GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value NULLS LAST) AS rank FROM pairs),
    top AS (SELECT *, min(count) OVER w AS last, count(*) OVER w AS found FROM ranked JOIN totals USING ("column")
      WHERE rank <= 5 WINDOW w AS (PARTITION BY "column")),
    sure AS (SELECT *, n_distinct <= {sketches.TRACKED // 2} OR found = 5 AND last > n_rows * {share} AS certain FROM top)
    SELECT DISTINCT "column", n_rows, CASE WHEN certain THEN rank END AS rank, CASE WHEN certain THEN value END AS value,
      CASE WHEN certain THEN count END AS count, certain FROM sure"""


def _categorical_profile(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    cols = ["p_brand", "p_type", "p_name", "p_size"]
    return profile.categorical_profile(part, cols, 5).withColumn("rank", big("rank"))


def _top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    # More rows per group than the engine cuts down by itself in the map tasks.
    counts = profile.pair_counts(table(spark, sf, "lineitem"), ["l_partkey", "l_orderkey"])
    ranked = profile.top_per_group(counts, ["column"], [F.desc("count"), F.asc_nulls_last("value")], 1500)
    return ranked.withColumn("rank", big("rank"))


def _column_overview(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    out = profile.column_overview(orders)
    return out.withColumns({"ordinal": big("ordinal"), "null_pct": rounded("null_pct")})


def _distributions(spark: SparkSession, sf: str) -> DataFrame:
    titles = {"o_orderstatus": "Status", "o_orderpriority": "Priority"}
    return profile.distributions(table(spark, sf, "orders"), titles)


def _quality(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return quality(accidents(spark, sf))[name]

    return run


_PROFILE_PRESENT = [
    "Police_Force", "Accident_Severity", "Number_of_Vehicles", "Number_of_Casualties", "Day_of_Week",
    "Local_Authority_(District)", "1st_Road_Class", "Road_Type", "Speed_limit", "Light_Conditions",
    "Weather_Conditions", "Road_Surface_Conditions", "Carriageway_Hazards", "Urban_or_Rural_Area",
    "Did_Police_Officer_Attend_Scene_of_Accident",
]


def _pairs_sql(source: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST("{c}" AS VARCHAR) AS value, count(*) AS count FROM {source} GROUP BY ALL"""
        for c in cols
    )


def _profile_sql(pairs: str, k: int, ctes: str = "") -> str:
    return f"""WITH {ctes} pairs AS ({pairs}),
    totals AS (SELECT "column", sum(count)::BIGINT AS n_rows, count(*) AS n_distinct FROM pairs GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value NULLS LAST) AS rank FROM pairs)
    SELECT "column", n_rows, n_distinct, rank, value, count FROM ranked JOIN totals USING ("column") WHERE rank <= {k}"""


def distributions_sql(source: str, titles: dict[str, str], ctes: str = "") -> str:
    cases = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in titles.items())
    return f"""WITH {ctes} pairs AS ({_pairs_sql(source, list(titles))})
    SELECT "column" AS dimension, CASE "column" {cases} END AS title, value, count,
      max(count) OVER (PARTITION BY "column") AS max_count FROM pairs"""


def _nulls_sql(source: str, missing: dict[str, str], ctes: str = "") -> str:
    rows = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {p}) AS nulls,
        round(100.0 * count(*) FILTER (WHERE {p}) / count(*)::DOUBLE, 6) AS null_pct FROM {source}"""
        for c, p in missing.items()
    )
    return f"WITH {ctes} one AS (SELECT 1) {rows}"


_LINE_COLUMNS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]
_ACCIDENT_COLUMNS = ["Date", "Day_of_Week", "Accident_Severity", "Time", "Year", *_PROFILE_PRESENT[:1]]

QUERIES: dict[str, Query] = {
    "distinct_stored": Query(
        _distinct_stored,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) AS n_rows, true AS near, true AS agrees_with_other_division FROM orders"""
            for c in _SKETCHED
        ),
    ),
    "quantiles_stored": Query(
        _quantiles_stored,
        """SELECT event_type, count(*) AS n, true AS near FROM events
        WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type""",
    ),
    "row_count": Query(
        lambda s, d: profile.row_count(table(s, d, "lineitem")), "SELECT count(*) AS n_rows FROM lineitem"
    ),
    "null_report": Query(
        _null_report,
        _nulls_sql(
            "lineitem",
            {c: f"{c} IS NULL" for c in _LINE_COLUMNS}
            | {"l_quantity": "l_quantity = 7", "l_discount": "l_discount = 0", "l_tax": "l_tax = 0"},
        ),
    ),
    "value_counts": Query(
        lambda s, d: profile.value_counts(table(s, d, "orders"), "o_orderpriority"),
        "SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY ALL",
    ),
    "top_k": Query(
        lambda s, d: profile.top_k(table(s, d, "part"), "p_brand", 5),
        "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY ALL ORDER BY count DESC, value LIMIT 5",
    ),
    "frequent_values": Query(_frequent_values, _frequent_sql(_FREQUENT)),
    "distinct_report": Query(
        _distinct_report,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(DISTINCT {v}) + max(CASE WHEN {v} IS NULL THEN 1 ELSE 0 END)::BIGINT
            AS n_distinct, count(DISTINCT {v}) AS n_distinct_not_null FROM lineitem"""
            for c, v in {
                "l_orderkey": "l_orderkey",
                "l_suppkey": "l_suppkey",
                "l_tax": "nullif(l_tax, 0)",
                "l_shipdate": "l_shipdate",
                "l_returnflag": "l_returnflag",
            }.items()
        ),
    ),
    "distinct_report_approx": Query(
        _distinct_report_approx,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", true AS near FROM lineitem HAVING count(*) > 0"""
            for c in ["l_orderkey", "l_suppkey", "l_tax", "l_shipdate", "l_returnflag"]
        ),
    ),
    "categorical_profile": Query(
        _categorical_profile, _profile_sql(_pairs_sql("part", ["p_brand", "p_type", "p_name", "p_size"]), 5)
    ),
    "top_per_group": Query(
        _top_per_group,
        f"""WITH pairs AS ({_pairs_sql("lineitem", ["l_partkey", "l_orderkey"])})
        SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value NULLS LAST) AS rank
        FROM pairs QUALIFY rank <= 1500""",
    ),
    "column_overview": Query(
        _column_overview,
        " UNION ALL ".join(
            f"""SELECT {i}::BIGINT AS ordinal, '{c}' AS "column", '{t}' AS dtype, 0::BIGINT AS nulls, 0::DOUBLE AS null_pct,
            count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) AS n_distinct_not_null FROM orders"""
            for i, (c, t) in enumerate(
                {
                    "o_orderkey": "bigint",
                    "o_custkey": "bigint",
                    "o_orderstatus": "string",
                    "o_totalprice": "double",
                    "o_orderdate": "timestamp_ntz",
                    "o_orderpriority": "string",
                }.items()
            )
        ),
    ),
    "distributions": Query(
        _distributions, distributions_sql("orders", {"o_orderstatus": "Status", "o_orderpriority": "Priority"})
    ),
    "quality_nulls": Query(
        lambda s, d: _quality("nulls")(s, d)
        .filter(F.col("column").isin(_ACCIDENT_COLUMNS))
        .withColumn("null_pct", rounded("null_pct")),
        _nulls_sql("accidents", {c: f'"{c}" IS NULL' for c in _ACCIDENT_COLUMNS}, CTE.split("labelled AS")[0]),
    ),
    "quality_categories": Query(
        lambda s, d: _quality("categories")(s, d).withColumn("rank", big("rank")),
        _profile_sql(_pairs_sql("accidents", _PROFILE_PRESENT), P.TOP_VALUES, CTE.split("labelled AS")[0]),
    ),
}
