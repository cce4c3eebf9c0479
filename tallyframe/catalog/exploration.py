"""Shares, trends, box plots, density, correlation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.catalog import Query, big, rounded, table
from tallyframe.catalog.accidents import CTE, accidents
from tallyframe.catalog.modelling import sample_check
from tallyframe.catalog.profiles import distributions_sql
from tallyframe import presets as P
from tallyframe.operators import box, explore as ops, quantile
from tallyframe.operators.clean import drop_incomplete, sentinel_to_null
from tallyframe.plans.explore import explore, severe
from tallyframe.sources.tables import bucketed
from tallyframe.workspace import new_path, settle

_SHARE_SQL = """SELECT {col} AS value, count(*) AS count, round(100.0 * count(*) / {total}, 1) AS pct,
  printf('%.1f%%', round(100.0 * count(*) / {total}, 1)) || chr(10) || '(' || count(*) || ')' AS label
  FROM {source} GROUP BY {col}"""


def _share_sql(source: str, col: str) -> str:
    total = f"(SELECT count(*) FROM {source})::DOUBLE"
    return _SHARE_SQL.format(source=source, col=col, total=total)


def _accident_sql(sql: str) -> str:
    return f"WITH {CTE} {sql}"


def _time_sql(expr: str) -> str:
    return f"""SELECT {expr} AS bucket, count(*) AS count,
    round(100.0 * count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS pct FROM events GROUP BY ALL"""


def _box_sql(group: str, value: str, source: str, ctes: str = "") -> str:
    return f"""WITH {ctes} data AS (SELECT {group} AS "group", {value}::DOUBLE AS y FROM {source}),
    q AS (SELECT "group", count(*) AS n, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS median,
      quantile_cont(y, 0.75) AS q3 FROM data GROUP BY ALL),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
    b AS (SELECT "group", any_value(n) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
      least(min(y) FILTER (WHERE y BETWEEN lo AND hi), any_value(q1)) AS whisker_lo,
      greatest(max(y) FILTER (WHERE y BETWEEN lo AND hi), any_value(q3)) AS whisker_hi,
      count(*) FILTER (WHERE y < lo OR y > hi) AS n_outliers
      FROM data JOIN f USING ("group") GROUP BY "group")"""


_BOX_COLUMNS = ["q1", "median", "q3", "whisker_lo", "whisker_hi"]
_BOX_SELECT = '"group", n, ' + ", ".join(f"round({c}, 6) AS {c}" for c in _BOX_COLUMNS) + ", n_outliers"
_BOX_ORDER = ["view", "refund", "click", "purchase"]


def _rounded_boxes(df: DataFrame) -> DataFrame:
    df = df.withColumns({c: rounded(c) for c in _BOX_COLUMNS})
    return df.withColumn("pos", big("pos")) if "pos" in df.columns else df


def _box_stats_approx(spark: SparkSession, sf: str) -> DataFrame:
    # Estimated quartiles are judged by their exact ranks, whiskers by the values that there are.
    events = table(spark, sf, "events")
    boxes = settle(box.box_stats(events, "event_type", "value", approx=True), "boxes")
    known = drop_incomplete(events.select(F.col("event_type").alias("group"), F.col("value").alias("y"))).join(boxes, "group")
    near, y = F.lit(True), F.col("y")
    for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        below, upto = (F.count_if(test) / F.count(F.lit(1)) for test in (y < F.col(c), y <= F.col(c)))
        near = near & (below <= p + 0.01) & (upto >= p - 0.01)
    ends = [F.count_if(y == F.col(c)) > 0 for c in ("whisker_lo", "whisker_hi")]
    return known.groupBy("group", "n").agg(near.alias("near"), (ends[0] & ends[1]).alias("whiskers_inside"))


def _ordered_sql(order: list[str]) -> str:
    places = ", ".join(f"({i}::BIGINT, '{g}')" for i, g in enumerate(order))
    return f"""SELECT pos, {_BOX_SELECT} FROM (VALUES {places}) p(pos, "group") LEFT JOIN b USING ("group")"""


def _domain_sql(col: str, source: str, domain: list[str]) -> str:
    places = ", ".join(f"({i}::BIGINT, '{v}')" for i, v in enumerate(domain))
    return f"""SELECT pos, value, count FROM (VALUES {places}) p(pos, value)
    LEFT JOIN (SELECT {col} AS value, count(*) AS count FROM {source} GROUP BY ALL) USING (value)"""


def _exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    # A small bound on what one task may hold, so that every group goes through the narrowing.
    out = quantile.exact_quantiles(
        table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", [0.01, 0.5, 0.999], in_task=500
    )
    return out.select("l_returnflag", "n", *[rounded(F.get("quantiles", F.lit(i))).alias(f"q{i}") for i in range(3)])


def _region_trend(spark: SparkSession, sf: str) -> DataFrame:
    return ops.region_trend(
        table(spark, sf, "orders"),
        "r_name",
        "o_orderdate",
        via=[
            (table(spark, sf, "customer"), "o_custkey", "c_custkey"),
            (table(spark, sf, "nation"), "c_nationkey", "n_nationkey"),
            (table(spark, sf, "region"), "n_regionkey", "r_regionkey"),
        ],
    )


_TREND_SQL = """SELECT r_name AS region, year(o_orderdate) AS year, count(*) AS count
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
_BUCKETS = 8


def _region_trend_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    # Both large tables in buckets of the customer: neither counting nor joining them shuffles a row.
    orders = bucketed(table(spark, sf, "orders"), new_path(spark, "orders-bucketed"), ["o_custkey"], _BUCKETS)
    customers = bucketed(table(spark, sf, "customer"), new_path(spark, "customers-bucketed"), ["c_custkey"], _BUCKETS)
    return ops.region_trend(
        orders,
        "r_name",
        "o_orderdate",
        via=[
            (customers, "o_custkey", "c_custkey"),
            (table(spark, sf, "nation"), "c_nationkey", "n_nationkey"),
            (table(spark, sf, "region"), "n_regionkey", "r_regionkey"),
        ],
    )


_WIDE = 200


def _corr_wide(spark: SparkSession, sf: str) -> DataFrame:
    # Weighted sums of five columns, so that all pairs follow from the covariances of the five.
    items = table(spark, sf, "lineitem")
    base = [F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100]
    base.append(F.col("l_linenumber").cast("double"))
    sums = [sum((x * ((i * (b + 3) + b * b) % 11 - 5) for b, x in enumerate(base)), F.lit(0.0)) for i in range(_WIDE)]
    # not written: 200 doubles a row are many times the table, and the one pass makes them as it reads
    wide = items.select(*[total.alias(f"x{i}") for i, total in enumerate(sums)])
    return ops.corr_matrix(wide, wide.columns).withColumn("r", rounded("r"))


_CORR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    # One constant column, and rows with a gap, which count for no pair.
    items = sentinel_to_null(table(spark, sf, "lineitem"), ["l_discount", "l_tax"], 0.0)
    items = items.withColumn("constant", F.col("l_linenumber") * 0 + F.lit(0.1))
    return ops.corr_matrix(items, [*_CORR_COLUMNS, "constant"]).withColumn("r", rounded("r"))


def _corr_sql(cols: list[str], source: str, constants: set[str] = frozenset()) -> str:
    def r(a: str, b: str) -> str:
        if a in constants or b in constants:
            return "NULL::DOUBLE"
        return f'(round(covar_samp("{a}", "{b}") / (stddev_samp("{a}") * stddev_samp("{b}")), 6) + 0.0)'

    cells = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': {r(a, b)}}}" for a in cols for b in cols)
    return f"SELECT unnest([{cells}], recursive := true) FROM {source}"


# Columns of the preset that the accident view has; Carriageway_Hazards is constant there.
_ACCIDENT_CORR = [
    "Accident_Severity", "Day_of_Week", "Road_Type", "Light_Conditions", "Weather_Conditions",
    "Road_Surface_Conditions", "Urban_or_Rural_Area", "1st_Road_Class", "Carriageway_Hazards", "Police_Force",
    "Longitude", "Latitude", "Number_of_Vehicles", "Speed_limit", "Hour", "Month", "Year",
]
_ACCIDENT_NUMBERS = ", ".join(f'"{c}"::DOUBLE AS "{c}"' for c in _ACCIDENT_CORR)


def _explored(name: str, finish: Callable[[DataFrame], DataFrame] = lambda df: df):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return finish(explore(accidents(spark, sf), [name])[name])

    return run


def _severe_sample(spark: SparkSession, sf: str) -> DataFrame:
    df = accidents(spark, sf)
    return sample_check(severe(df), explore(df, ["severe_sample"])["severe_sample"])


def _rounded_grid(df: DataFrame) -> DataFrame:
    return df.withColumns({"lat": rounded("lat"), "lon": rounded("lon")})


def _density(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer")
    return _rounded_grid(ops.geo_density(customers, "c_acctbal", "c_nationkey", 250.0))


QUERIES: dict[str, Query] = {
    "share": Query(
        lambda s, d: ops.share(table(s, d, "orders"), "o_orderpriority"), _share_sql("orders", "o_orderpriority")
    ),
    "counts_over_domain": Query(
        lambda s, d: ops.counts_over_domain(table(s, d, "events"), "event_type", _BOX_ORDER).withColumn(
            "pos", big("pos")
        ),
        _domain_sql("event_type", "events", _BOX_ORDER),
    ),
    "time_pattern_hour": Query(
        lambda s, d: ops.time_pattern(table(s, d, "events"), "ts", "hour").withColumn("pct", rounded("pct")),
        _time_sql("hour(ts)"),
    ),
    "time_pattern_weekday": Query(
        lambda s, d: ops.time_pattern(table(s, d, "events"), "ts", "weekday").withColumn("pct", rounded("pct")),
        _time_sql("dayofweek(ts) + 1"),
    ),
    "time_pattern_month": Query(
        lambda s, d: ops.time_pattern(table(s, d, "events"), "ts", "month").withColumn("pct", rounded("pct")),
        _time_sql("month(ts)"),
    ),
    "region_trend": Query(
        _region_trend,
        _TREND_SQL,
    ),
    "region_trend_bucketed": Query(_region_trend_bucketed, _TREND_SQL),
    "corr_wide": Query(
        _corr_wide,
        f"""WITH base AS (SELECT l_quantity AS x0, l_extendedprice / 1000 AS x1, l_discount * 100 AS x2, l_tax * 100 AS x3,
          l_linenumber::DOUBLE AS x4 FROM lineitem),
        cov AS (SELECT unnest([{", ".join(f"{{'b': {b}, 'c': {c}, 'v': covar_samp(x{b}, x{c})}}" for b in range(5) for c in range(5))}],
          recursive := true) FROM base),
        weights AS (SELECT i, b, (i * (b + 3) + b * b) % 11 - 5 AS w FROM range({_WIDE}) r(i), range(5) s(b)),
        half AS (SELECT i, c, sum(w * v) AS v FROM weights JOIN cov USING (b) GROUP BY ALL),
        pairs AS (SELECT h.i AS i, w.i AS j, sum(h.v * w.w) AS v FROM half h JOIN weights w ON w.b = h.c GROUP BY ALL),
        own AS (SELECT i, v FROM pairs WHERE i = j)
        SELECT 'x' || p.i AS a, 'x' || p.j AS b, round(p.v / (sqrt(o.v) * sqrt(q.v)), 6) + 0.0 AS r
        FROM pairs p JOIN own o ON o.i = p.i JOIN own q ON q.i = p.j""",
    ),
    "geo_centre": Query(
        lambda s, d: _rounded_grid(ops.geo_centre(table(s, d, "customer"), "c_acctbal", "c_nationkey")),
        "SELECT round(avg(c_acctbal), 6) AS lat, round(avg(c_nationkey), 6) AS lon FROM customer",
    ),
    "geo_density": Query(
        _density,
        """SELECT floor(c_acctbal / 250.0)::BIGINT AS lat_cell, floor(c_nationkey / 250.0)::BIGINT AS lon_cell,
        floor(c_acctbal / 250.0) * 250.0 + 0.0 AS lat, floor(c_nationkey / 250.0)::DOUBLE * 250.0 AS lon, count(*) AS count
        FROM customer GROUP BY ALL""",
    ),
    "box_stats": Query(
        lambda s, d: _rounded_boxes(box.box_stats(table(s, d, "events"), "event_type", "value")),
        _box_sql("event_type", "value", "events") + f" SELECT {_BOX_SELECT} FROM b",
    ),
    "box_stats_order": Query(
        lambda s, d: _rounded_boxes(box.box_stats(table(s, d, "events"), "event_type", "value", _BOX_ORDER)),
        _box_sql("event_type", "value", "events") + _ordered_sql(_BOX_ORDER),
    ),
    "box_stats_approx": Query(
        _box_stats_approx,
        """SELECT event_type AS "group", count(*) AS n, true AS near, true AS whiskers_inside FROM events
        WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type""",
    ),
    "exact_quantiles": Query(
        _exact_quantiles,
        """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.01), 6) AS q0,
        round(quantile_cont(l_extendedprice, 0.5), 6) AS q1, round(quantile_cont(l_extendedprice, 0.999), 6) AS q2
        FROM lineitem GROUP BY ALL""",
    ),
    "corr_matrix": Query(
        _corr_matrix,
        _corr_sql(
            [*_CORR_COLUMNS, "constant"],
            "(SELECT *, 0.1 AS constant FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0)",
            {"constant"},
        ),
    ),
    "explore_area_share": Query(_explored("area_share"), _accident_sql(_share_sql("labelled", "Area_Label"))),
    "explore_severity_share": Query(
        _explored("severity_share"), _accident_sql(_share_sql("labelled", "Severity_Label"))
    ),
    "explore_distributions": Query(
        _explored("distributions"), distributions_sql("labelled", P.DISTRIBUTIONS, CTE + ",")
    ),
    "explore_weekdays": Query(
        _explored("weekdays", lambda df: df.withColumn("pos", big("pos"))),
        _accident_sql(_domain_sql("Day_Name", "labelled", P.WEEKDAY_ORDER)),
    ),
    "explore_severity_by_speed": Query(
        _explored("severity_by_speed", _rounded_boxes),
        _box_sql("Severity_Label", "Speed_limit", "labelled WHERE Speed_limit > 0", CTE + ",")
        + _ordered_sql(P.SEVERITY_ORDER),
    ),
    "explore_severe_density": Query(
        _explored("severe_density", _rounded_grid),
        _accident_sql(
            """SELECT floor(Latitude / 0.05::DOUBLE)::BIGINT AS lat_cell, floor(Longitude / 0.05::DOUBLE)::BIGINT AS lon_cell,
            round(floor(Latitude / 0.05::DOUBLE)::BIGINT * 0.05::DOUBLE, 6) + 0.0 AS lat,
            round(floor(Longitude / 0.05::DOUBLE)::BIGINT * 0.05::DOUBLE, 6) + 0.0 AS lon, count(*) AS count
            FROM labelled WHERE Accident_Severity IN (1, 2) GROUP BY ALL"""
        ),
    ),
    "explore_severe_sample": Query(
        _severe_sample,
        _accident_sql(
            """SELECT count(*) AS n, 0::BIGINT AS "foreign", 0::BIGINT AS twice, true AS near_size FROM labelled
            WHERE Accident_Severity IN (1, 2) AND Latitude IS NOT NULL AND Longitude IS NOT NULL"""
        ),
    ),
    "explore_severe_centre": Query(
        _explored("severe_centre", _rounded_grid),
        _accident_sql(
            "SELECT round(avg(Latitude), 6) AS lat, round(avg(Longitude), 6) AS lon FROM labelled WHERE Accident_Severity IN (1, 2)"
        ),
    ),
    "explore_hours": Query(
        _explored("hours", lambda df: df.withColumn("Hour", big("Hour"))),
        _accident_sql("SELECT Hour, count(*) AS count FROM labelled GROUP BY ALL"),
    ),
    "explore_months": Query(
        _explored("months", lambda df: df.withColumn("pct", rounded("pct"))),
        _accident_sql(
            """SELECT Month AS bucket, count(*) AS count,
            round(100.0 * count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS pct FROM labelled GROUP BY ALL"""
        ),
    ),
    "explore_region_trend": Query(
        _explored("region_trend"),
        _accident_sql(
            "SELECT Police_Force AS region, year(Accident_Date) AS year, count(*) AS count FROM labelled GROUP BY ALL"
        ),
    ),
    "explore_correlation": Query(
        _explored("correlation", lambda df: df.withColumn("r", rounded("r"))),
        _accident_sql(
            _corr_sql(
                _ACCIDENT_CORR,
                f"(SELECT {_ACCIDENT_NUMBERS} FROM labelled WHERE Hour IS NOT NULL)",
                {"Carriageway_Hazards"},
            )
        ),
    ),
}
