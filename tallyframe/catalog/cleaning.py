"""Sources, projections, filters, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.catalog import Query, big, table
from tallyframe.operators import clean, derive
from tallyframe.sources.csv import drop_unnamed, scan_checked, scan_csv
from tallyframe.sources.tables import head, ingest, ingest_again, ingest_checked, write_result
from tallyframe.workspace import new_path, settle


def _scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit('"'), "p_name", F.lit('", '), "p_type").alias("p_name"), "p_retailprice"
    )
    path = write_result(part, new_path(spark, "part-csv"), "csv")
    types = T.StructType([T.StructField("p_retailprice", T.DoubleType()), T.StructField("p_partkey", T.LongType())])
    return scan_csv(spark, path, types)


def _scan_csv_inferred(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = write_result(orders, new_path(spark, "orders-csv"), "csv")
    read = scan_csv(spark, path, infer=True)
    return read.select(big("o_orderkey").alias("o_orderkey"), "o_totalprice", "o_orderpriority")


def _drop_unnamed(spark: SparkSession, sf: str) -> DataFrame:
    # A header line that starts with a comma, as in a table written with its row numbers.
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("_c0"), "p_brand", "p_type", "p_size")
    named = part.withColumnRenamed("_c0", " ")
    path = new_path(spark, "unnamed-csv")
    named.write.option("header", True).option("escape", '"').csv(path)
    types = T.StructType([T.StructField("p_size", T.IntegerType())])
    return drop_unnamed(scan_csv(spark, path, types))


def _ingest(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("o_year", F.year("o_orderdate"))
    stored = ingest(orders, new_path(spark, "orders-by-year"), ["o_year"])
    return stored.groupBy(big("o_year").alias("o_year")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def _ingest_again(spark: SparkSession, sf: str) -> DataFrame:
    # All years; one year a second time as it is; another year corrected. Files of the other years stay the same.
    orders = table(spark, sf, "orders").withColumn("o_year", F.year("o_orderdate"))
    path = new_path(spark, "orders-again")
    first = ingest(orders, path, ["o_year"])
    before = settle(_files(first), "files")
    ingest_again(orders.filter("o_year = 1995"), path, ["o_year"])
    corrected = orders.filter("o_year = 1996").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    after = ingest_again(corrected, path, ["o_year"])
    sums = after.groupBy("o_year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    files = before.join(_files(after).withColumnRenamed("files", "now"), "o_year")
    untouched = (F.col("files") == F.col("now")).alias("untouched")
    return sums.join(files, "o_year").select(big("o_year").alias("o_year"), "n", "total", untouched)


def _files(stored: DataFrame) -> DataFrame:
    return stored.groupBy("o_year").agg(F.array_sort(F.collect_set("_metadata.file_name")).alias("files"))


def _ingest_checked(infer: bool):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        # Numbers that are none, and lines with a field too many, written into the lines of a file.
        key = F.col("p_partkey")
        cells = [
            F.when(key % 401 == 0, "none").otherwise(key.cast("string")),
            F.regexp_replace("p_name", ",", " "),
            F.when(key % 211 == 0, "large").when(key % 10 == 0, "").otherwise(F.col("p_size").cast("string")),
            F.when(key % 307 == 0, F.lit("1,5")).otherwise(F.col("p_retailprice").cast("string")),
        ]
        path = new_path(spark, "part-lines")
        table(spark, sf, "part").select(F.concat_ws(",", *cells)).write.text(path)
        types = T.StructType.fromDDL("p_partkey bigint, p_size int, p_retailprice double")
        names = ["p_partkey", "p_name", "p_size", "p_retailprice"]
        checked = scan_checked(spark, path, None if infer else types, infer, names)
        good, bad, counts = ingest_checked(checked, new_path(spark, "part-checked"))
        totals = good.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("p_size").cast("long")).alias("size"))
        stored = bad.groupBy("cause").agg(F.count(F.lit(1)).alias("n_rows"), F.lit(None).cast("long").alias("size"))
        rows = totals.select(F.lit("good").alias("cause"), "n_rows", "size").unionByName(stored)
        bad_rows = sum(n for c, n in counts.items() if c != "rows")
        seen = {**counts, "good": counts["rows"] - bad_rows}
        counted = F.coalesce(*[F.when(F.col("cause") == c, F.lit(n).cast("long")) for c, n in seen.items()])
        return rows.withColumn("counted", counted)

    return run


_CHECKED_SQL = """WITH marked AS (SELECT p_size, p_partkey, CASE WHEN p_partkey % 307 = 0 THEN 'line'
  WHEN p_partkey % 401 = 0 THEN 'p_partkey' WHEN p_partkey % 211 = 0 THEN 'p_size' ELSE 'good' END AS cause FROM part)
SELECT cause, count(*) AS n_rows, count(*) AS counted,
  (sum(p_size) FILTER (WHERE cause = 'good' AND p_partkey % 10 <> 0))::BIGINT AS size FROM marked GROUP BY cause"""


def _write_result(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    path = write_result(counts, new_path(spark, "priorities"), "json")
    return spark.read.schema("o_orderpriority string, n bigint").json(path)


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    return clean.sentinel_to_null(table(spark, sf, "lineitem"), ["l_discount", "l_tax", "l_absent"], 0.0)


def _sentinel_to_null(spark: SparkSession, sf: str) -> DataFrame:
    return _gaps(spark, sf).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


def _sentinel_in_text(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    size = F.col("p_size")
    code = F.when(size == 1, "-1").when(size == 2, "None").otherwise(size.cast("string"))
    return clean.sentinel_to_null(part.select("p_partkey", code.alias("code")), ["code"], -1)


def _class_slices(spark: SparkSession, sf: str) -> DataFrame:
    slices = clean.class_slices(table(spark, sf, "lineitem"), "l_returnflag", ["A", "N", "R"])
    parts = [
        df.agg(F.lit(k).alias("slice"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
        for k, df in slices.items()
    ]
    return clean.union_classes(parts)


def _union_classes(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return clean.union_classes(list(clean.class_slices(orders, "o_orderstatus", ["F", "O", "P"]).values()))


def _derive(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    return customer.withColumns(
        {"in_debt": (F.col("c_acctbal") < 0).cast("int"), "c_mktsegment": F.lower("c_mktsegment")}
    ).select("c_custkey", F.col("c_name").alias("name"), "c_mktsegment", "in_debt")


def _parse_date(spark: SparkSession, sf: str) -> DataFrame:
    # Most dates padded, one status in another format: those are no dates.
    orders = table(spark, sf, "orders")
    text = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.date_format("o_orderdate", "  dd/MM/yyyy ")
    )
    texts = orders.select("o_orderkey", text.alias("Date"))
    return derive.parse_date(texts, "Date", out="order_date").select("o_orderkey", "order_date")


def _time_features(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        "event_id",
        F.date_format("ts", "dd/MM/yyyy").alias("Date"),
        F.when(F.col("event_type") != "error", F.date_format("ts", "HH:mm")).alias("Time"),
    )
    out = derive.time_features(events, "Date", "Time")
    return out.select("event_id", "Accident_Date", big("Hour").alias("Hour"), big("Month").alias("Month"))


def _hour_of_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    out = derive.hour_of(table(spark, sf, "events"), "ts")
    return out.select("event_id", big("Hour").alias("Hour"))


def _hour_from_text(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    text = F.when(F.col("event_type") == "view", "unknown").when(
        F.col("event_type") != "error", F.date_format("ts", "HH:mm")
    )
    return derive.hour_from_text(events.select("event_id", text.alias("Time")), "Time", default="00:00")


def _to_double(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    text = F.when(size < 5, "n/a").otherwise(size.cast("string"))
    part = table(spark, sf, "part").select("p_partkey", "p_size", text.alias("size_text"))
    return clean.to_double(part, ["p_size", "size_text", "absent"])


def _accident_code(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("code"))


QUERIES: dict[str, Query] = {
    "scan_csv": Query(
        _scan_csv,
        """SELECT p_partkey, '"' || p_name || '", ' || p_type AS p_name, p_retailprice FROM part""",
    ),
    "scan_csv_inferred": Query(_scan_csv_inferred, "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders"),
    "drop_unnamed": Query(_drop_unnamed, "SELECT p_brand, p_type, p_size FROM part"),
    "ingest": Query(
        _ingest,
        """SELECT year(o_orderdate) AS o_year, count(*) AS n, round(sum(o_totalprice), 2) AS total
        FROM orders GROUP BY ALL""",
    ),
    "ingest_again": Query(
        _ingest_again,
        """WITH o AS (SELECT year(o_orderdate) AS o_year, o_totalprice FROM orders)
        SELECT o_year, count(*) AS n, o_year NOT IN (1995, 1996) AS untouched,
        round(sum(CASE WHEN o_year = 1996 THEN 2 * o_totalprice ELSE o_totalprice END), 2) AS total FROM o GROUP BY o_year""",
    ),
    "ingest_checked": Query(_ingest_checked(False), _CHECKED_SQL),
    "ingest_checked_inferred": Query(_ingest_checked(True), _CHECKED_SQL),
    "write_result": Query(_write_result, "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL"),
    "head": Query(
        lambda s, d: head(
            table(s, d, "orders").select("o_orderkey", "o_totalprice"), 5, [F.desc("o_totalprice"), "o_orderkey"]
        ),
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
    ),
    "select_columns": Query(
        lambda s, d: table(s, d, "lineitem").select("l_returnflag", "l_quantity"),
        "SELECT l_returnflag, l_quantity FROM lineitem",
    ),
    "select_present": Query(
        lambda s, d: clean.select_present(table(s, d, "orders"), ["o_orderkey", "o_absent", "o_totalprice"]),
        "SELECT o_orderkey, o_totalprice FROM orders",
    ),
    "derive_columns": Query(
        _derive,
        """SELECT c_custkey, c_name AS name, lower(c_mktsegment) AS c_mktsegment,
        CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS in_debt FROM customer""",
    ),
    "filter_positive": Query(
        lambda s, d: clean.filter_positive(table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal"),
        "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0",
    ),
    "class_slices": Query(
        _class_slices,
        """SELECT l_returnflag AS slice, count(*) AS n, sum(l_quantity) AS quantity
        FROM lineitem GROUP BY ALL""",
    ),
    "union_classes": Query(_union_classes, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"),
    "filter_isin": Query(
        lambda s, d: clean.filter_isin(table(s, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).select(
            "o_orderkey", "o_orderpriority"
        ),
        "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    ),
    "sentinel_to_null": Query(
        _sentinel_to_null,
        """SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax
        FROM lineitem""",
    ),
    "sentinel_in_text": Query(
        _sentinel_in_text,
        """SELECT p_partkey, CASE p_size WHEN 1 THEN NULL WHEN 2 THEN 'None' ELSE p_size::VARCHAR END AS code
        FROM part""",
    ),
    "drop_incomplete": Query(
        lambda s, d: clean.drop_incomplete(_gaps(s, d)).select("l_orderkey", "l_discount", "l_tax"),
        "SELECT l_orderkey, l_discount, l_tax FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0",
    ),
    "drop_incomplete_subset": Query(
        lambda s, d: clean.drop_incomplete(_gaps(s, d), ["l_tax", "l_absent"]).select("l_orderkey", "l_discount", "l_tax"),
        "SELECT l_orderkey, nullif(l_discount, 0) AS l_discount, l_tax FROM lineitem WHERE l_tax <> 0",
    ),
    "recode": Query(
        lambda s, d: derive.recode(
            table(s, d, "orders").select("o_orderkey", "o_orderstatus"),
            "o_orderstatus",
            {"F": "filled", "O": "open"},
            out="state",
        ),
        """SELECT o_orderkey, o_orderstatus,
        CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS state FROM orders""",
    ),
    "severity_label": Query(
        lambda s, d: derive.severity_label(_accident_code(s, d), "code"),
        """SELECT l_orderkey, l_linenumber AS code,
        CASE l_linenumber WHEN 1 THEN 'Fatal' WHEN 2 THEN 'Serious' ELSE 'Slight' END AS Severity_Label
        FROM lineitem""",
    ),
    "area_label": Query(
        lambda s, d: derive.area_label(_accident_code(s, d), "code"),
        """SELECT l_orderkey, l_linenumber AS code,
        CASE l_linenumber WHEN 1 THEN 'Urban' WHEN 2 THEN 'Rural' ELSE 'Other' END AS Area_Label FROM lineitem""",
    ),
    "weekday_label": Query(
        lambda s, d: derive.weekday_label(
            table(s, d, "events").select("event_id", F.dayofweek("ts").alias("Day_of_Week"))
        ).select("event_id", "Day_Name"),
        "SELECT event_id, dayname(ts) AS Day_Name FROM events",
    ),
    "parse_date": Query(
        _parse_date,
        """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS order_date FROM orders""",
    ),
    "month_of": Query(
        lambda s, d: derive.month_of(table(s, d, "orders"), "o_orderdate").select("o_orderkey", big("Month").alias("Month")),
        "SELECT o_orderkey, month(o_orderdate) AS Month FROM orders",
    ),
    "time_features": Query(
        _time_features,
        """SELECT event_id, ts::DATE AS Accident_Date, CASE WHEN event_type <> 'error' THEN hour(ts) END AS Hour,
        month(ts) AS Month FROM events""",
    ),
    "hour_of_timestamp": Query(_hour_of_timestamp, "SELECT event_id, hour(ts) AS Hour FROM events"),
    "hour_from_text": Query(
        _hour_from_text,
        """SELECT event_id, CASE event_type WHEN 'view' THEN 'unknown' WHEN 'error' THEN '00:00'
          ELSE strftime(ts, '%H:%M') END AS Time,
        CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN 0 ELSE hour(ts) END::DOUBLE AS Hour FROM events""",
    ),
    "fill_default": Query(
        lambda s, d: clean.fill_default(_gaps(s, d), "l_tax", 0.5).select("l_orderkey", "l_tax"),
        "SELECT l_orderkey, CASE WHEN l_tax = 0 THEN 0.5 ELSE l_tax END AS l_tax FROM lineitem",
    ),
    "to_double": Query(
        _to_double,
        """SELECT p_partkey, p_size::DOUBLE AS p_size, CASE WHEN p_size >= 5 THEN p_size::DOUBLE END AS size_text
        FROM part""",
    ),
}
