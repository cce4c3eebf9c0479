"""Data-quality profile: schema, missing values, distinct values, frequent values.

The profiles over many columns read the table once: a row becomes one (column, value) pair per column, the
pairs are counted in the map tasks, and only counts are shuffled, by column *and* value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import columns as C
from tallyframe.operators.clean import dtype_of, named


def literal_rows(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence[Column]]) -> DataFrame:
    """A small frame of given expressions, one row each; its size is that of the argument."""
    structs = [F.struct(*[c.alias(n) for n, c in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def schema_report(df: DataFrame) -> DataFrame:
    """(ordinal, column, dtype, nullable), one row per column."""
    rows = [
        [F.lit(i), F.lit(f.name), F.lit(f.dataType.simpleString()), F.lit(f.nullable)]
        for i, f in enumerate(df.schema.fields)
    ]
    return literal_rows(df.sparkSession, ["ordinal", "column", "dtype", "nullable"], rows)


def null_report(df: DataFrame) -> DataFrame:
    """(column, nulls, null_pct): null or NaN values of every column, in one pass."""
    total = F.count(F.lit(1))
    missing = [F.count_if(C.is_missing(named(f.name), f.dataType)) for f in df.schema.fields]
    rows = [
        F.struct(
            F.lit(f.name).alias("column"), n.alias("nulls"), C.percent_of(n, total).alias("null_pct")
        )
        for f, n in zip(df.schema.fields, missing, strict=True)
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count), null counted as a value, most frequent first, then by value."""
    counts = df.groupBy(named(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc_nulls_last("value"))


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; equal counts are ordered by value."""
    return value_counts(df, col).limit(k)


def pair_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, count) over several columns in one pass, values as text."""
    texts = df.select(*[C.as_text(named(c), dtype_of(df, c)).alias(c) for c in cols])
    pairs = texts.unpivot([], [named(c) for c in cols], "column", "value")
    return pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``.

    Up to ``spark.sql.optimizer.windowGroupLimitThreshold`` each map task forwards only its own first ``k``
    of a group. Beyond that each group is first cut down in as many salted parts as a shuffle has partitions,
    so all tasks share the sorting of a large one.
    """
    def first_k(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.filter(F.col("rank") <= k)

    conf = df.sparkSession.conf
    if k > int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        parts = int(conf.get("spark.sql.shuffle.partitions"))
        salted = df.withColumn("salt", F.pmod(F.xxhash64(*[named(c) for c in df.columns]), F.lit(parts)))
        df = first_k(salted, [*by, "salt"]).drop("rank", "salt")
    return first_k(df, by)


def _group_totals(counts: DataFrame, by: str) -> DataFrame:
    return counts.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.count("value").alias("n_distinct_not_null"),
        F.sum("count").alias("n_rows"),
        F.max("count").alias("max_count"),
    )


def distinct_report(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """(column, n_distinct, n_distinct_not_null): distinct values of each column, with and without null.

    ``approx`` estimates them with one sketch per column and shuffles no values.
    """
    if not approx:
        totals = _group_totals(pair_counts(df, cols), "column")
        return totals.select("column", "n_distinct", "n_distinct_not_null")
    rows = []
    for c in cols:
        known = F.approx_count_distinct(named(c))
        has_null = F.coalesce(F.max(named(c).isNull().cast("bigint")), F.lit(0).cast("bigint"))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                (known + has_null).alias("n_distinct"),
                known.alias("n_distinct_not_null"),
            )
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def categorical_profile(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """(column, n_rows, n_distinct, rank, value, count): the ``k`` most frequent values of every column."""
    counts = pair_counts(df, cols)
    # One row per profiled column, so its size is that of the argument.
    totals = F.broadcast(_group_totals(counts, "column"))
    top = top_per_group(counts, ["column"], [F.desc("count"), F.asc_nulls_last("value")], k)
    return top.join(totals, "column").select("column", "n_rows", "n_distinct", "rank", "value", "count")


def distributions(df: DataFrame, titles: Mapping[str, str]) -> DataFrame:
    """(dimension, title, value, count, max_count): all value counts of several columns in one pass."""
    counts = pair_counts(df, list(titles))
    # One row per column of the argument.
    totals = F.broadcast(_group_totals(counts, "column"))
    named_rows = literal_rows(
        df.sparkSession, ["column", "title"], [[F.lit(c), F.lit(t)] for c, t in titles.items()]
    )
    return (
        counts.join(totals, "column")
        .join(F.broadcast(named_rows), "column")
        .select(F.col("column").alias("dimension"), "title", "value", "count", "max_count")
        .orderBy("dimension", F.desc("count"), F.asc_nulls_last("value"))
    )


def column_overview(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Schema, missing and distinct values of each column side by side."""
    cols = list(cols or df.columns)
    part = df.select(*[named(c) for c in cols])
    report = schema_report(part).select("ordinal", "column", "dtype")
    # Each of the three frames has one row per column.
    return (
        report.join(F.broadcast(null_report(part)), "column")
        .join(F.broadcast(distinct_report(part, cols)), "column")
        .select("ordinal", "column", "dtype", "nulls", "null_pct", "n_distinct", "n_distinct_not_null")
    )
