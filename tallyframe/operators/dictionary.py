"""Indices of categories of any number of values, without bringing the values to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import columns as C
from tallyframe.operators.clean import dtype_of, named
from tallyframe.operators.profile import pair_counts
from tallyframe.operators.rank import with_position
from tallyframe.workspace import settle

#: A value with more than one in so many rows is frequent, so there are fewer frequent values than this.
FREQUENT = 10_000


def category_dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, count, index): the values of each column as text, the most frequent one 0, ties by value.

    The indices are those of Spark ML's indexer. Values are counted in the map tasks, sorted by ranges of
    (column, count, value) and numbered by how many lie in the ranges before, so only one number per range and one
    per column are brought together. Null has no index.
    """
    counts = settle(pair_counts(df, cols).filter("value is not null"), "counts")
    order = [F.asc("column"), F.desc("count"), F.asc("value")]
    placed = settle(with_position(counts, order, "position"), "dictionary")
    # one row per column of the argument
    starts = placed.groupBy("column").agg(F.min("position").alias("start"))
    return placed.join(F.broadcast(starts), "column").select(
        "column", "value", "count", (F.col("position") - F.col("start")).alias("index")
    )


def index_by_dictionary(df: DataFrame, dictionary: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<col>_idx`` for every column; null and values that are not in the dictionary get the next index.

    Frequent values are looked up in a broadcast part of the dictionary. Rows with one of them need no second
    lookup and are spread over the tasks of the join with the rest, so no value is one task's work.
    """
    sizes = {r["column"]: r for r in dictionary.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("rows")).collect()}
    for c in cols:
        n, rows = (sizes[c]["n"], sizes[c]["rows"]) if c in sizes else (0, 0)
        text, hot, rare, spread, key, found = C.unused(df, "text", "hot", "rare", "spread", "key", "found")
        of_column = dictionary.filter(F.col("column") == c)
        is_frequent = F.col("count") * FREQUENT > rows
        frequent = of_column.filter(is_frequent).select(F.col("value").alias(key), F.col("index").alias(hot))
        rest = of_column.filter(~is_frequent).select(
            F.lit(True).alias(rare), F.col("value").alias(key), F.col("index").alias(found)
        )
        looked_up = df.withColumn(text, C.as_text(named(c), dtype_of(df, c)))
        looked_up = looked_up.join(F.broadcast(frequent), F.col(text) == F.col(key), "left").drop(key)
        is_rare = F.col(hot).isNull() & F.col(text).isNotNull()
        at_random = F.xxhash64(*[named(x) for x in df.columns]).cast("string")
        looked_up = looked_up.withColumn(spread, F.when(is_rare, F.col(text)).otherwise(at_random))
        joined = looked_up.join(rest, (is_rare == F.col(rare)) & (F.col(spread) == F.col(key)), "left")
        index = F.coalesce(F.col(hot), F.col(found), F.lit(n)).cast("double")
        df = joined.withColumn(f"{c}_idx", index).drop(text, hot, rare, spread, key, found)
    return df


def index_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``index_categories`` for columns of any number of values: the same indices, by a dictionary table."""
    return index_by_dictionary(df, settle(category_dictionary(df, cols), "dictionary"), cols)
