"""Parquet ingest, bucketed tables, result tables, first rows, caching."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import unused
from tallyframe.operators.clean import named
from tallyframe.sources.csv import Checked


def ingest(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "error",
    rebalance: bool = True,
) -> DataFrame:
    """Write ``df`` as Parquet, in one folder per value of ``partition_by``, and return the stored table.

    The rows of a value are brought together first, so that files get the advisory partition size; adaptive
    execution splits a value with many rows over as many tasks. Without ``rebalance`` nothing is shuffled and
    each task writes its own file per value: right for input that is already ordered by the values, else it
    makes as many small files as there are tasks times values.
    """
    if partition_by and rebalance:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def ingest_again(df: DataFrame, path: str, partition_by: Sequence[str]) -> DataFrame:
    """Write ``df`` in place of those values of ``partition_by`` that it has, and return the stored table.

    Folders of other values are not touched, so loading the same file twice changes nothing, and a corrected or new
    year costs that year. Each folder is replaced when the job commits; a job that fails leaves the table as it was.
    """
    writer = df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def ingest_checked(
    checked: Checked, path: str, partition_by: Sequence[str] = (), mode: str = "error"
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Write good and bad rows side by side in one job; return the good table, the bad one, and counts per cause.

    The counts are taken while the rows are written. The bad table has the cause and the line, and the good one
    the columns; both are read by pruning folders of one stored table.
    """
    rows, spark = checked.rows, checked.rows.sparkSession
    cells = [c for c in rows.columns if c not in (checked.cause, checked.line)]
    status = unused(rows, "row_status")[0]
    seen, total = Observation(), unused(rows, "rows")[0]
    per_cause = [F.count_if(named(checked.cause) == c).alias(f"of {c}") for c in ("line", *cells)]
    counted = rows.observe(seen, F.count(F.lit(1)).alias(total), *per_cause)
    counted = counted.withColumn(status, F.when(named(checked.cause).isNull(), "good").otherwise("bad"))
    counted.write.mode(mode).partitionBy(status, *partition_by).parquet(path)
    stored = spark.read.schema(rows.schema.add(status, T.StringType())).parquet(path)
    counts = {c.removeprefix("of "): n for c, n in seen.get.items() if n and c != total}
    good = stored.filter(named(status) == "good").select(*[named(c) for c in cells])
    bad = stored.filter(named(status) == "bad").select(named(checked.cause).alias("cause"), named(checked.line).alias("line"))
    return good, bad, {"rows": seen.get[total], **counts}


def bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` as ``buckets`` files by the hash of ``keys``, each sorted by them, and return the stored table.

    Tables in as many buckets of the same keys are joined, and counted by the keys, without a shuffle. One shuffle is paid
    when the table is written. ``buckets`` should make files of 128 MB to 1 GB.
    """
    name = f"bucketed_{uuid4().hex}"
    dealt = df.repartition(buckets, *[named(k) for k in keys])
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int) -> DataFrame:
    """A table that ``bucketed`` wrote in an earlier session."""
    name, by = f"bucketed_{uuid4().hex}", ", ".join(f"`{k}`" for k in keys)
    clustering = f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets:d} BUCKETS"
    spark.sql(f"CREATE TABLE {name} ({schema.toDDL()}) USING parquet OPTIONS (path '{path}') {clustering}")
    return spark.table(name)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> str:
    """Write a result table, ``fmt`` one of parquet, json, csv, orc."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)
    return path


def head(df: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows in a given order."""
    return df.orderBy(*order_by).limit(n)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows; reads no more partitions than it takes to find them."""
    return df.sparkSession.createDataFrame(df.take(n), df.schema)


@contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Keep ``df`` for several actions and free it afterwards."""
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()
