"""Registered queries: each operator on the given tables, with the same result as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(col: str | Column) -> Column:
    """SQL counts and date parts are 64-bit."""
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def rounded(col: str | Column, digits: int = 6) -> Column:
    """Doubles to a common precision, without a negative zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)
