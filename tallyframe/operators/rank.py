"""Positions of rows in an order, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import unused
from tallyframe.workspace import settle


def _placed(df: DataFrame, order: list[str | Column], at: str) -> tuple[DataFrame, Column, Column]:
    """``df`` dealt by ranges of ``order``, sorted and written, and each row's range and place in it."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(dealt.withColumn(at, F.monotonically_increasing_id()), "placed")
    # monotonically_increasing_id: the task's number from bit 33 on, and the row's number below
    return placed, F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)


def _before(sums: DataFrame, part: str, total: str) -> DataFrame:
    """(part, total of the parts before it): one row per range."""
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(part, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(total))


def with_position(df: DataFrame, order: list[str | Column], position: str = "position") -> DataFrame:
    """``df`` with each row's place in ``order``, counted from 1.

    Rows are dealt to tasks by ranges of ``order`` and sorted there; a row's place is its place in its range after
    the rows of the ranges before, which are counted per range. What is summed up in one task is one number per
    range. Rows that are equal in ``order`` lie in one range, so an order with many ties should end with a column
    that tells rows apart; without one, equal rows get their places in no particular order.
    """
    at, part, before = unused(df, "at", "part", "before")
    placed, task, row = _placed(df, order, at)
    counts = placed.groupBy(task.alias(part)).agg(F.count(F.lit(1)).alias(before))
    joined = placed.join(F.broadcast(_before(counts, part, before)), task == F.col(part))  # one row per range
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(before) + row + 1).alias(position))


def with_running_total(df: DataFrame, order: list[str | Column], value: str, total: str) -> DataFrame:
    """``df`` with the sum of ``value``, a whole number, over the rows before each row in ``order``; see ``with_position``."""
    at, part, before = unused(df.withColumn(total, F.lit(0)), "at", "part", "before")
    placed, task, row = _placed(df, order, at)
    placed = placed.withColumn(part, task)
    sums = placed.groupBy(part).agg(F.sum(value).alias(before))
    inside = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn(total, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = summed.join(F.broadcast(_before(sums, part, before)), part)  # one row per range
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(before) + F.col(total)).alias(total))
