"""Columns that exist, missing codes, defaults, casts, incomplete rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import columns as C


def named(name: str) -> Column:
    """Column by its literal name, which may hold dots, hyphens and parentheses."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def present_columns(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], list[str]]:
    """Split ``cols`` into those ``df`` has and those it lacks, both in the given order."""
    return [c for c in cols if c in df.columns], [c for c in cols if c not in df.columns]


def select_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns of ``cols`` that ``df`` has."""
    return df.select(*[named(c) for c in present_columns(df, cols)[0]])


def sentinel_to_null(df: DataFrame, cols: Sequence[str], sentinel: Any = -1) -> DataFrame:
    """Replace the code for "missing" by null in those of ``cols`` that exist."""
    found, _ = present_columns(df, cols)
    return df.withColumns({c: C.sentinel_as_null(named(c), dtype_of(df, c), sentinel) for c in found})


def fill_default(df: DataFrame, col: str, value: Any) -> DataFrame:
    """Replace null by ``value``."""
    return df.withColumns({col: F.coalesce(named(col), F.lit(value))})


def to_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast those of ``cols`` that exist to double; text that is no number gives null."""
    found, _ = present_columns(df, cols)
    return df.withColumns({c: named(c).try_cast("double") for c in found})


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with null or NaN in any column, or in any of those of ``subset`` that exist."""
    if subset is None:
        return df.dropna("any")
    found, _ = present_columns(df, subset)
    return df.dropna("any", subset=found)


def filter_positive(df: DataFrame, col: str) -> DataFrame:
    """Rows with a value above zero; null is none."""
    return df.filter(named(col) > 0)


def filter_isin(df: DataFrame, col: str, values: Sequence[Any]) -> DataFrame:
    """Rows whose value is one of ``values``."""
    return df.filter(named(col).isin(list(values)))


def class_slices(df: DataFrame, label: str, classes: Sequence[Any]) -> dict[Any, DataFrame]:
    """One frame per class."""
    return {k: df.filter(named(label) == k) for k in classes}


def union_classes(slices: Sequence[DataFrame]) -> DataFrame:
    """All rows of several frames with the same columns, matched by name; copies stay."""
    first, *rest = slices
    for df in rest:
        first = first.unionByName(df)
    return first
