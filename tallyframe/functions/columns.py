"""Expressions on one column. All run in the JVM; none raises on bad text under ANSI mode."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _comparable(col: Column, dtype: T.DataType, code: Any) -> Column:
    # Text that holds codes is compared as a number: "-1" and "-1.0" are the same code, "None" is none.
    if isinstance(dtype, T.StringType) and isinstance(code, (int, float)):
        return col.try_cast("double")
    return col


def sentinel_as_null(col: Column, dtype: T.DataType, sentinel: Any) -> Column:
    """Null where ``col`` holds the code for "missing", else ``col`` unchanged."""
    return F.when(_comparable(col, dtype, sentinel) == F.lit(sentinel), F.lit(None)).otherwise(col)


def label_of(col: Column, dtype: T.DataType, labels: Mapping[Any, str], otherwise: str | None = None) -> Column:
    """Label text of a code; codes not in ``labels``, and null, get ``otherwise``."""
    cases = [(_comparable(col, dtype, code) == F.lit(code), F.lit(text)) for code, text in labels.items()]
    if not cases:
        return F.lit(otherwise).cast("string")
    (first, text), *rest = cases
    chain = F.when(first, text)
    for condition, text in rest:
        chain = chain.when(condition, text)
    return chain.otherwise(F.lit(otherwise))


def date_of(col: Column, dtype: T.DataType, pattern: str) -> Column:
    """Date of padded text by ``pattern``; text that does not match gives null."""
    if isinstance(dtype, T.StringType):
        return F.try_to_date(F.trim(col), pattern)
    return col.cast("date")


def hour_of_time(col: Column, dtype: T.DataType) -> Column:
    """Hour 0-23 of a timestamp or of ``HH:MM`` text.

    The text is put on a fixed day without a zone, so no daylight-saving gap of the current day can move it.
    """
    if isinstance(dtype, T.StringType):
        col = F.concat(F.lit("1970-01-01T"), F.trim(col)).try_cast("timestamp_ntz")
    return F.hour(col)


def hour_from_text(col: Column, dtype: T.DataType) -> Column:
    """The part of the text before the first colon, as a double; the hour of a timestamp."""
    if not isinstance(dtype, T.StringType):
        return F.hour(col).cast("double")
    return F.split(col, ":").getItem(0).try_cast("double")


def as_text(col: Column, dtype: T.DataType) -> Column:
    """Text of a value, equal for equal values (``0.0`` and ``-0.0`` are equal)."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        raise TypeError("only atomic columns have value counts")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        col = col + F.lit(0).cast(dtype)
    if isinstance(dtype, T.BinaryType):
        return F.hex(col)
    return col.cast("string")


def is_missing(col: Column, dtype: T.DataType) -> Column:
    """Null, or NaN in a floating-point column."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def percent_of(part: Column, total: Column) -> Column:
    """``part`` in percent of ``total``; null for an empty total."""
    return F.lit(100.0) * part / F.nullif(total, F.lit(0))


def unused(df: DataFrame, *names: str) -> list[str]:
    """A name for each of ``names`` that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found
