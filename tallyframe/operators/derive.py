"""Labels for codes, dates from text, hour and month."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe import presets as P
from tallyframe.functions import columns as C
from tallyframe.operators.clean import dtype_of, fill_default, named


def recode(
    df: DataFrame, col: str, mapping: Mapping[Any, str], default: str | None = None, out: str | None = None
) -> DataFrame:
    """Add ``out`` (or replace ``col``) with the label of each code. Unknown codes and null get ``default``."""
    return df.withColumns({out or col: C.label_of(named(col), dtype_of(df, col), mapping, default)})


def severity_label(df: DataFrame, col: str = "Accident_Severity", out: str = "Severity_Label") -> DataFrame:
    return recode(df, col, P.SEVERITY, P.SEVERITY_OTHERWISE, out)


def area_label(df: DataFrame, col: str = "Urban_or_Rural_Area", out: str = "Area_Label") -> DataFrame:
    return recode(df, col, P.AREA, P.AREA_OTHERWISE, out)


def weekday_label(df: DataFrame, col: str = "Day_of_Week", out: str = "Day_Name") -> DataFrame:
    return recode(df, col, P.WEEKDAY, P.WEEKDAY_OTHERWISE, out)


def parse_date(df: DataFrame, col: str, fmt: str = P.DATE_FORMAT, out: str | None = None) -> DataFrame:
    """Date of padded text; text that does not match ``fmt`` gives null."""
    return df.withColumns({out or col: C.date_of(named(col), dtype_of(df, col), fmt)})


def month_of(df: DataFrame, col: str, out: str = "Month") -> DataFrame:
    return df.withColumns({out: F.month(named(col))})


def hour_of(df: DataFrame, col: str, out: str = "Hour") -> DataFrame:
    """Whole hour of a timestamp or of ``HH:MM`` text; missing stays null."""
    return df.withColumns({out: C.hour_of_time(named(col), dtype_of(df, col))})


def hour_from_text(df: DataFrame, col: str, out: str = "Hour", default: str | None = None) -> DataFrame:
    """Hour as a double from the text before the colon; with ``default``, that text stands for null."""
    if default is not None:
        df = fill_default(df, col, default)
    return df.withColumns({out: C.hour_from_text(named(col), dtype_of(df, col))})


def time_features(
    df: DataFrame,
    date: str,
    time: str,
    fmt: str = P.DATE_FORMAT,
    date_out: str = "Accident_Date",
    hour_out: str = "Hour",
    month_out: str = "Month",
) -> DataFrame:
    """Date, month and hour columns of a date text and a time text."""
    parsed = C.date_of(named(date), dtype_of(df, date), fmt)
    return df.withColumns(
        {
            date_out: parsed,
            month_out: F.month(parsed),
            hour_out: C.hour_of_time(named(time), dtype_of(df, time)),
        }
    )
