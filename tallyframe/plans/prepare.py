"""The table as the analyses want it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe import presets as P
from tallyframe.operators.clean import sentinel_to_null, to_double
from tallyframe.operators.derive import (
    area_label,
    hour_from_text,
    month_of,
    parse_date,
    severity_label,
    time_features,
    weekday_label,
)
from tallyframe.sources.csv import drop_unnamed, scan_csv
from tallyframe.workspace import settle


def session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).getOrCreate()


def read_table(spark: SparkSession, path: str, often: bool = False, fmt: str | None = None) -> DataFrame:
    """A CSV file or folder with the declared types, or a Parquet folder made by ``store``.

    ``fmt`` is csv or parquet; without it a name that ends in .csv or .csv.gz is CSV, and any other Parquet. CSV that is
    read ``often`` is first written as Parquet, so that each pass reads only its columns.
    """
    if (fmt or ("csv" if path.endswith((".csv", ".csv.gz")) else "parquet")) == "parquet":
        return drop_unnamed(spark.read.parquet(path))
    table = drop_unnamed(scan_csv(spark, path, P.SOURCE_TYPES))
    return settle(table, "table") if often else table


def prepare_exploration(df: DataFrame) -> DataFrame:
    """Add date, hour, month and the label columns; a missing time has no hour."""
    return weekday_label(area_label(severity_label(time_features(df, "Date", "Time"))))


def prepare_model(df: DataFrame) -> DataFrame:
    """Missing codes to null, date, month, hour (0 for a missing time), numbers as doubles.

    -1 counts as missing in the coordinates too, so a true longitude of exactly -1 is lost.
    """
    df = sentinel_to_null(df, P.MISSING_CODE_COLUMNS, P.MISSING_CODE)
    df = month_of(parse_date(df, "Date", out="Accident_Date"), "Accident_Date")
    df = hour_from_text(df, "Time", default=P.MISSING_TIME)
    return to_double(df, P.MODEL_NUMERIC)
