"""Distributions, box plot, density grid, trends and correlation of one table.

``spark-submit run.py explore <table> <folder for results>``
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe import presets as P
from tallyframe.operators.balance import sample_points
from tallyframe.operators.box import box_stats
from tallyframe.operators.clean import dtype_of, filter_positive, named, present_columns
from tallyframe.operators.explore import (
    corr_matrix,
    counts_over_domain,
    geo_centre,
    geo_density,
    region_trend,
    severe_points,
    share,
    time_pattern,
)
from tallyframe.operators.profile import distributions
from tallyframe.plans.prepare import prepare_exploration, read_table, session
from tallyframe.sources.tables import write_result


def severity_by_speed(df: DataFrame) -> DataFrame:
    return box_stats(
        filter_positive(df, "Speed_limit"), "Severity_Label", "Speed_limit", P.SEVERITY_ORDER
    )


def severe(df: DataFrame) -> DataFrame:
    return severe_points(df, P.LABEL_COLUMN, P.SEVERE_CODES, "Latitude", "Longitude")


def correlation(df: DataFrame) -> DataFrame:
    """Correlation of the coded and numeric columns; codes kept as text take part by their number.

    A cell without a number makes its row incomplete. Only a column that has no number at all is left out.
    """
    found, _ = present_columns(df, P.CORRELATION_COLUMNS)
    words = _columns_with_words(df, [c for c in found if isinstance(dtype_of(df, c), T.StringType)])
    coded = [c for c in found if c not in words]
    numbers = df.select(*[named(c).try_cast("double").alias(c) for c in coded])
    return corr_matrix(numbers, coded)  # one pass, so hour and month are parsed from text once without a table


def _columns_with_words(df: DataFrame, cols: Sequence[str]) -> list[str]:
    # Columns that have words and no number: with them, every row with a word would count as incomplete.
    if not cols:
        return []
    numbers = [F.count(named(c).try_cast("double")).alias(c) for c in cols]
    words = [F.count(named(c)).alias(f"words of {c}") for c in cols]
    counts = df.agg(*numbers, *words).first()
    return [c for c in cols if not counts[c] and counts[f"words of {c}"]]


ANALYSES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "area_share": lambda df: share(df, "Area_Label"),
    "severity_share": lambda df: share(df, "Severity_Label"),
    "distributions": lambda df: distributions(df, P.DISTRIBUTIONS),
    "weekdays": lambda df: counts_over_domain(df, "Day_Name", P.WEEKDAY_ORDER),
    "severity_by_speed": severity_by_speed,
    "severe_density": lambda df: geo_density(severe(df), "Latitude", "Longitude", P.GRID_STEP),
    "severe_sample": lambda df: sample_points(
        severe(df), ["Latitude", "Longitude"], P.SAMPLE_FRACTION, P.SEED, P.SAMPLE_CAP
    ),
    "severe_centre": lambda df: geo_centre(severe(df), "Latitude", "Longitude"),
    "hours": lambda df: df.groupBy("Hour").count().orderBy(F.asc_nulls_last("Hour")),
    "months": lambda df: time_pattern(df, "Accident_Date", "month"),
    "region_trend": lambda df: region_trend(df, "Police_Force", "Accident_Date"),
    "correlation": correlation,
}


def explore(df: DataFrame, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All result tables, or those in ``only``. An analysis that fails raises."""
    prepared = prepare_exploration(df)
    return {name: ANALYSES[name](prepared) for name in only or ANALYSES}


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("table")
    parser.add_argument("results")
    parser.add_argument("--only", nargs="*", choices=list(ANALYSES))
    args = parser.parse_args(argv)
    spark = session("explore")
    prepared = prepare_exploration(read_table(spark, args.table, often=True))
    for name in args.only or ANALYSES:
        write_result(ANALYSES[name](prepared), f"{args.results}/{name}", mode="overwrite")
