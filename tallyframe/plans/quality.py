"""Data-quality profile of one table.

``spark-submit run.py quality <table> <folder for results>``
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tallyframe import presets as P
from tallyframe.operators.clean import present_columns
from tallyframe.operators.profile import categorical_profile, null_report, row_count, schema_report
from tallyframe.plans.prepare import read_table, session
from tallyframe.sources.tables import first_rows, write_result


def quality(
    df: DataFrame, categorical: Sequence[str] = tuple(P.PROFILE_COLUMNS), k: int = P.TOP_VALUES
) -> dict[str, DataFrame]:
    """Schema, first rows, row count, missing values and frequent values; absent columns are named."""
    found, missing = present_columns(df, categorical)
    tables = {
        "schema": schema_report(df),
        "head": first_rows(df, P.HEAD_ROWS),
        "row_count": row_count(df),
        "nulls": null_report(df),
    }
    if found:
        tables["categories"] = categorical_profile(df, found, k)
    if missing:
        tables["absent"] = df.sparkSession.createDataFrame([(c,) for c in missing], "column string")
    return tables


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("table")
    parser.add_argument("results")
    args = parser.parse_args(argv)
    spark = session("quality")
    for name, table in quality(read_table(spark, args.table, often=True)).items():
        write_result(table, f"{args.results}/{name}", mode="overwrite")
