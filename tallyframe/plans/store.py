"""Ingest of a CSV table into Parquet, one folder per year.

``spark-submit run.py store <csv> <folder for the table>``
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tallyframe.operators.clean import present_columns
from tallyframe.plans.prepare import read_table, session
from tallyframe.sources.tables import ingest


def store(df: DataFrame, path: str, partition_by: Sequence[str] = ("Year",), mode: str = "error") -> DataFrame:
    """Write the table partitioned by those columns it has, so that later reads of some years skip the others."""
    return ingest(df, path, present_columns(df, partition_by)[0], mode)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("csv")
    parser.add_argument("table")
    parser.add_argument("--partition-by", nargs="*", default=["Year"])
    parser.add_argument("--overwrite", action="store_true")
    args = parser.parse_args(argv)
    df = read_table(session("store"), args.csv)
    store(df, args.table, args.partition_by, "overwrite" if args.overwrite else "error")
