"""Shares, counts over a fixed domain, trends, density grid, correlation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import columns as C
from tallyframe.operators.clean import dtype_of, drop_incomplete, named
from tallyframe.operators.profile import literal_rows


def _with_share(counts: DataFrame, count: str = "count") -> DataFrame:
    # A scalar subquery: a window over all groups would bring them into one task.
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn("pct", C.percent_of(F.col(count), total))


def share(df: DataFrame, col: str) -> DataFrame:
    """(value, count, pct, label): value counts with their percentage; ``label`` is the text of a pie slice."""
    counts = _with_share(df.groupBy(named(col).alias("value")).agg(F.count(F.lit(1)).alias("count")))
    return (
        counts.withColumn("pct", F.round("pct", 1))
        .withColumn("label", F.format_string("%.1f%%\n(%d)", "pct", "count"))
        .orderBy(F.desc("count"), F.asc_nulls_last("value"))
    )


def counts_over_domain(df: DataFrame, col: str, domain: Sequence[Any]) -> DataFrame:
    """(pos, value, count) for exactly the members of ``domain``, in its order; an absent member has null."""
    members = literal_rows(df.sparkSession, ["pos", "value"], [[F.lit(i), F.lit(v)] for i, v in enumerate(domain)])
    inside = df.filter(named(col).isin(list(domain)))
    counts = inside.groupBy(named(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    # At most one row per member of the argument.
    return members.join(F.broadcast(counts), "value", "left").select("pos", "value", "count").orderBy("pos")


def time_bucket(col: Column, grain: str) -> Column:
    """Hour 0-23, weekday 1-7 from Sunday, month 1-12 or year of a date or timestamp."""
    grains = {"hour": F.hour, "weekday": F.dayofweek, "month": F.month, "year": F.year}
    return grains[grain](col).cast("bigint")


def time_pattern(df: DataFrame, ts: str, grain: str) -> DataFrame:
    """(bucket, count, pct): how rows spread over the hours, weekdays, months or years."""
    buckets = df.groupBy(time_bucket(named(ts), grain).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    return _with_share(buckets).orderBy(F.asc_nulls_last("bucket"))


def region_trend(
    df: DataFrame, region: str, date: str, via: Sequence[tuple[DataFrame, str, str]] = ()
) -> DataFrame:
    """(region, year, count), rows per region and year.

    ``via`` leads from a key of ``df`` to the region: (dimension, key on the left, key of the dimension) per
    step. Rows are counted per first key and year *before* the first join, so a key with a third of all rows
    reaches the join as one row per year. Rows whose key no dimension knows have a null region.
    """
    year = time_bucket(named(date), "year").alias("year")
    if not via:
        counts = df.groupBy(named(region).alias("region"), year).agg(F.count(F.lit(1)).alias("count"))
        return counts.orderBy("region", "year")
    joined = df.groupBy(named(via[0][1]), year).agg(F.count(F.lit(1)).alias("rows_of_key"))
    for dimension, left, right in via:
        joined = joined.join(dimension, joined[left] == dimension[right], "left")
    return (
        joined.groupBy(named(region).alias("region"), "year")
        .agg(F.sum("rows_of_key").alias("count"))
        .orderBy("region", "year")
    )


def geo_centre(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Mean of both coordinates over the rows that have both."""
    points = drop_incomplete(df.select(named(lat), named(lon)))
    return points.agg(F.avg(named(lat)).alias("lat"), F.avg(named(lon)).alias("lon"))


def geo_density(df: DataFrame, lat: str, lon: str, step: float) -> DataFrame:
    """(lat_cell, lon_cell, lat, lon, count): rows per square cell; ``lat`` and ``lon`` are its lower edges."""
    points = drop_incomplete(df.select(named(lat), named(lon)))
    cell = [F.floor(named(c) / F.lit(float(step))).alias(n) for c, n in ((lat, "lat_cell"), (lon, "lon_cell"))]
    counts = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        "lat_cell",
        "lon_cell",
        (F.col("lat_cell") * F.lit(float(step))).alias("lat"),
        (F.col("lon_cell") * F.lit(float(step))).alias("lon"),
        "count",
    )


def severe_points(df: DataFrame, severity: str, codes: Sequence[int], lat: str, lon: str) -> DataFrame:
    """Coordinates of the rows of the given severities that have both."""
    return drop_incomplete(df.filter(named(severity).isin(list(codes))).select(named(lat), named(lon)))


def _numeric_columns(df: DataFrame, cols: Sequence[str]) -> None:
    text = [c for c in cols if not isinstance(dtype_of(df, c), T.NumericType)]
    if text:
        raise TypeError(f"not numeric: {', '.join(text)}")


#: What is known of complete rows: their number; per column its mean, least and greatest value, and its products with each
#: column, of deviations from the means, as doubles.
_MOMENTS = "n long, moments binary"
#: Rows that are multiplied at a time: a few columns or a few hundred, they stay in a core's cache.
_BLOCK = 1000
_Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of every pair of numeric columns; null if one of them is constant.

    Rows are read once, in blocks that are multiplied by themselves as matrices: each task adds up one matrix of
    (columns x columns) products of deviations. Those of tasks are merged in a tree; one of them is all that the driver
    sees. Rows with any gap are left out of all pairs, so every pair is measured on the same rows.
    """
    _numeric_columns(df, cols)
    # One array a row: of many columns, Spark adds up the sizes anew for every row that it hands over.
    cells = df.select(F.array(*[named(c).cast("double") for c in cols]).alias("row"))
    of_rows, of_tasks = _moment_tasks(len(cols))
    found = cells.mapInArrow(of_rows, _MOMENTS)
    for tasks in (df.sparkSession.sparkContext.defaultParallelism, 1):
        found = found.repartition(tasks).mapInArrow(of_tasks, _MOMENTS)
    whole = next(iter(found.collect()), None)  # a row of one task; read to its end, or its worker would complain
    rows = [(a, b, None) for a in cols for b in cols]
    if whole and whole["n"] > 1:
        _, least, greatest, *products = np.frombuffer(whole["moments"]).reshape(-1, len(cols))
        spread = np.sqrt(np.diag(products))
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.array(products) / np.outer(spread, spread)
        np.fill_diagonal(r, 1.0)
        # By value, not by variance: the rounding of a constant's mean must not pass for variance.
        varies = greatest > least
        rows = [
            (a, b, float(r[i, j]) if varies[i] and varies[j] else None)
            for i, a in enumerate(cols)
            for j, b in enumerate(cols)
        ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def _moment_tasks(cols: int) -> tuple[_Task, _Task]:
    """What a task does with rows of ``cols`` cells, and with what other tasks found.

    Made here and not in the module, so that workers need not have it.
    """

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                cells = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, cols)  # a null is NaN
                for at in range(0, len(cells), _BLOCK):
                    rows = cells[at : at + _BLOCK]
                    gaps = np.isnan(rows).any(axis=1)
                    rows = rows[~gaps] if gaps.any() else rows
                    if n := len(rows):
                        mean = rows.mean(axis=0)
                        apart = rows - mean
                        yield n, np.vstack([mean, rows.min(axis=0), rows.max(axis=0), apart.T @ apart])

        return merged(blocks())

    def of_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tasks() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                for n, moments in zip(*batch.columns):
                    yield n.as_py(), np.frombuffer(moments.as_buffer()).reshape(-1, cols)

        return merged(tasks())

    def merged(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        # One part at a time. Deviations are from the mean of their part and are moved to the common mean, so sums of
        # squares of large numbers lose no digits.
        total, whole = 0, None
        with np.errstate(invalid="ignore"):
            for n, part in parts:
                if whole is None:
                    total, whole = n, part.copy()
                    continue
                apart = part[0] - whole[0]
                whole[3:] += part[3:] + np.outer(apart, apart) * (n / (total + n) * total)
                total += n
                whole[0] += apart * (n / total)
                whole[1], whole[2] = np.minimum(whole[1], part[1]), np.maximum(whole[2], part[2])
        if whole is not None:
            yield pa.RecordBatch.from_pydict({"n": [total], "moments": [whole.tobytes()]})

    return of_rows, of_tasks
