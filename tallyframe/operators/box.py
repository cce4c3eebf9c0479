"""Box-plot statistics of a number per category."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.clean import drop_incomplete, named
from tallyframe.operators.profile import literal_rows
from tallyframe.operators.quantile import IN_TASK, approx_quantiles, exact_quantiles
from tallyframe.workspace import settle

_QUARTILES = [0.25, 0.5, 0.75]
_REACH = 1.5  # whiskers end at the last value within this many quartile distances of the box


def box_stats(
    df: DataFrame,
    group: str,
    value: str,
    order: Sequence[Any] | None = None,
    approx: bool = False,
    in_task: int = IN_TASK,
) -> DataFrame:
    """(group, n, q1, median, q3, whisker_lo, whisker_hi, n_outliers), incomplete rows left out.

    With ``order`` only these categories are shown, in that order, with their position ``pos``; one without
    rows has nulls. Quartiles are exact unless ``approx``.
    """
    data = df.select(named(group), named(value).cast("double").alias(value))
    if order is not None:
        data = data.filter(named(group).isin(list(order)))
    data = drop_incomplete(data)
    if approx:
        quartiles = approx_quantiles(data, group, value, _QUARTILES)
    else:
        quartiles = exact_quantiles(data, group, value, _QUARTILES, in_task)
    reach = F.lit(_REACH) * (F.col("q3") - F.col("q1"))
    boxes = settle(
        quartiles.select(
            named(group),
            "n",
            F.get("quantiles", F.lit(0)).alias("q1"),
            F.get("quantiles", F.lit(1)).alias("median"),
            F.get("quantiles", F.lit(2)).alias("q3"),
        ).select("*", (F.col("q1") - reach).alias("fence_lo"), (F.col("q3") + reach).alias("fence_hi")),
        "boxes",
    )
    y = named(value)
    within = y.between(F.col("fence_lo"), F.col("fence_hi"))
    ends = (
        data.join(boxes.select(named(group), "fence_lo", "fence_hi"), group)
        .groupBy(named(group))
        .agg(
            F.min(F.when(within, y)).alias("least"),
            F.max(F.when(within, y)).alias("most"),
            F.count_if(~within).alias("n_outliers"),
        )
    )
    # A whisker never ends inside the box.
    stats = boxes.join(ends, group).select(
        named(group).alias("group"),
        "n",
        "q1",
        "median",
        "q3",
        F.least("least", "q1").alias("whisker_lo"),
        F.greatest("most", "q3").alias("whisker_hi"),
        "n_outliers",
    )
    if order is None:
        return stats.orderBy("group")
    places = literal_rows(df.sparkSession, ["pos", "group"], [[F.lit(i), F.lit(g)] for i, g in enumerate(order)])
    # At most one row per category of the argument.
    return places.join(F.broadcast(stats), "group", "left").orderBy("pos")
