"""Exact quantiles per group when one group may hold a large part of all rows.

Spark's ``percentile`` keeps all distinct values of a group in the memory of one task. Here only the values
near the wanted ranks ever come together:

1. count the rows of each group, which gives the wanted ranks, and estimate its distinct values: a group
   with few of them, as any coded number has, needs no step 2, however many rows it has;
2. while a group has more than ``in_task`` candidates for a rank, cut them down: one pass takes a fixed-size
   sketch of the candidates, its slots around the rank become the new bounds, a second pass counts
   the rows up to and within the bounds. The candidates shrink to about 1/250 each time, so even 10^13 rows
   of one group need three turns. Bounds come from a sketch but ranks are always counted, so the
   result is exact;
3. count the remaining candidates by value and read off the value at each rank.

Every pass aggregates in the map tasks; the shuffles carry bounds, sketches and at most the last candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.clean import drop_incomplete, named
from tallyframe.workspace import settle

IN_TASK = 1_000_000
_SLOTS = 1000
_SKETCH_ACCURACY = 20 * _SLOTS
_ALL = -1  # bracket that serves every quantile of a group


def _inside() -> Column:
    """Strictly between the bounds; null is no bound."""
    above = F.col("lo").isNull() | (F.col("y") > F.col("lo"))
    below = F.col("hi").isNull() | (F.col("y") < F.col("hi"))
    return above & below


def _ranks(probs: Sequence[float]) -> list[tuple[Column, Column]]:
    """0-based ranks of the two neighbours between which each quantile is interpolated."""
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    return [(F.floor(a), F.ceil(a)) for a in at]


def _clamped(rank: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(rank - F.col("upto"), F.col("inside") - 1))


def _narrow(data: DataFrame, hot: DataFrame, probs: Sequence[float]) -> DataFrame:
    """One turn of step 2 for the brackets in ``hot``."""
    slots = F.array(*[F.lit(s / _SLOTS) for s in range(_SLOTS + 1)])
    sketch = (
        data.join(hot, "g")
        .filter(_inside())
        .groupBy("g", "b")
        .agg(F.percentile_approx("y", slots, _SKETCH_ACCURACY).alias("edges"))
    )
    ranks = _ranks(probs)
    first = F.element_at(F.array(*[r for r, _ in ranks]), F.col("b") + 1)
    last = F.element_at(F.array(*[r for _, r in ranks]), F.col("b") + 1)
    # One slot of slack on each side; the sketch is off by a twentieth of a slot at most.
    lo_slot = F.floor(_clamped(first) * _SLOTS / F.col("inside")) - 1
    hi_slot = F.ceil((_clamped(last) + 1) * _SLOTS / F.col("inside")) + 1
    # `get` gives null outside the array: then the old bound stays.
    bounds = hot.join(sketch, ["g", "b"]).select(
        "g",
        "b",
        "n",
        F.coalesce(F.get("edges", lo_slot.cast("int")), "lo").alias("lo"),
        F.coalesce(F.get("edges", hi_slot.cast("int")), "hi").alias("hi"),
    )
    bounds = settle(bounds, "bounds")
    counted = (
        data.join(bounds, "g")
        .groupBy("g", "b")
        .agg(
            F.count_if(F.col("y") <= F.col("lo")).alias("upto"),
            F.count_if(_inside()).alias("inside"),
        )
    )
    return bounds.join(counted, ["g", "b"])


def _brackets(data: DataFrame, probs: Sequence[float], in_task: int) -> DataFrame:
    """(g, b, n, lo, hi, upto, inside): per group and quantile the open interval that holds its candidates.

    ``upto`` rows are not above ``lo``. A group whose values fit a task has one bracket without bounds for all.
    """
    sizes = data.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("y").alias("d"))
    sizes = settle(sizes, "sizes")
    whole = [F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")]
    whole += [F.lit(0).cast("bigint").alias("upto"), F.col("n").alias("inside")]
    large = F.col("d") > in_task
    done = sizes.filter(~large).select("g", F.lit(_ALL).alias("b"), "n", *whole)
    each = F.explode(F.sequence(F.lit(0), F.lit(len(probs) - 1))).alias("b")
    hot = sizes.filter(large).select("g", each, "n", *whole)
    while not hot.isEmpty():
        narrowed = settle(_narrow(data, hot, probs), "brackets")
        done = done.unionByName(narrowed.filter(F.col("inside") <= in_task))
        hot = narrowed.filter(F.col("inside") > in_task)
    return done


def exact_quantiles(
    df: DataFrame, group: str, value: str, probs: Sequence[float], in_task: int = IN_TASK
) -> DataFrame:
    """(<group>, n, quantiles): exact, linearly interpolated quantiles per group; incomplete rows are left out.

    ``quantiles`` is an array in the order of ``probs``. At most about ``in_task`` distinct values of one
    group meet in one task. Reads ``df`` two times, and two more times per turn for larger groups.
    """
    if in_task < 10:
        raise ValueError("in_task must be at least 10")
    data = drop_incomplete(df.select(named(group).alias("g"), named(value).cast("double").alias("y")))
    brackets = _brackets(data, probs, in_task)
    values = (
        data.join(brackets.select("g", "b", "lo", "hi"), "g")
        .filter(_inside())
        .groupBy("g", "b", "y")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    upward = Window.partitionBy("g", "b").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("seen", F.sum("c").over(upward)).join(
        brackets.select("g", "b", "n", "upto"), ["g", "b"]
    )
    ranks = [r for pair in _ranks(probs) for r in pair]
    # The value at a rank is the first one whose running count exceeds it.
    found = ranked.groupBy("g", "b").agg(
        *[F.min(F.when(F.col("upto") + F.col("seen") > r, F.col("y"))).alias(f"v{i}") for i, r in enumerate(ranks)]
    )

    def value_at(i: int) -> Column:
        return F.when(ranks[i] < F.col("upto"), F.col("lo")).otherwise(F.coalesce(f"v{i}", "hi"))

    wanted = []
    for q, p in enumerate(probs):
        low, high = value_at(2 * q), value_at(2 * q + 1)
        part = F.lit(float(p)) * (F.col("n") - 1) - ranks[2 * q]
        own = F.col("b").isin(_ALL, q)
        wanted.append(F.max(F.when(own, F.when(low == high, low).otherwise(low + (high - low) * part))))
    return (
        brackets.join(found, ["g", "b"], "left")
        .groupBy(F.col("g").alias(group))
        .agg(F.max("n").alias("n"), F.array(*wanted).alias("quantiles"))
    )


def approx_quantiles(
    df: DataFrame, group: str, value: str, probs: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """As ``exact_quantiles`` but from one sketch per group in one pass; values are taken, not interpolated."""
    data = drop_incomplete(df.select(named(group).alias(group), named(value).cast("double").alias("y")))
    points = F.array(*[F.lit(float(p)) for p in probs])
    return data.groupBy(named(group)).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("y", points, accuracy).alias("quantiles")
    )
