"""Class counts, class balancing, train/test split, samples.

Each operation comes in two forms: by a hash of the row's key, which gives the same rows on any cluster and
after any retry, and by Spark's own random sampling.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import unused
from tallyframe.functions.hashing import hash_order, hash_percent, hash_unit, hash_unit_of_part
from tallyframe.operators.clean import drop_incomplete, named
from tallyframe.workspace import settle

_COPIES_IN_TASK = 1000  # of one row
_ROWS_IN_TASK = 5_000_000
# A Poisson number of mean above this is drawn as the sum of several of equal mean; of each, more than _MOST_DRAWN
# has a probability below 2**-32, the finest a hashed number can tell.
_MEAN_OF_DRAW = 8
_MOST_DRAWN = 40
_SAMPLE_IN_TASK = 100_000  # rows of a capped sample that tasks keep in a heap
_DIGIT = 12  # bits by which one pass narrows the order


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(class, n) of the rows with a label."""
    labelled = df.filter(named(label).isNotNull())
    return labelled.groupBy(named(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_ratios(df: DataFrame, label: str, target: Any) -> DataFrame:
    """(class, n, ratio): how often each row of a class is needed to match the size of class ``target``."""
    counts = settle(class_counts(df, label), "classes")
    wanted = counts.filter(F.col("class") == target).first()
    if wanted is None:
        raise ValueError(f"no rows of class {target!r} in {label}")
    return counts.withColumn("ratio", F.lit(float(wanted["n"])) / F.col("n"))


def balance(df: DataFrame, label: str, target: Any, seed: int = 42) -> DataFrame:
    """Bring every class to about the size of ``target``, at random, for any number of classes.

    A row has as many copies as its class's ratio, rounded up or down at random; so larger classes are thinned,
    smaller ones repeat their rows evenly, and ``target`` stays whole.
    """
    return balance_by_unit(df, F.rand(seed), label, target).drop("copy")


def copies_by_hash(df: DataFrame, key: Sequence[str], label: str, target: Any, seed: int = 42) -> DataFrame:
    """``df`` with ``copies``, the number of times each row is to be taken; rows without a label are left out.

    A row of a class with ratio r gets floor(r) copies, and one more with probability r - floor(r).
    """
    return _with_copies(df, class_ratios(df, label, target), hash_unit(key, seed), label)


def _with_copies(df: DataFrame, ratios: DataFrame, unit: Column, label: str) -> DataFrame:
    per_class = ratios.select(F.col("class").alias("_class"), F.col("ratio").alias("_ratio"))
    whole = F.floor("_ratio")
    extra = unit < F.col("_ratio") - whole
    return (
        df.join(per_class, named(label) == F.col("_class"))
        .withColumn("copies", whole + extra.cast("bigint"))
        .drop("_class", "_ratio")
    )


def _exploded(df: DataFrame, first: Column, last: Column) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(first, last)))


def balance_by_unit(df: DataFrame, unit: Column, label: str, target: Any) -> DataFrame:
    """As ``balance_by_hash``, with a number in [0, 1) per row that decides about its last copy."""
    ratios = class_ratios(df, label, target)
    return _repeated(_with_copies(df, ratios, unit, label), ratios, _COPIES_IN_TASK)


def _repeated(counted: DataFrame, ratios: DataFrame, frequent: float) -> DataFrame:
    """Each row as often as its ``copies`` say; classes of ratios up to ``frequent`` have no row too often for a task."""
    one = F.lit(1).cast("bigint")
    rare = ratios.agg(F.max("ratio"), F.sum(F.when(F.col("ratio") > frequent, F.col("n") * F.col("ratio")))).first()
    few = _exploded(counted.filter(F.col("copies").between(1, _COPIES_IN_TASK)), one, F.col("copies"))
    if rare[0] <= frequent:
        return few.drop("copies")
    # So few rows may lie in one task that it would write all copies: spread parts of the copies first.
    tasks = max(counted.sparkSession.sparkContext.defaultParallelism, math.ceil(rare[1] / _ROWS_IN_TASK))
    parts = F.floor((F.col("copies") - 1) / _COPIES_IN_TASK)
    spread = (
        counted.filter(F.col("copies") > _COPIES_IN_TASK)
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts)))
        .repartition(tasks)
    )
    start = F.col("_part") * _COPIES_IN_TASK + 1
    many = _exploded(spread, start, F.least("copies", start + _COPIES_IN_TASK - 1)).drop("_part")
    return few.unionByName(many).drop("copies")


def balance_by_hash(df: DataFrame, key: Sequence[str], label: str, target: Any, seed: int = 42) -> DataFrame:
    """Bring every class to about the size of ``target``, repeatably; ``copy`` numbers the copies of a row.

    Rows are not shuffled, but for those of a class that must grow more than a thousandfold.
    """
    return balance_by_unit(df, hash_unit(key, seed), label, target)


def _poisson_table(mean: Column) -> Column:
    """Array of the probabilities of drawing 0, at most 1, ... at most ``_MOST_DRAWN`` of a Poisson number."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("upto"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["upto"], F.array(F.element_at(acc["upto"], -1) + p)).alias("upto"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_MOST_DRAWN)), start, add, lambda acc: acc["upto"])


def _draws(key: Sequence[str], seed: int, parts: Column, table: Column) -> Column:
    """A Poisson number: for each part, how many of the table's probabilities its hashed number reaches."""
    def add(n: Column, part: Column) -> Column:
        unit = hash_unit_of_part(key, seed, part)
        return n + F.size(F.filter(table, lambda upto: upto <= unit)).cast("bigint")

    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), parts), F.lit(0).cast("bigint"), add)


def _with_draws(
    df: DataFrame, key: Sequence[str], ratios: DataFrame, label: str, kept: Any, seed: int, thin: bool = False
) -> DataFrame:
    group, parts, table, ratio = unused(df, "class", "parts", "table", "ratio")
    in_parts = F.greatest(F.ceil(F.col("ratio") / _MEAN_OF_DRAW), F.lit(1).cast("bigint"))
    per_class = ratios.select(
        F.col("class").alias(group),
        F.col("ratio").alias(ratio),
        in_parts.alias(parts),
        _poisson_table(F.col("ratio") / in_parts).alias(table),
    )
    per_class = settle(per_class, "draws")
    drawn = _draws(key, seed, F.col(parts), F.col(table))
    copies = F.when(F.col(group) == F.lit(kept), F.lit(1).cast("bigint"))
    if thin:
        once = hash_unit_of_part(key, seed, F.lit(1)) < F.col(ratio)
        copies = copies.when(F.col(ratio) < 1, once.cast("bigint"))
    joined = df.join(per_class, named(label) == F.col(group))
    return joined.withColumn("copies", copies.otherwise(drawn)).drop(group, parts, table, ratio)


def draws_by_hash(df: DataFrame, key: Sequence[str], label: str, target: Any, seed: int = 42) -> DataFrame:
    """``df`` with ``copies``, the number of times a row is drawn; rows without a label are left out.

    A class with ratio r is drawn from with replacement: each row's number is a Poisson number of mean r, read
    off its distribution at the place that the hash of the row's key gives. So any row can come several times or not
    at all, and rows are drawn without regard to each other; the class ``target`` is kept as it is.
    """
    return _with_draws(df, key, class_ratios(df, label, target), label, target, seed)


def balance_by_draws(
    df: DataFrame, key: Sequence[str], label: str, target: Any, seed: int = 42, thin: bool = False
) -> DataFrame:
    """Bring every class to about the size of ``target`` by drawing with replacement; ``copy`` numbers a row's copies.

    Repeatable like ``balance_by_hash``, which spreads the copies evenly instead. With ``thin`` only classes that have to
    grow are drawn from with replacement; of larger classes no row comes twice.
    """
    ratios = class_ratios(df, label, target)
    counted = _with_draws(df, key, ratios, label, target, seed, thin)
    return _repeated(counted, ratios, _MEAN_OF_DRAW * (_COPIES_IN_TASK // _MOST_DRAWN))


def split_by_hash(
    df: DataFrame, key: Sequence[str], train_percent: int = 70, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test): rows with the same key are on the same side; needs no shuffle."""
    percent = hash_percent(key, seed)
    return df.filter(percent < train_percent), df.filter(percent >= train_percent)


def split_random(df: DataFrame, train_percent: int = 70, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) at random, row by row."""
    train, test = df.randomSplit([float(train_percent), float(100 - train_percent)], seed)
    return train, test


def sample_points(
    df: DataFrame, cols: Sequence[str], fraction: float = 0.1, seed: int = 42, cap: int | None = None, key: Sequence[str] = ()
) -> DataFrame:
    """A random sample of the complete rows of ``cols``, about ``fraction`` of them; for all of them see ``geo_density``.

    With ``cap`` no more than so many: a uniform sample again, not the first that come. It is taken by the hash of
    ``key``, or of ``cols`` and a number of its own for each row.
    """
    wanted = list(dict.fromkeys([*cols, *key]))
    points = drop_incomplete(df.select(*[named(c) for c in wanted]), cols).sample(False, fraction, seed)
    if cap is not None:
        row = unused(points, "row")[0]
        if not key:
            points = settle(points.withColumn(row, F.monotonically_increasing_id()), "points")
        points = sample_capped(points, key or [*cols, row], cap, seed)
    return points.select(*[named(c) for c in cols])


def sample_capped(
    df: DataFrame, key: Sequence[str], cap: int, seed: int = 42, in_task: int = _SAMPLE_IN_TASK
) -> DataFrame:
    """A uniform sample of exactly ``cap`` rows, or all rows if there are fewer: those of the smallest hash of ``key``.

    It depends on key and seed alone, and a smaller cap gives a part of a larger one's rows. Up to ``in_task`` rows,
    each task keeps its smallest in a heap and the heaps are merged. Beyond that, passes count the rows by the
    next digit of the hash until the digit that holds the last row wanted has ``in_task`` rows at most; rows before it
    are taken where they are, and only those of that digit are sorted. Equal keys are ordered by all columns.
    """
    at = unused(df, "at")[0]
    placed = df.withColumn(at, hash_order(key, seed))
    order = [F.col(at), *[named(c) for c in (*key, *(c for c in df.columns if c not in key))]]
    low, bits, wanted = 0, 60, cap
    while wanted > in_task and bits > 0:
        inside = F.col(at).between(low, low + (1 << bits) - 1)
        bits -= _DIGIT
        digit = F.shiftright(F.col(at) - low, bits).alias("digit")
        counts = placed.filter(inside).groupBy(digit).agg(F.count(F.lit(1)).alias("n"))
        found = dict(counts.collect())  # as many rows as a digit has values
        if sum(found.values()) <= wanted:  # only at the first pass
            return df
        last = 0
        while found.get(last, 0) <= wanted:
            wanted -= found.get(last, 0)
            last += 1
        low += last << bits
        if found[last] <= in_task:
            break
    if low == 0 and wanted == cap:
        return placed.orderBy(*order).limit(cap).drop(at)
    before = placed.filter(F.col(at) < low)
    rest = placed.filter(F.col(at).between(low, low + (1 << bits) - 1)).orderBy(*order).limit(wanted)
    return before.unionByName(rest).drop(at)
