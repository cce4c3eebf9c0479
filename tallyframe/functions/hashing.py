"""Repeatable pseudo-random numbers from a row's key.

They depend on the key and the seed alone, not on partitioning, so a retried task or another cluster size
draws the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(key: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(f"`{k}`").cast("string") for k in key]))


def _digest_of_part(key: Sequence[str], seed: int, part: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(f"`{k}`").cast("string") for k in key], part.cast("string")))


def _number(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def hash_percent(key: Sequence[str], seed: int) -> Column:
    """Whole number 0-99."""
    return _number(_digest(key, seed), 1) % 100


def hash_unit(key: Sequence[str], seed: int) -> Column:
    """Number in [0, 1); from other digits than ``hash_percent``, so both may be used on one key."""
    return _number(_digest(key, seed), 9) / F.lit(2.0**32)


def hash_unit_of_part(key: Sequence[str], seed: int, part: Column) -> Column:
    """Number in [0, 1) for the key and a number, for as many draws of one row as are wanted."""
    return _number(_digest_of_part(key, seed, part), 9) / F.lit(2.0**32)


def hash_order(key: Sequence[str], seed: int) -> Column:
    """Whole number from 0 up to 2**60, by which rows are in random order; of all digits of the digest's second half."""
    return F.conv(F.substring(_digest(key, seed), 17, 15), 16, 10).cast("bigint")
