"""Helpers shared by the operators: words, hashes, folds of ids, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.workspace import passing, settle


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: what ``bytes`` methods, which know ASCII only, do."""
    return data.lower().split()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most: Python objects are made for so many texts at a time.

    At the end of a task, memory that Arrow keeps for later goes back, as the worker waits for other tasks.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


#: Of a record batch that goes to a Python worker, about. Spark's own is 64 MB, which a JVM and a worker hold a few times over.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """From now on batches for Python workers have about BATCH_BYTES, unless the session says how large they are.

    The setting is read when a query runs, so it stays set.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


class WordHashes(dict):
    """64-bit hash of a word, remembered; ``trim`` bounds what is remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, data: bytes) -> np.ndarray:
        self.trim()
        found = words(data)
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))

    def trim(self, most: int = 100_000) -> None:
        if len(self) > most:
            self.clear()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def stars(groups: DataFrame) -> DataFrame:
    """Links (a, b) that make the components (node, component)."""
    return groups.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): columns node, component (smallest node that is reachable).

    Rounds of large and small stars, each written to the shared folder, until each node but the least of its component
    has that one as its only neighbour; links that are so already take no round. Minima are taken by aggregates with
    map-side combining and joined back by unique keys, so a node with many links is no single task's work.
    The number of rounds grows with the logarithm of the longest path. Empty links give an empty result.
    """
    with passing(links.sparkSession):
        edges = settle(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
        while True:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.max("b").alias("most"))
            least = settle(least, "least")
            if least.filter("m < a AND m < most").isEmpty():
                break
            # large star: neighbours above a node are tied to the least of its neighbourhood
            large = both.join(least.drop("most"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            # small star: a node and its lower neighbours are tied to the least of them
            lower = settle(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
            tied = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            tied = tied.unionByName(lower.select("a", F.col("m").alias("b")))
            edges = settle(tied.filter("a <> b").distinct(), "edges")
        return settle(least.select(F.col("a").alias("node"), F.col("m").alias("component")), "components", keep=True)
