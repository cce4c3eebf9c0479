"""Resampling documents towards a target: n-gram bucket gains and Gumbel noise (DSIR).

A text's A-Z are lower-cased and an untrained ``Split`` of the ``tokenizers`` library cuts it at every ASCII
character that is no letter or digit, giving words with offsets. A feature is a window from one word's start to the
end of the same word or of one of the next, its words joined by one space; its bucket is the CRC of its bytes. The
bucket numbers of each text are written once; the histogram of all rows, the gains and the weights come from that
table. The drawn rows are the best by gain and noise, found by a sort that is dealt by ranges.

Null and empty texts have no words, no features and weight 0. A null doc_id counts as empty text in the noise and
comes last among ties. Repeated rows are scored each. An empty table of documents gives no rows; an empty target
has zero counts, like any other. Other columns are neither read nor returned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from tallyframe.llm.common import slices
from tallyframe.operators.rank import with_position
from tallyframe.workspace import settle

BUCKETS = 10_000
LONGEST = 3  # words of a feature
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Characters given to the library at a time; it keeps several numbers for each.
CUT = 1 << 15

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_FEATURES = "doc_id long, n_words long, n_features long, buckets binary"
_COUNTS = "bucket int, n long"


def word_split() -> Split:
    return Split(Regex(_WORD), "removed", invert=True)


def _words(split: Split, text: str) -> Iterator[tuple[str, tuple[int, int]]]:
    """Words with their offsets in ``text``; long texts go to the library in pieces that end between words."""
    at = 0
    while at < len(text):
        found = _BETWEEN.search(text, at + CUT)
        end = found.end() if found else len(text)
        for word, (a, b) in split.pre_tokenize_str(text[at:end]):
            yield word, (at + a, at + b)
        at = end


def feature_buckets(split: Split, text: bytes, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to ``longest`` words."""
    lowered = text.lower().decode()  # bytes.lower knows ASCII only
    small = np.min_scalar_type(buckets - 1)
    n_words, out, last = 0, [], []
    found = _words(split, lowered)
    while part := list(islice(found, CUT)):
        words = last + [word for word, _ in part]
        widths = np.array([len(w) for w in last] + [b - a for _, (a, b) in part])
        ends = np.cumsum(widths + 1) - 1  # offsets once one space joins the words
        joined, starts = " ".join(words), ends - widths
        if joined.isascii():
            line = joined.encode()
        else:  # offsets of characters become offsets of bytes
            line = joined.encode()
            lead = np.flatnonzero((np.frombuffer(line, np.uint8) & 0xC0) != 0x80)
            lead = np.append(lead, len(line))
            starts, ends = lead[starts], lead[ends]
        starts, ends = starts.tolist(), ends.tolist()
        for n in range(1, longest + 1):
            new = max(len(last) - n + 1, 0)  # windows within the words carried over are counted already
            crcs = [crc32(line[a:b]) for a, b in zip(starts[new:], ends[new + n - 1 :])]
            out.append((np.array(crcs, np.uint32) % np.uint32(buckets)).astype(small))
        n_words += len(part)
        last = words[-(longest - 1) :] if longest > 1 else []
    return n_words, np.concatenate(out) if out else np.empty(0, small)


def _features(docs: DataFrame, buckets: int) -> DataFrame:
    """Per row: doc_id, n_words, n_features, and the features' buckets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = word_split()
        for batch in slices(batches):
            words, numbers, data = [], [], []
            for text in batch.column(1).to_pylist():
                n, found = feature_buckets(split, text or b"", buckets)
                words.append(n)
                numbers.append(len(found))
                data.append(found.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(numbers, pa.int64()), pa.array(data, pa.binary())],
                ["doc_id", "n_words", "n_features", "buckets"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, _FEATURES)


def _histogram(features: DataFrame, buckets: int) -> list[int]:
    """How often each bucket occurs: one row per bucket from each task, and ``buckets`` numbers in all."""
    small = np.min_scalar_type(buckets - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for data in batch.column(0).to_pylist():
                counts += np.bincount(np.frombuffer(data, small), minlength=buckets)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found])], ["bucket", "n"])

    total = [0] * buckets
    per_task = features.select("buckets").mapInArrow(run, _COUNTS)
    for bucket, n in per_task.groupBy("bucket").agg(F.sum("n")).collect():  # ``buckets`` rows at most
        total[bucket] = n
    return total


def gains(everything: list[int], target: list[int]) -> list[int]:
    """Thousandths of the logarithm of a bucket's share of the target over its share of all, smoothed by one."""
    k, s_all, t_all = len(everything), sum(everything), sum(target)
    return [
        math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k))))
        for s, t in zip(everything, target, strict=True)
    ]


def _weights(features: DataFrame, gain: list[int], buckets: int) -> DataFrame:
    small, table = np.min_scalar_type(buckets - 1), np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sums = [int(table[np.frombuffer(data, small)].sum()) for data in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "n_words", "n_features", "weight"]
            )

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and rank for the drawn.

    ``docs`` has doc_id and text, ``target`` text. Of the documents with ``min_words`` words or more, ``percent``
    in a hundred are drawn, those of the highest scores (weight plus Gumbel noise from the id and ``seed``).
    """
    features = settle(_features(docs, buckets), "features")
    wanted = _features(target.select(F.lit(None).alias("doc_id"), "text"), buckets)
    gain = gains(_histogram(features, buckets), _histogram(wanted, buckets))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((number + 0.5) / F.lit(4294967296.0))))
    scored = settle(
        _weights(features, gain, buckets).select(
            "doc_id",
            "n_features",
            "weight",
            (F.col("weight") + noise).alias("score"),
            (F.col("n_words") >= min_words).alias("eligible"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "scored",
    )
    drawn = scored.filter("eligible").count() * percent // 100
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    place = F.col("place")
    return with_position(scored, order, "place").select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("eligible") & (place <= drawn), place).alias("rank")
    )
