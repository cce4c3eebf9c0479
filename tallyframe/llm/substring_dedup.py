"""Removal of passages that occur more than once, by windows whose length doubles from level to level.

A window of ``n`` words is named by the names of the two windows of ``ceil(n / 2)`` words that cover it, down to single
words, so names of all lengths come from the same few steps over a text. A window can only recur if both halves do.

Level 1, half the length asked for: of the half windows inside a full window the first one with the smallest name
stands for it. Equal full windows have equal representatives, so a full window whose representative occurs once goes.
Only representatives, about one position in ten, are counted; the windows that share one follow each other.

Level 2, up to twice as long: the stretch under all windows of one representative is named by its first and last
window. If the stretch recurs, so do all windows in it, and one row has settled them all.

Level 3: windows of the other stretches are counted one by one, by names of 128 bits. Of equal stretches one joins in,
if its representative stands in another stretch too, so that windows at the edge of a passage find their equals.

The search ends when a level leaves no candidates. Longer windows need no level: the words under a longer one that
recurs lie under windows of the length asked for, which recur too.

Of names that hold over one in ``FREQUENT`` rows there are fewer than ``FREQUENT``; only those are broadcast.
Windows with a frequent representative are counted in parts and then over the parts, so no name, however frequent, is
one task's work. Equal texts are one text after level 2: all their stretches recur, and one of them joins in.

Null and empty texts have no words and lose none, as do texts shorter than the window. Rows with equal texts, repeated
ids and null ids are rows like any other and get equal results. An empty table gives an empty result. Other columns
are kept by ``without_repeats``, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import unused
from tallyframe.llm.common import mix64, slices
from tallyframe.workspace import settle

WINDOW = 35
#: A name with more than one in so many rows is frequent.
FREQUENT = 10_000
#: Windows whose representative occurs at least so often are counted in parts.
MANY = 1000
#: Bytes of a text whose words are Python objects at a time.
CUT = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_NARROW = (
    "doc_id long, k1 long, k2 long, n_words long, all_sha256 string, "
    "names array<long>, u1 array<long>, u2 array<int>, first array<int>, many array<int>"
)
_STRETCH = ["names", "u1", "u2", "first", "many"]
_WINDOWS = "h1 long, h2 long, uid long, place int, n long, part int"
_KEPT = "k1 long, k2 long, n_removed long, kept binary, spans array<struct<first:int,last:int>>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def cuts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part at a time."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + CUT)
        end = found.end() if found else len(text)
        yield text[at:end].split()
        at = end


class WordNames(dict):
    """128-bit names of words, remembered."""

    def __missing__(self, word: bytes) -> bytes:
        value = self[word] = xxhash.xxh3_128_digest(word)
        return value

    def of(self, text: bytes) -> np.ndarray:
        """Two numbers of 64 bits for each word, one row per word."""
        if len(self) > 400_000:
            self.clear()
        parts = [b"".join(map(self.__getitem__, words)) for words in cuts(text)]
        return np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)


def lengths(window: int) -> list[int]:
    """Window lengths from 1 to ``window``, each at most twice the one before."""
    out = [window]
    while out[-1] > 1:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def half_length(window: int) -> int:
    return -(-window // 2)


def doubled(names: np.ndarray, by: int) -> np.ndarray:
    """Names of windows that are ``by`` words longer, from the names of the windows at both ends."""
    if len(names) <= by:
        return names[:0]
    return mix64(mix64(names[: len(names) - by] * _ODD) + names[by:])


def window_names(words: np.ndarray, window: int) -> np.ndarray:
    at = 1
    for n in lengths(window)[1:]:
        words, at = doubled(words, n - at), n
    return words


def representatives(half: np.ndarray, window: int) -> np.ndarray:
    """For each full window the place of the half window that stands for it."""
    within = window - half_length(window) + 1
    if len(half) < within:
        return np.empty(0, np.int64)
    inside = np.lib.stride_tricks.sliding_window_view(half, within)
    step = 1 << 16
    parts = [inside[at : at + step].argmin(1) for at in range(0, len(inside), step)]
    return np.concatenate(parts) + np.arange(len(inside))


def _key() -> list[Column]:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text")]


def _listed(lists: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists), kind))


def stretches(words: np.ndarray, window: int) -> list[np.ndarray]:
    """Per stretch: its representative's name, two names of its own, its first window, and how many it has."""
    half = window_names(words[:, 0], half_length(window))
    full = [doubled(half, window // 2) if window > 1 else half, window_names(words[:, 1], window)]
    at, first, many = np.unique(representatives(half, window), return_index=True, return_counts=True)
    where = ((at - first) * (window + 1) + many).astype(np.uint64)
    u1, u2 = (mix64(mix64(mix64(f[first] * _ODD) + f[first + many - 1]) + where) for f in full)
    return [half[at].view(np.int64), u1.view(np.int64), (u2 >> np.uint64(32)).astype(np.uint32).view(np.int32), first, many]


def _narrow(docs: DataFrame, window: int) -> DataFrame:
    """Per row: doc_id, its text's key, number of words, digest of all words, and its stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        for batch in slices(batches):
            sizes, digests, found = [], [], [[np.empty(0, np.int64)] for _ in kinds]
            for text in batch.column(3).to_pylist():
                words = names.of(text)
                for out, column in zip(found, stretches(words, window)):
                    out.append(column)
                digest = hashlib.sha256()
                for n, part in enumerate(part for part in cuts(text) if part):
                    digest.update((b" " if n else b"") + b" ".join(part))
                sizes.append(len(words))
                digests.append(digest.hexdigest())
            columns = [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
            columns += [_listed(lists, kind).slice(1) for lists, kind in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "n_words", "all_sha256", *_STRETCH])

    return docs.select(F.col("doc_id").cast("long"), *_key()).mapInArrow(run, _NARROW)


def _with_counts(rows: DataFrame, counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows whose keys ``counts`` has, with its column ``value``; fewer than ``FREQUENT`` of its rows are broadcast."""
    total = counts.agg(F.sum(value)).first()[0] or 0
    is_frequent = F.col(value) * FREQUENT > total
    often = F.broadcast(counts.filter(is_frequent))
    marked = rows.join(often, keys, "left")
    rare = marked.filter(F.col(value).isNull()).select(*rows.columns).join(counts.filter(~is_frequent), keys)
    return rare.unionByName(marked.filter(F.col(value).isNotNull()))


def _surviving(narrow: DataFrame) -> DataFrame | None:
    """Per text its stretches whose representative occurs again; None if there are none.

    ``recurs`` says that the stretch does, ``joins`` that its windows are to be counted.
    """
    names = narrow.select(F.explode("names").alias("name"))
    counts = settle(names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "names")
    if counts.isEmpty():
        return None
    rows = narrow.select("row", F.inline(F.arrays_zip(*_STRETCH))).withColumnRenamed("names", "name")
    rows = settle(_with_counts(rows, counts, ["name"], "n"), "level-1")
    stretch = ["name", "u1", "u2"]
    one = F.min(F.struct("row", "first", "many", "n")).alias("one")
    equal = settle(rows.groupBy(*stretch).agg(F.count(F.lit(1)).alias("equal"), one), "level-2")
    chosen = (F.col("one.row") == F.col("row")) & (F.col("one.first") == F.col("first"))
    recurring = _with_counts(rows, equal.filter("equal > 1"), stretch, "equal")
    recurring = recurring.withColumns({"recurs": F.lit(True), "joins": chosen & (F.col("n") > F.col("equal"))})
    single = equal.filter("equal = 1").select("one.*").withColumns({"recurs": F.lit(False), "joins": F.lit(True)})
    recurring = recurring.select(*single.columns)
    keyed = recurring.unionByName(single).join(narrow.select("row", "k1", "k2"), "row")
    once = keyed.groupBy("k1", "k2", "first").agg(
        F.first("many").alias("many"), F.first("n").alias("n"), F.max("recurs").alias("recurs"), F.max("joins").alias("joins")
    )
    return once.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "many", "n", "recurs", "joins")).alias("rivals"))


def ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """All places of the windows of stretches."""
    ends = np.cumsum(many)
    return np.repeat(first - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)


def _windows(candidates: DataFrame, window: int) -> DataFrame:
    """Full windows of the stretches that are to be counted, with the number of times they stand for.

    Of windows that recur within their text, the first is counted with all; the others, which need no more
    counting, are spread over parts below 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in slices(batches, 64):
            for n, text in enumerate(batch.column("text").to_pylist()):
                uid, rivals = batch.column("uid")[n].as_py(), batch.column("rivals")[n].values
                joins = rivals.field("joins").to_numpy(zero_copy_only=False)
                first, many, often, recurs = (
                    rivals.field(c).to_numpy(zero_copy_only=False)[joins] for c in ("first", "many", "n", "recurs")
                )
                at, often = ranges(first, many), np.repeat(often, many)
                words = names.of(text)
                h1, h2 = (window_names(words[:, side], window)[at] for side in (0, 1))
                order = np.lexsort((at, h2, h1))
                a, b = h1[order], h2[order]
                is_first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(at)]
                weight = np.where(np.repeat(recurs, many), 2, 1)[order]
                count = np.full(len(at), 2)
                count[is_first] = np.add.reduceat(weight, np.flatnonzero(is_first)) if len(at) else 0
                spread = mix64(order.astype(np.uint64) + np.uint64(uid))
                parts = np.where(often >= MANY, np.sqrt(often).astype(np.int64), 0)[order]
                part = np.where(parts > 0, 1 + (spread % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64), 0)
                part = np.where(is_first, part, -1 - (spread >> np.uint64(44)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a.view(np.int64)),
                        pa.array(b.view(np.int64)),
                        pa.array(np.full(len(at), uid, np.int64)),
                        pa.array(at[order], pa.int32()),
                        pa.array(count, pa.int64()),
                        pa.array(part, pa.int32()),
                    ],
                    ["h1", "h2", "uid", "place", "n", "part"],
                )

    joining = candidates.filter(F.exists("rivals", lambda r: r["joins"]))
    return joining.select("uid", "text", "rivals").mapInArrow(run, _WINDOWS)


def _recurring(windows: DataFrame) -> DataFrame:
    """uid and place of each window whose name occurs again."""
    of_part = F.sum("n").over(Window.partitionBy("h1", "h2", "part"))
    in_parts = F.col("part") > 0
    counted = windows.withColumn("n", of_part).filter((F.col("n") > 1) | in_parts)
    counted = settle(
        counted.select("uid", "place", "n", "part", *[F.when(in_parts, F.col(h)).alias(h) for h in ("h1", "h2")]),
        "counted",
    )
    parts = counted.filter(in_parts).groupBy("h1", "h2", "part").agg(F.first("n").alias("n"))
    elsewhere = parts.groupBy("h1", "h2").agg(F.sum("n").alias("total")).filter("total > 1")
    alone = counted.filter(in_parts & (F.col("n") == 1)).join(elsewhere, ["h1", "h2"], "left_semi")
    return counted.filter("n > 1").select("uid", "place").unionByName(alone.select("uid", "place"))


def covered(places: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words lie in a window that starts at one of ``places``."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, places, 1)
    np.add.at(edges, places + window, -1)
    return np.cumsum(edges[:-1]) > 0


def _cut_out(candidates: DataFrame, places: DataFrame, window: int) -> DataFrame:
    per_text = places.groupBy("uid").agg(F.collect_list("place").alias("places"))
    whole = F.transform(F.filter("rivals", lambda r: r["recurs"]), lambda r: F.struct(r["first"], r["many"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            removed, kept, spans = [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                n_words = sum(map(len, cuts(text)))
                whole, single = (batch.column(c)[n].values for c in ("whole", "places"))
                known = ranges(*(whole.field(c).to_numpy(zero_copy_only=False) for c in (0, 1)))
                gone = covered(np.concatenate([known, single.to_numpy(zero_copy_only=False)]).astype(np.int64), n_words, window)
                out, at = [], 0
                for words in cuts(text):
                    left = np.flatnonzero(~gone[at : at + len(words)])
                    if len(left):
                        out.append(b" ".join([words[i] for i in left]))
                    at += len(words)
                turns = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(out))
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in turns.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                ],
                ["k1", "k2", "n_removed", "kept", "spans"],
            )

    joined = candidates.select("uid", "k1", "k2", "text", whole.alias("whole")).join(per_text, "uid", "left")
    joined = joined.withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
    joined = joined.filter((F.size("whole") > 0) | (F.size("places") > 0))
    return joined.select("k1", "k2", "text", "whole", "places").mapInArrow(run, _KEPT)


def _frequent(narrow: DataFrame) -> DataFrame:
    """k1, k2 and copies of texts that over one in FREQUENT documents have, so fewer than FREQUENT of them."""
    copies = narrow.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    return settle(copies.filter(F.col("copies") * FREQUENT > narrow.count()), "frequent")


def _texts_with_repeats(docs: DataFrame, narrow: DataFrame, window: int) -> DataFrame:
    """One row for each different text that loses words: its key, what is kept, and the spans of words that go."""
    rivals = _surviving(narrow)
    if rivals is None:
        return docs.sparkSession.createDataFrame([], _KEPT)
    rivals, key = settle(rivals, "rivals"), ["k1", "k2"]
    texts, wanted, frequent = docs.select(*_key()), rivals.select(*key), F.broadcast(_frequent(narrow).select(*key))

    def one_each(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(F.first("text").alias("text"))

    # a text that many documents have is made one in each task before it moves; of others, only those wanted move
    rest = one_each(texts.join(frequent, key, "left_anti").join(wanted, key, "left_semi"))
    once = rest.unionByName(one_each(texts.join(frequent, key, "left_semi"))).join(rivals, key)
    candidates = settle(once.withColumn("uid", F.monotonically_increasing_id()), "candidates")
    return _cut_out(candidates, _recurring(_windows(candidates, window)), window)


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, and the digest of the words that are kept.

    A word goes if a window of ``window`` words covers it whose words also start anywhere else, in any document.
    """
    narrow = settle(_narrow(docs, window).withColumn("row", F.monotonically_increasing_id()), "narrow")
    key, found = ["k1", "k2"], ["n_removed", "kept_sha256"]
    changed = _texts_with_repeats(docs, narrow, window)
    changed = settle(changed.select(*key, "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "changed")
    rows = narrow.select("doc_id", *key, "n_words", "all_sha256")
    # two numbers and a digest for each
    frequent = _frequent(narrow).join(changed, key, "left")
    marked = rows.join(F.broadcast(settle(frequent, "frequent")), key, "left")
    rest = marked.filter("copies is null").drop("copies", *found).join(changed, key, "left")
    columns = ["doc_id", "n_words", "all_sha256", *found]
    both = rest.select(*columns).unionByName(marked.filter("copies is not null").select(*columns))
    return both.select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"),
    )


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the spans of words that go (first and last, counted from 0), for documents that lose any."""
    narrow = settle(_narrow(docs, window).withColumn("row", F.monotonically_increasing_id()), "narrow")
    changed = settle(_texts_with_repeats(docs, narrow, window).select("k1", "k2", "spans"), "changed")
    return narrow.select("doc_id", "k1", "k2").join(changed, ["k1", "k2"]).select("doc_id", "spans")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the words that are kept, joined by one space, as the text of rows that lose any."""
    narrow = settle(_narrow(docs, window).withColumn("row", F.monotonically_increasing_id()), "narrow")
    changed = _texts_with_repeats(docs, narrow, window).select("k1", "k2", "kept")
    k1, k2, kept = unused(docs, "k1", "k2", "kept")
    changed = changed.withColumnsRenamed({"k1": k1, "k2": k2, "kept": kept})
    keyed = docs.withColumns({name: col for name, col in zip((k1, k2), _key(), strict=False)})
    text = F.coalesce(F.col(kept).cast("string"), F.col("text")).alias("text")
    return keyed.join(changed, [k1, k2], "left").select(
        *[text if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    )
