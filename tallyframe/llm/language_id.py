"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams, most frequent first. A document's own list is
compared with each profile by the out-of-place distance: for every n-gram, how many places its rank is off, and the
length of a profile if the profile lacks it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import unused
from tallyframe.llm.common import fold, slices
from tallyframe.operators.rank import with_position
from tallyframe.workspace import settle

#: Length of a profile.
PROFILE = 400
#: Documents that a profile is learned from, at most about so many a language; a documented bound.
LEARN_FROM = 4000
#: Languages whose profiles a task holds at a time, PROFILE n-grams each; more of them take more passes.
LANGUAGES = 128
UNKNOWN = "und"

#: Characters of a text that are looked at together.
CUT = 1 << 20

_WORDS = re.compile(r"[^\W\d_]+")
_BETWEEN = re.compile(r"[\W\d_]")
_BORDER = 0x5F  # "_" stands for the border of a word
_NONE = np.empty(0, np.int64)


@cache
def _kinds() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if it is another character that words may hold, else 0."""
    kinds = np.zeros(0x110000, np.uint8)
    for first in range(0, len(kinds), 1 << 12):  # few characters at a time: what is made here stays with the worker
        some = "".join(map(chr, range(first, first + (1 << 12))))
        for word in _WORDS.finditer(some):
            kinds[first + word.start() : first + word.end()] = 1
        letters = first + np.flatnonzero(np.fromiter(map(str.isalpha, some), bool, len(some)))
        kinds[letters] *= 2
    return kinds


def _grams(text: str) -> np.ndarray:
    """N-grams of one to three letters of all words of a text, each as one number of 63 bits; borders count as letters."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = _kinds()[points]
    at = np.flatnonzero(kinds)
    word = np.cumsum(np.diff(at, prepend=-2) > 1)
    letter = kinds[at] == 2
    own, word = points[at[letter]].astype(np.int64), word[letter]
    if not len(own):
        return _NONE
    new = word[1:] != word[:-1]
    first, last = np.append(True, new), np.append(new, True)
    before, after = np.roll(own, 1), np.roll(own, -1)
    before[first] = after[last] = _BORDER
    pairs = before << 21 | own
    return np.concatenate([own, pairs, own[last] << 21 | _BORDER, pairs << 21 | after])


def count_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, sorted, and how often each occurs. Long texts are cut between words."""
    lowered, at, parts = (text or "").lower(), 0, []
    while at < len(lowered):
        found = _BETWEEN.search(lowered, at + CUT)
        end = found.end() if found else len(lowered)
        parts.append(np.unique(_grams(lowered[at:end]), return_counts=True))
        at = end
    if len(parts) < 2:
        return parts[0] if parts else (_NONE, _NONE)
    grams, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(of, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)


def ranked(grams: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent n-grams, most frequent first; equal counts by the n-gram's number."""
    if len(grams) > n:  # only those that reach the n-th count need sorting
        among = times >= np.partition(times, len(times) - n)[len(times) - n]
        grams, times = grams[among], times[among]
    return grams[np.lexsort((grams, -times))[:n]]


def learn(labelled: DataFrame, size: int = PROFILE, learn_from: int = LEARN_FROM) -> DataFrame:
    """Profiles of the languages in ``labelled`` (doc_id, text, lang): lang, place (of the language), rank, gram.

    A language is learned from about ``learn_from`` documents, chosen by a hash of the id, so reruns agree. Rows
    without text or lang teach nothing. Languages are numbered by code point; there may be any number of them.
    """
    rows = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = with_position(settle(rows.groupBy("lang").count(), "languages"), [F.asc("lang")], "place")
    shares = settle(sizes.select("lang", "place", (F.lit(float(learn_from)) / F.col("count")).alias("share")), "shares")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(shares, "lang").filter(draw < F.col("share")).select("place", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {}, 0

        def out() -> pa.RecordBatch:
            langs, found, times = [_NONE], [_NONE], [_NONE]
            for lang, parts in held.items():
                of, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                found.append(of)
                times.append(np.bincount(back, np.concatenate([p[1] for p in parts]), len(of)).astype(np.int64))
                langs.append(np.full(len(of), lang, np.int64))
            held.clear()
            arrays = [pa.array(np.concatenate(x)) for x in (langs, found, times)]
            return pa.RecordBatch.from_arrays(arrays, names=["place", "gram", "n"])

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = count_grams(text)
                held.setdefault(lang, []).append(counts)
                n += len(counts[0])
                if n > 1_000_000:
                    yield out()
                    n = 0
        yield out()

    counts = chosen.mapInArrow(task, "place long, gram long, n long").groupBy("place", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("place").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    return settle(best.join(shares.select("lang", "place"), "place").select("lang", "place", "rank", "gram"), "profiles")


class Ranker:
    """Profiles as one table of ranks: a row for each n-gram that any profile has, a column for each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(profiles), size
        self.known = np.array(sorted({g for grams in profiles.values() for g in grams}), np.int64)
        self.ranks = np.full((len(self.known) + 1, len(self.langs)), -1, np.int32)  # the last row: in no profile
        for column, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.known, profiles[lang]), column] = np.arange(len(profiles[lang]))

    def predict(self, grams: np.ndarray, times: np.ndarray) -> tuple[str, float]:
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(grams, times, self.size)
        place = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        at = self.ranks[np.where(self.known[place] == own, place, len(self.known))]
        off = np.abs(at - np.arange(len(own), dtype=np.int32)[:, None])
        distance = np.where(at < 0, self.size, off).sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], float(1.0 - distance[best] / (self.size * len(own)))


def _held(profiles: DataFrame, first: int) -> dict[str, list[int]]:
    """The profiles of ``LANGUAGES`` languages, from the one at place ``first`` on."""
    some = profiles.filter(F.col("place").between(first, first + LANGUAGES - 1)).orderBy("place", "rank")
    found: dict[str, list[int]] = {}
    for row in some.select("lang", "gram").collect():  # LANGUAGES * size rows at most
        found.setdefault(row["lang"], []).append(row["gram"])
    return found


def _ranking(profiles: dict[str, list[int]], size: int):
    """A function of texts: the nearest of the profiles, the score, and whether the text has a letter."""

    @F.arrow_udf("struct<lang:string,score:double,letters:boolean>")
    def rank(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranker = Ranker(profiles, size)
        for whole in texts:
            parts = []
            for at in range(0, len(whole), 256):
                counts = [count_grams(t) for t in whole.slice(at, 256).to_pylist()]
                langs, scores = zip(*(ranker.predict(*c) for c in counts))
                arrays = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([len(c[0]) > 0 for c in counts])]
                parts.append(pa.StructArray.from_arrays(arrays, ["lang", "score", "letters"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang", pa.string()), ("score", pa.float64()), ("letters", pa.bool_())]))

    return rank.asNondeterministic()  # else the planner runs it once for a filter and again for the result


def predicted(docs: DataFrame, profiles: DataFrame, out: str, size: int = PROFILE) -> DataFrame:
    """``docs`` with a column ``out``: the language predicted, its score (0 to 1), and whether the text has a letter.

    A text that is null or without a letter is ``und`` with score 0, as is every text when nothing was learned.
    Equal distances give the first language by code point. Only texts go to the Python workers. More than
    ``LANGUAGES`` languages are ranked in several passes, each written, so that no task holds more of them.
    """
    read = F.col("text").cast("string")
    most = profiles.agg(F.max("place")).first()[0] or 1
    found = docs.withColumn(out, _ranking(_held(profiles, 1), size)(read))
    for first in range(1 + LANGUAGES, most + 1, LANGUAGES):
        found = settle(found, "ranked")
        more = unused(found, "more")[0]
        found = found.withColumn(more, _ranking(_held(profiles, first), size)(read))
        better = F.col(f"{more}.score") > F.col(f"{out}.score")
        found = found.withColumn(out, F.when(better, F.col(more)).otherwise(F.col(out))).drop(more)
    return found


def predict(docs: DataFrame, profiles: DataFrame, size: int = PROFILE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (doc_id alone by default), with lang_pred and score; see ``predicted``.

    Rows that repeat stay; only text is looked at. If ``docs`` has a column named lang_pred or score, leave it out of
    ``keep``.
    """
    out = unused(docs, "found")[0]
    kept = [F.col(f"`{c}`") for c in (["doc_id"] if keep is None else keep)]
    found = predicted(docs, profiles, out, size)
    return found.select(*kept, F.col(f"{out}.lang").alias("lang_pred"), F.col(f"{out}.score").alias("score"))


def held_out() -> F.Column:
    """True for documents that are not learned from: one of three folds of the id; a null id is in none."""
    return F.coalesce(fold("doc_id", 3) == 1, F.lit(False))


def identify(docs: DataFrame, size: int = PROFILE, learn_from: int = LEARN_FROM) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, learned from the rows that are not held out.

    Rows with a null id are predicted and teach nothing. An empty table gives an empty result.
    """
    profiles = learn(docs.filter(fold("doc_id", 3) != 1), size, learn_from)
    return predict(docs.withColumn("held_out", held_out()), profiles, size, ["doc_id", "held_out"])


def known_language(docs: DataFrame, size: int = PROFILE, learn_from: int = LEARN_FROM) -> DataFrame:
    """The rows of ``docs`` whose text has a language; texts that are null or have no letter go.

    Columns are those of ``docs``; where ``lang`` is null it becomes the language predicted. When no row has a label,
    nothing is learned, and texts with a letter stay as they are.
    """
    profiles = learn(docs.filter(fold("doc_id", 3) != 1), size, learn_from)
    out = unused(docs, "found")[0]
    found = predicted(docs, profiles, out, size).filter(f"{out}.letters")
    lang = F.coalesce(F.col("lang"), F.nullif(F.col(f"{out}.lang"), F.lit(UNKNOWN))).alias("lang")
    return found.select(*[lang if c.lower() == "lang" else F.col(f"`{c}`") for c in docs.columns])
