"""Language-model scoring with a bigram model kept as Elias-Fano tries.

The model is a bigram model over words and the end of text, smoothed towards word shares by a Dirichlet prior. It is
as large as the corpus asks, so no task holds it: words and bigrams are dealt to shards by a hash, and each shard of
bigrams is one trie. Texts become buckets of word numbers. A bucket sends every shard its distinct words, then its
distinct bigrams, as sorted lists with their counts in training texts. A shard adds the counts up and answers each
list in its own order: with counts, or with the codes that its trie has for the bigrams. The buckets then add up the
scores of their texts.

A trie has three levels. The contexts are an Elias-Fano sequence, and so are the places where their successors begin.
Successors are stored relative to their context: raised by the context's number times the range of a successor, the
whole level is one increasing sequence. A bigram is found by a successor search of the context and one of the raised
successor, which has to lie between the context's two places. Probabilities are codes of one byte into a codebook.
A context with many occurrences is spread over several shards by its successors.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import WordHashes, fold, mix64
from tallyframe.workspace import settle

#: Words of a bucket of documents and of a shard of the model, about.
BUCKET_WORDS = 2_000_000
SHARD_WORDS = 1_000_000
#: Weight of the word shares: as many imagined occurrences of each context.
PRIOR = 200.0
#: Bits of the hash of a context and of a successor in a trie.
CONTEXT_BITS, SUCCESSOR_BITS = 40, 36
END = np.uint64(0x454E442D4F462D54)
FOLDS, HELD_OUT = 7, 2


class EliasFano:
    """An increasing sequence of numbers below 2^63: low bits packed, high bits in unary, searched by sampled counts."""

    SAMPLE = 512

    def __init__(self, low_bits: int, n: int, low: np.ndarray, high: np.ndarray):
        self.low_bits, self.n, self.low, self.high = low_bits, n, low, high
        # ones before each block of the unary part: few numbers, made anew when a trie is opened
        ones = np.bitwise_count(high).astype(np.int64)
        pad = -len(ones) % (self.SAMPLE // 8)
        self.ones_before = np.concatenate([[0], np.cumsum(np.pad(ones, (0, pad)).reshape(-1, self.SAMPLE // 8).sum(axis=1))])

    @staticmethod
    def pack(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << low_bits) - 1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 1, bool)
        high[places] = True
        planes = (low[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]).astype(np.uint8) & 1 if low_bits else np.empty((n, 0), np.uint8)
        return low_bits, n, np.packbits(planes.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()

    def _low(self, at: np.ndarray) -> np.ndarray:
        """The low bits of the numbers at some places, out of at most nine bytes each."""
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        need = (self.low_bits + 7 + 7) // 8
        out = np.zeros(len(at), np.uint64)
        for k in range(min(need, 8)):
            part = self.low[np.minimum(byte + k, len(self.low) - 1)].astype(np.uint64)
            out |= part << np.uint64(8 * k)
        out >>= shift
        if need > 8:
            part = self.low[np.minimum(byte + 8, len(self.low) - 1)].astype(np.uint64)
            over = shift > 0
            out[over] |= part[over] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low_bits) - 1)

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the rank-th one, or zero, of the unary part."""
        size = self.SAMPLE
        blocks = np.arange(len(self.ones_before))
        before = self.ones_before if ones else blocks * size - self.ones_before
        block = np.searchsorted(before, rank, side="right") - 1
        left = rank - before[block]
        width = size // 8
        at = np.empty(len(rank), np.int64)
        for begin in range(0, len(rank), 50_000):  # bounds the bits that are laid open at once
            part = slice(begin, begin + 50_000)
            rows, back = np.unique(block[part], return_inverse=True)
            index = rows[:, None] * width + np.arange(width)[None, :]
            held = np.where(index < len(self.high), self.high[np.minimum(index, len(self.high) - 1)], 0).astype(np.uint8)
            bits = np.unpackbits(held, axis=1, bitorder="little")
            counts = np.cumsum(bits if ones else 1 - bits, axis=1, dtype=np.int16)
            target = left[part] + 1
            # counts of all rows as one increasing sequence: a row's are raised by the row's number
            flat = (counts + np.arange(len(rows), dtype=np.int64)[:, None] * (size + 1)).ravel()
            at[part] = rows[back] * size + np.searchsorted(flat, back * (size + 1) + target, side="left") - back * size
        return at

    def get(self, at: np.ndarray) -> np.ndarray:
        high = self._select(at, True) - at
        return high.astype(np.uint64) << np.uint64(self.low_bits) | self._low(at)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Place of the first number that is not below each of ``values`` (n if there is none)."""
        if not self.n:
            return np.zeros(len(values), np.int64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        zeros = len(self.high) * 8 - int(self.ones_before[-1])
        inside = high < zeros
        low, end = np.zeros(len(values), np.int64), np.full(len(values), self.n)
        begin = (high > 0) & (high <= zeros)  # the last numbers may have no zero behind them
        low[begin] = self._select(high[begin] - 1, False) - (high[begin] - 1)
        low[high > zeros] = self.n
        end[inside] = self._select(high[inside], False) - high[inside]
        low, end = np.minimum(low, self.n), np.minimum(end, self.n)
        wanted = values & np.uint64((1 << self.low_bits) - 1)
        while (going := np.flatnonzero(low < end)).size:  # halve the numbers that share the high bits
            middle = (low[going] + end[going]) // 2
            less = self._low(middle) < wanted[going]
            low[going[less]] = middle[less] + 1
            end[going[~less]] = middle[~less]
        return low


class Trie:
    """One shard of the model. Levels lie one after the other in a file that is mapped into memory."""

    def __init__(self, data: memoryview | bytes):
        head = np.frombuffer(data, np.int64, 16)
        at = 128
        self.levels = []
        for level in range(3):
            low_bits, n, low, high = (int(x) for x in head[4 * level : 4 * level + 4])
            low_part = np.frombuffer(data, np.uint8, low, at)
            high_part = np.frombuffer(data, np.uint8, high, at + low)
            at += low + high
            self.levels.append(EliasFano(low_bits, n, low_part, high_part))
        self.codes = np.frombuffer(data, np.uint8, self.levels[2].n, at)

    @staticmethod
    def build(context: np.ndarray, successor: np.ndarray, codes: np.ndarray) -> bytes:
        """From bigrams sorted by context and successor."""
        contexts, first = np.unique(context, return_index=True)
        raised = successor + np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff([*first, len(context)])) * np.uint64(1 << SUCCESSOR_BITS)
        head, parts = np.zeros(16, np.int64), []
        for level, values in enumerate((contexts, np.append(first, len(context)).astype(np.uint64), raised)):
            low_bits, n, low, high = EliasFano.pack(values)
            low, high = low or b"\0", high or b"\0"
            head[4 * level : 4 * level + 4] = low_bits, n, len(low), len(high)
            parts += [low, high]
        return b"".join([head.tobytes(), *parts, codes.tobytes()])

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The codes of bigrams, 0 for those that the trie lacks."""
        contexts, pointers, raised = self.levels
        out = np.zeros(len(context), np.uint8)
        if not contexts.n:
            return out
        # the same context is asked for again and again
        asked, back = np.unique(context, return_inverse=True)
        node = contexts.successor(asked)
        there = node < contexts.n
        there[there] = contexts.get(node[there]) == asked[there]
        begin, end = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        begin[there] = pointers.get(node[there]).astype(np.int64)
        end[there] = pointers.get(node[there] + 1).astype(np.int64)
        known = np.flatnonzero(there[back])
        of = back[known]
        wanted = successor[known] + node[of].astype(np.uint64) * np.uint64(1 << SUCCESSOR_BITS)
        at = raised.successor(wanted)
        ok = (at >= begin[of]) & (at < end[of])
        ok[ok] = raised.get(at[ok]) == wanted[ok]
        out[known[ok]] = self.codes[at[ok]]
        return out


def mapped(data: bytes) -> mmap.mmap:
    """A trie's bytes in a mapping of their own, outside of Python's heap."""
    held = mmap.mmap(-1, len(data))
    held.write(data)
    return held


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; bytes of equal weight lie together."""
    parts = [np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()]
    for a in arrays:
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return zstandard.compress(b"".join(parts), 1)


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    sizes = np.frombuffer(raw, np.int64, 1 + len(kinds))[1:].tolist()
    at, out = 8 * (1 + len(kinds)), []
    for n, kind in zip(sizes, kinds):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return out


class Bucket:
    """Documents as numbers of the bucket's own words, frequent words first."""

    def __init__(self, ids: np.ndarray, vocabulary: np.ndarray, doc_ids: np.ndarray, known_id: np.ndarray, lengths: np.ndarray, held: np.ndarray):
        self.ids, self.vocabulary = ids.astype(np.int64), vocabulary
        self.doc_ids, self.known_id, self.lengths, self.held = doc_ids, known_id, lengths, held

    @staticmethod
    def of(rows: list[tuple]) -> Bucket:
        words = np.concatenate([r[2] for r in rows])
        vocabulary, ids, counts = np.unique(words, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        doc_ids = np.array([r[0] or 0 for r in rows], np.int64)
        known = np.array([r[0] is not None for r in rows], np.uint8)
        return Bucket(rank[ids], vocabulary[order], doc_ids, known, np.array([len(r[2]) for r in rows]), np.array([r[1] for r in rows], np.uint8))

    def pack(self) -> bytes:
        return _packed(self.ids.astype(np.uint32), self.vocabulary, self.doc_ids, self.known_id, self.lengths.astype(np.uint32), self.held)

    @staticmethod
    def unpack(data: bytes) -> Bucket:
        return Bucket(*_unpacked(data, np.uint32, np.uint64, np.int64, np.uint8, np.uint32, np.uint8))

    def training(self) -> np.ndarray:
        return np.repeat(self.held == 0, self.lengths)

    def words_by_shard(self, shards: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each shard with the places of its words in the vocabulary, in the order of their hashes."""
        of = (mix64(self.vocabulary) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((self.vocabulary, of))
        yield from _groups(of, order)

    def bigrams(self, counts: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
        """Distinct bigrams and where each token's is: shard, context, successor, training count, token to bigram.

        They are sorted by shard and by the hashes of context and successor. The first word's context is the end.
        """
        end = int(np.flatnonzero(self.vocabulary == END)[0])
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = end
        keys, of = np.unique(before * len(self.vocabulary) + self.ids, return_inverse=True)
        context, successor = keys // len(self.vocabulary), keys % len(self.vocabulary)
        n = np.bincount(of[self.training()], minlength=len(keys))
        head, tail = self.vocabulary[context], self.vocabulary[successor]
        parts = (1 + 2 * counts[context] // SHARD_WORDS).astype(np.uint64)
        shard = (mix64(head + (tail % parts) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((_successor(tail), _context(head), shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return shard[order], context[order], successor[order], n[order], place[of]


def _context(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - CONTEXT_BITS)


def _successor(hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes) >> np.uint64(64 - SUCCESSOR_BITS)


def _groups(of: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if len(order):
        cuts = np.flatnonzero(np.diff(of[order])) + 1
        for part in np.split(order, cuts):
            yield int(of[part[0]]), part


_ROW = "kind string, bucket long, shard long, data binary"
_ROW_SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("shard", pa.int64()), ("data", pa.binary())])


def _buckets(docs: DataFrame, shards: int) -> DataFrame:
    """Documents as buckets, and each bucket's words with their counts in training texts, by shard."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, rows, words = WordHashes(), [], 0
        number = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            bucket = Bucket.of(rows)
            found = [("bucket", number, -1, bucket.pack())]
            counts = np.bincount(bucket.ids[bucket.training()], minlength=len(bucket.vocabulary))
            for shard, at in bucket.words_by_shard(shards):
                found.append(("words", number, shard, _packed(bucket.vocabulary[at], counts[at])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _ROW_SCHEMA.types)], schema=_ROW_SCHEMA)

        for batch in batches:
            for doc_id, text, held in zip(*(c.to_pylist() for c in batch.columns)):
                found = memo.of(text) if text else np.empty(0, np.uint64)
                rows.append((doc_id, held, np.append(found, END)))
                words += len(found) + 1
                if words >= BUCKET_WORDS:
                    yield out()
                    rows, words, number = [], 0, number + 1
        if rows:
            yield out()

    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(True))
    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"), held.alias("held")]
    return settle(docs.select(*columns).mapInArrow(task, _ROW), "buckets")


def _add_words(lists: pd.DataFrame) -> pd.DataFrame:
    """The counts of a shard's words, for each list in its order; with the first, the shard's totals."""
    parts = [_unpacked(d, np.uint64, np.int64) for d in lists["data"]]
    hashes, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.zeros(len(hashes), np.int64)
    np.add.at(counts, of, np.concatenate([p[1] for p in parts]))
    answers = np.split(counts[of], np.cumsum([len(p[0]) for p in parts])[:-1])
    zeros = [0] * (len(parts) - 1)
    return pd.DataFrame(
        {
            "kind": "counts",
            "bucket": lists["bucket"],
            "shard": lists["shard"],
            "data": [_packed(a) for a in answers],
            "distinct": [int((counts > 0).sum()), *zeros],
            "tokens": [int(counts.sum()), *zeros],
        }
    )


def _counts(bucket: Bucket, answers: pd.DataFrame, shards: int) -> np.ndarray:
    counts = np.zeros(len(bucket.vocabulary), np.int64)
    data = dict(zip(answers["shard"], answers["data"]))
    for shard, at in bucket.words_by_shard(shards):
        counts[at] = _unpacked(data[shard], np.int64)[0]
    return counts


def _add_bigrams(lists: pd.DataFrame, tokens: int, distinct: int) -> pd.DataFrame:
    """Build a shard's trie from all lists, and answer each with the codes that the trie has for its bigrams."""
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
    parts = [_unpacked(d, *kinds) for d in lists["data"]]
    context, successor, n, of_context, of_successor = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((successor, context))
    context, successor = context[order], successor[order]
    new = np.ones(len(order), bool)
    new[1:] = (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(n[order], first)
    seen = total > 0
    first, total = first[seen], total[seen]
    share = (of_successor[order][first] + 1) / (tokens + distinct + 1)
    chance = np.log10((total + PRIOR * share) / (of_context[order][first] + PRIOR))
    # a codebook of 255 values: the range is cut evenly, and a value is the mean of its part
    codes = np.zeros(len(chance), np.uint8)
    book = np.zeros(256, np.float64)
    if len(chance):
        low, width = chance.min(), max(float(np.ptp(chance)), 1e-9)
        codes = (1 + np.minimum((chance - low) / width * 255, 254)).astype(np.uint8)
        book = np.bincount(codes, chance, 256) / np.maximum(np.bincount(codes, minlength=256), 1)
    trie = Trie(mapped(Trie.build(context[first], successor[first], codes)))
    answers = [_packed(trie.find(p[0], p[1]), book) for p in parts]
    return pd.DataFrame({"kind": "codes", "bucket": lists["bucket"], "shard": lists["shard"], "data": answers})


def score(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from documents whose crc32(doc_id as text) modulo FOLDS is not HELD_OUT; a null id is held out
    (its ``held_out`` is false, as it is in no fold). A null text is an empty one, which has its end alone. Scores are
    log10 probabilities of whole texts; ``base_score`` is that of the add-one word model, ``score`` that of the
    bigram model. Rows that repeat are scored and learned from as often as they occur. An empty table gives an empty
    result; a very long text is one bucket.
    """
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, total // (6 * SHARD_WORDS))
    rows = _buckets(docs, shards)
    buckets = rows.filter("kind = 'bucket'")
    counts = rows.filter("kind = 'words'").groupBy("shard").applyInPandas(_add_words, f"{_ROW}, distinct long, tokens long")
    counts = settle(counts, "counts")
    distinct, tokens = counts.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    counts = counts.select(*_ROW_SCHEMA.names)

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        bucket = Bucket.unpack(left["data"][0])
        known = _counts(bucket, right, shards)
        shard, context, successor, n, _ = bucket.bigrams(known, shards)
        heads, tails = _context(bucket.vocabulary), _successor(bucket.vocabulary)
        lists = []
        for number, at in _groups(shard, np.arange(len(shard))):
            v, w = context[at], successor[at]
            lists.append(("bigrams", left["bucket"][0], number, _packed(heads[v], tails[w], n[at], known[v], known[w])))
        return pd.DataFrame(lists, columns=_ROW_SCHEMA.names)

    asked = buckets.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInPandas(ask, _ROW)
    codes = asked.groupBy("shard").applyInPandas(lambda lists: _add_bigrams(lists, tokens, distinct), _ROW)
    answers = counts.unionByName(codes)

    def add_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        bucket = Bucket.unpack(left["data"][0])
        known = _counts(bucket, right[right["kind"] == "counts"], shards)
        shard, context, successor, _, of = bucket.bigrams(known, shards)
        right = right[right["kind"] == "codes"]
        data = dict(zip(right["shard"], right["data"]))
        share = (known[successor] + 1) / (tokens + distinct + 1)
        chance = np.log10(PRIOR * share / (known[context] + PRIOR))
        for number, at in _groups(shard, np.arange(len(shard))):
            code, book = _unpacked(data[number], np.uint8, np.float64)
            chance[at] = np.where(code > 0, book[code], chance[at])
        first = np.cumsum(bucket.lengths.astype(np.int64)) - bucket.lengths
        base = np.log10((known + 1) / (tokens + distinct + 1))
        return pd.DataFrame(
            {
                "doc_id": pd.Series(bucket.doc_ids).astype("Int64").where(bucket.known_id == 1),
                "held_out": (bucket.held == 1) & (bucket.known_id == 1),
                "n_tokens": bucket.lengths.astype(np.int64),
                "n_known": np.add.reduceat((known > 0)[bucket.ids].astype(np.int64), first),
                "train_tokens": tokens,
                "base_score": np.add.reduceat(base[bucket.ids], first),
                "score": np.add.reduceat(chance[of], first),
            }
        )

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return buckets.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(add_up, ddl)
