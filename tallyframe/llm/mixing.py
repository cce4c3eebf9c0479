"""Mixing sources to target weights.

Each source's documents, in an order of their own, are one stream of words, cut into blocks of fixed length. The mix
is a sequence of slots of one block each, dealt to output shards. A source's number of slots follows from its
target in words, and its last slot is cut to what is then left of it; how many of them each shard has is a multinomial draw. The slots of a source are numbered through, and slot
``k`` takes the block that a pseudorandom permutation of the source's blocks gives for ``k`` modulo their number: no
block is taken a third time before all were taken twice. Blocks are joined to slots by their index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import unused
from tallyframe.llm.common import slices
from tallyframe.operators.rank import with_position, with_running_total
from tallyframe.workspace import settle

#: Words of a block, slots of a shard, shards that one row of the drawing is about.
BLOCK = 128
SHARD = 4096
SHARDS_A_ROW = 64
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_TIMES = 2
#: Groups of sources that shards are drawn for. A source is its own group, unless there are more sources than that.
GROUPS = 100_000
#: Documents of one piece of a stream, about; a piece is summed in one task.
PIECE = 500
SEED = 20_240_617
#: numpy draws without replacement from fewer than this.
_MOST_DRAWN = 10**9

_MEMBER = ("number", "blocks", "slots", "last")
_WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], total: float, most_times: float = MOST_TIMES) -> list[float]:
    """Shares of ``total`` by weight, none above ``most_times`` its size; what is above is shared out by weight.

    Sources that reach their limit are final. Each round stops one at least or is the last. ``with_targets`` does the
    same for a table.
    """
    result = [float(most_times * size) for size in sizes]
    going = set(range(len(sizes)))
    while going:
        left = total - sum(result[n] for n in range(len(sizes)) if n not in going)
        weight = sum(weights[n] for n in going)
        over = {n for n in going if left * weights[n] / weight > most_times * sizes[n]}
        if not over:
            for n in going:
                result[n] = left * weights[n] / weight
            break
        going -= over
    return result


def permuted(index: np.ndarray, sizes: np.ndarray, keys: np.ndarray, back: bool = False) -> np.ndarray:
    """Images of ``index`` under a pseudorandom permutation of range(size), by a Feistel network with cycle walking.

    Every row has a size and a key of its own. Four rounds on the halves of the least even number of bits that holds
    the size permute a range at most four times as large; images beyond the size are mapped on until they fall in.
    ``back`` gives the indexes whose images ``index`` are.
    """
    half = np.array([max(1, (int(n - 1).bit_length() + 1) // 2) for n in sizes.tolist()], np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    walk = np.ones(len(out), bool)
    while walk.any():
        h, m, x, k = half[walk], mask[walk], out[walk], keys[walk].astype(np.uint64)
        left, right = (x & m, x >> h) if back else (x >> h, x & m)
        for turn in range(3, -1, -1) if back else range(4):
            z = (right + k + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & m)
        out[walk] = right << h | left if back else left << h | right
        walk = out >= sizes.astype(np.uint64)
    return out.astype(np.int64)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    uid = unused(docs, "uid")[0]
    return docs.withColumn(uid, F.monotonically_increasing_id()), uid


def _stream(rows: DataFrame, uid: str) -> tuple[DataFrame, DataFrame]:
    """Documents (uid, doc_id, source, number, size, start) in their streams, and sources (source, number, source_size).

    A stream is ordered by a hash of the id, in pieces of about PIECE documents: positions are summed within pieces,
    and pieces in one running total over all sources, so that a large source is many tasks' work. Sources are
    numbered by code point, null last.
    """
    sized = settle(
        rows.select(
            F.col(uid).alias("uid"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORDS)).cast("long"), F.lit(0)).alias("size"),
        ),
        "sizes",
    )
    pieces = max(1, sized.count() // PIECE)
    # null ids hash alike: a third of all rows could, so their row number goes in
    place = F.xxhash64(F.coalesce("doc_id", F.col("uid")), F.lit(SEED))
    placed = sized.withColumn("place", place).withColumn("piece", F.pmod("place", F.lit(pieces)))
    totals = placed.groupBy("source", "piece").agg(F.sum("size").alias("words"))
    order = [F.asc_nulls_last("source"), F.asc("piece")]
    totals = settle(with_running_total(totals, order, "words", "before"), "pieces")
    sources = totals.groupBy("source").agg(F.sum("words").alias("source_size"), F.min("before").alias("begin"))
    sources = settle(with_position(sources, [F.asc_nulls_last("source")], "place"), "sources")
    sources = sources.withColumn("number", F.col("place") - 1).drop("place")
    begins = sources.select(F.col("source").alias("_source"), "number", "begin")
    before = totals.join(begins, F.col("source").eqNullSafe(F.col("_source"))).select(
        "_source", F.col("piece").alias("_piece"), "number", (F.col("before") - F.col("begin")).alias("before")
    )
    within = Window.partitionBy("source", "piece").orderBy("place", "doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = inner["source"].eqNullSafe(before["_source"]) & (inner["piece"] == before["_piece"])
    start = (F.col("before") + F.col("inner")).alias("start")
    stream = inner.join(before, same).select("uid", "doc_id", "source", "number", "size", start)
    return settle(stream, "stream"), sources.drop("begin")


def slots_for(words: int, number: int, size: int, block: int) -> tuple[int, int]:
    """Slots in which source ``number`` of ``size`` words gives ``words`` in all, and how many of the last one's.

    Whole rounds take all words. In the round after them a slot takes a block, and the last block of the source, which
    may be a part, counts where the permutation has it.
    """
    if not words:
        return 0, 0
    blocks = -(-size // block)
    rounds, left = divmod(words, size)
    if not left:
        rounds, left = rounds - 1, size
    lacking = blocks * block - size
    at = int(permuted(np.array([blocks - 1]), np.array([blocks]), np.array([_key(number)]), back=True)[0])

    def taken(slots: int) -> int:
        return slots * block - (lacking if at < slots else 0)

    slots = -(-left // block)
    slots += taken(slots) < left
    return rounds * blocks + slots, left - taken(slots - 1)


def _key(number):
    return number * 1_000_003 + SEED


def with_targets(sources: DataFrame, weights: tuple, share: float, most_times: float) -> DataFrame:
    """Sources (number, source_size) with their ``target``, found like that of ``targets`` by rounds of aggregates.

    What one word of weight gets only grows from round to round, so the sources at their limit follow from it alone.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight)
    limit = F.col("source_size") * F.lit(float(most_times))
    left, weighing, stopped = 0.0, 1.0, -1
    while True:
        over = F.lit(left) * F.col("weight") / F.lit(weighing) > limit
        found = rows.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, F.col("source_size"))).alias("of_over"),
            F.sum(F.when(~over, F.col("weight"))).alias("weighing"),
            F.count_if(over).alias("n"),
        ).first()
        if found["n"] == stopped or not found["weighing"]:
            break
        left = share * (found["all"] or 0) - most_times * (found["of_over"] or 0)
        weighing, stopped = found["weighing"], found["n"]
    over = over | F.lit(not found["weighing"])
    return rows.withColumn("target", F.when(over, limit).otherwise(F.lit(left) * F.col("weight") / F.lit(weighing)))


def _sources(sources: DataFrame, weights: tuple, share: float, most_times: float, block: int) -> DataFrame:
    """Each source's numbers: source, number, source_size, target, blocks, slots, last (words of the last slot).

    Sources go by code point, null last, and get the weights in turn.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for number, size, target in zip(frame["number"], frame["source_size"], frame["target"]):
                words = min(round(target), int(most_times * size))
                rows.append((number, -(-size // block), *slots_for(words, number, size, block)))
            yield pd.DataFrame(rows, columns=["number", "blocks", "slots", "last"])

    wanted = settle(with_targets(sources, weights, share, most_times), "targets")
    counts = wanted.mapInPandas(count, "number long, blocks long, slots long, last long")
    return settle(wanted.drop("weight").join(settle(counts, "slots"), "number"), "sources")


def _halved(slots: np.ndarray, n: int, low: int, high: int) -> np.ndarray:
    """Of the slots of shards low to high, by source, the n that the first half of the shards has."""
    total = int(slots.sum())
    if n >= total:
        return slots.copy()
    if total < _MOST_DRAWN:
        return np.random.default_rng([SEED, low, high]).multivariate_hypergeometric(slots, n, method="marginals")
    # numpy draws from fewer only: one source after the other, with the mean and variance of such a draw
    rng, drawn = np.random.default_rng([SEED, low, high]), np.zeros(len(slots), np.int64)
    for source in np.flatnonzero(slots).tolist():
        own = int(slots[source])
        mean = own * n / total
        off = (int(rng.binomial(own, n / total)) - mean) * math.sqrt((total - own) / total)
        drawn[source] = min(max(round(mean + off), n - (total - own), 0), own, n)
        n, total = n - int(drawn[source]), total - own
    return drawn


def shard_counts(slots: list[int], shard: int, first_shard: int, end_shard: int) -> Iterator[tuple[int, int, int, int]]:
    """Shard, source, slots of the source in it, number of the first of them, for the shards asked for.

    All slots are halved again and again, each time by a draw without replacement that depends on the seed and the
    place alone. So any task draws its own shards without the others', a shard's counts are a multinomial draw given
    that all shards together have exactly the slots wanted.
    """
    total = sum(slots)
    shards = -(-total // shard)

    def walk(low: int, high: int, mine: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        if high <= first_shard or low >= end_shard:
            return
        if high - low == 1:
            for source in np.flatnonzero(mine).tolist():
                yield low, source, int(mine[source]), int(first[source])
            return
        middle = (low + high) // 2
        left = _halved(mine, min(middle * shard, total) - low * shard, low, high)
        yield from walk(low, middle, left, first)
        yield from walk(middle, high, mine - left, first + left)

    if total:
        yield from walk(0, shards, np.array(slots, np.int64), np.zeros(len(slots), np.int64))


def slot_table(sources: DataFrame, shard: int = SHARD, groups: int = GROUPS) -> DataFrame:
    """One row per slot of the mix: shard, number (of the source), slot (of the source), round, block, words.

    ``words`` is how many words of the block a source's last slot takes, and null for its other slots: all of them.
    Shards are drawn for ``groups`` groups of consecutive sources at most; only those groups' slots pass through the
    driver. Within a group of several sources, a pseudorandom permutation of the group's slots says whose turn it is.
    """
    spark = sources.sparkSession
    n_sources = sources.count()
    group = F.col("number") if n_sources <= groups else F.floor(F.col("number") * groups / F.lit(n_sources)).cast("long")
    totals = sources.groupBy(group.alias("group")).agg(F.sum("slots").alias("slots")).orderBy("group").collect()
    names, slots = [r["group"] for r in totals], [r["slots"] for r in totals]
    rows = -(-(-(-sum(slots) // shard)) // SHARDS_A_ROW)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = np.array(names, np.int64)
        for frame in frames:
            for row in frame["id"].tolist():
                for counts in _in_shards(shard_counts(slots, shard, row * SHARDS_A_ROW, (row + 1) * SHARDS_A_ROW)):
                    at = np.array(counts, np.int64)
                    yield pd.DataFrame({"shard": at[:, 0], "group": of[at[:, 1]], "n": at[:, 2], "first": at[:, 3]})

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table(held: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
            at, number, slot, size, end, cut = (np.concatenate(c) for c in zip(*held))
            block = permuted(slot % size, size, _key(number))
            words = pd.Series(cut, dtype="Int64").where(slot == end - 1)
            return pd.DataFrame({"shard": at, "number": number, "slot": slot, "round": slot // size, "block": block, "words": words})

        held, n_held = [], 0
        for frame in frames:
            for at, group, n, first, members in zip(*(frame[c] for c in ("shard", "group", "n", "first", "members"))):
                number, blocks, ends, cut = np.array([[m[c] for m in members] for c in _MEMBER], np.int64)
                turn = np.arange(first, first + n)
                upto = np.cumsum(ends)
                if len(number) > 1:
                    turn = permuted(turn, np.full(n, upto[-1]), np.full(n, _key(-1 - group)))
                which = np.searchsorted(upto, turn, "right")
                held.append((np.full(n, at), number[which], turn - (upto - ends)[which], blocks[which], ends[which], cut[which]))
                n_held += n
                if n_held >= 200_000:
                    yield table(held)
                    held, n_held = [], 0
        if held:
            yield table(held)

    parts = max(1, min(rows, 100_000))
    counts = spark.range(0, rows, 1, parts).mapInPandas(draw, "shard long, group long, n long, first long")
    member = F.struct(*_MEMBER)
    members = sources.groupBy(group.alias("group")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    # settled, so that no task has two Python workers
    joined = settle(counts, "shards").join(settle(members, "groups"), "group")
    return joined.mapInPandas(expand, "shard long, number long, slot long, round long, block long, words long")


def _in_shards(counts: Iterator[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int, int, int]]]:
    held: list[tuple[int, int, int, int]] = []
    for row in counts:
        if held and held[0][0] != row[0]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def mix(
    rows: DataFrame, uid: str, weights: tuple = WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES, block: int = BLOCK
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as spans of documents, the documents in their streams, and the sources.

    ``rows`` are documents with a row number in the column ``uid``. Spans: shard, slot, round, number (of the source), block, uid,
    doc_id, from, to (words of the document, ``to`` excluded).
    """
    stream, sources = _stream(rows, uid)
    sources = _sources(sources, weights, share, most_times, block)
    blocks = stream.filter("size > 0").withColumn(
        "block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"))
    )
    at = F.col("block") * block
    # the planner cannot know how many slots the drawing makes, and would broadcast them
    spans = (
        slot_table(sources)
        .hint("merge")
        .join(blocks, ["number", "block"])
        .select(
            "shard",
            "slot",
            "round",
            "number",
            "block",
            "uid",
            "doc_id",
            (F.greatest(F.col("start"), at) - F.col("start")).alias("from"),
            (F.least(F.col("start") + F.col("size"), at + F.coalesce("words", F.lit(block))) - F.col("start")).alias("to"),
        )
        .filter(F.col("from") < F.col("to"))
    )
    return spans, stream, sources


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    A null text has size 0 and nothing is taken from it; a null source is a source, the last one; rows that repeat
    are documents of their own, and so are rows with a null id. Other columns are not looked at. Order and
    permutations come from ids and the seed, so reruns agree. An empty table gives an empty result.
    """
    spans, stream, sources = mix(*_numbered(docs.select("doc_id", "source", "text")), **options)
    taken = spans.groupBy("uid").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    numbers = sources.select("number", "source_size", "target")
    return (
        stream.join(taken, "uid", "left")
        .join(numbers, "number")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )


def _cut(text: str, spans: list[dict]) -> str:
    """The words of the spans, in order; the text itself if they hold all words."""
    words = text.encode().split()
    ordered = sorted((s["from"], s["to"]) for s in spans)
    if sum(b - a for a, b in ordered) >= len(words):
        return text
    return b" ".join(w for a, b in ordered for w in words[a:b]).decode()


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: one row per document and round, text the words taken then.

    Words of a round keep the document's order and are joined by one space, unless the round takes the whole
    document: its text is then unchanged. ``n_chars``, if there, is that of the new text. Documents without a word
    are in no mix.
    """
    rows, uid = _numbered(docs)
    rows = settle(rows, "mixed")
    spans, _, _ = mix(rows, uid, **options)
    held, turn = unused(rows, "spans", "round")
    parts = spans.groupBy(F.col("uid").alias(uid), F.col("round").alias(turn)).agg(F.collect_list(F.struct("from", "to")).alias(held))
    joined = rows.join(parts, uid).select(held, *[F.col(f"`{c}`") for c in docs.columns])
    names = list(docs.columns)
    text_at = 1 + [c.lower() for c in names].index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [_cut(t, s) for s, t in zip(batch.column(0).to_pylist(), batch.column(text_at).to_pylist())]
            arrays = list(batch.columns)
            arrays[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays[1:], names=names)

    out = joined.mapInArrow(task, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
