"""N-gram Jaccard join: links between documents whose word shingles overlap enough, and the groups that all links make.

A document's shingles are ordered rarest first, by counters that are the same for all documents. Two documents that
link share one of their first shingles (as many as may be missing, and one), and their sizes are in the same or in
adjacent bands. So documents are dealt to tiles of a first shingle and two adjacent bands. Within a tile bitmaps of
the hashed shingles bound the overlap of two documents from above, by counting the bits that one has and the other has
not; what passes is decided by intersecting the sorted arrays.

Before bitmaps are fetched, places bound the overlap: in the tile of the first shingle that two documents share, no
shingle before it is common. So a document goes to the tile of the larger band only if enough of its shingles come
after, and two documents that are both there for their smaller band are not compared, as they meet in their own tile.

Only what can change the groups is compared: within a group of m near copies, which may have m * m / 2 links, about m of
them are found. Documents with equal shingles are one class from the start. Each tile's
documents are compared with a few hubs first, then with the one that has most links so far; after that, pairs of
documents of the tile are compared only where they are in different groups still. Of those, so many are intersected
first as tie all groups together a few times over, if they link; others only where groups are still apart then. So a
tile of near copies costs a few comparisons for each of its documents, and no tile is expanded into all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import WordHashes, components, mix64, slices, stars
from tallyframe.workspace import passing, settle

#: Words of a shingle, and the least overlap in hundredths of the union.
WORDS = 4
PERCENT = 85
#: Counters of the sketch by which shingles are ordered, and slots of the filter of ids whose texts are read again.
SKETCH_BITS = 18
SLOTS = 1 << 20
#: Documents of a tile that are compared with each other in one piece.
BLOCK = 512
#: Times that the first pairs across groups tie the groups of a block together.
TIES = 3

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _runs(hashes: np.ndarray, words: int) -> np.ndarray:
    """64-bit hashes of the runs of words of a text, by place; with fewer words one of them all; without words none."""
    n = min(words, len(hashes))
    if not n:
        return hashes
    runs = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        runs = mix64(runs + hashes[k : len(hashes) - n + 1 + k] * _FACTORS[k % 4] + np.uint64(k // 4))
    return runs


def shingles(data: bytes | None, memo: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(_runs(memo.of(data) if data else np.empty(0, np.uint64), words))


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a document of n shares with any that it links with, at least."""
    return -(-percent * n // 100)


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return common > 0 and 100 * common >= percent * (a + b - common)


def _enough(rest: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether documents of n and m shingles may link if ``rest`` of them may be common; holds in whole numbers."""
    return rest * (100 + percent) >= (n + m) * percent


def _place(n: Column, at: Column, own: Column) -> Column:
    """Size, place of the tile's shingle, and whether the tile is that of the document's own band, in one number."""
    return F.shiftleft(n.cast("long"), 32) + at.cast("long") * 2 + own.cast("long")


def _size_of(place: Column) -> Column:
    return F.shiftright(place, 32)


def _rest_of(place: Column) -> Column:
    """Shingles from the tile's on."""
    return _size_of(place) - F.shiftright(place.bitwiseAND(F.lit((1 << 32) - 1)), 1)


def _is_own(place: Column) -> Column:
    return place.bitwiseAND(F.lit(1)) == 1


def _band(n: int, percent: int) -> int:
    """Sizes of two documents that link are at most one band apart."""
    return math.floor(math.log(n) / -math.log(percent / 100)) if percent < 100 else n


def _bitmap(found: np.ndarray) -> bytes:
    width = 64
    while width < 2 * len(found):
        width *= 2
    bits = np.zeros(width, bool)
    bits[found & np.uint64(width - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _narrowed(bits: int, width: int, to: int) -> int:
    """A bitmap of ``width`` bits as one of ``to``: places are hashes modulo the width, so halves are laid on each other."""
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


def _may_link(a: int, wide_a: int, n_a: int, b: int, wide_b: int, n_b: int, percent: int) -> bool:
    """Whether bit counts leave room for a link: each bit that a has and b has not is a shingle that is not common."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    width = min(wide_a, wide_b)
    a, b = _narrowed(a, wide_a, width), _narrowed(b, wide_b, width)
    both = (a & b).bit_count()
    most = min(n_a - a.bit_count() + both, n_b - b.bit_count() + both)
    return linked(most, n_a, n_b, percent)


class Order:
    """How common shingles are, for ordering them; it decides nothing else.

    Counters of words and of shingles, by the first bits of their hashes, are sums over all documents, of a fixed
    number. From the words' shares follows how often a shingle is to be expected by chance; a counter of shingles well
    above the mean tells of a passage that many documents have.
    """

    def __init__(self, word_counts: np.ndarray, shingle_counts: np.ndarray, words: int):
        total = max(1, word_counts.sum())
        self.word_share = np.log2(np.maximum(word_counts, 1) / total).astype(np.float32)
        self.total, self.words = math.log2(total), words
        mean = max(1.0, shingle_counts.sum() / len(shingle_counts))
        self.above = np.floor(4 * np.log2(np.maximum(shingle_counts, 1) / mean)).astype(np.float32)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles of a text's word hashes, and the same shingles, rarest first."""
        runs = _runs(hashes, self.words)
        found, at = np.unique(runs, return_index=True)
        n = min(self.words, len(hashes))
        if not n:
            return found, found
        share = self.word_share[hashes >> np.uint64(64 - SKETCH_BITS)]
        chance = np.full(len(runs), self.total, np.float32)
        for k in range(n):
            chance += share[k : len(runs) + k]
        level = np.maximum(np.floor(4 * chance[at]), self.above[found >> np.uint64(64 - SKETCH_BITS)])
        return found, found[np.argsort(np.maximum(level, 0), kind="stable")]


def _order(texts: DataFrame, words: int) -> Order:
    size = 1 << SKETCH_BITS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total, held, n = WordHashes(), np.zeros(2 * size, np.int64), [], 0

        def add() -> None:
            both = np.concatenate(held) if held else np.empty(0, np.int64)
            total[:] += np.bincount(both, minlength=2 * size)

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                hashes = memo.of(text) if text else np.empty(0, np.uint64)
                for part, first in ((hashes, 0), (np.unique(_runs(hashes, words)), size)):
                    held.append((part >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) + first)
                    n += len(part)
                if n > 1_000_000:
                    add()
                    held, n = [], 0
        add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = texts.select("text").mapInArrow(task, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found = rows.toArrow()  # as many rows as counters, at most
    counts = np.zeros(2 * size, np.int64)
    counts[found["at"].to_numpy()] = found["n"].to_numpy()
    return Order(counts[:size], counts[size:], words)


_PROFILE = "uid long, doc_id long, text_hash long, n int, band int, key binary, bits binary, prefix array<long>"


def _profiles(texts: DataFrame, order: Order, percent: int) -> DataFrame:
    """One row per document: a number of its own, size, band, a hash of all its shingles, bitmap, first shingles."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        uid = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            sizes, bands, keys, bits, firsts = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                found, rarest = order.of(memo.of(text) if text else np.empty(0, np.uint64))
                n = len(found)
                sizes.append(n)
                bands.append(_band(n, percent) if n else -1)
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                bits.append(_bitmap(found) if n else b"")
                firsts.append(rarest[: n - least_overlap(n, percent) + 1] if n else found)
            offsets = np.cumsum([0, *map(len, firsts)])
            lists = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(np.concatenate(firsts).view(np.int64) if firsts else [], pa.int64())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(uid, uid + len(sizes)), pa.int64()),
                    *batch.columns[:2],
                    pa.array(sizes, pa.int32()),
                    pa.array(bands, pa.int32()),
                    pa.array(keys, pa.binary()),
                    pa.array(bits, pa.binary()),
                    lists,
                ],
                names=["uid", "doc_id", "text_hash", "n", "band", "key", "bits", "prefix"],
            )
            uid += len(sizes)

    return settle(texts.select("doc_id", "text_hash", "text").mapInArrow(task, _PROFILE), "profiles", keep=True)


class _Join:
    """The state of one join: documents that stand for their class, their shared first shingles, and tiles of these."""

    def __init__(self, texts: DataFrame, words: int, percent: int):
        texts = texts.withColumn("text_hash", F.xxhash64("text"))
        self.texts, self.words, self.percent = texts, words, percent
        self.profiles = _profiles(texts, _order(texts, words), percent)
        some = self.profiles.filter("n > 0")
        self.classes = settle(
            some.groupBy("key").agg(F.min("uid").alias("node"), F.min("doc_id").alias("first"), F.count("*").alias("size")), "classes"
        )
        nodes = settle(self.classes.filter("size > 1").select(F.col("key").alias("_key"), F.col("node").alias("_node")), "nodes")
        # of classes of one document nothing needs to be looked up: the class is the document
        members = some.select("uid", "key").join(nodes, F.col("key") == F.col("_key")).filter("uid <> _node")
        self.nodes = some.join(settle(members.select("uid"), "members"), "uid", "left_anti").select("uid", "n", "band", "bits", "prefix")
        # dealt once: the count and the join read the same files
        first = self.nodes.select("uid", F.posexplode("prefix").alias("at", "token")).repartition("token")
        shared = first.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
        shared = settle(first.join(shared, "token"), "shared")
        self.small = settle(shared.select("uid").distinct().join(self.nodes.drop("prefix"), "uid"), "small")
        banded = shared.join(self.small.select("uid", "n", "band"), "uid")
        # sizes in the next band are larger, and not below its lower end (less one, for rounding)
        larger = F.greatest(F.col("n") + 1, F.floor(F.pow(F.lit(100 / percent), F.col("band") + 1)) - 1)
        both = _enough((F.col("n") - F.col("at")).cast("long"), F.col("n").cast("long"), larger.cast("long"), percent)
        bands = F.when(both, F.array("band", F.col("band") + 1)).otherwise(F.array("band"))
        banded = banded.withColumn("tile", F.explode(bands))
        place = _place(F.col("n"), F.col("at"), F.col("band") == F.col("tile"))
        self.tiles = settle(banded.select("token", "tile", "uid", place.alias("place")), "tiles")

    def passed(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) for which sizes and bit counts leave room for a link."""
        percent = self.percent
        sides = [self.small.select(F.col("uid").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab"]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 2000):
                _, _, n_a, n_b, bits_a, bits_b = (c.to_pylist() for c in batch.columns)
                fits = [
                    _may_link(int.from_bytes(x, "little"), 8 * len(x), n, int.from_bytes(y, "little"), 8 * len(y), m, percent)
                    for n, m, x, y in zip(n_a, n_b, bits_a, bits_b)
                ]
                yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

        near = F.col("n_a") * 100 >= F.col("n_b") * percent
        near &= F.col("n_b") * 100 >= F.col("n_a") * percent
        both = pairs.join(sides[0], "a").join(sides[1], "b").filter(near)
        return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(task, "a long, b long")

    def exact(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that link, by intersecting the sorted arrays of their shingles, made anew from their texts."""
        words, percent = self.words, self.percent
        pairs = settle(pairs, "pairs")
        # the end that is in more pairs is b, so the sets of few documents meet those of many
        ends = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid")))
        wanted = settle(ends.groupBy("uid").agg(F.count("*").alias("pairs")), "ends")
        sides = [wanted.select(F.col("uid").alias(s), F.col("pairs").alias(f"of_{s}")) for s in "ab"]
        turned = F.col("of_a") > F.col("of_b")
        pairs = pairs.join(sides[0], "a").join(sides[1], "b").select(
            F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b")
        )
        pairs = settle(pairs, "turned")
        keys = self.profiles.select("uid", "doc_id", "text_hash", "key").join(wanted.select("uid"), "uid")
        keys = settle(keys.withColumnsRenamed({"doc_id": "of_id", "text_hash": "of_hash"}), "wanted")

        def slot(text_hash: str) -> Column:
            return F.pmod(F.col(text_hash), F.lit(SLOTS)).alias("slot")

        slots = settle(keys.select(slot("of_hash")).distinct(), "slots")  # SLOTS rows at most
        texts = self.texts.withColumn("slot", slot("text_hash")).join(F.broadcast(slots), "slot", "left_semi")
        # an id and a hash of the text: no id that many documents have makes many rows meet
        same = texts["doc_id"].eqNullSafe(keys["of_id"]) & (texts["text_hash"] == keys["of_hash"])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = WordHashes()
            for batch in slices(batches):
                found = [shingles(t, memo, words) for t in batch.column(2).to_pylist()]
                fits = [xxhash.xxh3_128_digest(f.tobytes()) == key for f, key in zip(found, batch.column(1).to_pylist())]
                arrays = [batch.column(0), pa.array([f.tobytes() for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["uid", "found"]).filter(pa.array(fits, pa.bool_()))

        # rows that repeat give a node twice: links are made distinct in the end
        sets = texts.join(keys, same).select("uid", "key", "text").mapInArrow(task, "uid long, found binary")
        sets = settle(sets, "sets")

        def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                fits = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    fits.append(linked(common, len(x), len(y), percent))
                yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

        hubs = settle(pairs.select(F.col("b").alias("uid")).distinct(), "hubs-of")
        one = pairs.join(sets.select(F.col("uid").alias("a"), F.col("found").alias("x")), "a")
        two = one.join(sets.join(hubs, "uid", "left_semi").select(F.col("uid").alias("b"), F.col("found").alias("y")), "b")
        found = two.select("a", "b", "x", "y").mapInArrow(intersect, "a long, b long")
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def pairs_with(self, tiles: DataFrame, hubs: DataFrame) -> DataFrame:
        """Distinct pairs of a tile's documents with its hubs that places leave room for; the smaller number is a."""
        met = tiles.join(hubs, ["token", "tile"]).select("uid", "place", F.explode("hubs").alias("hub"))
        here, there = F.col("place"), F.col("hub.place")
        rest = F.least(_rest_of(here), _rest_of(there))
        met = met.filter(F.col("uid") != F.col("hub.uid")).filter(_is_own(here) | _is_own(there))
        met = met.filter(_enough(rest, _size_of(here), _size_of(there), self.percent))
        return met.select(F.least("uid", "hub.uid").alias("a"), F.greatest("uid", "hub.uid").alias("b")).distinct()

    def divided(self, tiles: DataFrame, groups: DataFrame) -> DataFrame:
        """Rows (token, tile, uid, place, group) of tiles whose documents are in more than one group."""
        found = groups.select(F.col("node").alias("uid"), "component")
        known = tiles.join(found, "uid", "left").withColumn("group", F.coalesce("component", "uid")).drop("component")
        known = settle(known, "grouped")
        split = known.groupBy("token", "tile").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi")
        # settled, as other sides of joins by tile, so that rows of a tile in many documents can be split over tasks
        return known.join(settle(split.select("token", "tile"), "split"), ["token", "tile"])

    def groups(self) -> DataFrame:
        """Groups (node, component) of class representatives that all links between them make."""
        one, order = F.struct("uid", "place"), F.struct(F.xxhash64("uid").alias("h"), "uid", "place")
        ends = [F.struct(x["uid"].alias("uid"), x["place"].alias("place")) for x in (F.min(order), F.max(order))]
        hubs = F.array_distinct(F.array(F.min(one), F.max(one), *ends))
        own = F.max(F.col("place").bitwiseAND(F.lit(1))).alias("own")
        hubs = self.tiles.groupBy("token", "tile").agg(F.count("*").alias("c"), own, hubs.alias("hubs"))
        hubs = hubs.filter("c > 1 and own = 1").drop("own")
        hubs = settle(hubs, "hubs")
        links = settle(self.exact(self.passed(self.pairs_with(self.tiles, hubs.drop("c")))).distinct(), "links")
        groups = components(links)

        # where at most one document is no hub, all pairs have been compared
        larger = settle(hubs.filter("c - size(hubs) >= 2").select("token", "tile"), "larger")
        larger = settle(self.tiles.join(larger, ["token", "tile"]), "larger")
        # a document that most of a tile's hubs link with is a better hub
        ends = links.select(F.col("a").alias("uid")).unionByName(links.select(F.col("b").alias("uid")))
        degree = ends.groupBy("uid").agg(F.count("*").alias("degree"))
        tiles = settle(self.divided(larger, groups).join(degree, "uid", "left").fillna(0, ["degree"]), "divided")
        best = tiles.groupBy("token", "tile").agg(F.max(F.struct("degree", "uid", "place")).alias("m"))
        best = settle(best.select("token", "tile", F.array(F.struct("m.uid", "m.place")).alias("hubs")), "best")
        more = self.exact(self.passed(self.pairs_with(tiles, best)))
        # further links are added to the groups that there are, not to all links again
        groups = components(stars(groups).unionByName(more))

        first = settle(self.across(self.divided(larger, groups), TIES), "first")
        pairs = settle(first.filter("NOT more").select("a", "b"), "pairs")
        groups = components(stars(groups).unionByName(self.exact(pairs)))
        more = settle(first.filter("more").select(F.col("a").alias("token"), F.col("b").alias("tile")), "more")
        if more.isEmpty():
            return groups
        rest = self.across(self.divided(settle(larger.join(more, ["token", "tile"]), "larger"), groups))
        rest = self.exact(rest.select("a", "b").join(pairs, ["a", "b"], "left_anti"))
        return components(stars(groups).unionByName(rest))

    def across(self, tiles: DataFrame, ties: int | None = None) -> DataFrame:
        """Pairs (a, b) of documents of a tile in different groups, for which bit counts leave room for a link.

        Documents outside of a tile's main group are its few; a pair has one of them at least. Both the few and all
        documents of a tile are dealt to blocks, and each block of the few meets each block of all. With ``ties`` a
        block gives that many forests of its groups at most, each of pairs that the ones before it leave out; rows with
        ``more`` are the tiles (a: token, b: tile) that have further pairs.
        """
        percent = self.percent
        tiles = settle(tiles, "across")
        main = tiles.groupBy("token", "tile", "group").agg(F.count("*").alias("in_group"))
        main = main.groupBy("token", "tile").agg(
            F.max(F.struct("in_group", "group")).alias("m"), F.sum("in_group").alias("rows")
        ).select("token", "tile", F.col("m.group").alias("main"), "rows", (F.col("rows") - F.col("m.in_group")).alias("few"))
        main = settle(main, "main")
        rows = tiles.join(main, ["token", "tile"]).withColumn("is_few", F.col("group") != F.col("main"))
        many_blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
        few_blocks = F.ceil(F.col("few") / BLOCK).cast("int")
        h = F.xxhash64("uid")
        as_any = rows.withColumn("all_block", F.pmod(h, many_blocks).cast("int")).withColumn(
            "few_block", F.explode(F.sequence(F.lit(0), few_blocks - 1))
        )
        as_few = rows.filter("is_few").withColumn("few_block", F.pmod(h, few_blocks).cast("int")).withColumn(
            "all_block", F.explode(F.sequence(F.lit(0), many_blocks - 1))
        )
        cols = ["token", "tile", "few_block", "all_block", "uid", "place", "group"]
        dealt = as_any.select(*cols, F.lit(False).alias("few_side")).unionByName(as_few.select(*cols, F.lit(True).alias("few_side")))
        dealt = dealt.join(self.small.select("uid", "bits"), "uid")
        keys = ["token", "tile", "few_block", "all_block"]
        dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "uid")

        def side(rows: list[tuple], few: bool) -> list[tuple]:
            out = []
            for _, _, _, _, uid, place, group, is_few, bits in rows:
                if is_few == few:
                    n, at = place >> 32, (place & 0xFFFFFFFF) >> 1
                    out.append((uid, group, place & 1, n, n - at, int.from_bytes(bits, "little"), 8 * len(bits)))
            return out

        def compare(rows: list[tuple]) -> Iterator[tuple[int, int, bool]]:
            every, forests, more = side(rows, False), [{} for _ in range(ties or 0)], False
            for uid, group, own, n, rest, bits, width in side(rows, True):
                for uid_2, group_2, own_2, n_2, rest_2, bits_2, width_2 in every:
                    if group == group_2 or not (own or own_2) or min(rest, rest_2) * (100 + percent) < (n + n_2) * percent:
                        continue
                    ends = next((e for f in forests if (e := (f, _root(f, group), _root(f, group_2)))[1] != e[2]), None)
                    if ends is None and more or not _may_link(bits, width, n, bits_2, width_2, n_2, percent):
                        continue
                    if ends is None and ties is not None:
                        more = True
                        continue
                    if ends is not None:
                        ends[0][ends[1]] = ends[2]
                    yield min(uid, uid_2), max(uid, uid_2), False
            if more:
                yield rows[0][0], rows[0][1], True

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def tiles() -> Iterator[list[tuple]]:
                held: list[tuple] = []
                for batch in batches:
                    for row in zip(*(c.to_pylist() for c in batch.columns)):
                        if held and held[0][:4] != row[:4]:
                            yield held
                            held = []
                        held.append(row)
                if held:
                    yield held

            found: set[tuple[int, int, bool]] = set()
            for rows in tiles():
                found.update(compare(rows))
                if len(found) > 50_000:
                    yield _pairs(found)
                    found.clear()
            yield _pairs(found)

        out = dealt.select(*keys, "uid", "place", "group", "few_side", "bits").mapInArrow(task, "a long, b long, more boolean")
        return out.distinct()


def _root(parents: dict[int, int], group: int) -> int:
    while (above := parents.get(group, group)) != group:
        parents[group] = group = parents.get(above, above)
    return group


def _pairs(found: set[tuple[int, int, bool]]) -> pa.RecordBatch:
    columns = zip(*found) if found else ((), (), ())
    arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()))]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "more"])


def shingle_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when 100 * common >= percent * union of their shingles; component_id is the smallest doc_id
    that links lead to. A null text, or one without a word, has no shingles and no links, and its component is its
    own id. Equal rows and equal ids are documents of their own that link as their texts do; null ids are larger than
    any other. Other columns are not looked at; an empty table gives an empty result. Shingles are compared by 64-bit
    hashes, and whole sets by 128-bit ones.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")]
    with passing(docs.sparkSession):
        join = _Join(docs.select(*columns), words, percent)
        of_class = join.classes.join(join.groups(), "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
        named = settle(of_class.join(least, "component").select("key", "component_id"), "named", keep=True)
    empty = join.profiles.filter("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    some = join.profiles.filter("n > 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "key")
    return some.join(named, "key").drop("key").unionByName(empty)


def one_of_each_group(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group; rows without a shingle stay. Ids are to be unique."""
    with passing(docs.sparkSession):
        kept = shingle_groups(docs, words, percent).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_kept"))
        kept = settle(kept.distinct(), "kept", keep=True)
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept"]), "left_semi")
