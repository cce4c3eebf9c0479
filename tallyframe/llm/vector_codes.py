"""Codes for vectors from codebooks fitted by Lloyd's rounds over cover trees.

Components are made whole numbers, so distances are exact. Each task cuts its rows into blocks; a block holds, for each
part of the vectors, a cover tree: a node's rows lie within its radius of the node's own row, children within half of
it, and sibling rows stand further apart than that. Rows are stored in the order of the tree, so a node is a range of
rows, and differences of running sums are the sums of its rows.

A round sends the codebook through each tree from the top. If the nearest entry is nearer than any other by more than
twice the radius, the triangle inequality gives it the whole node, and its sums are added at once. Only other nodes
pass on to their children, and only rows of leaves that stay undecided are compared one by one. Blocks are
written once and read in each round; what leaves a task of a round is one row of sums per entry and component. The
codebook (``entries`` times the length of a vector) is the one thing that goes through the driver.

Rows whose vector is null, or holds a null, NaN or infinite component, are dropped. Shorter vectors count as filled up
with zeros, and lengths as rounded up to a multiple of the number of parts. Components are held within +-2**50, and sums
of errors that no long holds are the largest long. Null ids come last among the ids of the first codebook; rows of
one id follow in the order of their vectors. Repeated rows are rows like any other; with fewer rows than entries
the codebook is as long as the table. An empty table gives an empty result. Other columns are neither read nor
returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.workspace import settle

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block, and numbers in it.
BLOCK_ROWS, BLOCK_NUMBERS = 2048, 1 << 21
#: Rows up to which a node has no children.
LEAF = 8
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53
_LARGEST = (1 << 63) - 1
_HELD = 1 << 50

_NODES = pa.list_(
    pa.struct([("points", pa.binary()), *((n, pa.binary()) for n in ("order", "start", "end", "radius", "first", "last"))])
)
_NODES_DDL = "array<struct<points:binary,`order`:binary,`start`:binary,`end`:binary,radius:binary,first:binary,last:binary>>"


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether squared distances between rows of both fit a double, so that they can be made by a matrix product."""
    largest = max((int(np.abs(x).max()) for x in (a, b) if x.size), default=0)
    return 4 * a.shape[1] * largest**2 < EXACT


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries: doubles that are whole, or Python's numbers where too large."""
    if _exact(points, entries):
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return (p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)
    p, e = points.astype(object), entries.astype(object)
    return np.stack([((row - e) ** 2).sum(1) for row in p]) if len(p) else np.empty((0, len(e)), object)


class CoverTree:
    """Rows in the tree's order, and nodes as ranges of them; ``first`` to ``last`` are a node's children."""

    def __init__(self, points: np.ndarray, arrays: dict[str, np.ndarray]) -> None:
        self.points = points
        self.order, self.start, self.end, self.radius, self.first, self.last = (
            arrays[n] for n in ("order", "start", "end", "radius", "first", "last")
        )

    @classmethod
    def build(cls, rows: np.ndarray) -> CoverTree:
        n = len(rows)
        if not _exact(rows, rows):  # one leaf, whose rows are compared one by one
            whole = {"order": np.arange(n), "start": [0], "end": [n], "radius": [np.inf], "first": [0], "last": [0]}
            return cls(rows, {k: np.asarray(v) for k, v in whole.items()})
        apart = np.sqrt(distances(rows, rows))
        order = np.arange(n)
        start, end, radius, first, last = [0], [n], [apart[0].max(initial=0.0)], [0], [0]
        at = 0
        while at < len(start):
            a, b, reach = start[at], end[at], radius[at]
            if b - a > LEAF and reach > 0:
                left, groups = order[a:b], []
                while len(left):  # the node's own row is the first child's
                    near = apart[left[0], left] <= reach / 2
                    groups.append(left[near])
                    left = left[~near]
                order[a:b] = np.concatenate(groups)
                first[at] = len(start)
                for group in groups:
                    start.append(a)
                    a += len(group)
                    end.append(a)
                    radius.append(apart[group[0], group].max())
                    first.append(0)
                    last.append(0)
                last[at] = len(start)
            at += 1
        nodes = {"order": order, "start": start, "end": end, "radius": radius, "first": first, "last": last}
        return cls(rows[order], {k: np.asarray(v) for k, v in nodes.items()})

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each row in the tree's order, and the ranges (start, end, entry) that it was found for."""
        out = np.empty(len(self.points), np.int64)
        exact = _exact(self.points, entries)
        settled, undecided = [], []
        nodes = np.array([0]) if exact and len(self.points) else np.empty(0, np.int64)
        if not exact:
            undecided.append(np.arange(len(self.points)))
        while len(nodes):
            squared = distances(self.points[self.start[nodes]], entries)
            best = squared.argmin(1)
            line = np.arange(len(nodes))
            near = np.sqrt(squared[line, best])
            squared[line, best] = np.inf
            reach = self.radius[nodes]
            # the margin is far above the error of the square roots; at radius 0 all rows are one
            whole = (reach == 0) | (np.sqrt(squared.min(1)) > (near + 2 * reach) * (1 + 1e-9) + 1e-6)
            for a, b, entry in zip(self.start[nodes[whole]], self.end[nodes[whole]], best[whole]):
                out[a:b] = entry
                settled.append((a, b, entry))
            open_nodes = nodes[~whole]
            is_leaf = self.first[open_nodes] == self.last[open_nodes]
            undecided += [np.arange(self.start[x], self.end[x]) for x in open_nodes[is_leaf]]
            inner = open_nodes[~is_leaf]
            nodes = np.concatenate([np.arange(self.first[x], self.last[x]) for x in inner] or [nodes[:0]])
        if undecided:
            rows = np.concatenate(undecided)
            for at in range(0, len(rows), 1 << 14):
                some = rows[at : at + (1 << 14)]
                out[some] = distances(self.points[some], entries).argmin(1)
            settled += [(a, a + 1, out[a]) for a in rows]
        return out, np.array(settled, np.int64).reshape(-1, 3)

    def sums(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of rows of each entry and their sums by component."""
        _, ranges = self.nearest(entries)
        running = np.concatenate([np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points, 0)])
        counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
        a, b, entry = ranges.T
        np.add.at(counts, entry, b - a)
        np.add.at(sums, entry, running[b] - running[a])
        return counts, sums

    def packed(self) -> dict[str, bytes]:
        kind = np.int32 if np.abs(self.points).max(initial=0) < 1 << 31 else np.int64
        out = {n: getattr(self, n).astype(np.int32).tobytes() for n in ("order", "start", "end", "first", "last")}
        return out | {"points": self.points.astype(kind).tobytes(), "radius": self.radius.astype(np.float64).tobytes()}

    @classmethod
    def unpacked(cls, data: dict[str, bytes], width: int) -> CoverTree:
        arrays = {n: np.frombuffer(data[n], np.int32) for n in ("order", "start", "end", "first", "last")}
        kind = np.int32 if len(data["points"]) == 4 * width * len(arrays["order"]) else np.int64
        arrays["radius"] = np.frombuffer(data["radius"])
        return cls(np.frombuffer(data["points"], kind).astype(np.int64).reshape(-1, width), arrays)


def _whole(values: pa.Array, lengths: np.ndarray, width: int, scale: int) -> np.ndarray:
    """Rows of ``floor(scale * x)``, filled up with zeros to ``width``."""
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(flat * scale), -_HELD, _HELD).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _blocks(rows: DataFrame, width: int, parts: int, scale: int) -> DataFrame:
    """One row per block: ids, labels and a tree for each part."""
    label = rows.schema["label"].dataType.simpleString()
    most = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(width, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                held.append(batch.slice(at, most))
                if sum(b.num_rows for b in held) >= most:
                    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    yield block(table.slice(0, most))
                    held = [table.slice(most)] if table.num_rows > most else []
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = batch.column(2)
        whole = _whole(vectors.flatten(), np.asarray(vectors.value_lengths()), width, scale)
        trees = [CoverTree.build(np.ascontiguousarray(part)).packed() for part in np.split(whole, parts, 1)]
        ends = pa.array([0, batch.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays([batch.column(n)])) for n in (0, 1)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([trees], _NODES)], ["ids", "labels", "trees"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(
        run, f"ids array<long>, labels array<{label}>, trees {_NODES_DDL}"
    )


def _trees(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[CoverTree]]]:
    for batch in batches:
        for n in range(batch.num_rows):
            one = batch.slice(n, 1)
            yield one, [CoverTree.unpacked(data, width) for data in one.column("trees")[0].as_py()]


def _round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry replaced by the floored mean of the parts next to it; entries without any stay."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(books), len(books[0])), np.int64)
        high, low = (np.zeros((len(books), *books[0].shape), np.int64) for _ in range(2))
        for _, trees in _trees(batches, width):
            for part, tree in enumerate(trees):
                n, sums = tree.sums(books[part])
                counts[part] += n
                high[part] += sums >> 32
                low[part] += sums & 0xFFFFFFFF
        part, entry = np.nonzero(counts)
        at = np.repeat(np.arange(len(part)), width)
        place = np.tile(np.arange(width), len(part))
        columns = [part[at], entry[at], place, counts[part, entry][at], high[part, entry].ravel(), low[part, entry].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    names = ["part", "entry", "place", "n", "high", "low"]
    sums = blocks.select("trees").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    new = [book.copy() for book in books]
    total = sums.groupBy("part", "entry", "place").agg(*[F.sum(n).alias(n) for n in names[3:]])
    for part, entry, place, n, high, low in total.collect():  # one row per number of the codebooks
        new[part][entry, place] = ((high << 32) + low) // n
    return new


def _assigned(blocks: DataFrame, books: list[np.ndarray], label: str) -> DataFrame:
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, trees in _trees(batches, width):
            n = len(trees[0].points)
            codes, error = np.empty((n, len(trees)), np.uint8), np.zeros(n, object)
            for part, tree in enumerate(trees):
                found, _ = tree.nearest(books[part])
                codes[tree.order, part] = found
                kind = np.int64 if _exact(tree.points, books[part]) else object
                gap = tree.points.astype(kind) - books[part][found].astype(kind)
                error[tree.order] += (gap * gap).sum(1).astype(object)
            text = codes.tobytes().hex()
            columns = [
                one.column("ids").flatten(),
                one.column("labels").flatten(),
                pa.array([text[at : at + 2 * len(trees)] for at in range(0, len(text), 2 * len(trees))]),
                pa.array([min(e, _LARGEST) for e in error], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows whose vector is there and finite throughout."""
    inf = float("inf")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == inf))
    kept = vectors.filter(F.col("embedding").isNotNull() & ~odd)
    return kept.select(F.col("vec_id").cast("long"), "label", "embedding")


def fitted(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[np.ndarray]]:
    """The rows as blocks of trees, and a codebook for each part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part, so 1 to 256 entries")
    kept = usable(vectors)
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(-(-longest // parts), 1)
    blocks = settle(_blocks(kept, width * parts, parts, scale), "blocks")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    lengths = np.array([len(r[0]) for r in first], np.int64)
    flat = pa.array([x for r in first for x in r[0]], pa.float64())
    books = [np.ascontiguousarray(b) for b in np.split(_whole(flat, lengths, width * parts, scale), parts, 1)]
    for _ in range(rounds if first else 0):
        books = _round(blocks, books)
    return blocks, books


def encode(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """Per row kept: vec_id, code (two hex digits a part), error, label_error, and a digest of the codebooks."""
    blocks, books = fitted(vectors, parts, entries, rounds, scale)
    numbers = ",".join(str(x) for book in books for x in book.ravel().tolist())
    label: T.DataType = vectors.schema["label"].dataType
    rows = settle(_assigned(blocks, books, label.simpleString()), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = settle(
        rows.groupBy(F.col("label").alias("of")).agg(F.least(total, F.lit(_LARGEST)).cast("long").alias("label_error")),
        "label-errors",
    )
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256")
    )
