"""Exact dedup by Grace hashing.

Copies inside a task are folded first, so a group of copies, however large, sends one record from each task. The
folded records are dealt to tasks by a hash of their content. A task splits its records into spill files by further
bits of the hash until the distinct contents of a file fit the memory given, and finds equal ones in an
open-addressing table that compares the complete content.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import unused
from tallyframe.llm.common import slices
from tallyframe.workspace import settle

#: Bytes of distinct contents that a table holds before its records are split further.
TABLE_BYTES = 16 << 20
#: Spill files that one level of splitting writes.
FAN_OUT = 16
#: Bytes of a batch that a task hands on.
BATCH_BYTES = 8 << 20

_NUMBERS = [("keep_id", pa.int64()), ("group_size", pa.int64()), ("keep_rows", pa.int64())]
_FOLDED = pa.schema([("bucket", pa.int64()), ("content", pa.binary()), *_NUMBERS])
_CLASSES = pa.schema([("text_sha256", pa.string()), *_NUMBERS])

Record = tuple[int, bytes, int | None, int, int]  # hash, content, largest id, rows, rows with that id


def normalised(text: bytes | None) -> bytes:
    """The text with A-Z lower-cased; null counts as empty."""
    return text.lower() if text else b""


class ContentTable:
    """Open addressing with linear probing; a slot is a record's number, and equality is that of whole contents."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.records: list[list] = []
        self.bytes = 0

    def add(self, key: int, content: bytes, keep_id: int | None, rows: int, keep_rows: int) -> None:
        mask = len(self.slots) - 1
        at = key & mask
        while (n := self.slots[at]) >= 0:
            record = self.records[n]
            if record[0] == key and record[1] == content:
                record[3] += rows
                if record[2] == keep_id:
                    record[4] += keep_rows
                elif record[2] is None or keep_id is not None and keep_id > record[2]:
                    record[2], record[4] = keep_id, keep_rows
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.records)
        self.records.append([key, content, keep_id, rows, keep_rows])
        self.bytes += len(content) + 200
        if 2 * len(self.records) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for n, record in enumerate(self.records):
            at = record[0] & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = n


def _read(file: IO[bytes]) -> Iterator[Record]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def grace(records: Iterator[Record], table_bytes: int = TABLE_BYTES, level: int = 0) -> Iterator[Record]:
    """One record per distinct content, with the largest id and the number of rows.

    While the contents seen fit the table there are no files. Beyond that all records go to spill files by four bits
    of the hash a level, and each file is treated likewise. After sixteen levels the hash is used up and the table
    takes what is left: contents with the same 64-bit hash.
    """
    table = ContentTable()
    for record in records:
        table.add(*record)
        if table.bytes > table_bytes and level < 16:
            break
    else:
        yield from map(tuple, table.records)
        return
    files = [tempfile.TemporaryFile() for _ in range(FAN_OUT)]
    try:
        shift = 60 - 4 * level
        for held in (table.records, records):
            for record in held:
                pickle.dump(tuple(record), files[(record[0] >> shift) & (FAN_OUT - 1)], protocol=5)
        del table
        for file in files:
            yield from grace(_read(file), table_bytes, level + 1)
            file.close()
    finally:
        for file in files:
            file.close()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _fold_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold copies inside the task; a full table is handed on and begun anew, so memory is bounded."""

    def rows() -> Iterator[tuple]:
        table = ContentTable()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content = normalised(text)
                table.add(xxhash.xxh3_64_intdigest(content), content, doc_id, 1, 1)
                if table.bytes > TABLE_BYTES:
                    yield from table.records
                    table = ContentTable()
        yield from table.records

    signed = ((row[0] - (1 << 64) if row[0] >> 63 else row[0], *row[1:]) for row in rows())
    yield from _batches(signed, _FOLDED, lambda row: len(row[1]) + 32)


def _class_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[Record]:
        for batch in slices(batches):
            for key, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                yield key & 0xFFFFFFFFFFFFFFFF, *rest

    found = ((hashlib.sha256(content).hexdigest(), *rest) for _, content, *rest in grace(records()))
    yield from _batches(found, _CLASSES, lambda row: 100)


def _digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        digests = [hashlib.sha256(normalised(t)).hexdigest() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], names=["doc_id", "text_sha256"])


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))


def classes(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id (largest doc_id), group_size (rows), keep_rows.

    ``keep_rows`` counts the rows that have the largest id: one, unless rows repeat.
    """
    numbers = "keep_id long, group_size long, keep_rows long"
    folded = _columns(docs).mapInArrow(_fold_task, f"bucket long, content binary, {numbers}")
    return folded.repartition("bucket").mapInArrow(_class_task, f"text_sha256 string, {numbers}")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. The row with the largest
    doc_id stays; a null doc_id is below any other and never kept unless all ids of the group are null. Rows that
    repeat a doc_id with an equal text are one record: all of them say kept, and :func:`deduplicated` leaves one.
    Other columns of ``docs`` are not looked at. An empty table gives an empty result.
    """
    # settled, so that the join below knows its size, and splits the rows of a large group where it is no broadcast
    found = settle(classes(docs), "classes")
    members = _columns(docs).mapInArrow(_digest_task, "doc_id long, text_sha256 string")
    return members.join(found, "text_sha256").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``: of equal texts that with the largest doc_id.

    Of rows that repeat a doc_id with an equal text one stays.
    """
    of, at = unused(docs, "keep", "digest")
    kept = settle(classes(docs), "classes").select(
        F.col("keep_id").alias("keep"), F.col("text_sha256").alias("sha256"), "keep_rows"
    )
    rows = docs.withColumns({of: F.col("doc_id").cast("long"), at: _digest()})
    same = (rows[at] == kept["sha256"]) & rows[of].eqNullSafe(kept["keep"])
    once = rows.join(kept.filter("keep_rows = 1"), same, "left_semi").drop(of, at)
    if kept.filter("keep_rows > 1").isEmpty():
        return once
    repeated = rows.join(kept.filter("keep_rows > 1"), same, "left_semi").dropDuplicates([of, at])
    return once.unionByName(repeated.drop(of, at))


def _digest() -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.sha2(F.translate(text, _UPPER, _UPPER.lower()), 256)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
