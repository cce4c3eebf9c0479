"""WARC archives: a writer, and a PySpark Python data source that reads them.

An archive is a folder of ``part-*.warc.gz`` files, each record a gzip member of its own, as the format asks for, and
beside each file an index ``.cdx`` of where its members begin. A manifest, written last, names the files that count, so
what a lost or repeated task has left behind is not read. The reader plans ranges of bytes from the files' sizes; each
task finds the members that begin in its range in the index, so a large file is many tasks' work; filters on record type, id, digest and reference reach it and are
decided on a record's headers; a payload is decoded only for records that pass and only if its column is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull
from pyspark.sql.types import StructType

from tallyframe.llm.common import slices
from tallyframe.workspace import new_path, settle

#: Compressed bytes of a partition, and of a gzip member's headers to decode at first.
SPLIT_BYTES = 16 << 20
HEAD_BYTES = 2048
MANIFEST = "_manifest"

_HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "page_id": "x-page-id",
    "payload_digest": "warc-payload-digest",
    "payload_bytes": "x-payload-length",
    "refers_to": "x-refers-to-page",
}
_NUMBERS = {"page_id", "payload_bytes", "refers_to"}
SCHEMA = ", ".join(f"{c} {'long' if c in _NUMBERS else 'string'}" for c in _HEADERS) + ", payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: dict[str, str | int | None], block: bytes) -> bytes:
    """A WARC 1.1 record; headers that are None are left out, and line ends in values become spaces."""
    lines = ["WARC/1.1"]
    for name, value in headers.items():
        if value is not None:
            lines.append(f"{name}: {' '.join(str(value).splitlines()) if isinstance(value, str) else value}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers: int | None) -> bytes:
    """A response holds the payload; a revisit holds none, and says how long it is and which page has it."""
    name = f"{page_id}/{url}/{digest}/{kind}"
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": url or None,
        "Content-Type": "text/html",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-Id": page_id,
        "X-Payload-Length": len(payload),
    }
    if kind == "revisit":
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        headers["X-Refers-To-Page"] = refers
        return record_bytes(headers, b"")
    return record_bytes(headers, payload)


def write_archive(records: DataFrame, path: str) -> int:
    """Write ``records`` (page_id, url, html, digest, record_type, refers_to) as an archive; the number of records.

    A task writes its file and the file's index under names of its own attempt. The attempts whose results Spark takes
    are named in the manifest: one line per task. ``path`` is any folder that pyarrow's file systems reach: file, hdfs,
    s3, gs.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        store.create_dir(root, recursive=True)
        starts, at, n = [], 0, 0
        with store.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out:
            for batch in slices(batches):
                for page_id, url, html, digest, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    data = member(_page_record(page_id, url, html, digest, kind, refers))
                    starts.append(at)
                    out.write(data)
                    at, n = at + len(data), n + 1
        if n:
            with store.open_output_stream(f"{root}/{name}.cdx", compression=None) as out:
                out.write("\n".join(map(str, [*starts, at])).encode())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "n"])
        else:
            store.delete_file(f"{root}/{name}.warc.gz")

    rows = records.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")),
        "digest",
        "record_type",
        F.col("refers_to").cast("long"),
    )
    written = rows.mapInArrow(task, "name string, n long").collect()  # one row per task
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
        out.write("\n".join(sorted(r["name"] for r in written)).encode())
    return sum(r["n"] for r in written)


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int, index: str = ""):
        self.path, self.start, self.end, self.index = path, start, end, index


class WarcReader(DataSourceReader):
    """Reads ranges of members. Filters that it takes over are decided on the headers."""

    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema]
        self.path = options["path"]
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.wanted: list[tuple[str, str, tuple]] = []
        if "recordtype" in options:
            self.wanted.append(("record_type", "in", (options["recordtype"],)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in _HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.wanted.append((column, "in", tuple(f.value)))
            elif isinstance(f, IsNotNull):
                self.wanted.append((column, "there", ()))
            elif isinstance(f, IsNull):
                self.wanted.append((column, "missing", ()))
            else:
                yield f

    def partitions(self) -> list[Split]:
        store, root = fs.FileSystem.from_uri(self.path)
        splits = []
        files = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        indexed = {f.path for f in files if f.path.endswith(".cdx")}
        archives = [f for f in files if f.path.endswith((".warc.gz", ".warc"))]
        if any(f.base_name == MANIFEST for f in files):
            with store.open_input_stream(f"{root}/{MANIFEST}") as held:
                named = {f"{name}.warc.gz" for name in held.read().decode().split()}
            archives = [f for f in archives if f.base_name in named]
        for file in sorted(archives, key=lambda f: f.path):
            index = file.path.removesuffix(".warc.gz") + ".cdx"
            if index not in indexed:
                splits.append(Split(file.path, 0, file.size))
                continue
            for start in range(0, file.size, self.split_bytes):
                splits.append(Split(file.path, start, min(start + self.split_bytes, file.size), index))
        return splits or [Split("", 0, 0)]

    def _passes(self, row: dict) -> bool:
        for column, how, values in self.wanted:
            value = row[column]
            if how == "in" and (value is None or value not in values):
                return False
            if how == "there" and value is None or how == "missing" and value is not None:
                return False
        return True

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        payload_wanted = "payload" in self.names
        types = {c: pa.int64() if c in _NUMBERS else pa.string() for c in _HEADERS} | {"payload": pa.binary()}
        schema = pa.schema([(c, types[c]) for c in self.names])
        held: list[tuple] = []
        size = 0
        with store.open_input_file(partition.path) as file:
            if partition.path.endswith(".warc"):
                members = _plain(file)
            elif partition.index:
                with store.open_input_stream(partition.index) as held_index:
                    starts = list(map(int, held_index.read().split()))
                mine = [(a, b) for a, b in zip(starts, starts[1:]) if partition.start <= a < partition.end]
                members = _indexed(file, mine)
            else:
                members = _members(file, partition.start, partition.end)
            for lines, block in members:
                row = _row(lines)
                if not self._passes(row):
                    continue
                if payload_wanted:
                    row["payload"] = block()
                    size += len(row["payload"])
                held.append(tuple(row[c] for c in self.names))
                size += 300
                if size > 8 << 20:
                    yield _batch(held, schema)
                    held, size = [], 0
        if held:
            yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _row(head: bytes) -> dict:
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    row: dict = {c: fields.get(h) for c, h in _HEADERS.items()}
    for c in _NUMBERS:
        row[c] = int(row[c]) if row[c] is not None else None
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    return row


def _indexed(file: pa.NativeFile, members: list[tuple[int, int]]):
    """Headers of each gzip member, given by its start and end, and a function that decodes its block.

    Of a member whose block is not asked for only the first bytes are read and unpacked.
    """
    for start, end in members:
        file.seek(start)
        unpack = zlib.decompressobj(31)
        head, data = b"", b""
        while (cut := head.find(b"\r\n\r\n")) < 0:
            data = data or file.read(min(HEAD_BYTES, end - file.tell()))
            if not data:
                raise ValueError("a record without headers")
            head += unpack.decompress(data, HEAD_BYTES)
            data = unpack.unconsumed_tail

        def block(begun=head[cut + 4 :], data=data, unpack=unpack, at=file.tell(), end=end) -> bytes:
            file.seek(at)
            return (begun + unpack.decompress(data + file.read(end - at)))[:-4]

        yield head[:cut], block


def _members(file: pa.NativeFile, start: int, end: int):
    """Headers of each gzip member between two places, and a function that decodes its block when called.

    A member is unpacked only until its headers end; the rest is skipped to find the next member without being kept,
    or kept if the block is asked for.
    """
    file.seek(start)
    left = end - start
    data = b""
    while left or data:
        unpack = zlib.decompressobj(31)
        head = b""
        while (cut := head.find(b"\r\n\r\n")) < 0:
            if not data:
                if not left:
                    return
                data = file.read(min(1 << 20, left))
                left -= len(data)
            head += unpack.decompress(data, HEAD_BYTES)
            data = unpack.unconsumed_tail if not unpack.eof else unpack.unused_data
            if unpack.eof and b"\r\n\r\n" not in head:
                raise ValueError("a record without headers")
        state = {"data": data, "left": left, "block": None}

        def finish(keep: bool, unpack=unpack, state=state, begun=head[cut + 4 :]) -> None:
            parts = [begun] if keep else []
            while not unpack.eof:
                if not state["data"]:
                    state["data"] = file.read(min(1 << 20, state["left"]))
                    state["left"] -= len(state["data"])
                    if not state["data"]:
                        raise ValueError("an archive ends inside a record")
                more = unpack.decompress(state["data"], 1 << 20)
                state["data"] = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
                if keep:
                    parts.append(more)
            if keep:
                state["block"] = b"".join(parts)[:-4]

        def block(state=state, finish=finish) -> bytes:
            if state["block"] is None:
                finish(True)
            return state["block"]

        yield head[:cut], block
        finish(False)
        data, left = state["data"], state["left"]


def _plain(file: pa.NativeFile):
    """The same for an archive that is not packed: blocks that are not asked for are passed over by seeking."""
    file.seek(0)
    size = file.size()
    at = 0
    while at < size:
        file.seek(at)
        head = b""
        while (cut := head.find(b"\r\n\r\n")) < 0:
            more = file.read(HEAD_BYTES)
            if not more:
                if head.strip():
                    raise ValueError("an archive ends inside a record")
                return
            head += more
        lines = head[:cut].decode("utf-8", "replace").lower().split("\r\n")
        length = int(next(line.partition(":")[2] for line in lines if line.startswith("content-length:")))
        begin = at + cut + 4

        def block(begin=begin, length=length) -> bytes:
            file.seek(begin)
            return file.read(length)

        yield head[:cut], block
        at = begin + length + 4


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options: recordType, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, {k.lower(): v for k, v in self.options.items()})


def read_archive(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of an archive; ``columns`` are those that the reader makes, all by default.

    Filters reach the reader only with ``spark.sql.python.filterPushdown.enabled``, which is set here.
    """
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc")
    if columns:
        kinds = dict(part.split(" ") for part in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)


def with_revisits(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to for every row of ``pages``.

    Of the rows with equal payloads of at least ``smallest`` bytes that with the smallest page_id is the response and
    the others revisit it; of rows that share that page_id all are responses. A null html is an empty payload; a null
    page_id is above any other.
    """
    binary = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), binary.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    least = (
        rows.filter(F.octet_length("html") >= smallest)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "first_page")
    )
    # settled, so that payloads are not shuffled for a few repeated ones
    joined = rows.join(settle(least, "repeated"), "digest", "left")
    again = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    kind = F.when(again, "revisit").otherwise("response")
    refers = F.when(again, F.col("first_page"))
    return joined.select("page_id", "url", "html", "digest", kind.alias("record_type"), refers.alias("refers_to"))


def archive_pages(pages: DataFrame, path: str | None = None, smallest: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as an archive and read it back.

    One row per row of ``pages``, from the archive alone: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Payloads of responses are decoded, measured and hashed again; for revisits the headers have both. Rows that
    repeat are records of their own; an empty table gives an empty result; other columns are not looked at. A very
    long payload is held in memory once, by the task that has it.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archive(_hex_to_base32(with_revisits(pages, smallest)), path)
    revisits = read_archive(spark, path, [c for c in _HEADERS]).filter("record_type = 'revisit'")
    responses = read_archive(spark, path).filter("record_type = 'response'")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            payloads = batch.column(1).to_pylist()
            arrays = [
                batch.column(0),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([sha1_base32(p) for p in payloads], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "payload_bytes", "payload_digest"])

    measured = responses.select("page_id", "payload").mapInArrow(measure, "page_id long, payload_bytes long, payload_digest string")
    measured = measured.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long"))
    return measured.unionByName(revisits.select(*measured.columns))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _hex_to_base32(records: DataFrame) -> DataFrame:
    """The digest column from hex to base32: each of 8 groups of 20 bits gives 4 of the 32 digits."""
    groups = [F.conv(F.substring("digest", 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    digits = [
        F.substring(F.lit(_BASE32), F.shiftright(g, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)
    ]
    return records.withColumn("digest", F.concat(*digits))
