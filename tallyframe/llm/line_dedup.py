"""Line dedup by a log-template tree.

A line's place in the tree is fixed by its number of words and its leading words, words with a digit counting as
variable. In a leaf, a word that many documents have at the same place of a line can be constant. A line has the
template of all those words, and those of the words that twice, four times ... as many documents have, as long as
enough words are constant. Lines with a template that occurs in many documents are dropped.

Lines meet by word and place, and by template, never a whole leaf: a word is a number that has its leaf and place in it.
Leaves that too few documents reach are pruned before any line moves.

Lines too short for that, of four or five words, recur if all of their words but one do, in its place, in many documents.

Equal lines need no tree: a line that is in two documents is dropped in all, one of a word or two if it is in many.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import slices
from tallyframe.workspace import settle

#: Leading words that lead to a leaf.
DEPTH = 3
#: Share of a line's words, without the leading and the variable ones, that are constant in its templates.
SIMILARITY = 0.6
#: Documents from which on an equal line recurs.
MIN_DOCS = 2
#: Documents from which on a template of different lines recurs.
TEMPLATE_DOCS = 10
#: Lines with fewer words are short: they are in no leaf, and recur from SHORT_DOCS documents on.
MIN_WORDS = 3
SHORT_DOCS = 20
#: Words without a digit that make lines equal which differ in variable words only, and that a template has after the
#: leading words.
MIN_EQUAL = 3
#: Lines with fewer words than MIN_EQUAL after the leading ones have a template for each of their words: the others, if
#: they are MIN_EQUAL or more. So little is recurring only from so many documents on.
SHORT_TEMPLATE_DOCS = 50
#: Slots of the filter that keeps lines of rare leaves from moving.
SLOTS = 1 << 20

VARIABLE = "<*>"
_DIGITS = set("0123456789")
_DIGIT = re.compile("[0-9]")


def masked(line: str) -> list[str]:
    """Words of a line; those with a digit are variable."""
    words = line.split()
    return [VARIABLE if _DIGITS.intersection(w) else w for w in words] if _DIGIT.search(line) else words


def equal_form(line: str) -> str:
    """What lines that count as equal share: the masked words if MIN_EQUAL of them are constant, else the words."""
    return _form(line, masked(line))


def _form(line: str, words: list[str]) -> str:
    return " ".join(words if len(words) - words.count(VARIABLE) >= MIN_EQUAL else line.split())


def _signed(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


def leaf_of(words: list[str]) -> int:
    """The leaf as a signed 64-bit number."""
    return _signed(" ".join([str(len(words)), *words[:DEPTH]]))


def generalise(lines: list[tuple[str, ...]], similarity: float = SIMILARITY) -> list[tuple[str, ...]]:
    """The template of each of a few lines of equal length by greedy matching; not used by the query.

    A template keeps the words that all its lines have in their place. The best template is the one with most equal
    words, the earlier one of equals; templates that end up equal are one.
    """
    templates: list[list[str]] = []
    of: list[int] = []
    for line in lines:
        best, at = -1, -1
        for n, template in enumerate(templates):
            same = sum(map(str.__eq__, line, template))
            if same > best:
                best, at = same, n
        if at >= 0 and best >= similarity * len(line):
            templates[at] = [a if a == b else VARIABLE for a, b in zip(templates[at], line)]
        else:
            at = len(templates)
            templates.append(list(line))
        of.append(at)
    return [tuple(templates[n]) for n in of]


def places(words: list[str], leaf: int) -> list[int]:
    """Numbers of the constant words after the leading ones, each with its leaf and place."""
    return [_signed(f"{leaf} {at} {w}") for at, w in enumerate(words[DEPTH:]) if w != VARIABLE]


def but_one(words: list[str]) -> list[int]:
    """Templates of a short line: all words but one, which may be any; lines with a variable word need none."""
    if not MIN_EQUAL < len(words) < DEPTH + MIN_EQUAL or VARIABLE in words:
        return []
    return [_signed(" ".join([VARIABLE, str(at), *words[:at], *words[at + 1 :]])) for at in range(len(words))]


def _in_templates(met: DataFrame, docs: int, similarity: float) -> DataFrame:
    """uid and number of the lines ``met`` (uid, number, line, places) with a template that ``docs`` documents have."""
    words = met.select("uid", F.explode("places").alias("place")).distinct().groupBy("place").agg(F.count("*").alias("n"))
    # how often the least number of documents can be doubled until more than have the word
    level = (F.length(F.bin(F.expr(f"n div {docs}"))) - 1).alias("level")
    words = settle(words.filter(F.col("n") >= docs).select("place", level), "words")
    lines = settle(met.dropDuplicates(["line"]).select("line", F.size("places").alias("size"), F.posexplode("places").alias("at", "place")), "words-of")
    held = lines.join(words, "place").groupBy("line", "size").agg(F.sort_array(F.collect_list(F.struct("at", "place", "level"))).alias("held"))
    each = held.withColumn("from", F.explode(F.array_distinct("held.level")))
    kept = F.filter("held", lambda w: w["level"] >= F.col("from"))
    each = each.select("line", "size", F.transform(kept, lambda w: w["place"]).alias("kept"))
    enough = F.size("kept") >= F.greatest(F.lit(MIN_EQUAL), F.lit(similarity) * F.col("size"))
    each = settle(each.filter(enough).select("line", F.xxhash64("kept").alias("template")).distinct(), "templates")
    # a line that many documents have is in as many rows, so both sides are settled and can be split
    of = settle(met.select("line", "uid").distinct(), "lines-of")
    found = each.join(of, "line").select("template", "uid").distinct().groupBy("template").agg(F.count("*").alias("docs"))
    found = settle(found.filter(F.col("docs") >= docs).select("template"), "recurring")
    recurring = settle(each.join(found, "template").select("line").distinct(), "recurring-lines")
    return met.join(recurring, "line").select("uid", "number")


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and a number of both: rows that repeat share it, and their lines are dropped alike."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("uid", F.xxhash64("doc_id", "text"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """uid and the numbers of the lines of that document that recur; documents without any are not there."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = {None}
                for number, line in enumerate((text or "").split("\n")):
                    words = masked(line)
                    if not words:
                        continue
                    leaf = leaf_of(words) if len(words) >= MIN_WORDS else None
                    form = _signed(_form(line, words))
                    found.append((uid, number, form, len(words) < MIN_WORDS, None if leaf in seen else leaf, but_one(words)))
                    seen.add(leaf)
            columns = list(zip(*found)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()))
            names = ["uid", "number", "form", "short", "leaf", "but_one"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = _identified(docs)
    spelled = rows.select("uid", "text").mapInArrow(spell, "uid long, number int, form long, short boolean, leaf long, but_one array<long>")
    spelled = settle(spelled, "spelled")
    docs_of = spelled.select("form", "short", "uid").distinct().groupBy("form", "short").agg(F.count("*").alias("docs"))
    least = F.when(F.col("short"), F.lit(max(min_docs, SHORT_DOCS))).otherwise(F.lit(min_docs))
    equal = settle(docs_of.filter(F.col("docs") >= least).select("form", "short"), "equal")
    dropped = spelled.join(equal, ["form", "short"]).select("uid", "number")

    near = settle(spelled.select("uid", "number", "form", F.explode("but_one").alias("key")), "near")
    many = near.groupBy("key").agg(F.min("form").alias("lo"), F.max("form").alias("hi"), F.count("*").alias("n"))
    many = settle(many.filter((F.col("n") >= max(min_docs, SHORT_TEMPLATE_DOCS)) & (F.col("lo") < F.col("hi"))).select("key"), "many")
    of_many = settle(near.join(many, "key").select("key", "uid", "number"), "of-many")
    docs_of = of_many.select("key", "uid").distinct().groupBy("key").agg(F.count("*").alias("docs"))
    docs_of = settle(docs_of.filter(F.col("docs") >= max(min_docs, SHORT_TEMPLATE_DOCS)).select("key"), "near-recurring")
    dropped = dropped.unionByName(of_many.join(docs_of, "key").select("uid", "number"))

    template_docs = max(min_docs, TEMPLATE_DOCS)
    # a document has a leaf once here; rows that repeat count as documents of their own, so none is pruned wrongly
    leaves = spelled.filter("leaf is not null").groupBy("leaf").agg(F.count("*").alias("n"))
    leaves = settle(leaves.filter(F.col("n") >= template_docs).select("leaf"), "leaves")
    slots = {r[0] for r in leaves.select(F.pmod("leaf", F.lit(SLOTS))).distinct().collect()}  # SLOTS at most
    mask = bytearray(SLOTS // 8)
    for slot in slots:
        mask[slot >> 3] |= 1 << (slot & 7)
    mask = bytes(mask)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for number, line in enumerate((text or "").split("\n")):
                    words = masked(line)
                    if len(words) < MIN_WORDS:
                        continue
                    leaf = leaf_of(words)
                    slot = leaf % SLOTS
                    if mask[slot >> 3] >> (slot & 7) & 1:
                        constant = places(words, leaf)
                        if len(constant) >= MIN_EQUAL:
                            found.append((uid, number, leaf, _signed(f"{leaf} {' '.join(words)}"), constant))
            columns = list(zip(*found)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ["uid", "number", "leaf", "line", "places"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    met = rows.select("uid", "text").mapInArrow(lines, "uid long, number int, leaf long, line long, places array<long>")
    met = settle(met.join(leaves, "leaf").drop("leaf"), "lines")
    dropped = dropped.unionByName(_in_templates(met, template_docs, similarity))
    return dropped.groupBy("uid").agg(F.collect_set("number").alias("numbers"))


def without_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text (without the dropped lines), kept_sha256.

    A line ends at a line feed. Lines with the same :func:`equal_form` recur from ``min_docs`` distinct documents on,
    those with fewer than MIN_WORDS words from SHORT_DOCS on, templates from TEMPLATE_DOCS on, and those of lines of four
    or five words from SHORT_TEMPLATE_DOCS on (or ``min_docs``, if that is more); lines without a word stay. What recurs is dropped in every document, so copies of a document leave
    nothing of each other: they are better deduplicated before. A null text stays null, has no line and the digest of an empty one. Rows with equal id and
    text count as one document. Other columns are not looked at; an empty table gives an empty result.
    """
    dropped = recurring_lines(docs, min_docs, similarity)
    joined = _identified(docs).join(dropped, "uid", "left").select("doc_id", "text", "numbers")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            totals, gone, texts = [], [], []
            for text, numbers in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = text.split("\n") if text is not None else []
                out = set(numbers or ())
                totals.append(len(parts))
                gone.append(len(out))
                texts.append(text if not out else "\n".join(p for n, p in enumerate(parts) if n not in out))
            arrays = [batch.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_lines", "n_dropped", "text"])

    out = joined.mapInArrow(task, "doc_id long, n_lines long, n_dropped long, text string")
    return out.withColumn("kept_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
