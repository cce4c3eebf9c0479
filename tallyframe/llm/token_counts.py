"""Token counts that follow edits.

A document's pre-tokens lie in blocks, and a segment tree over the blocks holds sums of characters and tokens. An
edit finds its place by descending the tree, re-encodes the pre-tokens that it touches and two before them, goes on
until a new pre-token begins where an old one began, and updates the sums above the blocks that changed. The rest of
the document is not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of a block, and pre-tokens whose counts a task remembers.
BLOCK = 64
MOST_PIECES = 400_000
#: Pre-tokens before an edit that can change with it: the pattern looks two characters ahead at most.
CONTEXT = 2

Edit = tuple[int, int, str]  # place, characters removed there, text put there


class Counter(dict):
    """Tokens of a pre-token, remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) >= MOST_PIECES:
            self.clear()
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n


class TokenTree:
    """The pre-tokens of one text as (characters, tokens), in blocks under a tree of sums."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        pieces = counter.pattern.findall(text)
        leaves = list(zip(map(len, pieces), map(counter.__getitem__, pieces)))
        self.blocks = [leaves[at : at + BLOCK] for at in range(0, len(leaves), BLOCK)] or [[]]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for n, block in enumerate(self.blocks, self.size):
            self.chars[n], self.tokens[n] = sum([c for c, _ in block]), sum([t for _, t in block])
        for n in range(self.size - 1, 0, -1):
            self.chars[n] = self.chars[2 * n] + self.chars[2 * n + 1]
            self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]
        self.encoded = 0

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _update(self, block: int) -> None:
        n = block + self.size
        held = self.blocks[block]
        self.chars[n], self.tokens[n] = sum([c for c, _ in held]), sum([t for _, t in held])
        while n > 1:
            n //= 2
            self.chars[n] = self.chars[2 * n] + self.chars[2 * n + 1]
            self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]

    def _find(self, place: int) -> tuple[int, int, int]:
        """Block and number of the pre-token that holds a place, and where it begins; the last one for the end."""
        n, begin = 1, 0
        while n < self.size:
            n *= 2
            if place - begin >= self.chars[n] and self.chars[n + 1]:
                begin += self.chars[n]
                n += 1
        block = n - self.size
        for number, (chars, _) in enumerate(self.blocks[block]):
            if place < begin + chars or number == len(self.blocks[block]) - 1:
                return block, number, begin
            begin += chars
        return block, 0, begin

    def _back(self, block: int, number: int, begin: int) -> tuple[int, int, int]:
        """CONTEXT pre-tokens further to the front."""
        for _ in range(CONTEXT):
            while number == 0:
                if block == 0:
                    return block, number, begin
                block -= 1
                number = len(self.blocks[block])
            number -= 1
            begin -= self.blocks[block][number][0]
        return block, number, begin

    def edit(self, place: int, removed: int, added: str) -> None:
        """Replace ``removed`` characters at ``place`` by ``added``; both are cut to the text."""
        place = min(max(place, 0), len(self.text))
        removed = min(max(removed, 0), len(self.text) - place)
        if not removed and not added:
            return
        first, number, begin = self._back(*self._find(place))
        text = self.text[:place] + added + self.text[place + removed :]
        shift = len(added) - removed
        # old pre-tokens from the first that is made anew: where they end
        block, at, old = first, number, begin
        new: list[tuple[int, int]] = []
        matches = self.counter.pattern.finditer(text, begin)
        position = begin
        while True:
            # pre-tokens that begin at or after the edit's end, where the old ones began, are as they were
            while old + shift < position or old < place + removed:
                if at >= len(self.blocks[block]):
                    if block + 1 >= len(self.blocks):
                        break
                    block, at = block + 1, 0
                    continue
                old += self.blocks[block][at][0]
                at += 1
            if position >= place + len(added) and old + shift == position and old >= place + removed:
                break
            match = next(matches, None)
            if match is None:
                break
            piece = match.group()
            new.append((len(piece), self.counter[piece]))
            position = match.end()
        self.encoded += len(new)
        self.text = text
        tail = self.blocks[block][at:]
        if block == first:
            self.blocks[first][number:] = [*new, *tail]
        else:
            self.blocks[first][number:] = new
            for between in range(first + 1, block):
                self.blocks[between] = []
                self._update(between)
            self.blocks[block] = tail
            self._update(block)
        self._update(first)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    """The counter of a vocabulary file; a worker process reads it once."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(read_ranks(SparkFiles.get(path[6:]) if path.startswith("files:") else path), pattern)
    return _counters[path, pattern]


def count_with_edits(docs: DataFrame, edits: Column, path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_pieces, edited_tokens, encoded_pieces, edited_chars.

    ``edits`` is an array of structs (place, removed, added), made one after the other, each on the result of the one
    before; places and lengths in characters, cut to the text. ``encoded_pieces`` is how many pre-tokens all edits
    re-encoded. A null text is an empty one, null edits are none, a null within an edit is 0 or empty. Rows that
    repeat stay; other columns are looked at by ``edits`` alone; an empty table gives an empty result.
    """
    names = ["doc_id", "n_tokens", "n_pieces", "edited_tokens", "encoded_pieces", "edited_chars"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in batches:
            rows = []
            for text, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tree = TokenTree(text or "", own)
                before, pieces = tree.total, sum(map(len, tree.blocks))
                for change in changes or ():
                    tree.edit(change["place"] or 0, change["removed"] or 0, change["added"] or "")
                rows.append((before, pieces, tree.total, tree.encoded, len(tree.text)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), edits.alias("edits"))
    return rows.mapInArrow(task, ", ".join(f"{n} long" for n in names))


def revision() -> Column:
    """Three edits of each document: its source's name goes in at a third, its first half-line is removed, its language
    is put in the place of eight characters at two thirds."""
    n = F.length("text")

    def edit(place: Column, removed: Column, added: Column) -> Column:
        return F.struct(place.cast("long").alias("place"), removed.cast("long").alias("removed"), added.alias("added"))

    half_line = F.length(F.substring_index("text", "\n", 1)) / 2
    return F.array(
        edit(n / 3, F.lit(0), F.concat(F.lit(" "), F.coalesce("source", F.lit("")))),
        edit(F.lit(0), F.floor(half_line), F.lit("")),
        edit(n * 2 / 3, F.lit(8), F.coalesce(F.col("lang"), F.lit(""))),
    )
