"""SentencePiece encoding and decoding for merge-type models, exact and without merging the text.

A text's encoding is the only split into pieces in which every adjacent pair is *compatible*: undoing the merges of
both pieces in time order shows no moment at which the two parts next to the border would have merged. So a text is
covered by longest pieces, found by Aho-Corasick, with the next shorter piece where a pair is incompatible and a
step back where none is left; a bit per position remembers positions from which the text cannot be covered.

No piece of such a model has a space mark after its first letter, except pieces of marks alone, which merge after
all others. So the parts between spaces are encoded on their own and remembered, and runs of spaces apart; signs that
no piece has after a letter part the text likewise.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import slices

MARK = "▁"
#: Parts whose ids a task remembers, and compatible pairs.
MOST_PARTS, MOST_PAIRS = 400_000, 400_000


def read_model(path: str) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and kinds (1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte) of a model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    norm = model.normalizer_spec
    if (
        model.trainer_spec.model_type != 2
        or norm.precompiled_charsmap
        or norm.remove_extra_whitespaces
        or not norm.add_dummy_prefix
        or not norm.escape_whitespaces
        or model.trainer_spec.treat_whitespace_as_suffix
        or not model.trainer_spec.byte_fallback
    ):
        raise ValueError("only merge-type models with byte fallback and no normalisation are encoded")
    pieces = model.pieces
    return [p.piece for p in pieces], [p.score for p in pieces], [p.type for p in pieces]


class Parts(dict):
    """Ids of a part, each after a space, remembered. Each is decoded as well; ``odd`` holds what differs from the part."""

    def __init__(self, codec: Codec):
        self.codec, self.odd = codec, {}

    def __missing__(self, part: str) -> str:
        ids = self.codec.ids(part)
        found = " " + " ".join(map(str, ids))
        if (decoded := self.codec.raw(ids)) != part.replace(MARK, " "):
            self.odd[part] = decoded
        self[part] = found
        return found

    def trim(self) -> None:
        if len(self) > MOST_PARTS:
            self.clear()
            self.odd.clear()


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], end_id: int = 2):
        if any(kind in (4, 5) for kind in kinds):
            raise ValueError("models with user-defined or unused pieces are not encoded")
        self.pieces, self.end_id = pieces, end_id
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i, k in enumerate(kinds) if k in (2, 3)}
        normal = [i for i, k in enumerate(kinds) if k == 1]
        letters = [i for i in normal if len(pieces[i]) == 1]
        merged = [i for i in normal if len(pieces[i]) > 1 and pieces[i].strip(MARK)]
        if any(MARK in pieces[i][1:] for i in merged):
            raise ValueError("a piece has a space inside")
        merged.sort(key=lambda i: -scores[i])
        if any(scores[a] == scores[b] for a, b in zip(merged, merged[1:])):
            raise ValueError("scores of pieces are not distinct")
        self.run_score = {len(pieces[i]): scores[i] for i in normal if not pieces[i].strip(MARK)}
        self.run_id = {len(pieces[i]): i for i in normal if not pieces[i].strip(MARK)}
        if merged and max([-1e30, *(s for n, s in self.run_score.items() if n > 1)]) >= scores[merged[-1]]:
            raise ValueError("runs of spaces merge before other pieces")

        # from here on a piece is its place in the order of merging; letters come first
        order = letters + merged
        self.id_of = order
        self.text = [pieces[i] for i in order]
        self.rank = {text: r for r, text in enumerate(self.text)}
        self.letters = len(letters)
        self.alphabet = frozenset(self.text[: self.letters])
        self.split = self._splits()
        self.automaton = ahocorasick.Automaton()
        for r, text in enumerate(self.text):
            if self.split[r]:
                self.automaton.add_word(text, (r, len(text) - 1))
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.text]
        self.shorter = self._shorter()
        self.pairs: list[dict[int, bool]] = [{} for _ in order]
        self.held_pairs = 0
        self.plain = [None if i in self.byte_of or i in self.silent else p.replace(MARK, " ") for i, p in enumerate(pieces)]
        self.parts = Parts(self)
        self.find_parts = self._part_pattern().findall
        self.mark = self.rank[MARK]

    def _part_pattern(self) -> re.Pattern:
        """Parts that no merge joins: cut before space marks, around line ends, and before a sign after a letter.

        Signs are the ASCII characters that no piece has after a Latin letter or digit: there is always a border there.
        """
        letter = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
        signs = {chr(c) for c in range(33, 127) if not chr(c).isalnum()}
        signs -= {b for t in self.text for a, b in zip(t, t[1:]) if re.match(letter, a)}
        z = re.escape("".join(sorted(signs)))
        any_ = f"[^{MARK}\n]"
        cut = f"{MARK}?[^{MARK}\n{z}]+(?<={letter})(?=[{z}])|" if signs else ""
        return re.compile(f"{cut}{MARK}?{any_}+|{MARK}+(?={MARK}{any_})|{MARK}+|\n")

    def _splits(self) -> list[tuple[int, int] | None]:
        """The last merge of each piece; None for pieces that merging never reaches. Letters have themselves."""
        split: list[tuple[int, int] | None] = []
        for r, text in enumerate(self.text):
            if r < self.letters:
                split.append((r, r))
                continue
            parts = [self.rank.get(c, -1) for c in text]
            last = None
            while len(parts) > 1 and min(parts) >= 0:
                found = [(self.rank.get(self.text[a] + self.text[b], 1 << 30), n) for n, (a, b) in enumerate(zip(parts, parts[1:]))]
                best, at = min(found)
                if best == 1 << 30:
                    break
                last = (parts[at], parts[at + 1])
                parts[at : at + 2] = [best]
            split.append(last if parts == [r] else None)
        return split

    def _shorter(self) -> list[int]:
        """The longest reachable piece that is a proper prefix of each piece, -1 where there is none."""
        out = []
        for text in self.text:
            found = (self.rank.get(text[:n], -1) for n in range(len(text) - 1, 0, -1))
            out.append(next((r for r in found if r >= 0 and self.split[r]), -1))
        return out

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the border between a and b outlives all merges: undo the later one, look for a merge across."""
        rank, text, split, letters = self.rank, self.text, self.split, self.letters
        until = 1 << 30
        while True:
            if rank.get(text[a] + text[b], until) < until:
                return False
            if a > b:
                if a < letters:
                    return True
                until, a = a, split[a][1]
            else:
                if b < letters:
                    return True
                # of equal merges the left one comes first, so a border merge as early as b's own is made
                until, b = b + 1, split[b][0]

    def _cover(self, part: str) -> list[int]:
        """Pieces of a part all of whose letters are pieces."""
        size, length, pairs = len(part), self.length, self.pairs
        longest = [-1] * size
        for end, (r, n) in self.automaton.iter(part):
            longest[end - n] = r  # matches of one start come in order of length
        failed = 0
        piece = longest[0]
        pieces = [piece]
        at = length[piece]
        if at == size:
            return pieces
        last, piece = piece, longest[at]
        while True:
            while piece >= 0:
                to = at + length[piece]
                if not failed >> to & 1:
                    known = pairs[last]
                    fits = known.get(piece)
                    if fits is None:
                        fits = known[piece] = self._compatible(last, piece)
                        self.held_pairs += 1
                    if fits:
                        break
                piece = self.shorter[piece]
            if piece >= 0:
                pieces.append(piece)
                if to == size:
                    return pieces
                at, last = to, piece
                piece = longest[at]
                continue
            # the text from here on cannot be covered after what stands before: shorten the piece before
            failed |= 1 << at
            piece = pieces.pop()
            at -= length[piece]
            piece = self.shorter[piece]
            if pieces:
                last = pieces[-1]
            else:  # the first piece has no pair to fit
                while failed >> length[piece] & 1:
                    piece = self.shorter[piece]
                pieces = [piece]
                at = length[piece]
                last, piece = piece, longest[at]

    def ids(self, part: str) -> list[int]:
        """Ids of a run of spaces, or of a part without spaces inside; letters that are no piece become bytes."""
        if self.held_pairs > MOST_PAIRS:
            self.pairs = [{} for _ in self.pairs]
            self.held_pairs = 0
        if not part.strip(MARK):
            return self._spaces(len(part))
        if self.alphabet.issuperset(part):
            return list(map(self.id_of.__getitem__, self._cover(part)))
        ids: list[int] = []
        start = 0
        for at, letter in enumerate(part):
            if letter not in self.alphabet:
                if start < at:
                    ids += map(self.id_of.__getitem__, self._cover(part[start:at]))
                ids += map(self.byte_id.__getitem__, letter.encode())
                start = at + 1
        if start < len(part):
            ids += map(self.id_of.__getitem__, self._cover(part[start:]))
        return ids

    def _spaces(self, n: int) -> list[int]:
        """Ids of a run of n space marks. Their pieces can have equal scores: the left one merges first."""
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        size = [1] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else n
            if a >= 0 and b < n and size[a] + size[b] in self.run_score:
                heapq.heappush(heap, (-self.run_score[size[a] + size[b]], a, size[a], size[b]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, was, then = heapq.heappop(heap)
            b = after[a]
            if size[a] != was or b >= n or size[b] != then:
                continue
            size[a], size[b] = was + then, 0
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(before[a])
            offer(a)
        return [self.run_id[s] for s in size if s]

    def _join(self, parts: list[str]) -> list[str]:
        """Runs of spaces before a part whose own mark merges with none of its letters take that mark in."""
        out: list[str] = []
        alone = f" {self.id_of[self.mark]}"
        for part in parts:
            if out and part != MARK * len(part) and part[0] == MARK and out[-1] == MARK * len(out[-1]):
                ids = self.parts[part]
                if ids == alone or ids.startswith(alone + " "):
                    out[-1] += MARK
                    part = part[1:]
            out.append(part)
        return out

    def encoded(self, text: str) -> tuple[str, int, str]:
        """Ids with the end id, joined by spaces; their number; the text that they decode to."""
        if not text:
            return str(self.end_id), 1, ""
        marked = MARK + text.replace(" ", MARK)
        parts = self.find_parts(marked)
        if MARK + MARK in marked or MARK + "\n" in marked:
            parts = self._join(parts)
        self.parts.trim()
        joined = "".join(map(self.parts.__getitem__, parts))[1:]
        odd = self.parts.odd
        decoded = "".join([odd.get(p, p) for p in parts]) if odd else marked
        return f"{joined} {self.end_id}", joined.count(" ") + 2, decoded.replace(MARK, " ")[1:]

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.encoded(text)[0].split(" ")))

    def raw(self, ids: list[int]) -> str:
        """What ids stand for, spaces as spaces; runs of bytes that are no UTF-8 give one U+FFFD for each bad byte."""
        try:
            return "".join(map(self.plain.__getitem__, ids))
        except TypeError:  # bytes or pieces that are not text among them
            pass
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_from_bytes(bytes(held)))
                held.clear()
            if i not in self.silent:
                out.append(self.pieces[i])
            elif self.pieces[i] == "<unk>":
                out.append(" ⁇ ")
        if held:
            out.append(_from_bytes(bytes(held)))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: without the space that encoding puts before it, which is never one from a byte."""
        raw = self.raw(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return raw[1:] if raw.startswith(" ") and first not in self.byte_of else raw


def _from_bytes(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file; a worker process builds it once."""
    if path not in _codecs:
        _codecs[path] = Codec(*read_model(path))
        gc.freeze()  # its many small objects stay: the collector need not look at them again and again
    return _codecs[path]


def encode_documents(docs: DataFrame, model: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256; if asked for also ids, and decoded.

    ``model`` is a model file that every executor has under this path, or one added by ``SparkContext.addFile``,
    named ``files:<name>``. A null text is an empty one and has the end id only. Rows that repeat stay; other columns
    are not looked at; an empty table gives an empty result. What a task remembers is bounded, and a text is
    encoded in memory that grows with its own length alone.
    """
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        kinds.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    if with_text:
        kinds.append(("decoded", pa.string()))
        ddl += ", decoded string"
    schema = pa.schema(kinds)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(model[6:]) if model.startswith("files:") else model)
        sha = hashlib.sha256
        for batch in slices(batches):
            numbers, ids_digests, digests, lists, texts = [], [], [], [], []
            for text in batch.column(1):
                ids, n, decoded = own.encoded(text.as_py() or "")
                numbers.append(n)
                ids_digests.append(sha(ids.encode()).hexdigest())
                digests.append(sha(decoded.encode()).hexdigest())
                if with_ids:
                    lists.append(np.fromstring(ids, np.int32, sep=" "))
                if with_text:
                    texts.append(decoded)
            arrays = [batch.column(0), pa.array(numbers, pa.int64()), pa.array(ids_digests), pa.array(digests)]
            if with_ids:
                offsets = np.cumsum([0, *map(len, lists)])
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lists))))
            if with_text:
                arrays.append(pa.array(texts))
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, ddl)
