"""Byte-level BPE as a streaming transducer with a lookahead computed from the merge list.

A text reaches the encoder in chunks. Tokens leave it as soon as nothing that may still
follow can change them:

* the pre-tokenizer puts a boundary before every space that no white space follows, so all
  complete *units* (a word with the space before it) are final, whatever comes next;
* inside one pre-token longer than a window, a token is final once the window reaches
  `lookahead` bytes beyond it. `sufficient_lookahead` derives that number from the merges.

Pending state is one unit, or one window of a long pre-token. Units recur, so their ids are
kept in a bounded dictionary; the units of a chunk that it lacks are merged together with
numpy, one merge of every word per round.
"""

from __future__ import annotations

import codecs
import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

CHUNK_CHARS = 1 << 18
GROUP_CHARS = 1 << 20
UNIT_CHARS = 200
WINDOW_BYTES = 4096
CACHE_UNITS = 450_000
SLICE_BYTES = 4 << 20
DECODE_ROWS = 256
DECODE_IDS = 1 << 16
NO_RANK = np.int32(2**31 - 1)

# The white space of the pre-tokenizer's \s.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
# Marks that end a word: a run of them is one pre-token.
MARKS = ".,;:!?"
CUT = re.compile(f" (?=[^{SPACES}])")
SPACED = re.compile(f" (?:[{SPACES}]|\\Z)")


def _char_class(kind: str) -> str:
    """The characters of a Unicode general category as the inside of a character class."""
    out, start = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code))[0] == kind
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


def pre_token_pattern() -> re.Pattern:
    letter, number = _char_class("L"), _char_class("N")
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACES}{letter}{number}]+"
        rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    )


def byte_chars() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: list[int], left: dict[int, int]) -> int:
    """How many bytes right of a token can matter to it.

    merges: (left id, right id, new id) in rank order; left: the left part of each merged id.
    What follows a window can change it only through merges across the frontier between
    known and unknown. Merge i moves the frontier left by its left part. A later merge j moves
    it on only if it takes, as its right part, a token that begins with that left part, that
    is, one that has it on its left spine. The longest such chain, in bytes, is the answer.
    """
    furthest: dict[int, int] = {}
    most = 0
    for a, b, _ in reversed(merges):
        reach = length[a] + furthest.get(a, 0)
        most = max(most, reach)
        while True:
            if furthest.get(b, 0) < reach:
                furthest[b] = reach
            if b not in left:
                break
            b = left[b]
    return most


class MergeTable:
    """The merge list as arrays: rank of a pair by open addressing, id a merge makes, bytes of an id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = byte_chars()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int32)
        for i, token in enumerate(self.token_bytes):
            if len(token) == 1:
                self.byte_id[token[0]] = i
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.merged = np.array([m[2] for m in merges], np.int32)
        self.lookahead = sufficient_lookahead(
            merges, [len(t) for t in self.token_bytes], {new: a for a, _, new in merges}
        )
        keys = np.array([(a << 20) | b for a, b, _ in merges], np.int64)
        self.bits = max(12, int(len(keys)).bit_length() + 2)
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        mask = (1 << self.bits) - 1
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.slots[slot] != -1:
                slot = (slot + 1) & mask
            self.slots[slot], self.ranks[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 20) | b
        slot = self._slot(keys)
        found = self.slots[slot]
        out = np.where(found == keys, self.ranks[slot], NO_RANK)
        at = np.flatnonzero((found != keys) & (found != -1))
        slot = slot[at]
        while at.size:
            slot = (slot + 1) & (self.slots.size - 1)
            found = self.slots[slot]
            hit = found == keys[at]
            out[at[hit]] = self.ranks[slot[hit]]
            go = ~hit & (found != -1)
            at, slot = at[go], slot[go]
        return out

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each non-empty byte string as little-endian bytes, all merged side by side."""
        out: list[bytes] = [b""] * len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        tokens = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        which = np.arange(len(words))
        last = np.zeros(tokens.size, bool)
        last[np.cumsum(length) - 1] = True
        rank = np.full(tokens.size, NO_RANK, np.int32)
        inner = np.flatnonzero(~last)
        rank[inner] = self.rank(tokens[inner], tokens[inner + 1])
        while which.size:
            starts = np.cumsum(length) - length
            least = np.minimum.reduceat(rank, starts)
            done = least == NO_RANK
            if done.any():
                ids = tokens.astype("<i4").tobytes()
                for i, s, n in zip(which[done].tolist(), (starts[done] * 4).tolist(), (length[done] * 4).tolist()):
                    out[i] = ids[s : s + n]
                keep = ~done
                inside = np.repeat(keep, length)
                tokens, rank, last = tokens[inside], rank[inside], last[inside]
                length, which, least = length[keep], which[keep], least[keep]
                if not which.size:
                    break
                starts = np.cumsum(length) - length
            hits = np.flatnonzero(rank == np.repeat(least, length))
            # A pair of equal tokens may overlap itself: of each run take the 1st, 3rd, 5th ...
            follows = np.zeros(hits.size, bool)
            follows[1:] = hits[1:] == hits[:-1] + 1
            if follows.any():
                order = np.arange(hits.size)
                run = np.maximum.accumulate(np.where(follows, 0, order))
                hits = hits[(order - run) % 2 == 0]
            tokens[hits] = self.merged[rank[hits]]
            last[hits] = last[hits + 1]
            stay = np.ones(tokens.size, bool)
            stay[hits + 1] = False
            length = np.add.reduceat(stay, starts, dtype=np.int64)
            tokens, rank, last = tokens[stay], rank[stay], last[stay]
            made = hits - np.arange(hits.size)
            # Only pairs that hold a new token have a new rank.
            pairs = np.concatenate([made, made[made > 0] - 1])
            real = ~last[pairs]
            rank[pairs] = NO_RANK
            pairs = pairs[real]
            rank[pairs] = self.rank(tokens[pairs], tokens[pairs + 1])
        return out


class Encoder:
    """Text chunks in, ids out; holds one unfinished unit and a bounded dictionary of units."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS, window: int = WINDOW_BYTES):
        self.table = MergeTable(path)
        self.pattern = pre_token_pattern()
        # Two generations: units of the older one that still occur move to the younger.
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.cache_units = cache_units
        self.long_chars = 0
        self.window = max(window, 2 * self.table.lookahead)
        self.special_ids = self.table.special
        self.special = re.compile("(" + "|".join(map(re.escape, self.special_ids)) + ")") if self.special_ids else None

    def chunks(self, text: str) -> Iterator[list[str]]:
        """Lists of complete units; each list begins where a chunk of about CHUNK_CHARS does."""
        at, end = 0, len(text)
        while end - at > CHUNK_CHARS:
            cut = text.rfind(" ", at + 1, at + CHUNK_CHARS)
            while cut > at and text[cut + 1] in SPACES:
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:
                cut = text.find(" ", at + CHUNK_CHARS)
                while 0 <= cut < end - 1 and text[cut + 1] in SPACES:
                    cut = text.find(" ", cut + 1)
                if cut < 0 or cut >= end - 1:
                    break
            yield self.units(text[at:cut])
            at = cut
        yield self.units(text[at:])

    @staticmethod
    def units(chunk: str) -> list[str]:
        """The chunk cut before every space that something else than white space follows."""
        if "\0" not in chunk and not SPACED.search(chunk):
            return chunk.replace(" ", "\0 ").split("\0")
        parts = CUT.split(chunk)
        return [parts[0], *[" " + p for p in parts[1:]]]

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of `text` as little-endian 32-bit blocks; special strings become their ids."""
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                yield np.int32(self.special_ids[part]).tobytes()
            else:
                for units in self.chunks(part):
                    yield from self._flush([self._known(units)])

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as one block; the new units of neighbouring texts are learnt together."""
        group: list[tuple[list[str], list[bytes | None], list[int]]] = []
        chars = 0
        for text in texts:
            if len(text) <= CHUNK_CHARS and not (self.special and self.special.search(text)):
                group.append(self._known(self.units(text)))
                chars += len(text)
                if chars < GROUP_CHARS:
                    continue
                yield from self._flush(group)
            else:
                yield from self._flush(group)
                yield b"".join(self.encode(text))
            group, chars = [], 0
        yield from self._flush(group)

    def _known(self, units: list[str]) -> tuple[list[str], list[bytes | None], list[int]]:
        """(units, their ids as far as the dictionary has them, the places of those that it lacks)."""
        ids = list(map(self.cache.get, units))
        return units, ids, [k for k, known in enumerate(ids) if known is None]

    def _flush(self, group: list[tuple[list[str], list[bytes | None], list[int]]]) -> Iterator[bytes]:
        """Ids of each list of units, after those that the dictionary lacks are learnt."""
        self.learn({units[k] for units, _, missing in group for k in missing})
        for units, ids, missing in group:
            for k in missing:
                ids[k] = self.cache[units[k]]
            long = self.long_chars and any(len(units[k]) > UNIT_CHARS for k in missing)
            yield b"".join(self._streamed(units, ids)) if long else b"".join(ids)

    def learn(self, unseen: set[str]) -> None:
        """Put every unit into the dictionary; one too long to keep maps to None."""
        if len(self.cache) > self.cache_units or self.long_chars > CHUNK_CHARS:
            self.older, self.cache, self.long_chars = self.cache, {"": b""}, 0
        cache, older, split, words = self.cache, self.older, {}, set()
        for unit in unseen:
            if (known := older.get(unit)) is not None:
                cache[unit] = known
            elif len(unit) > UNIT_CHARS:
                cache[unit] = None
                self.long_chars += len(unit)
            else:
                stem = unit[1:].rstrip(MARKS) if unit[0] == " " else ""
                if not stem.isalpha():
                    split[unit] = self.pattern.findall(unit)
                elif len(stem) + 1 < len(unit):
                    # Letters after a space, then marks: two pre-tokens.
                    split[unit] = [unit[: len(stem) + 1], unit[len(stem) + 1 :]]
                else:
                    words.add(unit)
        new = [w for w in words.union(*split.values()) if w not in cache]
        if new:
            cache.update(zip(new, self.table.merge_words([w.encode() for w in new])))
        for unit, parts in split.items():
            cache[unit] = b"".join([cache[w] for w in parts])

    def _streamed(self, units: list[str], ids: list[bytes | None]) -> Iterator[bytes]:
        for unit, known in zip(units, ids):
            if known is None:
                for match in self.pattern.finditer(unit):
                    yield from self.stream_word([match[0].encode()])
            else:
                yield known

    def stream_word(self, pieces: Iterable[bytes]) -> Iterator[bytes]:
        """Ids of one pre-token that arrives in pieces, with one window in memory."""
        pending = b""
        for piece in pieces:
            for at in range(0, len(piece), self.window):
                pending += piece[at : at + self.window]
                if len(pending) < 2 * self.window:
                    continue
                ids = np.frombuffer(self.table.merge_words([pending])[0], "<i4")
                ends = np.cumsum([len(self.table.token_bytes[i]) for i in ids.tolist()])
                stable = int(np.searchsorted(ends, len(pending) - self.table.lookahead, "right"))
                if stable:
                    yield ids[:stable].tobytes()
                    pending = pending[int(ends[stable - 1]) :]
        if pending:
            yield self.table.merge_words([pending])[0]


class Decoder:
    """Ids in, text out: bytes of unfinished characters wait for the next block of ids."""

    def __init__(self, path: str | None = None, table: MergeTable | None = None):
        self.token_bytes = (table or MergeTable(path)).token_bytes

    def decode(self, blocks: Iterable[list[int]]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for block in blocks:
            yield machine.decode(b"".join([self.token_bytes[i] for i in block]))
        yield machine.decode(b"", True)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file; kept from task to task."""
    return Encoder(path)


@functools.lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def id_lists(blocks: Iterable[bytes]) -> pa.Array:
    """Blocks of little-endian ids as an Arrow list array, without a Python object per id."""
    blocks = list(blocks)
    ends = np.cumsum([0, *map(len, blocks)]) // 4
    flat = np.frombuffer(b"".join(blocks), "<i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` holds about `most` bytes in each, one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            before = at[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(at, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with an array column `ids`: the tokens of the whole text.

    Null text counts as empty and gives an empty array. All other columns pass through, a
    column that is already called `ids` is replaced. No shuffle; tasks hold one slice of texts.
    """
    docs = docs.drop(ids)
    schema = StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, id_lists(enc.encode_all(texts))], [*batch.schema.names, ids]
            )

    return docs.mapInArrow(run, schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`frame` with a string column made from its token arrays; null arrays give empty text."""
    frame = frame.drop(text)
    schema = StructType([*frame.schema.fields, StructField(text, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = decoder(path)
        for whole in batches:
            for start in range(0, whole.num_rows, DECODE_ROWS):
                batch = whole.slice(start, DECODE_ROWS)
                out = []
                for row in batch.column(ids):
                    values = row.values
                    n = 0 if values is None else len(values)
                    blocks = (values.slice(i, DECODE_IDS).to_pylist() for i in range(0, n, DECODE_IDS))
                    out.append("".join(dec.decode(blocks)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text]
                )

    return frame.mapInArrow(run, schema)
