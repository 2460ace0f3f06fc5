"""Collocations: frequent phrases ranked by how much they stick together, from Rabin-Karp fingerprints.

Texts are joined to units of a few megabytes. Prefix polynomials over a unit's bytes give a hash of
every word at once, and prefix polynomials over these give a fingerprint of every run of n words.
Phrases grow word by word: a task counts a run only if the two shorter runs inside it may be frequent
themselves, and the shuffle adds up one number per fingerprint and task. What may be frequent is told
by a bitmap of fixed size, set from the fingerprints counted before; it may let too much pass, never
too little.

Counts by fingerprint only choose. The last scan gathers the chosen runs by fingerprint, holds every
occurrence against the text of the first one in its unit (a pointer into the unit), parts those that
differ, and hands on text, count and the document of each; text against text, these are added up.
Texts of runs that are not chosen are never made. A phrase leaves each task that holds it once, so few
tasks, one per core while none has to take more than MERGED_PARTITIONS partitions, do this scan.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from claimcheck.llm.byte_bpe import slices
from claimcheck.llm.shared import written

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
# A longer phrase that holds this many of 100 occurrences of a shorter one replaces it.
COVERED = 100
UNKNOWN = "und"
UNIT_BYTES = 4 << 20
BLOCK_BYTES = 1 << 18
HELD_KEYS = 1_000_000
HELD_PHRASES = 400_000
# Partitions that one task of the last scan takes at most, to add up phrases before they are shuffled.
MERGED_PARTITIONS = 16
COMPARED = 1 << 18
NO_ID = np.iinfo(np.int64).max
# Size of the bitmaps: 2 to this many bits, whatever the input.
FILTER_BITS = 24

# What parts pieces, what parts words, what is lower-cased.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(PIECE_ENDS)] = 2

BYTE_BASE, WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@functools.lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base and its inverse modulo 2**64 to the powers 0 to n - 1."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(int(base), 1 << max(n, 1 << 12).bit_length())
    return up[:n], down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all others."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """The polynomials of values[start:end], from one prefix sum; equal runs have equal hashes wherever they begin."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


@dataclass
class Unit:
    """Texts joined: per word its hash, piece, language seed and its place in `text`, where words are followed by a space."""

    text: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    pieces: np.ndarray
    seeds: np.ndarray
    first_words: np.ndarray

    def keys(self, n: int, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, whether the run lies in one piece) of every run of n words."""
        count = max(len(self.hashes) - n + 1, 0)
        at = np.arange(count)
        grams = run_hashes(self.hashes, at, at + n, WORD_BASE)
        keys = mixed(grams ^ self.seeds[:count] + np.uint64(n)) & mask
        return keys, self.pieces[:count] == self.pieces[n - 1 :]

    def documents(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first_words, words, "right") - 1


def unit(texts: list[bytes], seeds: list[int]) -> Unit:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kept, lengths, hashes, pieces, places = [], [], [], [], []
    piece = at = 0
    while at < len(data):
        end = min(at + BLOCK_BYTES, len(data))
        while end < len(data) and not KIND[data[end - 1]]:
            # A block ends after a byte between words.
            gap = np.flatnonzero(KIND[data[end : end + BLOCK_BYTES]])
            end = end + int(gap[0]) + 1 if len(gap) else min(end + BLOCK_BYTES, len(data))
        kind, block = KIND[data[at:end]], LOWER[data[at:end]]
        inside = np.zeros(len(kind) + 1, bool)
        inside[1:] = kind == 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        marks = np.cumsum(kind == 2, dtype=np.int32)
        hashes.append(mixed(run_hashes(block.astype(np.uint64) + np.uint64(1), starts, ends, BYTE_BASE)))
        lengths.append(ends - starts)
        pieces.append(marks[starts] + piece)
        places.append(starts + at)
        # Words and the one byte after each, which becomes a space.
        after = inside[:-1] & ~inside[1:]
        kept.append(np.where(after, np.uint8(32), block)[inside[1:] | after])
        piece += int(marks[-1])
        at = end
    sizes = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    lengths, places = np.concatenate(lengths), np.concatenate(places)
    first_words = np.searchsorted(places, sizes)
    per_text = np.diff(np.append(first_words, len(places)))
    return Unit(
        np.concatenate(kept), np.cumsum(lengths + 1) - lengths - 1, lengths, np.concatenate(hashes), np.concatenate(pieces),
        np.repeat(np.array(seeds, np.uint64), per_text), first_words,
    )


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Unit, list[str], list[int]]]:
    """(unit, languages, documents) of about UNIT_BYTES each; one document is never cut."""
    texts: list[bytes] = []
    langs: list[str] = []
    docs: list[int] = []
    size = 0
    for batch in slices(batches, "text"):
        for text, lang, doc in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist(), batch.column("doc_id").to_pylist()):
            texts.append(text)
            langs.append(lang)
            docs.append(doc)
            size += len(text) + 1
        if size >= UNIT_BYTES:
            yield unit(texts, list(map(_seed, langs))), langs, docs
            texts, langs, docs, size = [], [], [], 0
    if texts:
        yield unit(texts, list(map(_seed, langs))), langs, docs


@functools.lru_cache(maxsize=1024)
def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang)


def _holds(bits: np.ndarray, keys: np.ndarray, filter_bits: int) -> np.ndarray:
    """Whether each key's bit is set; a key may be told by its top bits alone."""
    at = keys >> np.uint64(64 - filter_bits)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def fingerprint_counts(docs: DataFrame, n: int, shorter: np.ndarray | None, mask: int, filter_bits: int) -> DataFrame:
    """(key, n) per fingerprint and task of the runs of n words whose two runs of n - 1 words `shorter` lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = _counted(*map(np.concatenate, zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

        for u, _, _ in units(batches):
            keys, whole = u.keys(n, np.uint64(mask))
            if shorter is not None:
                parts, parts_whole = u.keys(n - 1, np.uint64(mask))
                may = _holds(shorter, parts, filter_bits) & parts_whole
                whole = whole & may[:-1] & may[1:] if len(keys) else whole
            keys, counts = np.unique(keys[whole], return_counts=True)
            if not len(keys):
                continue
            held.append((keys, counts.astype(np.int64)))
            size += len(keys)
            if size >= HELD_KEYS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "key long, n long")


def bitmap(keys: DataFrame, filter_bits: int) -> np.ndarray:
    """A bit set for the top bits of every key. The driver gets 2 ** (filter_bits - 6) numbers at most."""
    place = F.shiftrightunsigned("key", 64 - filter_bits)
    bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(key, {64 - filter_bits}) & 63 AS INT))")
    words = keys.select(F.shiftrightunsigned(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()
    bits = np.zeros(1 << (filter_bits - 6), np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def _alike(u: Unit, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the runs of n words at `a` and at `b` have the same language and the same text, byte by byte."""
    size = u.starts[a + n - 1] + u.lengths[a + n - 1] - u.starts[a]
    same = (size == u.starts[b + n - 1] + u.lengths[b + n - 1] - u.starts[b]) & (u.seeds[a] == u.seeds[b])
    at = 0
    while at < len(a):
        end = min(at + COMPARED, len(a))
        some = at + np.flatnonzero(same[at:end] & (a[at:end] != b[at:end]))
        if len(some):
            sizes = size[some]
            ends = np.cumsum(sizes)
            inside = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
            differ = u.text[np.repeat(u.starts[a[some]], sizes) + inside] != u.text[np.repeat(u.starts[b[some]], sizes) + inside]
            same[some] = np.add.reduceat(differ, ends - sizes, dtype=np.int64) == 0
        at = end
    return same


def verified_runs(
    u: Unit, n: int, ids: np.ndarray, bits: np.ndarray, mask: int, filter_bits: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pointer, count, least): the first place of every chosen run of n words, how often its text occurs in the unit, and
    the least of `ids`, one per document, where it does."""
    keys, whole = u.keys(n, np.uint64(mask))
    places = np.flatnonzero(whole & _holds(bits, keys, filter_bits)) if len(keys) else np.array([], np.int64)
    places = places[np.argsort(keys[places], kind="stable")]
    while len(places):
        group = keys[places]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        pointers = np.repeat(places[first], np.diff(np.append(first, len(group))))
        same = _alike(u, n, places, pointers)
        owners = np.where(same, ids[u.documents(places)], NO_ID)
        yield places[first], np.add.reduceat(same, first, dtype=np.int64), np.minimum.reduceat(owners, first)
        # Texts that share a fingerprint with another one are gathered anew.
        places = places[~same]


PHRASES = "lang string, words int, phrase string, n long, doc_id long"


def phrase_texts(docs: DataFrame, chosen: list[np.ndarray], mask: int, filter_bits: int) -> DataFrame:
    """(lang, words, phrase, n, doc_id) per text of a chosen run and task; words = 0 counts the words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], dict[bytes, list[int]]] = {}
        size = 0
        for u, langs, docs_ in units(batches):
            ids = np.array([NO_ID if d is None else d for d in docs_], np.int64)
            per_text = np.diff(np.append(u.first_words, len(u.starts)))
            for lang, words in zip(langs, per_text.tolist()):
                held.setdefault((lang, 0), {}).setdefault(b"", [0, NO_ID])[0] += words
            raw = u.text.tobytes()
            for n, bits in enumerate(chosen, 1):
                of_lang = {lang: held.setdefault((lang, n), {}) for lang in set(langs)}
                for pointers, counts, least in verified_runs(u, n, ids, bits, mask, filter_bits):
                    ends = u.starts[pointers + n - 1] + u.lengths[pointers + n - 1]
                    found = zip(*(x.tolist() for x in (u.documents(pointers), u.starts[pointers], ends, counts, least)))
                    for doc, start, end, count, owner in found:
                        phrases, text = of_lang[langs[doc]], raw[start:end]
                        if (entry := phrases.get(text)) is None:
                            phrases[text] = [count, owner]
                            size += 1
                        else:
                            entry[0] += count
                            entry[1] = min(entry[1], owner)
            if size >= HELD_PHRASES:
                yield from _phrase_batches(held)
                held, size = {}, 0
        yield from _phrase_batches(held)

    parallel, partitions = docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()
    return docs.coalesce(max(parallel, -(-partitions // MERGED_PARTITIONS))).mapInArrow(run, PHRASES)


def _phrase_batches(held: dict[tuple[str, int], dict[bytes, list[int]]]) -> Iterator[pa.RecordBatch]:
    for (lang, words), phrases in held.items():
        texts = [t.decode() for t in phrases]
        counts, owners = (np.array([e[k] for e in phrases.values()], np.int64) for k in (0, 1))
        columns = [pa.array([lang] * len(texts), pa.string()), pa.array(np.full(len(texts), words, np.int32)), pa.array(texts, pa.string())]
        columns += [pa.array(counts), pa.array(owners, mask=owners == NO_ID)]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "n", "doc_id"])


def frequent_phrases(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, key_bits: int = 64, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(lang, words, phrase, n, doc_id): every run of 1 to max_words words that occurs min_count times or more in its
    language, n times, in doc_id first (the smallest); and per language a row of words = 0, n its number of words.

    key_bits: how many bits of a fingerprint count; with fewer, more texts share one, and the rows stay the same.
    """
    mask = (1 << 64) - (1 << (64 - key_bits))
    texts = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
    )
    chosen: list[np.ndarray] = []
    for n in range(1, max_words + 1):
        counts = fingerprint_counts(texts, n, chosen[-1] if chosen else None, mask, filter_bits)
        often = counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        chosen.append(bitmap(often, filter_bits))
    found = phrase_texts(texts, chosen, mask, filter_bits).groupBy("lang", "words", "phrase").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("doc_id")
    )
    return found.where((F.col("n") >= min_count) | (F.col("words") == 0))


def cut_score(a: str, n: str, left: str, right: str) -> str:
    """floor(1000 * a * n / (left * right)) as SQL over 38 digits."""
    wide = "CAST({} AS DECIMAL(19, 0))".format
    return f"({wide(f'1000 * {a}')} * {wide(n)}) div ({wide(left)} * {wide(right)})"


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, covered: int = COVERED,
    key_bits: int = 64, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut, doc_id): the `top` phrases of two or more words of each language.

    docs: doc_id, text, lang; other columns are not read. Null text is empty, null lang is `und`, rows that repeat
    count each time. A phrase's score is its lowest over all cuts into two; one that lies in a longer frequent phrase
    with `covered` percent of its occurrences or more is left out. doc_id: the smallest that holds the phrase, null if
    none has an id. Exact at any size; one document fits a task.
    """
    found = written(frequent_phrases(docs, max_words, min_count, key_bits, filter_bits), "phrases")
    phrases = found.where("words > 0").select("lang", "words", "phrase", F.col("n").alias("a"), "doc_id")
    # Written, so that the join knows its size.
    totals = written(found.where("words = 0").select("lang", "n"), "phrase-totals")
    candidates = phrases.where("words > 1").withColumn("w", F.split("phrase", " "))

    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "doc_id", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest")
    )
    firsts = phrases.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    rests = phrases.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    scored = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"]).join(totals, "lang")
    scored = scored.withColumn("score", F.expr(cut_score("a", "n", "l", "r")))
    lowest = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("low"), F.first("a").alias("a"), F.first("n").alias("n"), F.first("doc_id").alias("doc_id")
    )

    sizes = candidates.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = sizes.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    longer = inner.select("lang", part(F.col("start"), F.col("size")).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {covered} * a")

    order = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", "low.score", F.col("low.k").cast("long").alias("cut"), "doc_id"
    )
