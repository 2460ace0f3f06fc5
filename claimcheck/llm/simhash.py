"""SimHash near-duplicates joined on segment popcounts.

A fingerprint is embedded as the bit counts of its segments. Flipping a bit moves one count
by one, so the Manhattan distance of two embeddings is at most the Hamming distance: within
`2` bits at most two segments differ, hence of the four groups of segments at least two agree
in every count. The grid cell of a pair of groups is its counts; fingerprints meet in the six
cells of their group pairs, are held against the Manhattan bound over all segments, and are
then compared bit by bit. Copies share a fingerprint and are joined as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from claimcheck.llm.byte_bpe import slices
from claimcheck.llm.components import connected_components
from claimcheck.llm.shared import written

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
CHUNK_SHINGLES = 1 << 15
LOW_BITS = 0x5555555555555555
GROUPS = 4


def fingerprint(text: str, words_each: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash over word shingles, repeats included; as a signed number."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_each + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK_SHINGLES):
        part = words[at : at + CHUNK_SHINGLES + words_each - 1]
        if len(part) < words_each:
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(words_each))))
        counts += bit_counts(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8"))
    return majority(counts, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit."""
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that over half of `n` hashes have, as a signed number."""
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) per row of `docs`; null text has no words and the fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = [fingerprint(t or "", words_each) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """The bit counts of all 32 two-bit segments, two bits each, in one long."""
    low, high = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    # The sum of two bits in bits: the top field may reach the sign.
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two embeddings. Fields are 0 to 2, so xor is 1 or 3 for distance 1 and 2 for 2."""
    x = a.bitwiseXOR(b)
    low, high = x.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW_BITS))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def _group(counts: Column, g: int) -> Column:
    return F.shiftrightunsigned(counts, 16 * g).bitwiseAND(F.lit(0xFFFF))


def _cells(fps: DataFrame) -> DataFrame:
    """(fp, counts, pair, cell): a row per pair of groups."""
    counts = fps.select("fp", segment_counts(F.col("fp")).alias("counts"))
    cells = [
        F.struct(
            F.lit(k).alias("pair"),
            F.shiftleft(_group(F.col("counts"), i), 16).bitwiseOR(_group(F.col("counts"), j)).alias("cell"),
        )
        for k, (i, j) in enumerate(combinations(range(GROUPS), 2))
    ]
    return counts.select("fp", "counts", F.inline(F.array(*cells)))


def linked(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: every pair of distinct fingerprints that differ in at most `max_bits` bits, once."""
    if max_bits > MAX_BITS:
        raise ValueError(f"two of {GROUPS} groups agree only up to {MAX_BITS} differing bits")
    left = _cells(fps).select(F.col("fp").alias("a"), F.col("counts").alias("ca"), "pair", "cell")
    right = _cells(fps).select(F.col("fp").alias("b"), F.col("counts").alias("cb"), F.col("pair").alias("pair_b"), F.col("cell").alias("cell_b"))
    # A pair that meets in several cells is taken from the first.
    same = [_group(F.col("ca"), g) == _group(F.col("cb"), g) for g in range(GROUPS)]
    first = F.lit(-1)
    for k, (i, j) in reversed(list(enumerate(combinations(range(GROUPS), 2)))):
        first = F.when(same[i] & same[j], F.lit(k)).otherwise(first)
    met = left.join(
        right.hint("merge"),
        (F.col("pair") == F.col("pair_b"))
        & (F.col("cell") == F.col("cell_b"))
        & (F.col("a") < F.col("b"))
        & (manhattan(F.col("ca"), F.col("cb")) <= max_bits)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        & (first == F.col("pair")),
    )
    return met.select("a", "b")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id, n_links) per row of `docs`.

    component_id: the smallest doc_id that links reach, the row's own included; n_links: how
    many other rows it links to directly. Rows that repeat a doc_id stay repeated and link to
    each other; a null doc_id is never the smallest unless a component has no other.
    """
    rows = written(fingerprints(docs, words_each), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    edges = written(linked(fps, max_bits), "fingerprint-links")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = both.join(fps.select(F.col("fp").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    roots = connected_components(edges)
    labelled = (
        fps.join(roots, fps["fp"] == roots["node"], "left")
        .join(partners, fps["fp"] == partners["a"], "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = written(labelled.join(smallest, "root").select(F.col("fp").alias("label_fp"), "component_id", "n_links"), "labels")
    return rows.join(labels, rows["fp"] == labels["label_fp"]).select("doc_id", "fp", "component_id", "n_links")
