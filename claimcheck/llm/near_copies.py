"""Near copies by shared word shingles: a Jaccard similarity of 0.8 or more over sets of five words.

Copies share the digest of their set and count as one text. First come the pairs that `simhash` joins on
segment popcounts, by the SimHash of the set: fingerprints of at most two differing bits, of each
fingerprint the first text. That reaches only the closest copies, so MinHash tells which other texts may
have a near copy: a text has 40 buckets, each of five minima over its shingles, and a pair at 0.8 shares
none once in eight million times. Every text is held against one text of each of its buckets, which
brings most of a group together without a square. Links of both kinds are compared by their sets. Texts of buckets that are still divided then go
through an exact prefix join: shingles are ordered by how few of these texts hold them, and two sets
that are alike share one of their first n - ceil(0.8 n) + 1. A pair is proposed only if its sizes,
the places of the shared shingle and its parity sketches allow a similarity of 0.8, and is compared
by its sets in the end.

The parity sketch of a set has a bit per residue of a hash, flipped by every shingle there. A shingle
that only one of two sets holds flips one bit, so the bits in which two sketches differ are at most
the shingles in which the sets do: near misses, of which a large group has a square, are not proposed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from claimcheck.llm import simhash
from claimcheck.llm.byte_bpe import slices
from claimcheck.llm.components import connected_components
from claimcheck.llm.shared import written

SHINGLE_WORDS = 5
# Similarity as a fraction: 4 of 5.
SHARED, OF = 4, 5
BANDS, ROWS = 40, 5
SEED = 42
CHUNK_SHINGLES = 1 << 10
# Parity sketches of 32 longs; frequencies of shingles are added up in a table of this fixed size.
PARITY_LONGS = 32
FREQUENCY_BITS = 20
_rng = np.random.default_rng(SEED)
MASKS = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
FACTORS = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str) -> set[bytes]:
    """The runs of five words; a shorter text is one shingle, one without words has none."""
    words = text.encode().lower().split()
    if len(words) < SHINGLE_WORDS:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)))))


def shingle_hashes(text: str) -> np.ndarray:
    """The set of shingles as sorted 64-bit hashes."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text)], np.uint64))


def sketch(text: str) -> tuple[bytes, int, list[int], int]:
    """(digest of the set of shingles, its size, a signed hash per band, its SimHash)."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return bytes(16), 0, [], 0
    least, ones = np.full(BANDS * ROWS, ~np.uint64(0)), np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK_SHINGLES):
        part = (hashes[at : at + CHUNK_SHINGLES, None] ^ MASKS) * FACTORS
        np.minimum(least, part.min(0), out=least)
        ones += simhash.bit_counts(hashes[at : at + CHUNK_SHINGLES])
    buckets = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    buckets = np.array(buckets, np.uint64).view(np.int64).tolist()
    return xxhash.xxh3_128_digest(hashes.tobytes()), len(hashes), buckets, simhash.majority(ones, len(hashes))


def sketches(docs: DataFrame) -> DataFrame:
    """`docs` with columns digest, n, buckets and fp; null text has no words."""
    kinds = {"digest": pa.binary(), "n": pa.int64(), "buckets": pa.list_(pa.int64()), "fp": pa.int64()}
    types = [BinaryType(), LongType(), ArrayType(LongType()), LongType()]
    schema = StructType([*docs.schema, *[StructField(c, t) for c, t in zip(kinds, types)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [sketch(t or "") for t in batch.column("text").to_pylist()]
            added = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *kinds])

    return docs.mapInArrow(run, schema)


def parity(hashes: np.ndarray) -> bytes:
    bits = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % (64 * PARITY_LONGS), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


SETS = "node long, n long, hashes binary, parity array<long>"


def sets(texts: DataFrame) -> DataFrame:
    """(node, n, hashes, parity) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingle_hashes(t or "") for t in batch.column("text").to_pylist()]
            signs = [np.frombuffer(parity(h), np.int64).tolist() for h in found]
            columns = [pa.array(list(map(len, found)), pa.int64()), pa.array([h.tobytes() for h in found], pa.binary()), pa.array(signs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *columns], ["node", "n", "hashes", "parity"])

    return texts.mapInArrow(run, SETS)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of hashes have a Jaccard similarity of 0.8 or more."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return OF * both >= SHARED * (len(a) + len(b) - both)


def _most_apart(n: Column, m: Column) -> Column:
    """How many shingles at most may lie in only one of two sets of n and m that are alike."""
    return F.floor((n + m) * (OF - SHARED) / (OF + SHARED))


def _sizes_allow(n: Column, m: Column) -> Column:
    return OF * F.least(n, m) >= SHARED * F.greatest(n, m)


def _bits_apart(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _linked(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "set_a"), "set_b"):
            read = lambda c: (np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c))
            yield batch.filter(pa.array([alike(x, y) for x, y in zip(read("set_a"), read("set_b"))], pa.bool_())).select(["a", "b"])

    left = found.select(F.col("node").alias("a"), F.col("hashes").alias("set_a"))
    right = found.select(F.col("node").alias("b"), F.col("hashes").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _frequencies(found: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each residue; at most 2 ** FREQUENCY_BITS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << FREQUENCY_BITS, np.int64)
        for batch in slices(batches, "hashes"):
            for x in batch.column("hashes"):
                np.add.at(counts, _residue(np.frombuffer(x.as_buffer(), np.uint64)), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    summed = found.select("hashes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << FREQUENCY_BITS, np.int64)
    counts[summed["at"].to_numpy()] = summed["n"].to_numpy()
    return counts


def _residue(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << FREQUENCY_BITS) - 1)).astype(np.int64)


def _prefixes(found: DataFrame) -> DataFrame:
    """(shingle, node, place) of the rarest shingles of every set, as many as two sets that are alike cannot do without."""
    counts = _frequencies(found).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "hashes"):
            shingle, node, place = [], [], []
            for id_, x in zip(batch.column("node").to_pylist(), batch.column("hashes")):
                hashes = np.frombuffer(x.as_buffer(), np.uint64)
                first = len(hashes) - -(-SHARED * len(hashes) // OF) + 1
                # Any order that is the same for all sets will do; ties go by hash.
                rare = hashes[np.lexsort((hashes, counts[_residue(hashes)]))[:first]]
                shingle.append(rare.view(np.int64))
                node.append(np.full(len(rare), id_))
                place.append(np.arange(len(rare)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (shingle, node, place)], ["shingle", "node", "place"])

    return found.select("node", "hashes").mapInArrow(run, "shingle long, node long, place long")


def _proposed(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of nodes with different labels that may be alike; misses none that are."""
    rare = written(_prefixes(found), "rare-shingles")
    often = rare.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1").select("shingle")
    whole = found.select("node", "n", "parity").join(labels, "node")
    index = written(rare.join(often, "shingle", "left_semi").join(whole, "node"), "shared-shingles")
    left = index.select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("node", "place", "n", "parity", "label")])
    right = index.select(F.col("shingle").alias("shingle_b"), *[F.col(c).alias(f"{c}_b") for c in ("node", "place", "n", "parity", "label")])
    apart = _most_apart(F.col("n_a"), F.col("n_b"))
    # Of the first shingle that both hold, all that come before are held by one of them alone.
    met = left.join(
        right,
        (F.col("shingle") == F.col("shingle_b"))
        & (F.col("node_a") < F.col("node_b"))
        & (F.col("label_a") != F.col("label_b"))
        & _sizes_allow(F.col("n_a"), F.col("n_b"))
        & (F.col("place_a") + F.col("place_b") <= apart)
        & (_bits_apart(F.col("parity_a"), F.col("parity_b")) <= apart),
    )
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes whose SimHashes are joined on segment popcounts, or equal; sizes allow them to be alike.

    Of each fingerprint the first node stands for all; others meet that one.
    """
    sized = nodes.where("n > 0").select("node", "n", "fp")
    heads = written(sized.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("size")), "distinct-fingerprints")
    same = sized.join(heads.where("size > 1"), "fp").where(F.col("head.node") < F.col("node"))
    same = same.select(F.col("head.node").alias("a"), "node", "n", F.col("head.n").alias("n_a"))
    near = simhash.linked(heads.select("fp"))
    ends = [heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in ("a", "b")]
    near = near.join(ends[0], "a").join(ends[1], "b")
    near = near.select(F.col("head_a.node").alias("a"), F.col("head_b.node").alias("node"), F.col("head_b.n").alias("n"), F.col("head_a.n").alias("n_a"))
    pairs = same.union(near).where(_sizes_allow(F.col("n_a"), F.col("n")))
    return written(pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")), "fingerprint-pairs")


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): docs with row_id and digest, written; and (digest, label), the label of a component for each digest."""
    rows = written(sketches(docs).withColumn("row_id", F.monotonically_increasing_id()), "sketches")
    nodes = rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("n", "buckets", "fp")])
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "distinct-sketches")
    close = _fingerprint_pairs(nodes)
    members = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("size")).where("size > 1")
    shared = written(members.join(heads.drop("size"), "bucket"), "shared-buckets")
    ends = shared.select("node").union(close.select("a")).union(close.select("b"))
    wanted = nodes.join(ends.distinct(), "node", "left_semi").select("digest", "node")
    texts = rows.select("digest", "text").join(wanted, "digest").groupBy("node").agg(F.first("text").alias("text"))
    found = written(sets(texts), "candidate-sets")

    to_head = shared.where((F.col("head.node") < F.col("node")) & _sizes_allow(F.col("head.n"), F.col("n")))
    to_head = to_head.select(F.col("head.node").alias("a"), F.col("node").alias("b"))
    links = written(_linked(close.union(to_head).distinct(), found), "first-links")
    roots = connected_components(links)
    labelled = written(shared.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("label")), "bucket-labels")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    divided = written(labelled.join(mixed, "bucket", "left_semi").select("node", "label").distinct(), "divided")
    proposed = written(_proposed(found.join(divided.select("node"), "node", "left_semi"), divided), "other-pairs")
    roots = connected_components(written(links.union(_linked(proposed, found)), "near-copy-links"))
    labels = nodes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("label"))
    return rows, written(labels, "near-copy-labels")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) per row of `docs`: the smallest doc_id that links reach, the row's own included.

    Rows that repeat a doc_id are linked by their texts like any others; a null doc_id is never the smallest unless
    a component has no other. Null text has no words; texts without words are copies of each other.
    Other columns are not read.
    """
    rows, labels = _labelled(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    ids = rows.select("doc_id", "digest").join(labels, "digest").select("doc_id", "label")
    smallest = written(ids.groupBy("label").agg(F.min("doc_id").alias("component_id")), "smallest-ids")
    return ids.join(smallest, "label").select("doc_id", "component_id")


def keep(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component: that with the smallest doc_id, nulls last.

    Among rows that repeat that doc_id the one with the smallest digest of its text stays, and among those that agree
    in both, any one. All columns pass through, whatever their names.
    """
    names = docs.columns
    bare = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*names).alias("row")
    )
    rows, labels = _labelled(bare)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("text"), "row_id")
    ranked = written(rows.select(place.alias("place"), "row_id", "digest").join(labels, "digest").select("label", "place", "row_id"), "ranked-rows")
    first = ranked.groupBy("label").agg(F.min("place").alias("first"), F.count("*").alias("size")).where("size > 1")
    gone = ranked.join(first, "label").where(F.col("row_id") != F.col("first.row_id")).select("row_id")
    return rows.join(gone, "row_id", "left_anti").select("row.*")
