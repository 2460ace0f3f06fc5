"""Pack tokenised documents into sequences of fixed length: concatenate and cut.

Two passes. The first writes every document's ids with its offset inside its partition. The
totals of the partitions, prefix-summed, then place each partition in one global stream, and
the second pass cuts every document where the stream crosses a multiple of the length.
Partition numbers and offsets are read from the written table, so a lost executor cannot
change them between the passes.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from claimcheck.llm.byte_bpe import encoder, slices
from claimcheck.llm.shared import written

SEQUENCE_TOKENS = 1024
SEPARATOR_ID = 0
TOKENS = "part int, part_start long, doc_id long, n_ids long, ids binary"
PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "goes_on boolean, ids binary"
)


@contextmanager
def no_cycle_search() -> Iterator[None]:
    """Encoding makes millions of small lists and no cycles; the search for these would take a tenth of the time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def token_table(docs: DataFrame, path: str, separator: int = SEPARATOR_ID) -> DataFrame:
    """First pass: (part, part_start, doc_id, n_ids, ids), ids as little-endian 32-bit numbers.

    Every row of `docs` is one document, repeated rows too; null text is empty, so that the
    document is its separator alone. Columns besides doc_id and text are not read.
    """
    last = np.array([separator], "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        enc = encoder(path)
        for batch in slices(batches, "text"):
            with no_cycle_search():
                ids = [b + last for b in enc.encode_all(t or "" for t in batch.column("text").to_pylist())]
            n = np.fromiter((len(b) // 4 for b in ids), np.int64, len(ids))
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), batch.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())],
                ["part", "part_start", "doc_id", "n_ids", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENS)


def part_offsets(tokens: DataFrame) -> DataFrame:
    """(part, part_offset): where each partition begins in the stream. One row per write task."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = tokens.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_offset"))


def cut(tokens: DataFrame, length: int = SEQUENCE_TOKENS) -> DataFrame:
    """Second pass: one row per piece; `goes_on` marks boundary records, whose document continues."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in slices(batches, "ids"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_ids", "ids", "at")))
            out: list[list] = [[] for _ in names]
            for doc, n, ids, at in rows:
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    piece = (doc, start, size, n, sequence, offset, start + size < n, ids[4 * start : 4 * (start + size)])
                    for column, value in zip(out, piece):
                        column.append(value)
                    start += size
            kinds = [*[pa.int64()] * 6, pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    placed = tokens.join(F.broadcast(part_offsets(tokens)), "part")
    return placed.select(
        "doc_id", "n_ids", "ids", (F.col("part_offset") + F.col("part_start")).alias("at")
    ).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, length: int = SEQUENCE_TOKENS, separator: int = SEPARATOR_ID) -> DataFrame:
    """Every id of every document in exactly one piece; only the last sequence has free places."""
    return cut(written(token_table(docs, path, separator), "tokens"), length)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids array, doc_ids): the pieces of a sequence put together in order."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(ordered.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return grouped.select("sequence_id", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"))
