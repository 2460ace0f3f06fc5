"""Keep the first occurrence of every long line: ranges of line hashes, sorted and streamed.

Line hashes are range-partitioned with document and position as secondary sort keys, so that
even one line that a third of all documents share is spread over many partitions. Each
partition is streamed once. Only the run with which it begins may have started earlier; the
rows of that run wait, while boundary records of all partitions settle in which document its
line occurs first. Text never moves: the result is one compressed keep bitmap per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from claimcheck.llm.byte_bpe import slices
from claimcheck.llm.shared import written

MIN_KEY_CHARS = 10
KEYS = "h1 long, h2 long, doc_id long, copy long, pos int, n_lines int"
EVENTS = "kind int, h1 long, h2 long, doc_id long, copy long, pos int, n_lines int"
DROP, OPEN, BOUNDARY = 0, 1, 2


def text_copy(text: Column) -> Column:
    """Tells rows with the same doc_id but different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """A row per line whose key has `min_chars` code points: 128-bit hash, document, position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h1, h2, docs_, copies, pos, n_lines = [], [], [], [], [], []
            for doc, copy, text in zip(*(c.to_pylist() for c in batch.columns)):
                # Bytes lower-case and strip ASCII alone, as the keys want it.
                lines = text.encode().lower().split(b"\n")
                for i, line in enumerate(lines):
                    key = line.strip()
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        digest = xxhash.xxh3_128_digest(key)
                        h1.append(digest[:8])
                        h2.append(digest[8:])
                        docs_.append(doc)
                        copies.append(copy)
                        pos.append(i)
                        n_lines.append(len(lines))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(b"".join(h1), "<i8")), pa.array(np.frombuffer(b"".join(h2), "<i8")),
                    pa.array(docs_, pa.int64()), pa.array(copies, pa.int64()), pa.array(pos, pa.int32()), pa.array(n_lines, pa.int32()),
                ],
                ["h1", "h2", "doc_id", "copy", "pos", "n_lines"],
            )

    texts = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long"), text_copy(F.col("text")).alias("copy"), F.coalesce("text", F.lit("")).alias("text")
    )
    return texts.mapInArrow(run, KEYS)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition in order: rows to drop, rows of its first run, a boundary record of its first and last run."""
    first_key = key = None
    owner = first_owner = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
        starts = np.ones(len(doc), bool)
        starts[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts[0] = key != (h1[0], h2[0])
        if first_key is None:
            first_key, first_owner = (h1[0], h2[0]), doc[0]
        at = np.maximum.accumulate(np.where(starts, np.arange(len(doc)), -1))
        owners = np.where(at >= 0, doc[at], owner)
        in_first = (h1 == first_key[0]) & (h2 == first_key[1])
        kind = np.where(in_first, OPEN, DROP).astype(np.int32)
        send = np.flatnonzero(in_first | (doc != owners))
        key, owner = (h1[-1], h2[-1]), owners[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind[send]), *(c.take(pa.array(send)) for c in batch.columns)], ["kind", *batch.schema.names]
        )
    if first_key is not None:
        ends = [(BOUNDARY, *map(int, first_key), int(first_owner)), (BOUNDARY, *map(int, key), int(owner))]
        kinds = [pa.int32(), *[pa.int64()] * 3]
        columns = [pa.array(c, k) for c, k in zip(zip(*ends), kinds)]
        columns += [pa.nulls(2, pa.int64()), pa.nulls(2, pa.int32()), pa.nulls(2, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "h1", "h2", "doc_id", "copy", "pos", "n_lines"])


def dropped_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(doc_id, copy, pos, n_lines) of every line that an earlier document, by doc_id, also holds."""
    keys = written(line_keys(docs, min_chars), "line-keys")
    order = ["h1", "h2", "doc_id", "copy", "pos"]
    events = written(
        keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, EVENTS), "line-events"
    )
    owners = events.where(F.col("kind") == BOUNDARY).groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
    # Two boundary records per partition at most, so the owners fit any task.
    late = events.where(F.col("kind") == OPEN).join(F.broadcast(owners), ["h1", "h2"]).where("doc_id > owner")
    columns = ["doc_id", "copy", "pos", "n_lines"]
    return events.where(F.col("kind") == DROP).select(columns).union(late.select(columns))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(doc_id, copy, n_lines, n_dropped, keep): one row per document that loses a line.

    keep: zlib-compressed bits, most significant first, 1 for lines that stay. Documents
    without a row keep all lines. A row without doc_id takes no part: it keeps its lines and
    counts for no other. Rows that repeat a doc_id are the same document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, dropped = [], []
            for n, positions in zip(batch.column("n_lines").to_pylist(), batch.column("positions")):
                bits = np.ones(n, np.uint8)
                bits[positions.values.to_numpy()] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
                dropped.append(n - int(bits.sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "copy", "n_lines")), pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())],
                ["doc_id", "copy", "n_lines", "n_dropped", "keep"],
            )

    grouped = dropped_lines(docs, min_chars).groupBy("doc_id", "copy").agg(
        F.first("n_lines").alias("n_lines"), F.collect_list("pos").alias("positions")
    )
    return grouped.mapInArrow(run, "doc_id long, copy long, n_lines int, n_dropped int, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`docs` with `text` cut down to the kept lines, and columns n_lines and n_dropped.

    Columns that already have these two names are replaced; all others pass through.
    """
    docs = docs.drop("n_lines", "n_dropped")
    bits_name = "keep_bits"
    while bits_name in docs.columns:
        bits_name += "_"
    marks = bitmaps.select(
        F.col("doc_id").alias("bitmap_doc"), F.col("copy").alias("bitmap_copy"), F.col("keep").alias(bits_name), "n_dropped"
    )
    joined = docs.join(
        marks, (docs["doc_id"] == marks["bitmap_doc"]) & (text_copy(docs["text"]) == marks["bitmap_copy"]), "left"
    ).select(*[docs[c] for c in docs.columns], bits_name, marks["n_dropped"])
    names = docs.columns
    schema = StructType([*docs.schema, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, n_lines, n_dropped = [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", bits_name, "n_dropped")))
            for text, keep, dropped in rows:
                lines = (text or "").split("\n")
                if keep is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
                    text = "\n".join([lines[i] for i in np.flatnonzero(bits).tolist()])
                texts.append(text or "")
                n_lines.append(len(lines))
                n_dropped.append(dropped or 0)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"]
            )

    return joined.mapInArrow(run, schema)
