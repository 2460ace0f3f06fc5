"""Token counts by a digest cache: texts counted once per tokenizer version, ever.

A text is known by the digest of its normalised content, a tokenizer by the digest of its
file. Only digests that the cache lacks are encoded, once each, and appended to it.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimcheck.llm.byte_bpe import encoder, slices
from claimcheck.llm.shared import shared_dir, written

CACHE = "content binary, version string, n_tokens long"
TOKEN_LIMIT = 4096
# Missing digests are broadcast while their counted size is below this.
DIGEST_BYTES, BROADCAST_BYTES = 64, 8 << 20


def normalised(text: Column) -> Column:
    """The content that is counted. Counts must equal the library's, so only null changes: to empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and the library that reads it."""
    kind = Path(path).suffix
    return hashlib.sha256(kind.encode() + Path(path).read_bytes()).hexdigest()


@functools.lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _counts(path: str, texts: list[str]) -> list[int]:
    if path.endswith(".model"):
        return [len(ids) for ids in _pieces(path).encode(texts, num_threads=1)]
    return [len(ids) // 4 for ids in encoder(path).encode_all(texts)]


def encode_misses(texts: DataFrame, path: str) -> DataFrame:
    """(content, version, n_tokens) of the rows of `texts`: content, text."""
    version = tokenizer_version(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            counts = np.array(_counts(path, batch.column("text").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([version] * len(counts), pa.string()), pa.array(counts)],
                ["content", "version", "n_tokens"],
            )

    return texts.select("content", "text").mapInArrow(run, CACHE)


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts, of all runs; a folder that does not exist yet is an empty cache.

    Two runs that append at once may both store a count.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).option("recursiveFileLookup", "true").parquet(cache)


def _digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, content) per row of `docs`, written."""
    text = normalised(F.col("text"))
    return written(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("content")), "digests")


def fill_cache(docs: DataFrame, path: str, cache: str, digests: DataFrame | None = None) -> None:
    """Append the counts of the texts that `cache` lacks, each encoded once.

    Digests are compared first: where all are known, no text is read again, and few missing ones are looked for
    before texts are shuffled. A run writes to a folder of its own.
    """
    spark, version = docs.sparkSession, tokenizer_version(path)
    digests = digests or _digests(docs)
    known = read_cache(spark, cache).where(F.col("version") == version).select("content")
    missing = written(digests.select("content").distinct().join(known, "content", "left_anti"), "missing-digests")
    n_missing = missing.count()
    if not n_missing:
        return
    texts = docs.select(normalised(F.col("text")).alias("text"), content_digest(F.col("text")).alias("content"))
    few = n_missing * DIGEST_BYTES <= BROADCAST_BYTES
    if few:
        texts = texts.join(F.broadcast(missing), "content", "left_semi")
    # Copies meet before the shuffle: a task sends one text per digest.
    single = texts.groupBy("content").agg(F.first("text").alias("text"))
    encode_misses(single if few else single.join(missing, "content", "left_semi"), path).write.option("compression", "zstd").parquet(
        f"{cache.rstrip('/')}/run-{uuid.uuid4().hex}"
    )


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of `docs`; new counts are appended to `cache`.

    Null text is empty; repeated rows stay repeated; columns besides doc_id and text are not read.
    Without `cache` the counts are kept in the shared folder for this call alone. A count that the cache does not
    hold after all (its files were removed meanwhile) is an error.
    """
    spark = docs.sparkSession
    cache = cache or shared_dir(spark, "token-counts")
    keys = _digests(docs)
    fill_cache(docs, path, cache, keys)
    stored = read_cache(spark, cache).where(F.col("version") == tokenizer_version(path)).select("content", "n_tokens")
    # Of the cache only what these documents ask for is put together.
    counts = stored.join(keys.select("content").distinct(), "content", "left_semi").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    lost = F.raise_error(F.lit(f"{cache} lacks the count of a document")).cast("long")
    return keys.join(counts, "content", "left").withColumn("n_tokens", F.coalesce("n_tokens", lost)).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
