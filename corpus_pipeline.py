"""The corpus pipeline: documents that stay, without shared lines, near copies and personal data, packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimcheck.llm import line_dedup, near_copies, packing, pii, quality
from claimcheck.llm.queries import digest_pieces
from claimcheck.llm.shared import written


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep; rows that repeat a doc_id, or have none, are judged each for itself."""
    return quality.keep(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; one of which nothing is left goes."""
    # In a struct, so that no column of the documents is taken for one of the counts.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    bare = docs.select("doc_id", "text", F.struct(*others).alias("others"))
    kept = line_dedup.apply_bitmaps(bare, line_dedup.keep_bitmaps(bare)).where("n_dropped = 0 OR text <> ''")
    return _sized(kept.select(*[F.col("others")[c].alias(c) if c in others else c for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, Jaccard 0.8 or more): that with the smallest doc_id, nulls last.

    Pairs come from SimHashes joined on segment popcounts, those too far apart for that from MinHash and a prefix join.
    """
    return near_copies.keep(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _sized(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return digest_pieces(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

# Fingerprints and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
