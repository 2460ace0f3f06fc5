"""Quality rules whose thresholds come from the data: quantile sketches per language and source.

A sketch is a histogram over buckets of fixed relative width. Counts of equal buckets add up,
so sketches of partitions, of sources and of languages merge in any order into the same
sketch, and quantiles are repeatable. A group with few documents borrows the sketch of its
language, a small language that of the whole table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from claimcheck.llm.byte_bpe import slices
from claimcheck.llm.shared import written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW_WORDS = 5
# How many documents of its parent a group's quantiles are blended with.
PARENT_WEIGHT = 10
SUB_BUCKETS = 16
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def features(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.encode().split()
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return (
        len(words), word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five that occur more than once."""
    windows = list(zip(*(words[i:] for i in range(WINDOW_WORDS))))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.fromiter((i for i, w in enumerate(windows) if w in often), np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW_WORDS, -1)
    return int((np.cumsum(marks) > 0).sum())


def text_digest(text: Column) -> Column:
    """Tells rows with the same doc_id, or with none, but different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, digest) and the features of every row; null text has no word and no line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [features(t or "") for t in batch.column("text").to_pylist()]
            columns = zip(*rows) if rows else [[]] * 5
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            keys = ["doc_id", "lang", "source", "digest"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), *(pa.array(c, pa.int64()) for c in columns)], [*keys, *names]
            )

    keyed = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        text_digest(F.col("text")).alias("digest"), "text",
    )
    return keyed.mapInArrow(run, f"doc_id long, lang string, source string, digest long, {FEATURES}")


#: Rates that are judged against the data: what they count per what, and the slack in their own
#: unit beyond which a document may stand out at all.
RATES = {
    "symbols": ("n_symbols", 1000, "word_chars", 20),
    "dup_lines": ("n_dup_lines", 1000, "n_words", 30),
    "word_length": ("word_chars", 10, "n_words", 60),
}
SPREAD = 3


def rate(name: str) -> Column:
    top, scale, bottom, _ = RATES[name]
    return F.floor(F.col(top) * scale / F.greatest(F.col(bottom), F.lit(1)))


def bucket(v: Column) -> Column:
    """Bucket of a whole number: below 16 each its own, then 16 to each doubling."""
    shift = F.length(F.bin(v)) - 5
    return F.when(v < SUB_BUCKETS, v).otherwise(SUB_BUCKETS * shift + F.call_function("shiftright", v, shift))


def bucket_floor(b: Column) -> Column:
    """The least number in a bucket."""
    shift = F.floor(b / SUB_BUCKETS).cast("int") - 1
    return F.when(b < 2 * SUB_BUCKETS, b).otherwise(
        F.call_function("shiftleft", (SUB_BUCKETS + b % SUB_BUCKETS).cast("long"), shift)
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, name, bucket, n): the sketch of every rate per language and source."""
    rates = F.array(*[F.struct(F.lit(k).alias("name"), bucket(rate(k)).cast("long").alias("bucket")) for k in RATES])
    return (
        rows.where(~base_failed())
        .select("lang", "source", F.inline(rates))
        .groupBy("lang", "source", "name", "bucket")
        .agg(F.count("*").alias("n"))
    )


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, name, n, q25, q50): merged sketches read off at two points."""
    merged = sketch.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "name")
    seen = merged.withColumns(
        {"upto": F.sum("n").over(own.orderBy("bucket")), "total": F.sum("n").over(own)}
    )
    at = lambda q: bucket_floor(F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket"))))
    return seen.groupBy(*keys, "name").agg(F.max("total").alias("n"), at(25).alias("q25"), at(50).alias("q50"))


def thresholds(sketch: DataFrame, weight: int = PARENT_WEIGHT) -> DataFrame:
    """(lang, source, and for each rate its highest accepted value).

    A source's quantiles are blended with its language's, and these with the whole table's, as if PARENT_WEIGHT documents
    of the parent belonged to the group: a small group leans on its parent, and no size changes the rule.
    q50 + 3 * (q50 - q25) + slack: junk moves the lower half of a group only when most of the group is junk.
    """
    sketch = written(sketch, "sketches")
    groups = sketch.select("lang", "source", "name").distinct()
    named = lambda d, p: d.select(
        *[c for c in d.columns if c in ("lang", "source", "name")], *[F.col(c).alias(p + c) for c in ("n", "q25", "q50")]
    )
    levels = (
        groups.join(named(quantiles(sketch, "lang", "source"), "s_"), ["lang", "source", "name"])
        .join(named(quantiles(sketch, "lang"), "l_"), ["lang", "name"])
        .join(named(quantiles(sketch), "a_"), ["name"])
    )
    slack = F.create_map(*[F.lit(x) for k, (_, _, _, s) in RATES.items() for x in (k, s)])
    blend = lambda level, q, parent: f"(({level}_n * {level}_{q} + {weight} * {parent}) div ({level}_n + {weight}))"
    pick = lambda q: F.expr(blend("s", q, blend("l", q, "a_" + q)))
    most = pick("q50") + SPREAD * (pick("q50") - pick("q25")) + F.element_at(slack, F.col("name"))
    return levels.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("name") == k, most)).alias("most_" + k) for k in RATES]
    )


def judge(docs: DataFrame, weight: int = PARENT_WEIGHT) -> DataFrame:
    """(doc_id, lang, source, digest, features, base_failed, the three rates, their thresholds, kept) per row of `docs`.

    Null text has no words and fails the base rules; null language or source is the group ''.
    A group of which no document passes the base rules has null thresholds and keeps nothing.
    """
    rows = written(with_features(docs), "quality-features")
    # Written, so that the join knows its size: Spark broadcasts it only if it is small.
    limits = written(thresholds(sketches(rows), weight), "quality-limits")
    judged = rows.join(limits, ["lang", "source"], "left").withColumns({k: rate(k) for k in RATES})
    inside = F.lit(True)
    for k in RATES:
        inside = inside & (F.col(k) <= F.col("most_" + k))
    return judged.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    )


def keep(docs: DataFrame, weight: int = PARENT_WEIGHT) -> DataFrame:
    """The rows of `docs` whose verdict is kept, with all their columns.

    A verdict names its row by doc_id, null or not, language, source and the digest of the
    text, which are all that it depends on. Rows that agree in these share their verdict.
    """
    rejected = judge(docs, weight).where("NOT kept").select("doc_id", "lang", "source", "digest").distinct()
    same = (
        docs["doc_id"].cast("long").eqNullSafe(rejected["doc_id"])
        & (text_digest(docs["text"]) == rejected["digest"])
        & (F.coalesce(docs["lang"], F.lit("")) == rejected["lang"])
        & (F.coalesce(docs["source"], F.lit("")) == rejected["source"])
    )
    return docs.join(rejected, same, "left_anti")
