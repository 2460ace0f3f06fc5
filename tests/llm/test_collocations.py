"""Phrases and their scores against dictionaries of word tuples."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimcheck.llm import collocations as col, queries
from tests.conftest import TESTDATA


def plain_counts(rows, max_words=5):
    """(lang, words) to (count, smallest doc_id), and the number of words of each language."""
    counts, first, totals = Counter(), {}, Counter()
    for doc, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        totals[lang] += 0
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, max_words + 1):
                for i in range(len(words) - n + 1):
                    key = (lang, *words[i : i + n])
                    counts[key] += 1
                    if doc is not None:
                        first[key] = min(doc, first.get(key, doc))
    return counts, first, totals


def plain_collocations(rows, max_words=5, least=100, top=2000):
    counts, first, totals = plain_counts(rows, max_words)
    often = {k: a for k, a in counts.items() if a >= least}
    ranked = {}
    for key, a in often.items():
        lang, *words = key
        if len(words) < 2:
            continue
        inside = any(
            longer[0] == lang and len(longer) > len(key) and b >= a and any(longer[i : i + len(words)] == tuple(words) for i in range(1, len(longer)))
            for longer, b in often.items()
        )
        if inside:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = often[(lang, *words[:k])], often[(lang, *words[k:])]
            cuts.append((Fraction(1000 * a * totals[lang], left * right).__floor__(), k, left, right))
        score, k, left, right = min(cuts)
        phrase = " ".join(words)
        ranked.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, a, left, right, totals[lang], score, k, first.get(key)))
    return sorted(
        ((lang, rank, *row[3:]) for lang, found in ranked.items() for rank, row in enumerate(sorted(found)[:top], 1)), key=repr
    )


def got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def made_docs(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "B", "ab", "Ünd", "c\x0e", "d\xa0e", "x" * 40, "\0", "of"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!? "]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.choice([0, 1, 5, 300]))) for _ in range(n)]
    return [(rng.choice([None, k, k // 2]), rng.choice([t, None, "of the of the of the"]), rng.choice(["en", "de", None])) for k, t in enumerate(texts)]


# With few bits many texts share a fingerprint, and with a small bitmap everything passes.
@pytest.mark.parametrize("key_bits, filter_bits", [(64, 25), (8, 25), (2, 7), (64, 6)])
def test_equals_plain_counts(spark, key_bits, filter_bits, monkeypatch):
    rows = made_docs(key_bits + filter_bits)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = col.frequent_phrases(docs, 5, 3, key_bits, filter_bits)
    counts, first, totals = plain_counts(rows)
    expected = {(k[0], len(k) - 1, " ".join(k[1:]), a, first.get(k)) for k, a in counts.items() if a >= 3}
    assert set(map(tuple, found.where("words > 0").collect())) == expected
    assert {(r["lang"], r["n"]) for r in found.where("words = 0").collect()} == set(totals.items())
    assert got(col.collocations(docs, 5, 3, 50, key_bits=key_bits, filter_bits=filter_bits)) == plain_collocations(rows, 5, 3, 50)


def test_units_blocks_and_long_words(monkeypatch):
    monkeypatch.setattr(col, "BLOCK_BYTES", 7)
    texts = [b"One two.three", b"", b"  FOUR\tfive  six ", b"x" * 50 + b" y", b"one two"]
    u = col.unit(texts, [1, 1, 1, 1, 1])
    words = [u.text[s : s + n].tobytes() for s, n in zip(u.starts, u.lengths)]
    assert words == [b"one", b"two", b"three", b"four", b"five", b"six", b"x" * 50, b"y", b"one", b"two"]
    assert u.documents(np.arange(10)).tolist() == [0, 0, 0, 2, 2, 2, 3, 3, 4, 4]
    keys, whole = u.keys(2, ~np.uint64(0))
    assert whole.tolist() == [True, False, False, True, True, False, True, False, True]
    assert keys[0] == keys[8] and len(set(keys.tolist())) == 8
    assert [u.text[s : s + 8].tobytes() for s in u.starts[3:4]] == [b"four fiv"]


def test_small_units_and_tasks(spark, monkeypatch):
    rows = made_docs(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    batches = pa.RecordBatch.from_pylist([{"doc_id": d, "text": t or "", "lang": lg or "und"} for d, t, lg in rows])
    monkeypatch.setattr(col, "UNIT_BYTES", 64)
    assert sum(len(u.starts) for u, _, _ in col.units(iter([batches]))) == sum(plain_counts(rows)[2].values())
    monkeypatch.setattr(col, "HELD_KEYS", 5)
    assert got(col.collocations(docs, 3, 4, 20)) == plain_collocations(rows, 3, 4, 20)


def test_scores_are_exact(spark):
    big = [(10**12 + 7, 10**13 + 1, 10**12 + 9, 10**12 + 11), (100, 10**13, 100, 100), (3, 10, 7, 11), (10**13, 10**14 - 1, 10**13, 10**13)]
    frame = spark.createDataFrame(big, "a long, n long, l long, r long").select("*", F.expr(col.cut_score("a", "n", "l", "r")).alias("score"))
    assert {tuple(r[:4]): r["score"] for r in frame.collect()} == {(a, n, lf, r): 1000 * a * n // (lf * r) for a, n, lf, r in big}
    assert frame.schema["score"].dataType.typeName() == "long"


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()]
    assert got(col.collocations(odd_docs, 5, 2)) == plain_collocations(rows, 5, 2)
    assert col.collocations(no_docs).collect() == []
    hidden = odd_docs.withColumn("a", F.lit("x")).withColumn("phrase", F.lit("x")).withColumn("key", F.lit("x"))
    assert got(col.collocations(hidden, 5, 2)) == plain_collocations(rows, 5, 2)


def test_query_against_plain_counts(spark):
    folder = f"{TESTDATA}/sf0.001"
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got(queries.QUERIES["op11_collocations"](spark, folder)) == plain_collocations(rows)
