"""Tokens: the streaming encoder, packing and the digest cache against the tokenizer libraries."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimcheck.llm import byte_bpe, packing, token_counts
from claimcheck.llm.queries import BYTE_BPE, PIECE_BPE, QUERIES, digest_pieces
from claimcheck.llm.shared import shared_dir
from tests.conftest import TESTDATA

library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PARTS = ["a", "the", " ", "  ", "\n", "'s", "'", "é", "ß", "١", "½", "中", "🙂", "\t", " ", "\x1c", "\0", "<|endoftext|>", "12", "-", "***", " the", "‍", "\xa0", " \xa0", "\u3000", "\x85", "word.", " word,", " no!?"]


def expected(text):
    return library.encode(text or "", add_special_tokens=False).ids


def ids(blocks):
    return np.frombuffer(b"".join(blocks), "<i4").tolist()


@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(byte_bpe.encoder(BYTE_BPE).encode(text)) == expected(text)


def test_every_short_run_of_white_space():
    """All strings of up to four of the pre-tokenizer's white-space characters and a letter."""
    texts = ["".join(t) for n in range(1, 5) for t in itertools.product(byte_bpe.SPACES + "a", repeat=n)]
    library_ids = (e.ids for e in library.encode_batch(texts, add_special_tokens=False))
    blocks = byte_bpe.Encoder(BYTE_BPE).encode_all(texts)
    assert [t for t, block, want in zip(texts, blocks, library_ids) if ids([block]) != want] == []


def test_white_space_at_the_ends_of_chunks(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 5)
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(" \xa0\n \u3000ab") for _ in range(rng.randrange(40)))
        assert ids(byte_bpe.encoder(BYTE_BPE).encode(text)) == expected(text)


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000, "abcdefgh" * 5_000, "=-" * 20_000, " " * 20_000 + "x", "x  " * 100_000, "\n" * 9_000])
def test_long_pre_tokens_and_chunks(text):
    assert ids(byte_bpe.encoder(BYTE_BPE).encode(text)) == expected(text)


def test_a_word_may_arrive_in_pieces():
    word = "abcabdabe" * 4_000
    pieces_of_it = [word[i : i + 777].encode() for i in range(0, len(word), 777)]
    blocks = list(byte_bpe.encoder(BYTE_BPE).stream_word(pieces_of_it))
    assert len(blocks) > 3 and ids(blocks) == expected(word)


def test_dictionary_stays_bounded():
    enc = byte_bpe.Encoder(BYTE_BPE, cache_units=50)
    texts = [f"word{i} other{i * 7} third{i * 31}" for i in range(400)]
    assert [ids([b]) for t in texts for b in enc.encode_all([t])] == [expected(t) for t in texts]
    assert len(enc.cache) < 60


def test_lookahead_follows_the_longest_chain():
    # ab, then c+ab, then d+cab: what follows "d c a" decides about a, c and d.
    length = [1, 1, 1, 1, 2, 3, 4]
    assert byte_bpe.sufficient_lookahead([(0, 1, 4), (2, 4, 5), (3, 5, 6)], length, {4: 0, 5: 2, 6: 3}) == 3
    assert byte_bpe.sufficient_lookahead([], [1], {}) == 0


def test_decoder_joins_split_characters():
    dec = byte_bpe.decoder(BYTE_BPE)
    tokens = expected("naïve 🙂 <|endoftext|> ¿qué?")
    assert "".join(dec.decode([t] for t in tokens)) == library.decode(tokens, skip_special_tokens=False)
    broken = expected("🙂")[:-1] + expected("x")
    assert "".join(dec.decode([broken])) == library.decode(broken, skip_special_tokens=False)


def test_round_trip(odd_docs):
    found = byte_bpe.decode(byte_bpe.encode(odd_docs, BYTE_BPE), BYTE_BPE).collect()
    assert len(found) == odd_docs.count()
    for row in found:
        assert row["ids"] == expected(row["text"]) and row["decoded"] == (row["text"] or "")


def test_packing_covers_every_id_once(odd_docs):
    packed = packing.pack(odd_docs, BYTE_BPE)
    found = packed.collect()
    docs = sorted([(r["doc_id"], expected(r["text"]) + [0]) for r in odd_docs.collect()], key=repr)
    by_place = sorted(found, key=lambda r: (r["sequence_id"], r["offset"]))
    at, seen = 0, []
    for r in by_place:
        assert divmod(at, 1024) == (r["sequence_id"], r["offset"])
        at += r["length"]
        if r["start"] == 0:
            seen.append([r["doc_id"], []])
        assert len(seen[-1][1]) == r["start"] and seen[-1][0] == r["doc_id"]
        seen[-1][1].extend(np.frombuffer(r["ids"], "<i4").tolist())
        assert r["goes_on"] == (r["start"] + r["length"] < r["doc_tokens"])
    assert sorted([tuple(x) for x in seen], key=repr) == docs
    first = digest_pieces(packed).where("doc_id = 2").first()
    assert first["ids_crc32"] == zlib.crc32(b"\0\0\0\0")
    whole = packing.sequences(packed).collect()
    assert all(len(s["ids"]) == 4096 for s in whole if s["sequence_id"] < max(x["sequence_id"] for x in whole))


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, BYTE_BPE).count() == 0


def test_counts_equal_the_library(odd_docs):
    found = token_counts.count_tokens(odd_docs, PIECE_BPE, limit=1000).collect()
    wanted = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    wanted = [(i, len(t.encode()), len(pieces.encode(t)), len(pieces.encode(t)) > 1000) for i, t in wanted]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)


def test_cache_is_read_and_appended(spark, odd_docs, no_docs):
    cache = shared_dir(spark, "cache")
    first = token_counts.count_tokens(odd_docs, PIECE_BPE, cache).count()
    stored = token_counts.read_cache(spark, cache)
    distinct = odd_docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert first == odd_docs.count() and stored.count() == distinct
    more = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(99, "not seen before")], "doc_id long, text string"))
    token_counts.count_tokens(more, PIECE_BPE, cache).collect()
    assert token_counts.read_cache(spark, cache).count() == distinct + 1
    token_counts.count_tokens(more, BYTE_BPE, cache).collect()
    assert token_counts.read_cache(spark, cache).groupBy("version").count().count() == 2
    assert token_counts.count_tokens(no_docs, PIECE_BPE, cache).count() == 0


def test_a_count_that_is_missing_is_an_error(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(token_counts, "fill_cache", lambda *a: None)
    cache = shared_dir(spark, "cache")
    with pytest.raises(Exception, match="lacks the count"):
        token_counts.count_tokens(odd_docs, PIECE_BPE, cache).collect()


def test_known_texts_are_not_encoded_again(spark, odd_docs, monkeypatch):
    """Nothing is encoded where all digests are known; few and many misses give the same; a count stored twice counts once."""
    cache, other = shared_dir(spark, "cache"), shared_dir(spark, "cache")
    wanted = sorted(map(tuple, token_counts.count_tokens(odd_docs, PIECE_BPE, cache).collect()), key=repr)
    monkeypatch.setattr(token_counts, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, token_counts.count_tokens(odd_docs, PIECE_BPE, other).collect()), key=repr) == wanted
    token_counts.read_cache(spark, other).write.parquet(f"{cache}/run-again")
    monkeypatch.setattr(token_counts, "encode_misses", lambda *a: pytest.fail("encoded again"))
    assert sorted(map(tuple, token_counts.count_tokens(odd_docs, PIECE_BPE, cache).collect()), key=repr) == wanted


def test_stored_counts_are_used(spark):
    cache = shared_dir(spark, "cache")
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    docs.select(token_counts.content_digest(F.col("text")).alias("content")).selectExpr(
        "content", f"'{token_counts.tokenizer_version(PIECE_BPE)}' AS version", "12345L AS n_tokens"
    ).write.parquet(cache)
    assert token_counts.count_tokens(docs, PIECE_BPE, cache).first()["n_tokens"] == 12345


@pytest.fixture(scope="module")
def texts(spark):
    folder = f"{TESTDATA}/sf0.001"
    return folder, {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_codec_query_equals_the_library_on_the_whole_table(spark, texts):
    folder, by_id = texts
    rows = QUERIES["op4_bpe_codec"](spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(by_id) and len(rows) == len(by_id)
    for r in rows:
        want = expected(by_id[r["doc_id"]])
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_packing_query_equals_the_library_on_the_whole_table(spark, texts):
    folder, by_id = texts
    rows = QUERIES["op1_packing"](spark, folder).collect()
    seen = dict.fromkeys(by_id, 0)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        want = [*expected(by_id[r["doc_id"]]), 0]
        piece = np.array(want[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(piece.tobytes())
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(expected(t)) + 1 for i, t in by_id.items()}
    at = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert [s * 1024 + o for s, o, _ in at] == [0, *np.cumsum([n for *_, n in at])[:-1]] and all(o + n <= 1024 for _, o, n in at)


def test_count_query_equals_the_library_on_the_whole_table(spark, texts):
    folder, by_id = texts
    rows = QUERIES["op6_token_counts"](spark, folder).collect()
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows}
    counts = {i: len(pieces.encode(t)) for i, t in by_id.items()}
    assert found == {i: (len(t.encode()), counts[i], counts[i] > 4096) for i, t in by_id.items()}
