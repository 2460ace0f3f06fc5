"""Archives, chats and top-k search against plain Python."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimcheck.llm import chat, top_k, warc
from claimcheck.llm.shared import shared_dir

PAGES = "page_id long, url string, html string, digest string, leader long"


@pytest.fixture(scope="module")
def pages(spark):
    html = ["<p>é</p>", None, "", "<p>é</p>", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "x" * 300_000, "<p>é</p>"]
    rows = [(9 - i, None if i == 2 else f"http://h/{i} \r\nX: y", h, "clash", 5) for i, h in enumerate(html)]
    return spark.createDataFrame([*rows, rows[0], (None, "u", "no id", "c", 1)], PAGES)


def test_round_trip(spark, pages):
    folder = warc.write_archives(pages)
    back = warc.read_archives(spark, folder)
    assert back.where("kind = 'gap'").count() == 0
    found = warc.page_records(back).collect()
    wanted = []
    rows = pages.collect()
    for r in rows:
        body = (r["html"] or "").encode()
        leader = min((x["page_id"] for x in rows if (x["html"] or "") == (r["html"] or "") and x["page_id"] is not None), default=None)
        kind = "response" if leader in (None, r["page_id"]) else "revisit"
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        wanted.append((r["page_id"], len(body), digest, kind, leader if kind == "revisit" else None, body if kind == "response" else b""))
    assert sorted([(*tuple(r)[:5], bytes(r["payload"])) for r in found], key=repr) == sorted(wanted, key=repr)


def test_small_payloads_may_stay_responses(spark, pages):
    back = warc.page_records(warc.read_archives(spark, warc.write_archives(pages, min_bytes=1)))
    assert back.where("payload_bytes = 0 AND record_type = 'response'").count() == 2


def test_archives_of_nothing(spark):
    empty = spark.createDataFrame([], PAGES)
    assert warc.page_records(warc.read_archives(spark, warc.write_archives(empty))).count() == 0


def record(i, body=b"payload"):
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def ids(data):
    return [h["WARC-Record-ID"] for kind, _, _, h, _ in warc.salvage(data) if kind == "record"]


def gaps(data):
    return [(at, n) for kind, at, n, _, _ in warc.salvage(data) if kind == "gap"]


def test_salvage_of_damage():
    parts = [record(i, bytes([65 + i]) * 50) for i in range(5)]
    whole = b"".join(parts)
    assert len(ids(whole)) == 5 and gaps(whole) == []
    flipped = bytearray(whole)
    flipped[len(parts[0]) + len(parts[1]) - 10] ^= 1
    assert ids(bytes(flipped)) == [f"<urn:page:{i}>" for i in (0, 2, 3, 4)]
    assert gaps(bytes(flipped)) == [(len(parts[0]), len(parts[1]))]
    cut = parts[0] + parts[1][:-30] + parts[2] + b"trailing"
    assert ids(cut) == ["<urn:page:0>", "<urn:page:2>"] and sum(n for _, n in gaps(cut)) == len(parts[1]) - 30 + 8
    assert ids(b"junk" + parts[3]) == ["<urn:page:3>"] and ids(b"") == [] and gaps(b"junk") == [(0, 4)]


def test_a_length_that_reaches_into_the_next_record():
    broken = record(1).replace(b"Content-Length: 7", b"Content-Length: 99")
    assert ids(record(0) + broken + record(2)) == ["<urn:page:0>", "<urn:page:2>"]


def test_salvage_of_compressed_members():
    members = [gzip.compress(record(i, bytes([65 + i]) * 500)) for i in range(4)]
    data = b"".join(members)
    assert len(ids(data)) == 4
    hurt = bytearray(data)
    hurt[len(members[0]) + 25] ^= 0xFF
    assert ids(bytes(hurt)) == [f"<urn:page:{i}>" for i in (0, 2, 3)]
    assert gaps(bytes(hurt)) == [(len(members[0]), len(members[1]))]
    assert ids(record(7) + members[1] + record(8)) == ["<urn:page:7>", "<urn:page:1>", "<urn:page:8>"]


def test_every_byte_is_in_a_record_or_a_gap():
    rng = random.Random(4)
    for _ in range(50):
        data = bytearray(b"".join(record(i, rng.randbytes(rng.randrange(60))) for i in range(6)))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(data))
            data[at : at + rng.randrange(20)] = rng.randbytes(rng.randrange(20))
        found = list(warc.salvage(bytes(data)))
        assert sum(n for _, _, n, _, _ in found) == len(data)
        assert [at for _, at, *_ in found] == sorted(at for _, at, *_ in found)


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a <turn user>\nb"), (1, 2, "assistant", "\\l \\\\< </turn>\n ok"),
    (2, 1, "assistant", "second"), (2, 0, "user", None), (3, 0, None, ""), (3, 1, "odd >role\\", "x"),
    (4, 0, "user", "é🙂" * 20_000), (4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (None, None, "user", "lost"),
    (5, 0, "user", "a"), (5, 1, "assistant", "b"), (5, 2, "tool", "c"), (5, 3, "assistant", "d"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*t, "x", "y") for t in TURNS], "conv_id long, turn long, role string, text string, segments string, turns string")


def test_chats_read_back(turns):
    frame = chat.format_chats(turns)
    back = frame.select("conv_id", "n_turns", "valid", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("loss"))
    found = {r["conv_id"]: r for r in back.collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted([(t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv])
        row = found[conv]
        assert [tuple(t) for t in row["t"]] == [t[1:] for t in own] and row["n_turns"] == len(own)
        assert row["loss"] == "".join(text for _, role, text in own if role == "assistant")
        assert row["formatted"].count("</turn>\n") == len(own)
    assert {c: r["valid"] for c, r in found.items()} == {1: True, 2: True, 3: False, 4: False, None: False, 5: True}


def test_segments_make_up_the_text(turns):
    for r in chat.format_chats(turns).collect():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]


def test_chats_of_nothing(turns):
    assert chat.format_chats(turns.limit(0)).count() == 0


def brute_force(queries, rows, k):
    out = []
    for qid, q in queries.items():
        scores = sorted((-int(np.dot(q, v)), i) for i, v in rows if i != qid and len(v) == len(q))
        out += [(qid, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [3, 60, 10**6, 10**9])
def test_top_k_equals_brute_force(spread):
    """Narrow spreads make ties; wide ones need 64-bit sums."""
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (20_000, 6))
    ids = rng.permutation(20_000)
    q = x[:30]
    found = top_k.search_block(ids[:30], q, ids, x, 20)
    for qid, v in zip(ids[:30], q):
        scores = x @ v
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != qid][:20]
        assert [(int(ids[i]), int(scores[i])) for i in order] == [(b, c) for a, b, c in found if a == qid]


def test_top_k_with_many_rows_of_the_query():
    """Rows that repeat the query's id and outscore all others neither count nor hide others."""
    rng = np.random.default_rng(5)
    x = rng.integers(-60, 61, (5_000, 4))
    ids = np.arange(5_000)
    ids[:400], x[:400] = 7, 60
    found = top_k.search_block(np.array([7]), np.full((1, 4), 60), ids, x, 20)
    scores = x @ np.full(4, 60)
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != 7][:20]
    assert [(b, c) for _, b, c in found] == [(int(ids[i]), int(scores[i])) for i in order]


def test_top_k_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, None), (6, [1.0, None]), (7, [-1.0, 0.1]), (7, [-1.0, 0.1]), (None, [1.0, 1.0]), (8, [1.0]), (20, [2.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, score int")
    whole = frame.select("vec_id", top_k.quantised(F.col("embedding")).alias("v"), "score")
    rows = [(r["vec_id"], r["v"]) for r in whole.collect() if r["v"] is not None and r["vec_id"] is not None]
    assert [i for i, _ in rows] == [1, 2, 7, 7, 8, 20] and rows[0][1] == [32, -16]
    found = sorted(map(tuple, top_k.top_k(whole.where("vec_id IN (1, 7, 8, 20)"), whole, 3).collect()))
    assert found == brute_force({i: v for i, v in rows if i != 2}, rows, 3)
    assert top_k.top_k(whole.limit(0), whole, 3).count() == 0 and top_k.top_k(whole, whole.limit(0), 3).count() == 0
