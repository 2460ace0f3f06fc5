"""The prefix trie against a walk over plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from claimcheck.llm import prefix_trie, queries
from tests.conftest import TESTDATA

CHATS = "conv_id long, turns array<struct<role:string,text:string>>"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(chats):
    members = {}
    for conv, turns in chats.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    rows = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(convs) if len(chats[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.select(COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("block", [1, 2, 3, 8])
def test_equals_plain_walk(spark, block):
    rng = random.Random(block)
    chats = {}
    for conv in range(-20, 60):
        base = list(chats.get(rng.randrange(-20, conv) if conv > -20 else 0, []))[: rng.randrange(8)]
        chats[conv] = base + [(rng.choice("ua"), rng.choice(["", "a b", "c\td e", "ü\xa0x"])) for _ in range(rng.choice([0, 0, 1, 2, 9]))]
    frame = spark.createDataFrame(list(chats.items()), CHATS)
    assert found(prefix_trie.prefix_trie(frame, block)) == plain_trie(chats)


def test_many_ends_in_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN_IDS", 3)
    chats = {c: [("u", "hi"), ("a", "there")] for c in range(-5, 40)}
    frame = spark.createDataFrame(list(chats.items()), CHATS).repartition(7)
    assert found(prefix_trie.prefix_trie(frame)) == plain_trie(chats)


def test_odd_rows(spark):
    rows = [
        (1, 1, None, None, "x"), (1, None, "b", "first", "x"), (1, 1, None, None, "x"), (2, 0, "a", "w " * 50_000, "x"),
        (None, 0, "a", "no conversation", "x"), (3, 5, "u", "t", "x"), (3, 5, "a", "t", "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")
    chats = {1: [("b", "first"), ("", ""), ("", "")], 2: [("a", "w " * 50_000)], 3: [("a", "t"), ("u", "t")]}
    read = prefix_trie.read_chats(turns)
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in read.collect()} == chats
    assert found(prefix_trie.prefix_trie(read)) == plain_trie(chats)
    assert prefix_trie.prefix_trie(prefix_trie.read_chats(turns.limit(0))).collect() == []
    bare = spark.createDataFrame([(7, None, "x"), (4, [], "x"), (5, [(None, None)], "x")], CHATS + ", node string")
    assert found(prefix_trie.prefix_trie(bare)) == plain_trie({7: [], 4: [], 5: [("", "")]})


def test_query_against_plain_walk(spark):
    folder = f"{TESTDATA}/sf0.001"
    own = {}
    for r in sorted(spark.read.parquet(f"{folder}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        own.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    rebuilt = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        rebuilt[conv] = own.get(conv - conv % 20, [])[:h] + turns[h:]
    assert found(queries.QUERIES["op13_prefix_trie"](spark, folder)) == plain_trie(rebuilt)
