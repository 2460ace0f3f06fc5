"""Prefix trie of conversations, built from blocks of turns.

A conversation is a chain of digests, one per turn, each over all turns so far. Its turns are cut
into blocks of fixed length, and only blocks are grouped first: a block's last digest stands for
every turn up to there. Where one block alone continues a parent, all its turns have the block's
members, and nothing more is counted. Where siblings diverge, the distinct blocks (not the
conversations) are opened, and their turns are grouped again.

Subtree totals need no walk over the tree. Every node belongs to its smallest member, so that a
conversation owns a tail of its own path. What it saves is the part before that tail, and it owns
at most one leaf; the totals of a node are sums of these two numbers over its members, again
grouped by block and refined where blocks diverge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from claimcheck.llm.shared import written

BLOCK_TURNS = 8
# Ids of one node that are joined to one text before the texts are hashed in order.
RUN_IDS = 4096
SLICE_CHATS = 256
ROOT = bytes(16)
PATHS = "conv_id long, path array<struct<node:binary,words:long,total:long>>"
PATH_TYPE = pa.list_(pa.struct([("node", pa.binary()), ("words", pa.int64()), ("total", pa.int64())]))


def read_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array of role and text) per conversation of a table conv_id, turn, role, text.

    Turns are ordered by turn, nulls first, ties by role and text; rows that repeat stay. Null role and
    text are empty. Rows without conv_id belong to no conversation; other columns are not read.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(turn)).alias("t")
    )
    return chats.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def graft(chats: DataFrame, base: Column, keep: Column) -> DataFrame:
    """`chats` whose first `keep` turns come from the conversation `base`: fewer if it has fewer, none if it is absent."""
    bases = chats.select(F.col("conv_id").alias("base_id"), F.col("turns").alias("base_turns"))
    asked = chats.withColumns({"asked": base, "keep": keep})
    joined = asked.join(bases, F.col("asked") == F.col("base_id"), "left")
    head = F.slice(F.coalesce("base_turns", F.slice("turns", F.lit(1), F.lit(0))), F.lit(1), F.col("keep"))
    own = F.slice("turns", F.col("keep") + 1, F.greatest(F.size("turns") - F.col("keep"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def paths(chats: DataFrame) -> DataFrame:
    """(conv_id, path): per turn the digest of all turns so far, its own words, and the words so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_CHATS):
                batch, out = whole.slice(at, SLICE_CHATS), []
                for chat in batch.column("turns").to_pylist():
                    path, node, total = [], ROOT, 0
                    for turn in chat or []:
                        role, text = (turn["role"] or "").encode(), (turn["text"] or "").encode()
                        # The length of the role keeps role and text apart.
                        node = xxhash.xxh3_128_digest(node + len(role).to_bytes(8, "little") + role + text)
                        words = len(text.split())
                        total += words
                        path.append({"node": node, "words": words, "total": total})
                    out.append(path)
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(out, PATH_TYPE)], ["conv_id", "path"])

    return chats.select("conv_id", "turns").mapInArrow(run, PATHS)


def _node_at(i: Column) -> Column:
    """The node after `i` turns."""
    return F.when(i == 0, F.lit(ROOT)).otherwise(F.col("path")[i - 1]["node"])


def _blocks(frame: DataFrame, block_turns: int, *kept: str) -> DataFrame:
    """A row per block of every path: start, block (its last node) and the columns `kept`."""
    start = F.explode(F.sequence(F.lit(0), F.size("path") - 1, F.lit(block_turns))).alias("start")
    cut = frame.where(F.size("path") > 0).select("path", start, *kept)
    return cut.withColumn("block", _node_at(F.least(F.col("start") + block_turns, F.size("path"))))


def _refined(blocks: DataFrame, sums: list[str], least: str | None = None) -> DataFrame:
    """Per node of the blocks: depth, parent, words, total, and `sums` and `least` over the blocks it lies in.

    blocks: parent, start, turns, single, and the columns to add up. A block that alone continues
    its parent gives its numbers to all its turns; the turns of the others are grouped.
    """
    opened = blocks.select("parent", "start", "single", "turns", *sums, *filter(None, [least]), F.posexplode("turns").alias("i", "turn")).select(
        F.col("turn.node").alias("node"),
        (F.col("start") + F.col("i") + 1).cast("long").alias("depth"),
        F.when(F.col("i") == 0, F.col("parent")).otherwise(F.col("turns")[F.col("i") - 1]["node"]).alias("parent"),
        F.col("turn.words").alias("words"),
        F.col("turn.total").alias("total"),
        *sums, *filter(None, [least]), "single",
    )
    keys = ["node", "depth", "parent", "words", "total"]
    adding = [F.sum(c).alias(c) for c in sums] + ([F.min(least).alias(least)] if least else [])
    same = opened.where("single").drop("single")
    return same.unionByName(opened.where("NOT single").groupBy(*keys).agg(*adding))


def id_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): SHA-256 of the ids in ascending order, comma-joined.

    Ids are range-partitioned by node and id, so that a node with a third of all ids is spread over
    partitions; each partition joins up to RUN_IDS neighbours to one text. Only these texts meet in
    the task that hashes a node, one in memory at a time.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, int, str]]:
            node, ids = None, []
            for batch in batches:
                for n, i in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                    if ids and (n != node or len(ids) == RUN_IDS):
                        yield node, ids[0], ",".join(map(str, ids))
                        ids = []
                    node = n
                    ids.append(i)
            if ids:
                yield node, ids[0], ",".join(map(str, ids))

        yield from _batched(rows(), [("node", pa.binary()), ("first_id", pa.int64()), ("ids", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, str]]:
            node = digest = None
            for batch in batches:
                for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                    if n == node:
                        digest.update(b"," + ids.encode())
                        continue
                    if digest:
                        yield node, digest.hexdigest()
                    node, digest = n, hashlib.sha256(ids.encode())
            if digest:
                yield node, digest.hexdigest()

        yield from _batched(rows(), [("node", pa.binary()), ("ends_sha256", pa.string())])

    ordered = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    packed = written(ordered.mapInArrow(runs, "node binary, first_id long, ids string"), "trie-ends")
    return packed.repartition("node").sortWithinPartitions("node", "first_id").mapInArrow(hashed, "node binary, ends_sha256 string")


def _batched(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    chunk = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == most:
            yield _batch(chunk, fields)
            chunk = []
    if chunk:
        yield _batch(chunk, fields)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])


def prefix_trie(chats: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per distinct sequence of first turns: node, conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    chats: conv_id, turns (array of role and text); conv_id must be unique and not null, a null array or one
    without turns is a member of the root alone. Null role and text are empty. No conversations, no rows. Other
    columns are not read. One conversation fits a task.
    saved_tokens: words that members share with a smaller one, over the node's subtree. ends_sha256: digest
    of the ids that end here; the empty string's if none do. Nodes are 128-bit digests of their turns.
    """
    convs = written(paths(chats), "trie-paths")
    rows = _blocks(convs, block_turns, "conv_id").select(
        "block", _node_at(F.col("start")).alias("parent"), "start", F.slice("path", F.col("start") + 1, F.lit(block_turns)).alias("turns"), "conv_id"
    )
    found = written(
        rows.groupBy("block").agg(
            F.first("parent").alias("parent"), F.first("start").alias("start"), F.first("turns").alias("turns"),
            F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"),
        ),
        "trie-blocks",
    )
    alone = found.groupBy("parent").agg(F.count("*").alias("n"), F.min("block").alias("block")).where("n = 1").select("block", F.lit(True).alias("single"))
    blocks = written(found.join(alone, "block", "left").withColumn("single", F.coalesce("single", F.lit(False))), "trie-siblings")

    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner")).where("n_convs > 0").select(
        F.lit(ROOT).alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("total"), "n_convs", "owner",
    )
    counted = root.unionByName(_refined(blocks, ["n_convs"], "owner"))
    counted = written(counted, "trie-counts")
    children = counted.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(counted.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")

    # What the owner of a node shares with smaller conversations ends before the first node that it owns.
    owners = nodes.groupBy("owner").agg(
        F.min(F.col("total") - F.col("words")).alias("shared"), F.max((F.col("n_children") == 0).cast("long")).alias("leaves")
    )
    owners = written(owners, "trie-owners")
    mine = convs.join(owners, F.col("conv_id") == F.col("owner"), "left").select(
        "conv_id", F.transform("path", lambda t: F.struct(t["node"].alias("node"))).alias("path"),
        # A conversation without a node of its own repeats a smaller one in full.
        F.coalesce("shared", F.try_element_at("path", F.lit(-1))["total"], F.lit(0)).alias("shared"),
        F.coalesce("leaves", F.lit(0)).alias("leaves"),
    )
    mine = written(mine, "trie-shares")
    sums = _blocks(mine, block_turns, "shared", "leaves").groupBy("block").agg(F.sum("shared").alias("shared"), F.sum("leaves").alias("leaves"))
    below = _refined(blocks.join(sums, "block"), ["shared", "leaves"]).select("node", "shared", "leaves")
    top = mine.agg(F.sum("shared").alias("shared"), F.sum("leaves").alias("leaves")).select(F.lit(ROOT).alias("node"), "shared", "leaves")
    totals = below.unionByName(top.where("leaves IS NOT NULL"))

    ends = written(convs.select(_node_at(F.size("path")).alias("node"), "conv_id"), "trie-ends-of")
    parents = nodes.select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id"))
    own = owners.select("owner", F.col("shared").alias("owner_shared"))
    joined = (
        nodes.join(totals, "node")
        .join(own, "owner")
        .join(id_digests(ends), "node", "left")
        .join(parents, "parent", "left")
    )
    before = F.col("total") - F.col("words")
    return joined.select(
        "node",
        F.col("owner").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        (F.col("shared") - F.col("owner_shared") - (F.col("n_convs") - 1) * before).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
