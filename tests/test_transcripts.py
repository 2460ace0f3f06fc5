import json

import pytest
from pyspark.sql import functions as F

from claimcheck.operators import ordered, transcripts
from claimcheck.sources import attempts

SCHEMA = (
    "conv_id long, msg_idx long, block_idx long, role string, type string, id string, name string, input string, "
    "tool_use_id string, content string, is_error boolean"
)


def block(msg, i, role, kind, id=None, name=None, input=None, ref=None, content=None, error=False, conv=1):
    return (conv, msg, i, role, kind, id, name, input, ref, content, error)


BLOCKS = [
    block(0, 0, "user", "string", content="go"),
    block(1, 0, "assistant", "text", content="first"),
    block(1, 1, "assistant", "tool_use", "t1", "read_schema", "{}"),
    block(1, 2, "assistant", "text", content="second"),
    block(1, 3, "assistant", "tool_use", "t2", "query_sql", '{"query":"Q"}'),
    block(2, 0, "user", "tool_result", ref="t2", content="old"),
    block(2, 1, "user", "tool_result", ref="t1", content="schema"),
    block(2, 2, "user", "tool_result", ref="t2", content="new", error=True),
    block(2, 3, "user", "text", content="carry on"),
    block(3, 0, "assistant", "tool_use", "", "lost", "{}"),
    block(3, 1, "assistant", "tool_use", "t3", "query_sql", '{"query":"R"}'),
    block(4, 0, "user", "tool_result", ref="t9", content="stray"),
    block(5, 0, "assistant", "tool_use", "t1", "run_python", "{}"),
    block(6, 0, "user", "tool_result", ref="t1", content="ran"),
]


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame(BLOCKS, SCHEMA)


def test_pairs(blocks):
    rows = transcripts.tool_call_pairs(blocks).orderBy("pos").collect()
    assert [(r["id"], r["name"], r["content"]) for r in rows] == [
        ("t1", "run_python", "ran"), ("t2", "query_sql", "new"), ("t3", "query_sql", None), ("t1", "run_python", "ran"),
    ]
    first = {r["name"]: r["content"] for r in transcripts.first_tool_result(transcripts.tool_call_pairs(blocks)).collect()}
    assert first == {"run_python": "ran", "query_sql": "new"}
    assert transcripts.first_tool_result(transcripts.tool_call_pairs(blocks), query="R").count() == 0


def test_reshape(spark, blocks):
    system = spark.createDataFrame([(1, "rules")], "conv_id long, content string")
    rows = transcripts.chat_reshape(blocks, system).orderBy("pos").collect()
    assert [(r["role"], r["content"], r["tool_name"]) for r in rows] == [
        ("system", "rules", None), ("user", "go", None), ("assistant", "first\nsecond", None),
        ("tool", "old", "query_sql"), ("tool", "schema", "read_schema"), ("tool", "ERROR: new", "query_sql"),
        ("user", "carry on", None), ("assistant", "", None), ("tool", "stray", ""), ("assistant", "", None),
        ("tool", "ran", "run_python"),
    ]
    assert json.loads(rows[2]["tool_calls"]) == [
        {"type": "function", "function": {"name": "read_schema", "arguments": {}}},
        {"type": "function", "function": {"name": "query_sql", "arguments": {"query": "Q"}}},
    ]
    assert rows[3]["tool_calls"] is None


def test_responses(spark):
    def call(arguments, name="f"):
        return {"function": {"name": name, "arguments": arguments}}

    raw = [
        (1, 0, {"message": {"content": " ", "tool_calls": [call({"a": 1}), call('{"b": 2}')]}}),
        (1, 1, {"message": {"content": "hi"}}),
        (1, 2, {"message": {"content": "x", "tool_calls": [call("junk"), call("[1]"), call(None), {}]}}),
        (2, 0, {"message": {"tool_calls": [call({})]}}),
        (3, 0, {}),
    ]
    frame = spark.createDataFrame([(c, i, json.dumps(r)) for c, i, r in raw], "conv_id long, response_idx long, raw string")
    rows = transcripts.response_blocks(frame).orderBy("conv_id", "response_idx", "block_idx").collect()
    assert [(r["conv_id"], r["stop_reason"], r["type"], r["text"], r["id"], r["input"]) for r in rows] == [
        (1, "tool_use", "tool_use", None, "toolu_1", '{"a":1}'),
        (1, "tool_use", "tool_use", None, "toolu_2", '{"b":2}'),
        (1, "end_turn", "text", "hi", None, None),
        (1, "tool_use", "text", "x", None, None),
        (1, "tool_use", "tool_use", None, "toolu_3", "{}"),
        (1, "tool_use", "tool_use", None, "toolu_4", "{}"),
        (1, "tool_use", "tool_use", None, "toolu_5", "{}"),
        (1, "tool_use", "tool_use", None, "toolu_6", "{}"),
        (2, "tool_use", "tool_use", None, "toolu_1", "{}"),
    ]


def test_slices_do_not_change_ordered_results(spark):
    frame = spark.range(2000).selectExpr(
        "id % 3 AS k", "id AS o", "CASE WHEN id % 7 = 0 THEN id END AS v", "1 AS one"
    )
    for size in (1, 10, 10_000):
        sliced = frame.withColumn("s", F.floor(F.col("o") / size))
        last = ordered.carried_last(sliced, ["k"], "o", "s", F.col("v"), "last")
        total = ordered.running_total(sliced, ["k"], "o", "s", F.col("one"), "before")
        lasts = {r["o"]: r["last"] for r in last.collect()}
        totals = {r["o"]: r["before"] for r in total.collect()}
        for o in range(2000):
            earlier = [i for i in range(o % 3, o, 3) if i % 7 == 0]
            assert lasts[o] == (earlier[-1] if earlier else None)
            assert totals[o] == o // 3


def test_attempt_log(spark, tmp_path):
    log = spark.createDataFrame(
        [(1, "gave up", 10.06, 20), (2, "gave up", 5.0, 18), (3, "lost", 1.0, 2)],
        "attempt int, error string, wall_clock_s double, n_calls int",
    )
    rows = {r["error"]: tuple(r)[1:] for r in attempts.attempt_log_summary(log).collect()}
    assert rows == {"gave up": (2, 15.1, 10.06, 38), "lost": (1, 1.0, 1.0, 2)}
    attempts.write_attempt_log(log, str(tmp_path / "log"))
    assert {r["wall_clock_s"] for r in spark.read.json(str(tmp_path / "log")).collect()} == {10.1, 5.0, 1.0}
