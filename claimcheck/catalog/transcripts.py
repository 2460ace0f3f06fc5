"""Tool-call transcripts made from the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimcheck.catalog import derived, query
from claimcheck.operators import transcripts
from claimcheck.sources.attempts import attempt_log_summary

# An assistant turn says its text and makes one call; the next user turn is the call's result.
# Every fifth conversation speaks in plain strings, every seventh fails its calls, and
# every eleventh asks again under an id it has used before.
CALL_ID = """CASE WHEN conv_id % 11 = 0 THEN concat('c', conv_id, '_1')
  WHEN conv_id % 13 = 0 AND turn > 2 THEN '' ELSE concat('c', conv_id, '_t', turn) END"""
TURNS = f"""
SELECT conv_id, turn, role, text, conv_id % 5 = 0 AS plain, conv_id % 7 = 0 AS failed,
  {CALL_ID} AS call_id, {CALL_ID.replace('turn >', 'turn - 1 >').replace("'_t', turn", "'_t', turn - 1")} AS answered_id,
  CASE turn % 4 WHEN 1 THEN 'query_sql' ELSE 'run_python' END AS tool,
  concat('{{"query":"SELECT ', turn, '"}}') AS arguments
FROM conversations
"""
_NONE = "CAST(NULL AS STRING)"
BLOCKS = f"""
SELECT conv_id, turn AS msg_idx, CAST(0 AS BIGINT) AS block_idx, role, 'string' AS type, {_NONE} AS id, {_NONE} AS name,
  {_NONE} AS input, {_NONE} AS tool_use_id, text AS content, false AS is_error
FROM ({TURNS}) a WHERE plain OR role = 'system' OR (role = 'user' AND turn = 0)
UNION ALL SELECT conv_id, turn, 0, role, 'text', NULL, NULL, NULL, NULL, text, false FROM ({TURNS}) b WHERE NOT plain AND role = 'assistant'
UNION ALL SELECT conv_id, turn, 1, role, 'tool_use', call_id, tool, arguments, NULL, NULL, false FROM ({TURNS}) c WHERE NOT plain AND role = 'assistant'
UNION ALL SELECT conv_id, turn, 0, role, 'tool_result', NULL, NULL, NULL, answered_id, text, failed FROM ({TURNS}) d
WHERE NOT plain AND role = 'user' AND turn > 0
"""


def blocks(spark, sf_dir):
    return derived(spark, sf_dir, BLOCKS, "conversations")


PAIRS = f"""
WITH b AS (SELECT *, msg_idx * 1048576 + block_idx AS pos FROM ({BLOCKS})),
calls AS (SELECT * FROM b WHERE type = 'tool_use' AND id <> ''),
latest AS (SELECT conv_id, id, max(pos) AS pos FROM calls GROUP BY ALL),
last_call AS (SELECT c.* FROM calls c JOIN latest l ON l.conv_id = c.conv_id AND l.id = c.id AND l.pos = c.pos),
answers AS (SELECT conv_id, tool_use_id, max(pos) AS pos, arg_max(content, pos) AS content FROM b WHERE type = 'tool_result' GROUP BY ALL)
SELECT c.conv_id, c.pos::BIGINT AS pos, c.id, k.name, k.input, CASE WHEN a.pos > k.pos THEN a.content END AS content
FROM calls c JOIN last_call k ON k.conv_id = c.conv_id AND k.id = c.id
LEFT JOIN answers a ON a.conv_id = c.conv_id AND a.tool_use_id = c.id
"""


@query("tool_call_pairs", PAIRS)
def tool_call_pairs(spark, sf_dir):
    return transcripts.tool_call_pairs(blocks(spark, sf_dir))


@query(
    "first_tool_result",
    f"SELECT conv_id, name, arg_min(content, pos) AS content FROM ({PAIRS}) WHERE content IS NOT NULL GROUP BY conv_id, name",
)
def first_tool_result(spark, sf_dir):
    return transcripts.first_tool_result(transcripts.tool_call_pairs(blocks(spark, sf_dir)))


@query(
    "first_query_result",
    f"SELECT conv_id, name, arg_min(content, pos) AS content FROM ({PAIRS}) "
    "WHERE content IS NOT NULL AND input = '{\"query\":\"SELECT 1\"}' GROUP BY conv_id, name",
)
def first_query_result(spark, sf_dir):
    pairs = transcripts.tool_call_pairs(blocks(spark, sf_dir))
    return transcripts.first_tool_result(pairs, query="SELECT 1")


@query(
    "chat_reshape",
    f"""
WITH b AS (SELECT *, msg_idx * 1048576 + block_idx AS pos FROM ({BLOCKS})),
calls AS (SELECT conv_id, id, name, pos FROM b WHERE type = 'tool_use')
SELECT conv_id, pos::BIGINT AS pos, role, content, NULL AS tool_name, NULL AS tool_calls FROM b WHERE type = 'string'
UNION ALL SELECT t.conv_id, t.pos, 'assistant', t.content, NULL, concat('[{{"type":"function","function":{{"name":"', c.name,
  '","arguments":', c.input, '}}}}]')
FROM b t JOIN b c ON c.conv_id = t.conv_id AND c.msg_idx = t.msg_idx AND c.type = 'tool_use' WHERE t.type = 'text'
UNION ALL SELECT r.conv_id, r.pos, 'tool', concat(CASE WHEN r.is_error THEN 'ERROR: ' ELSE '' END, r.content),
  coalesce((SELECT arg_max(c.name, c.pos) FROM calls c WHERE c.conv_id = r.conv_id AND c.id = r.tool_use_id
            AND r.tool_use_id <> '' AND c.pos < r.pos), ''), NULL
FROM b r WHERE r.type = 'tool_result'
UNION ALL SELECT DISTINCT conv_id, -1, 'system', 'You check claims.', NULL, NULL FROM b
""",
)
def chat_reshape(spark, sf_dir):
    made = blocks(spark, sf_dir)
    system = made.select("conv_id").distinct().withColumn("content", F.lit("You check claims."))
    return transcripts.chat_reshape(made, system)


RESPONSES = """
SELECT conv_id, turn AS response_idx, turn % 4 AS kind, conv_id % 5 AS c,
  CASE conv_id % 5
    WHEN 0 THEN concat('{"message":{"content":"hello ', turn, '"}}')
    WHEN 1 THEN concat('{"message":{"content":"  ","tool_calls":[{"function":{"name":"query_sql","arguments":{"q":', turn, '}}}]}}')
    WHEN 2 THEN concat('{"message":{"content":"on it","tool_calls":[{"function":{"name":"a","arguments":"{\\\\"q\\\\":', turn,
      '}"}},{"function":{"name":"b","arguments":"junk"}}]}}')
    WHEN 3 THEN '{"message":{"tool_calls":[{"function":{"arguments":[1,2]}}]}}'
    ELSE 'not json' END AS raw
FROM conversations WHERE role = 'assistant'
"""
_DUCK_RESPONSES = RESPONSES.replace("\\\\", "\\")


@query(
    "response_blocks",
    f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY response_idx) - 1 AS i FROM ({_DUCK_RESPONSES}))
SELECT conv_id, response_idx, 'end_turn' AS stop_reason, 0 AS block_idx, 'text' AS type, concat('hello ', response_idx) AS text,
  NULL AS id, NULL AS name, NULL AS input FROM r WHERE c = 0
UNION ALL SELECT conv_id, response_idx, 'tool_use', 0, 'tool_use', NULL, concat('toolu_', i + 1), 'query_sql',
  concat('{{"q":', response_idx, '}}') FROM r WHERE c = 1
UNION ALL SELECT conv_id, response_idx, 'tool_use', 0, 'text', 'on it', NULL, NULL, NULL FROM r WHERE c = 2
UNION ALL SELECT conv_id, response_idx, 'tool_use', 1, 'tool_use', NULL, concat('toolu_', 2 * i + 1), 'a',
  concat('{{"q":', response_idx, '}}') FROM r WHERE c = 2
UNION ALL SELECT conv_id, response_idx, 'tool_use', 2, 'tool_use', NULL, concat('toolu_', 2 * i + 2), 'b', '{{}}' FROM r WHERE c = 2
UNION ALL SELECT conv_id, response_idx, 'tool_use', 0, 'tool_use', NULL, concat('toolu_', i + 1), '', '{{}}' FROM r WHERE c = 3
""",
)
def response_blocks(spark, sf_dir):
    return transcripts.response_blocks(derived(spark, sf_dir, RESPONSES, "conversations"))


ATTEMPTS = """
SELECT event_id AS attempt, CASE WHEN event_id % 2 = 0 THEN 'no report after 20 iterations' ELSE concat('tool failed: ', event_type) END AS error,
  value AS wall_clock_s, event_id % 20 AS n_calls
FROM events
"""


@query(
    "attempt_log_summary",
    f"SELECT error, count(*)::BIGINT AS n_attempts, round(sum(wall_clock_s), 1) AS wall_clock_s, max(wall_clock_s) AS longest_s, "
    f"sum(n_calls)::BIGINT AS n_calls FROM ({ATTEMPTS}) GROUP BY error",
)
def attempts(spark, sf_dir):
    return attempt_log_summary(derived(spark, sf_dir, ATTEMPTS, "events"))
