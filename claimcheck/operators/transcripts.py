"""Tool-call transcripts as tables.

A blocks table holds conv_id, msg_idx, block_idx, role, type, id, name, input, tool_use_id,
content, is_error. `type` is 'text', 'tool_use' or 'tool_result', or 'string' for a message
whose content is one plain string. A message's block_idx stays below 2**20.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimcheck.operators.ordered import carried_last, running_total

# Positions hold the block below these bits; a message with more blocks is an error, never a mix-up.
BLOCK_BITS = 20
# Messages (or responses) of one conversation handled by one task.
SLICE = 4096


def position(msg_idx: Column, block_idx: Column) -> Column:
    """Block order within a conversation as one number."""
    fits = F.when(block_idx < 1 << BLOCK_BITS, block_idx.cast("bigint")).when(
        block_idx.isNotNull(), F.raise_error(F.lit("a message has too many blocks")).cast("bigint")
    )
    return F.shiftleft(msg_idx.cast("bigint"), BLOCK_BITS) + fits


def with_position(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("pos", position(F.col("msg_idx"), F.col("block_idx")))


def tool_call_pairs(blocks: DataFrame) -> DataFrame:
    """Each call with its last result: conv_id, pos, id, name, input, content.

    Calls without an id are dropped; a call nobody answered keeps a NULL content. A reused id
    stands for its latest call, and only a result after that call counts.
    """
    placed = with_position(blocks)
    calls = placed.where((F.col("type") == "tool_use") & (F.col("id") != ""))
    latest = calls.groupBy("conv_id", "id").agg(
        F.max(F.struct("pos", "name", "input")).alias("call")
    )
    results = (
        placed.where(F.col("type") == "tool_result")
        .groupBy("conv_id", F.col("tool_use_id").alias("id"))
        .agg(F.max(F.struct("pos", "content")).alias("result"))
    )
    answered = latest.join(results, ["conv_id", "id"], "left").select(
        "conv_id",
        "id",
        "call.name",
        "call.input",
        F.when(F.col("result.pos") > F.col("call.pos"), F.col("result.content")).alias("content"),
    )
    return calls.select("conv_id", "id", "pos").join(answered, ["conv_id", "id"]).select(
        "conv_id", "pos", "id", "name", "input", "content"
    )


def first_tool_result(pairs: DataFrame, query: str | None = None) -> DataFrame:
    """Content of the first completed call per conversation and tool, optionally of one query only."""
    done = pairs.where(F.col("content").isNotNull())
    if query is not None:
        done = done.where(F.try_variant_get(F.try_parse_json("input"), "$.query", "string") == query)
    return done.groupBy("conv_id", "name").agg(F.min_by("content", "pos").alias("content"))


def chat_reshape(blocks: DataFrame, system: DataFrame | None = None) -> DataFrame:
    """Flat chat rows: conv_id, pos, role, content, tool_name, tool_calls.

    Assistant blocks of one message become one row; every result becomes a `tool` row with
    the name its id had in the calls before it. `system` (conv_id, content) opens a conversation.
    """
    placed = with_position(blocks)
    nothing = F.lit(None).cast("string")
    plain = placed.where(
        (F.col("type") == "string") | ((F.col("role") != "assistant") & (F.col("type") == "text"))
    ).select(
        "conv_id", "pos",
        F.when(F.col("type") == "string", F.col("role")).otherwise("user").alias("role"),
        F.coalesce("content", F.lit("")).alias("content"),
        nothing.alias("tool_name"), nothing.alias("tool_calls"),
    )
    call = F.struct(
        F.lit("function").alias("type"),
        F.struct(
            F.coalesce("name", F.lit("")).alias("name"),
            F.coalesce(F.try_parse_json("input"), F.parse_json(F.lit("{}"))).alias("arguments"),
        ).alias("function"),
    )
    text = F.when(F.col("type") == "text", F.struct("pos", F.coalesce("content", F.lit("")).alias("text")))
    use = F.when(F.col("type") == "tool_use", F.struct("pos", F.to_json(call).alias("call")))
    said = (
        placed.where((F.col("role") == "assistant") & (F.col("type") != "string"))
        .groupBy("conv_id", "msg_idx")
        .agg(
            F.min("pos").alias("pos"),
            F.array_sort(F.collect_list(text)).alias("texts"),
            F.array_sort(F.collect_list(use)).alias("calls"),
        )
        .select(
            "conv_id", "pos", F.lit("assistant").alias("role"),
            F.array_join(F.col("texts.text"), "\n").alias("content"),
            nothing.alias("tool_name"),
            F.when(
                F.size("calls") > 0,
                F.concat(F.lit("["), F.array_join(F.col("calls.call"), ","), F.lit("]")),
            ).alias("tool_calls"),
        )
    )
    rows = plain.unionByName(said).unionByName(_result_rows(placed))
    if system is not None:
        opening = system.select(
            "conv_id", F.lit(-1).cast("bigint").alias("pos"), F.lit("system").alias("role"), "content",
            nothing.alias("tool_name"), nothing.alias("tool_calls"),
        )
        rows = opening.unionByName(rows)
    return rows


def _result_rows(placed: DataFrame) -> DataFrame:
    """Tool rows, named by the latest earlier call with the same id."""
    is_call = F.col("type") == "tool_use"
    is_result = (F.col("type") == "tool_result") & (F.col("role") != "assistant")
    shown = F.concat(
        F.when(F.col("is_error"), "ERROR: ").otherwise(""), F.coalesce("content", F.lit(""))
    )
    called = F.when(is_call, F.col("id")).otherwise(F.col("tool_use_id"))
    events = placed.where((is_call & (F.col("role") == "assistant")) | is_result).select(
        "conv_id", "pos", F.nullif(called, F.lit("")).alias("call_id"),
        F.when(is_call, F.coalesce("name", F.lit(""))).alias("name"),
        is_result.alias("is_result"), shown.alias("content"),
        F.floor(F.col("msg_idx") / SLICE).alias("slice"),
    )
    named = carried_last(
        events.where(F.col("call_id").isNotNull()), ["conv_id", "call_id"], "pos", "slice", F.col("name"), "tool_name"
    )
    unnamed = events.where(F.col("call_id").isNull()).withColumn("tool_name", F.lit(None).cast("string"))
    return named.unionByName(unnamed).where("is_result").select(
        "conv_id", "pos", F.lit("tool").alias("role"), "content",
        F.coalesce("tool_name", F.lit("")).alias("tool_name"),
        F.lit(None).cast("string").alias("tool_calls"),
    )


def response_blocks(responses: DataFrame, id_prefix: str = "toolu_") -> DataFrame:
    """Raw chat responses (conv_id, response_idx, raw JSON) as blocks plus a stop reason.

    Blank text is skipped, arguments may be an object or a JSON string of one (anything else
    reads as {}), and calls are numbered through the whole conversation.
    """
    raw = F.try_parse_json("raw")
    parsed = responses.select(
        "conv_id", "response_idx",
        F.coalesce(F.try_variant_get(raw, "$.message.content", "string"), F.lit("")).alias("text"),
        F.coalesce(
            F.try_variant_get(raw, "$.message.tool_calls", "array<variant>"),
            F.array().cast("array<variant>"),
        ).alias("calls"),
    )
    numbered = running_total(
        parsed.withColumn("slice", F.floor(F.col("response_idx") / SLICE)),
        ["conv_id"], "response_idx", "slice", F.size("calls"), "earlier",
    )
    nothing = F.lit(None).cast("string")
    text_block = F.when(
        F.regexp_replace("text", r"(?U)\s+", "") != "",
        F.struct(
            F.lit("text").alias("type"), F.col("text").alias("text"),
            nothing.alias("id"), nothing.alias("name"), nothing.alias("input"),
        ),
    )

    def call_block(call: Column, i: Column) -> Column:
        given = F.try_variant_get(call, "$.function.arguments", "variant")
        inner = F.try_parse_json(F.try_variant_get(given, "$", "string"))
        arguments = F.when(_is_object(given), given).when(_is_object(inner), inner)
        return F.struct(
            F.lit("tool_use").alias("type"), nothing.alias("text"),
            F.concat(F.lit(id_prefix), (F.col("earlier") + i + 1).cast("string")).alias("id"),
            F.coalesce(F.try_variant_get(call, "$.function.name", "string"), F.lit("")).alias("name"),
            F.coalesce(F.to_json(arguments), F.lit("{}")).alias("input"),
        )

    blocks = F.concat(F.array_compact(F.array(text_block)), F.transform("calls", call_block))
    stop = F.when(F.size("calls") > 0, "tool_use").otherwise("end_turn")
    return numbered.select(
        "conv_id", "response_idx", stop.alias("stop_reason"), F.posexplode(blocks).alias("block_idx", "block")
    ).select("conv_id", "response_idx", "stop_reason", "block_idx", "block.*")


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
