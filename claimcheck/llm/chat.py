"""Format conversations from a declarative template, with a loss flag on every text segment.

A finite-state machine over roles, run as one fold over a conversation's turns, tells whether
the order of turns is allowed. Everything is built from DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

# Characters that only markers may hold, and what stands for them after a backslash.
RESERVED = {"<": "l", ">": "g"}


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is `<turn role>`, a line end, its text, `</turn>`, a line end.

    moves: state and role to next state; a state is named like the role that led to it.
    """

    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    final: tuple[str, ...] = ("assistant",)
    opening: tuple[str, str] = ("<turn ", ">\n")
    closing: str = "</turn>\n"


TEMPLATE = ChatTemplate()


def escape(text: Column) -> Column:
    """No reserved character is left; a backslash always begins a pair."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, name in RESERVED.items():
        out = F.replace(out, F.lit(char), F.lit("\\" + name))
    return out


def unescape(text: Column) -> Column:
    """The inverse: between doubled backslashes, each pair stands for one reserved character."""

    def part(x: Column) -> Column:
        for char, name in RESERVED.items():
            x = F.replace(x, F.lit("\\" + name), F.lit(char))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def accepts(roles: Column, template: ChatTemplate = TEMPLATE) -> Column:
    """Whether the machine ends in a final state after the roles, in order."""
    moves = [x for s, nexts in template.moves.items() for r in nexts for x in (F.lit(f"{s}>{r}"), F.lit(r))]
    table = F.create_map(*moves)
    step = lambda state, role: F.coalesce(F.try_element_at(table, F.concat_ws(">", state, role)), F.lit("rejected"))
    return F.aggregate(roles, F.lit(template.start), step).isin(list(template.final))


def format_chats(turns: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, valid, segments, formatted) per conversation.

    turns: conv_id, turn, role, text; other columns are not read. Rows are ordered by turn,
    ties by role and text; null turns come first. Null role and text are empty, and rows with a null conv_id
    form one conversation. segments: (text, loss) in order; formatted: their texts, joined.
    Invalid conversations are formatted too and marked.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head, tail = template.opening
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(F.lit(head), escape(t["role"]), F.lit(tail)), F.lit(False)),
                segment(escape(t["text"]), t["role"].isin(list(template.loss_roles))),
                segment(F.lit(template.closing), F.lit(False)),
            ),
        )
    )
    built = chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), accepts(F.col("turns.role"), template).alias("valid"), segments.alias("segments")
    )
    return built.withColumn("formatted", F.array_join("segments.text", ""))


def read_turns(formatted: Column, template: ChatTemplate = TEMPLATE) -> Column:
    """The turns (role, text) in a formatted conversation."""
    head, tail = template.opening
    pieces = F.split(formatted, f"\\Q{template.closing}\\E")
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        opening = F.substring_index(piece, tail[0], 1)
        return F.struct(
            unescape(F.substring(opening, F.lit(len(head) + 1), F.length(opening))).alias("role"),
            unescape(F.substring(piece, F.length(opening) + len(tail) + 1, F.length(piece))).alias("text"),
        )

    return F.transform(turns, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
