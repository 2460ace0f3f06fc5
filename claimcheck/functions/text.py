"""Plain text helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

MAX_TEXT = 10_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` written into the plan, and evaluated, once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip_text(text: Column) -> Column:
    """Drop leading and trailing white space of any script."""
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    # Between visible ASCII characters there is nothing to drop, nor to search for.
    bare = first.between("!", "~") & last.between("!", "~")
    return F.when(bare, text).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def fold(text: Column) -> Column:
    """Normal form for categorical comparison."""
    return F.lower(strip_text(text))


def quoted(text: Column) -> Column:
    """Text in quotes, escaped so that it stays on one line."""

    def quote(text: Column) -> Column:
        escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for raw, mark in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            escaped = F.replace(escaped, F.lit(raw), F.lit(mark))
        mark = F.when(text.contains("'") & ~text.contains('"'), '"').otherwise("'")
        apostrophe = F.when(mark == '"', "'").otherwise("\\'")
        return F.concat(mark, F.replace(escaped, F.lit("'"), apostrophe), mark)

    return let(text, quote)


def truncate_text(text: Column, limit: int = MAX_TEXT) -> Column:
    """Text cut to `limit` characters, with a marker when something was cut."""
    marker = F.lit(f"\n... (truncated at {limit} chars)")
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), marker)).otherwise(text)
