"""Result tables as `| a | b |` text, written and read back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from claimcheck.functions.guard import quote_ident
from claimcheck.functions.numbers import value_text
from claimcheck.functions.text import let, strip_text


def render_line(cells: list[Column]) -> Column:
    """One table line; NULL cells stay empty."""
    texts = [F.coalesce(cell.cast("string"), F.lit("")) for cell in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *texts), F.lit(" |"))


def render_row(schema) -> Column:
    """One table line out of a row's own columns."""
    return render_line([value_text(F.col(quote_ident(f.name)), f.dataType) for f in schema.fields])


def header_lines(names: list[str]) -> str:
    return "| " + " | ".join(names) + " |\n| " + " | ".join("---" for _ in names) + " |"


def parse_table(text: Column) -> Column:
    """STRUCT<header ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>>, NULL when the text holds no table."""
    lines = F.filter(F.split(strip_text(text), r"\R"), lambda line: strip_text(line).startswith("|"))

    def cells(line: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), strip_text)

    def read(lines: Column) -> Column:
        ruled = F.try_element_at(lines, F.lit(2)).contains("---")
        body = F.slice(lines, F.when(ruled, 3).otherwise(2), F.size(lines))
        return F.when(
            F.size(lines) >= 2,
            F.struct(
                cells(F.try_element_at(lines, F.lit(1))).alias("header"),
                F.transform(body, cells).alias("rows"),
            ),
        )

    return let(lines, read)


def single_value(text: Column) -> Column:
    """The one cell of a one-by-one table, else NULL."""
    return let(
        parse_table(text),
        lambda t: F.when(
            (F.size(t.header) == 1) & (F.size(t.rows) == 1),
            F.try_element_at(F.try_element_at(t.rows, F.lit(1)), F.lit(1)),
        ),
    )
