"""Filtered aggregates that differ only in the literals of their filter, many texts per scan.

`SELECT <aggregate expression> FROM data WHERE <predicate>` becomes a template when the
literals of its predicate are taken out. The texts of one template are a block of literal
rows that meets the dataset in one join, the predicate as its condition; value and row count
come out of one grouped pass. Blocks are bounded in rows and bytes, so is what is broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import batched, groupby

from pyspark.sql import Column, DataFrame, Row, functions as F

from claimcheck.functions.guard import standard_literals
from claimcheck.functions.numbers import value_text
from claimcheck.functions.text import let
from claimcheck.operators.checked import checked_sql
from claimcheck.session import ClaimSession

# Texts that share one scan, and the bytes of their literals.
BLOCK_TEXTS = 1_000
BLOCK_BYTES = 8 << 20

HOLE, SEPARATOR = "\x1e", "\x1f"
_SHAPE = r"""(?is)\A\s*SELECT\s+(.+?)\s+FROM\s+"?data"?\s+WHERE\s+(.+?)\s*;?\s*\z"""
_TEXT = r"'(?:[^']|'')*+'"
_LITERAL = rf"(?i)\b(?:DATE|TIMESTAMP)\s*{_TEXT}|{_TEXT}|(?<![A-Za-z0-9_.])[0-9]+(?:\.[0-9]+)?(?![A-Za-z0-9_.])"
# An aggregate by name; a text with one and no GROUP BY has one row, whatever it filters.
_AGGREGATE = r"(?i)\b(?:count|count_if|sum|avg|mean|min|max|median|mode|stddev|stddev_pop|stddev_samp|variance|var_pop|var_samp|percentile)\s*\("
# What a filter or a select list may not hold here: further clauses, windows, generators, chance.
_OTHER_SHAPE = (
    r"(?i)['`\;{?]|--|/\*|\b(?:select|from|where|group|order|limit|having|union|intersect|except|minus|window|qualify|lateral"
    r"|tablesample|cluster|sort|distribute|offset|fetch|join|over|interval|within"
    r"|explode|posexplode|explode_outer|inline|stack|rand|randn|random|uuid|shuffle|monotonically_increasing_id)\b"
)
_PLAIN_NAME = r'"[A-Za-z_][A-Za-z0-9_]*"'


def with_template(texts: DataFrame, text: str) -> DataFrame:
    """Add `template` (NULL when the text has another shape) and `literals`."""
    parts = F.split(F.regexp_replace(text, _SHAPE, f"$1{SEPARATOR}$2"), SEPARATOR)

    def kind(literal: Column) -> Column:
        return (
            F.when(literal.rlike("(?i)^DATE"), "DATE")
            .when(literal.rlike("(?i)^TIMESTAMP"), "TIMESTAMP")
            .when(literal.startswith("'"), "STRING")
            .when(literal.contains("."), "DOUBLE")
            .when(F.length(literal) <= 9, "INT")
            .when(F.length(literal) <= 18, "BIGINT")
        )

    def value(literal: Column) -> Column:
        inside = F.regexp_extract(literal, r"(?s)'(.*)'\z", 1)
        return F.when(literal.endswith("'"), F.replace(inside, F.lit("''"), F.lit("'"))).otherwise(literal)

    def template(select: Column, predicate: Column) -> Column:
        found = F.regexp_extract_all(predicate, F.lit(_LITERAL), F.lit(0))
        kinds = F.transform(found, kind)
        holed = F.regexp_replace(predicate, _LITERAL, HOLE)
        bare = F.regexp_replace(select, _TEXT, " ")
        outside = F.regexp_replace(F.concat(bare, F.lit(" "), holed), _PLAIN_NAME, " ")
        shared = (
            bare.rlike(_AGGREGATE)
            & ~outside.rlike(_OTHER_SHAPE)
            & ~outside.contains('"')
            & (F.size(found) > 0)
            & F.forall(kinds, lambda k: k.isNotNull())
        )
        return F.when(
            shared,
            F.struct(
                F.concat_ws(SEPARATOR, select, holed, F.array_join(kinds, ",")).alias("template"),
                F.transform(found, value).alias("literals"),
            ),
        )

    clean = ~F.col(text).rlike(f"[{HOLE}{SEPARATOR}]")
    shape = F.when(clean, let(parts, lambda p: F.when(F.size(p) == 2, template(p[0], p[1]))))
    return texts.withColumn("_shape", shape).select(
        *texts.columns, F.col("_shape.template").alias("template"), F.col("_shape.literals").alias("literals")
    )


def blocks(rows: Iterator[Row]) -> Iterator[list[Row]]:
    """Rows ordered by template as blocks of one template each."""
    for _, same in groupby(rows, key=lambda r: r["template"]):
        for block in batched(same, BLOCK_TEXTS):
            yield list(block)


def run_block(session: ClaimSession, block: list[Row], run_query, errors: tuple) -> tuple[list[tuple], list[Row]]:
    """(text, raw, error, row count) of the texts that share a scan, and the rows left to run alone.

    A block that fails is halved until the texts that fail stand alone.
    """
    if len(block) < 2:
        return [], block
    if sum(len(x.encode()) for r in block for x in r["literals"]) <= BLOCK_BYTES:
        try:
            return _scan(session, block, run_query)
        except errors:
            if _never_runs(session, block[0], errors):
                return [], block
    half = len(block) // 2
    (a, b), (c, d) = (run_block(session, part, run_query, errors) for part in (block[:half], block[half:]))
    return a + c, b + d


def _statement(template: str, view: str) -> str:
    select, predicate, kinds = template.split(SEPARATOR)
    holes = iter(range(kinds.count(",") + 1))
    filled = "".join(p if i == 0 else f"_p{next(holes)}{p}" for i, p in enumerate(predicate.split(HOLE)))
    return standard_literals(
        f"SELECT /*+ BROADCAST(_literals) */ _id, {select}, count(*) FROM data JOIN {view} AS _literals ON ({filled}) GROUP BY _id"
    )


def _literal_rows(session: ClaimSession, block: list[Row]) -> DataFrame:
    kinds = block[0]["template"].split(SEPARATOR)[2].split(",")
    rows = session.spark.createDataFrame(
        [(i, r["literals"]) for i, r in enumerate(block)], "_id int, _values array<string>"
    )
    return rows.select("_id", *[F.col("_values")[i].cast(k.lower()).alias(f"_p{i}") for i, k in enumerate(kinds)])


def _joined(session: ClaimSession, block: list[Row]) -> DataFrame:
    view = f"literals_{uuid.uuid4().hex}"
    _literal_rows(session, block).createOrReplaceTempView(view)
    try:
        # The text itself must be accepted: only then is its rewritten form run.
        if len(checked_sql(session, block[0]["_run_text"]).columns) != 1:
            raise ValueError("more than one column")
        return session.spark.sql(_statement(block[0]["template"], view)).toDF("_id", "v", "n")
    finally:
        session.spark.catalog.dropTempView(view)


def _never_runs(session: ClaimSession, row: Row, errors: tuple) -> bool:
    """Whether the template itself, not one of its texts, is the reason for a failure."""
    try:
        _joined(session, [row])
    except (*errors, ValueError):
        return True
    return False


def _scan(session: ClaimSession, block: list[Row], run_query) -> tuple[list[tuple], list[Row]]:
    try:
        result = _joined(session, block)
    except ValueError:
        return [], block
    shown = value_text(F.col("v"), result.schema["v"].dataType)
    found = {r["_id"]: r for r in result.select("_id", shown.alias("v"), "n").collect()}
    done, rest, nothing = [], [], None
    for i, row in enumerate(block):
        text, counted = row["_run_text"], row["count_text"] is not None
        if i in found:
            done.append((text, found[i]["v"] or "", None, found[i]["n"] if counted else None))
            continue
        if nothing is None:
            select = row["template"].split(SEPARATOR)[0]
            nothing = run_query(session, f"SELECT {select} FROM data WHERE false")
        if nothing[1] is None:
            done.append((text, nothing[0], None, 0 if counted else None))
        else:
            rest.append(row)
    return done, rest
