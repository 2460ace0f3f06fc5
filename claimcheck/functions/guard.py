"""Which query texts may run at all."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from claimcheck.functions.text import let, strip_text

# Fixed values.
ALLOWED_WORDS = ["SELECT", "WITH", "SUMMARIZE", "DESCRIBE"]
FORBIDDEN_WORDS = (
    "read_csv read_csv_auto read_parquet read_json read_json_auto read_ndjson read_text glob "
    "attach detach install load copy insert update delete merge"
).split()
# What Spark SQL can reach beyond a table: JVM methods from an expression.
SPARK_FORBIDDEN_WORDS = "reflect java_method try_reflect".split()
# ... and shell commands: TRANSFORM/MAP/REDUCE ... USING 'command'.
SCRIPT_WORDS = "transform map reduce".split()


def validate_query(query: Column) -> Column:
    """Why a query text is refused, or NULL when it is a single read statement."""
    body = F.regexp_replace(strip_text(F.coalesce(query, F.lit(""))), r";\z", "")
    return F.when(~F.coalesce(_harmless(F.lower(query)), F.lit(False)), let(body, _refusal))


def _harmless(lowered: Column) -> Column:
    """One statement that begins as allowed and holds none of the character runs that a refusal rests on."""
    words = [*FORBIDDEN_WORDS, *SPARK_FORBIDDEN_WORDS, "using", "identifier", ";"]
    runs = [w for w in words if not any(v != w and v in w for v in words)]
    begins = reduce(Column.__or__, [lowered.startswith(f"{w.lower()} ") for w in ALLOWED_WORDS])
    return reduce(Column.__and__, [~lowered.contains(run) for run in runs], begins)


def _banned(body: Column) -> Column:
    """Forbidden words among the identifiers, sorted; one search clears the usual text."""
    words = FORBIDDEN_WORDS + SPARK_FORBIDDEN_WORDS
    identifiers = F.regexp_extract_all(F.lower(body), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))
    found = F.array_sort(F.array_intersect(identifiers, F.array(*map(F.lit, words))))
    suspect = body.rlike(rf"(?i)(?<![A-Za-z_])(?:{'|'.join(words)})(?![A-Za-z0-9_])")
    return F.when(suspect, F.concat_ws(", ", found)).otherwise("")


def _refusal(body: Column) -> Column:
    allowed = "/".join(ALLOWED_WORDS)
    leading = F.upper(F.regexp_extract(body, r"(?U)\A\s*([A-Za-z]+)", 1))
    script = "|".join(SCRIPT_WORDS)
    return (
        F.when(body == "", "empty query")
        .when(
            body.contains(";"), "multiple statements are not allowed (found ';' inside the query)"
        )
        .when(
            ~leading.isin(ALLOWED_WORDS),
            F.concat(
                F.lit(f"only {allowed} statements are allowed, got statement starting with '"),
                F.coalesce(F.nullif(leading, F.lit("")), F.left(body, F.lit(20))),
                F.lit("'"),
            ),
        )
        .otherwise(
            let(
                _banned(body),
                lambda banned: F.when(
                    banned != "",
                    F.concat(
                        F.lit("disallowed keyword(s) in query: "),
                        banned,
                        F.lit(
                            " -- file access, catalog changes and DML are not permitted; "
                            "only read the `data` view"
                        ),
                    ),
                ).when(
                    body.rlike(rf"(?i)\b(?:{script})\b") & body.rlike(r"(?i)\bUSING\b(?!\s*\()"),
                    "disallowed script clause in query: only read the `data` view",
                )
                .when(
                    F.regexp_replace(body, r"'(?:[^']|'')*+'|/\*[\s\S]*?\*/|--[^\n]*", " ").rlike(r"(?i)\bidentifier\s*\("),
                    "disallowed in query: a name made by identifier()",
                ),
            )
        )
    )


def quote_ident(name: str) -> str:
    """A column name as one back-quoted identifier, whatever it contains."""
    return "`" + name.replace("`", "``") + "`"


_LITERALS = re.compile(
    r"""('(?:[^']|'')*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*.*?\*/)|(?<![\w.])(\d+\.\d*|\.\d+)(?![\w.])""",
    re.DOTALL,
)


def standard_literals(query: str) -> str:
    """A query text with its literals written for Spark.

    A bare decimal becomes a DOUBLE, so that averages over it are doubles, and a backslash
    in a quoted text stays an ordinary character.
    """

    def write(match: re.Match) -> str:
        kept, decimal = match.groups()
        if decimal:
            return decimal + "D"
        return kept.replace("\\", "\\\\") if kept.startswith("'") else kept

    return _LITERALS.sub(write, query)
