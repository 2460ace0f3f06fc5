"""What a captured run printed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from claimcheck.functions.numbers import parse_row_count
from claimcheck.functions.text import let, strip_text

# Fixed values.
RESULT_LINE = r"(?iU)^RESULT:\s*(.*)$"
ROWS_LINE = r"(?iU)^ROWS:\s*(.*)$"


def _lines(stdout: Column) -> Column:
    return F.filter(F.transform(F.split(stdout, r"\R"), strip_text), lambda line: line != "")


def _last(lines: Column) -> Column:
    return F.try_element_at(lines, F.lit(-1))


def _last_marked(stdout: Column, pattern: str) -> Column:
    marked = F.filter(_lines(stdout), lambda line: line.rlike(pattern))
    return let(F.regexp_extract(_last(marked), pattern, 1), strip_text)


def stdout_result(stdout: Column) -> Column:
    """The value of the last RESULT line, else the last line that is no ROWS line, else the last line."""
    plain = F.filter(_lines(stdout), lambda line: ~line.rlike(ROWS_LINE))
    return F.coalesce(_last_marked(stdout, RESULT_LINE), _last(plain), _last(_lines(stdout)))


def stdout_rows(stdout: Column) -> Column:
    """The number on the last ROWS line, NULL when missing or malformed."""
    return let(_last_marked(stdout, ROWS_LINE), parse_row_count)


def run_error(ok: Column, stdout: Column, error: Column) -> Column:
    """Why a run yields no value, or NULL."""
    return F.when(
        ~ok, F.concat(F.lit("run_python failed to execute evidence: "), F.coalesce(error, F.lit("None")))
    ).when(
        F.size(_lines(F.coalesce(stdout, F.lit("")))) == 0,
        "run_python produced no stdout to extract a value from",
    )


def run_message(ok: Column, stdout: Column, stderr: Column, error: Column) -> Column:
    """The text a caller sees: stdout of a good run, else the error followed by stderr."""
    shown = F.concat_ws("\n", F.coalesce(F.nullif(error, F.lit("")), F.lit("unknown error")), F.nullif(stderr, F.lit("")))
    return F.when(ok, stdout).otherwise(shown)
