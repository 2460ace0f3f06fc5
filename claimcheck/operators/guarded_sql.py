"""Run one read-only query over `data`; failures come back as a result, never as an exception."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from claimcheck.functions.guard import validate_query
from claimcheck.functions.tables import header_lines, render_row
from claimcheck.operators.checked import checked_sql
from claimcheck.operators.profile import schema_table, summarize
from claimcheck.operators.recompute import RUN_ERRORS, first_line
from claimcheck.session import ClaimSession

MAX_ROWS = 200


@dataclass
class QueryResult:
    ok: bool
    table: DataFrame | None = None
    n_more: int = 0
    error: str | None = None

    def text(self) -> str:
        """The shown rows as a `| a | b |` table, with the number of rows left out."""
        if not self.ok:
            return ""
        lines = [r["line"] for r in self.table.select(render_row(self.table.schema).alias("line")).collect()]
        more = f"\n\n... ({self.n_more} more rows)" if self.n_more else ""
        return "\n".join([header_lines(self.table.columns), *lines]) + more


def query_error(session: ClaimSession, query: str) -> str | None:
    """Why a query text is refused, or None."""
    return session.spark.sql("SELECT 1").select(validate_query(F.lit(query)).alias("e")).first()["e"]


def relation(session: ClaimSession, query: str) -> DataFrame:
    """The DataFrame of an accepted query, SUMMARIZE and DESCRIBE included."""
    body = query.strip().removesuffix(";").strip()
    leading = re.match(r"[A-Za-z]+", body)
    word = leading.group(0).upper() if leading else ""
    if word not in ("SUMMARIZE", "DESCRIBE"):
        return checked_sql(session, body)
    target = re.sub(r"(?i)^(?:SUMMARIZE|DESCRIBE)\s+(?:QUERY\s+|TABLE\s+)?", "", body)
    if re.match(r"(?i)(?:SELECT|WITH)\b", target):
        source = checked_sql(session, target)
    else:
        source = checked_sql(session, f"SELECT * FROM {target}")
    return summarize(source) if word == "SUMMARIZE" else schema_table(source)


def query_sql(session: ClaimSession, query: str, max_rows: int = MAX_ROWS) -> QueryResult:
    """At most `max_rows` rows, and how many more there are; the rest is only counted when it exists."""
    error = query_error(session, query)
    if error is not None:
        return QueryResult(False, error=error)
    try:
        result = relation(session, query)
        rows = result.limit(max_rows + 1).collect()
        n_more = result.count() - max_rows if len(rows) > max_rows else 0
        shown = session.spark.createDataFrame(rows[:max_rows], result.schema)
    except RUN_ERRORS as failure:
        return QueryResult(False, error=f"Spark error: {first_line(failure)}")
    return QueryResult(True, shown, n_more)
