"""What an evidence text is and what it reads, decided from the text alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from claimcheck.functions.claims import any_disclosed, tokens
from claimcheck.functions.text import let, strip_text

# Fixed values.
SQL_WORDS = ["SELECT", "WITH"]
READS_DATA = r'(?iU)\b(?:FROM|JOIN)\s+"?data"?\b'
CLAUSE_END = r"(?iU)\b(?:GROUP\s+BY|HAVING|ORDER\s+BY|LIMIT|OFFSET|WINDOW|QUALIFY)\b"
SET_OPERATOR = r"(?iU)\b(?:UNION|INTERSECT|EXCEPT)\b"

# A name and a text literal of a filter; the two predicates are put together from them.
NAME = r'(?:"[^"]+"|[A-Za-z_][A-Za-z0-9_]*)'
LITERAL = r"'(?:[^']++|'')*+'"
EQUALS_PREDICATE = rf"(?U)\A\s*({NAME})\s*=\s*({LITERAL})\s*\z"
IN_PREDICATE = rf"(?iU)\A\s*({NAME})\s+IN\s*\(\s*({LITERAL}(?:\s*,\s*{LITERAL})*)\s*\)\s*\z"
# How a clause that is one of the two begins, found without looking at brackets.
MAY_FILTER = rf"(?iU)\bWHERE\b\s*{NAME}(?:\s*=\s*'|\s+IN\s*\(\s*')"


def is_sql(evidence: Column) -> Column:
    lowered = F.lower(evidence)
    plainly = reduce(Column.__or__, [lowered.startswith(f"{w.lower()} ") for w in SQL_WORDS])
    word = F.upper(F.regexp_extract(strip_text(evidence), "^([A-Za-z]+)", 1))
    return plainly | word.isin(SQL_WORDS)


def _reads_data(evidence: Column) -> Column:
    """READS_DATA, searched for only where plain text does not decide."""
    lowered = F.lower(evidence)
    plainly = lowered.contains(" from data ") | lowered.endswith(" from data")
    # Other letters that read as an I in any case can only stand behind JO.
    possible = lowered.contains("data") & (lowered.contains("from") | lowered.contains("jo"))
    return plainly | (possible & evidence.rlike(READS_DATA))


def touches_data(evidence: Column, dataset_path: str | None = None) -> Column:
    """SQL must read `data` in a FROM or JOIN; anything else must name the dataset's path."""
    names_path = evidence.contains(dataset_path) if dataset_path else F.lit(False)
    return F.when(is_sql(evidence), _reads_data(evidence)).otherwise(names_path)


def implausible_reason(evidence: Column, dataset_path: str | None = None) -> Column:
    """Why the evidence cannot have read the dataset, or NULL."""
    evidence = F.coalesce(evidence, F.lit(""))
    sql_reason = (
        "SQL evidence never references the `data` view in a FROM/JOIN clause "
        "-- it cannot have queried the real dataset"
    )
    python_reason = (
        f"Python evidence never references the dataset path ({dataset_path}) "
        "-- it cannot have loaded the real dataset"
    )
    return F.when(
        ~touches_data(evidence, dataset_path),
        F.when(is_sql(evidence), sql_reason).otherwise(python_reason),
    )


def query_body(evidence: Column) -> Column:
    return F.regexp_replace(strip_text(evidence), r";\z", "")


def mask_parens(text: Column) -> Column:
    """Blank out parenthesised spans, brackets included, keeping every other position."""
    pieces = F.regexp_extract_all(text, F.lit(r"[()]|[^()]+"), F.lit(0))

    def step(state: Column, piece: Column) -> Column:
        depth = (
            F.when(piece == "(", state.depth + 1)
            .when(piece == ")", F.greatest(state.depth - 1, F.lit(0)))
            .otherwise(state.depth)
        )
        hidden = (state.depth > 0) | piece.isin("(", ")")
        blank = F.repeat(F.lit(" "), F.length(piece))
        return F.struct(
            depth.alias("depth"),
            F.concat(state.masked, F.when(hidden, blank).otherwise(piece)).alias("masked"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("masked"))
    return F.aggregate(pieces, start, step, lambda state: state.masked)


def _upto(text: Column, word: str) -> Column:
    """Characters up to and including the first `word`, 0 when it is absent."""
    return F.length(F.regexp_extract(text, rf"(?isU)\A(.*?\b{word}\b)", 1))


def _masked(evidence: Column, use) -> Column:
    """Apply `use` to STRUCT<body, masked> of an evidence text."""

    def with_mask(body: Column) -> Column:
        return F.struct(body.alias("body"), mask_parens(body).alias("masked"))

    return let(let(query_body(evidence), with_mask), use)


def row_count_query(evidence: Column) -> Column:
    """The evidence with its outermost select list replaced by count(*), or NULL."""

    def cut(q: Column, select_end: Column) -> Column:
        from_end = _upto(F.substr(q.masked, select_end + 1), "FROM")
        return let(
            from_end,
            lambda n: F.when(
                (select_end > 0) & (n > 0),
                F.concat(
                    F.substr(q.body, F.lit(1), select_end),
                    F.lit(" count(*) "),
                    F.substr(q.body, select_end + n - len("FROM") + 1),
                ),
            ),
        )

    return _masked(evidence, lambda q: let(_upto(q.masked, "SELECT"), lambda n: cut(q, n)))


def where_clause(evidence: Column) -> Column:
    """The single top-level WHERE text of a query without set operators, or NULL."""

    def clause_length(rest: Column) -> Column:
        before_end = F.length(F.regexp_extract(rest, rf"(?isU)\A(.*?){CLAUSE_END}", 1))
        return F.when(rest.rlike(CLAUSE_END), before_end).otherwise(F.length(rest))

    def cut(q: Column, start: Column) -> Column:
        length = let(F.substr(q.masked, start + 1), clause_length)
        return F.substr(q.body, start + 1, length)

    def find(q: Column) -> Column:
        single = F.regexp_count(q.masked, F.lit(r"(?iU)\bWHERE\b")) == 1
        return F.when(
            single & ~q.masked.rlike(SET_OPERATOR), let(_upto(q.masked, "WHERE"), lambda n: cut(q, n))
        )

    return _masked(evidence, find)


def where_tokens(clause: Column) -> Column:
    """STRUCT<columns, values> of tokens for one `col = 'x'` or `col IN ('x', ...)`, else NULL."""

    def parsed(clause: Column, pattern: str) -> Column:
        return F.struct(
            tokens(F.regexp_extract(clause, pattern, 1)).alias("columns"),
            tokens(F.regexp_extract(clause, pattern, 2)).alias("values"),
        )

    return let(
        clause,
        lambda c: F.when(c.rlike(EQUALS_PREDICATE), parsed(c, EQUALS_PREDICATE)).when(
            c.rlike(IN_PREDICATE), parsed(c, IN_PREDICATE)
        ),
    )


def population_mismatch(evidence: Column, claim: Column) -> Column:
    """Why the evidence rests on a narrower population than the claim admits, or NULL."""

    def hidden(clause: Column, parsed: Column) -> Column:
        disclosed = let(
            tokens(claim),
            lambda words: any_disclosed(F.array_union(parsed.columns, parsed.values), words),
        )
        reason = F.concat(
            F.lit("evidence filters on WHERE "),
            strip_text(clause),
            F.lit(
                " but the claim text mentions neither the filtered column nor its value "
                "-- the number may rest on a narrower population than the claim describes"
            ),
        )
        return F.when(parsed.isNotNull() & ~disclosed, reason)

    checked = let(where_clause(evidence), lambda c: let(where_tokens(c), lambda p: hidden(c, p)))
    # Without a name and a quoted text behind WHERE there is no predicate to parse.
    return F.when(evidence.contains("'") & evidence.rlike(MAY_FILTER) & is_sql(evidence), checked)
