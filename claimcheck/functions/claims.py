"""What a claim sentence says: its numerals, its words, and whether they fit the value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from claimcheck.functions.numbers import ABS_TOL, REL_TOL, is_close
from claimcheck.functions.text import let

# Fixed values.
DIGITS = r"[0-9][0-9,]*(?:\.[0-9]+)?"
NUMERAL = rf"(?iU)({DIGITS})\s*(%|per\s*cent\b)?"
WORD = "[a-z0-9]+"
PREFIX_LENGTH = 4


def claim_numbers(claim: Column) -> Column:
    """Every numeral as ARRAY<DOUBLE>; a percentage counts both as n and as n/100."""
    numerals = F.regexp_extract_all(claim, F.lit(NUMERAL), F.lit(1))
    percents = F.regexp_extract_all(claim, F.lit(NUMERAL), F.lit(2))

    def number(digits: Column) -> Column:
        return F.replace(digits, F.lit(","), F.lit("")).cast("double")

    def readings(digits: Column, percent: Column) -> Column:
        n = number(digits)
        return F.when(percent != "", F.array(n, n / 100.0)).otherwise(F.array(n))

    # Most claims hold no percentage; then the numerals alone do, read once.
    may_be_percent = claim.contains("%") | F.lower(claim).contains("cent")
    return F.when(may_be_percent, F.flatten(F.zip_with(numerals, percents, readings))).otherwise(
        F.transform(F.regexp_extract_all(claim, F.lit(DIGITS), F.lit(0)), number)
    )


def claim_agrees(
    claim: Column, value: Column, rel_tol: float = REL_TOL, abs_tol: float = ABS_TOL
) -> Column:
    """A claim agrees with a value when it quotes no number or at least one close to it."""

    def agree(candidates: Column) -> Column:
        return (F.size(candidates) == 0) | F.exists(candidates, lambda n: is_close(n, value, rel_tol, abs_tol))

    return let(claim_numbers(claim), agree)


def tokens(text: Column) -> Column:
    """Distinct lower-case alphanumeric runs."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def token_disclosed(token: Column, claim_tokens: Column) -> Column:
    """A token counts as mentioned when a claim word equals it or, from four letters on, extends or shortens it."""
    return F.array_contains(claim_tokens, token) | (
        (F.length(token) >= PREFIX_LENGTH)
        & F.exists(
            claim_tokens,
            lambda word: (F.length(word) >= PREFIX_LENGTH)
            & (word.startswith(token) | token.startswith(word)),
        )
    )


def any_disclosed(wanted: Column, claim_tokens: Column) -> Column:
    return F.exists(wanted, lambda token: token_disclosed(token, claim_tokens))
