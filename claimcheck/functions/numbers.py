"""Numbers: parsing, comparing, rounding and rendering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from claimcheck.functions.text import let, strip_text

REL_TOL = 0.01
ABS_TOL = 0.01

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = (
    rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
)
_INTEGER = rf"^[+-]?{_DIGITS}$"
_INFINITE = r"(?i)^[+-]?inf(?:inity)?$"
_NAN = r"(?i)^[+-]?nan$"


def parse_number(text: Column) -> Column:
    """Text as DOUBLE, or NULL when it does not read as one number."""
    infinity = F.lit(float("inf"))

    def read(t: Column) -> Column:
        return (
            F.when(t.rlike(_NUMBER), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
            .when(t.rlike(_INFINITE), F.when(t.startswith("-"), -infinity).otherwise(infinity))
            .when(t.rlike(_NAN), F.lit(float("nan")))
        )

    return let(strip_text(text), read)


def is_integer_text(text: Column) -> Column:
    return strip_text(text).rlike(_INTEGER)


def is_number_text(text: Column) -> Column:
    return strip_text(text).rlike(_NUMBER)


def parse_row_count(text: Column) -> Column:
    """Text as a non-negative BIGINT, else NULL."""
    t = F.replace(strip_text(text), F.lit("_"), F.lit(""))
    n = F.when(is_integer_text(text), t.try_cast("bigint"))
    return F.when(n >= 0, n)


def is_close(a: Column, b: Column, rel_tol: float = REL_TOL, abs_tol: float = ABS_TOL) -> Column:
    """Relative-or-absolute closeness; NaN is close to nothing, infinity only to itself."""
    a, b = a.cast("double"), b.cast("double")
    infinity = F.lit(float("inf"))

    def finite(c: Column) -> Column:
        return ~F.isnan(c) & (F.abs(c) != infinity)

    margin = F.greatest(F.lit(float(rel_tol)) * F.greatest(F.abs(a), F.abs(b)), F.lit(float(abs_tol)))
    return ((a == b) & ~F.isnan(a)) | (finite(a) & finite(b) & (F.abs(a - b) <= margin))


def _scaled(value: Column, digits: int) -> Column:
    """|value| * 10^digits rounded to a whole number, half to even on the exact binary value.

    The product's rounding error is recovered with a two-product split, so a tie is
    recognised exactly instead of through the decimal rendering of the double.
    """
    v, scale = F.abs(value.cast("double")), float(10**digits)
    splitter = 134217729.0
    c = v * splitter
    v_hi = c - (c - v)
    v_lo = v - v_hi
    s_hi = scale * splitter - (scale * splitter - scale)
    s_lo = scale - s_hi
    product = v * scale
    error = ((v_hi * s_hi - product) + v_hi * s_lo + v_lo * s_hi) + v_lo * s_lo
    whole = F.floor(product).cast("double")
    rest = product - whole
    odd = (whole % 2.0) == 1.0
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & odd)))
    return F.when(up, whole + 1.0).otherwise(whole)


def _splits_exactly(value: Column, digits: int) -> Column:
    return F.abs(value) < float(2**52 // 10**digits)


def round_half_even(value: Column, digits: int = 4) -> Column:
    """Correctly rounded DOUBLE with ties to even."""
    value = value.cast("double")
    sign = F.when(value < 0, -1.0).otherwise(1.0)
    return F.when(
        _splits_exactly(value, digits), sign * _scaled(value, digits) / float(10**digits)
    ).otherwise(F.bround(value, digits))


def fixed_text(value: Column, digits: int) -> Column:
    """Fixed-point text with exactly `digits` (at least one) decimals."""

    def parts(value: Column) -> Column:
        # The fraction of a double is itself a double, so nothing is lost by rounding it alone.
        size = F.abs(value)
        whole = F.when(size < float(2**53), F.floor(size).cast("double")).otherwise(size)
        rounded = let(size - whole, lambda fraction: _scaled(fraction, digits))
        return F.struct(
            F.when(value.cast("string").startswith("-"), "-").otherwise("").alias("sign"),
            whole.try_cast("decimal(38,0)").alias("whole"),
            rounded.cast("bigint").alias("n"),
        )

    def render(p: Column) -> Column:
        whole = F.when(p.n >= 10**digits, (p.whole + 1).cast("decimal(38,0)")).otherwise(p.whole)
        decimals = F.lpad((p.n % 10**digits).cast("string"), digits, "0")
        return F.concat(p.sign, whole.cast("string"), F.lit("."), decimals)

    value = value.cast("double")
    return F.coalesce(let(let(value, parts), render), F.format_string(f"%.{digits}f", value))


def number_text(value: Column, as_int: Column) -> Column:
    """A number as it appears in a claim: whole for counts, else 4 decimals, zeros trimmed."""
    return let(
        value.cast("double"),
        lambda v: F.when(as_int, F.rint(v).cast("decimal(38,0)").cast("string")).otherwise(
            F.regexp_replace(fixed_text(v, 4), r"\.?0+$", "")
        ),
    )


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.concat(fixed_text(value.cast("double") * 100.0, digits), F.lit("%"))


def float_text(value: Column) -> Column:
    """A DOUBLE in plain notation between 1e-4 and 1e16, `1e+16` style outside."""

    def render(value: Column) -> Column:
        sign = F.when(value.cast("string").startswith("-"), "-").otherwise("")
        signed = F.concat(sign, let(F.abs(value).cast("string"), _plain))
        return (
            F.when(F.isnan(value), "nan")
            .when(F.abs(value) == float("inf"), F.when(value < 0, "-inf").otherwise("inf"))
            .otherwise(signed)
        )

    return let(value.cast("double"), render)


def _plain(text: Column) -> Column:
    """Rewrite `d.dddE±x` for the range that is shown without an exponent."""
    return F.when(~text.contains("E"), text).otherwise(
        let(
            F.struct(
                F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "").alias("mantissa"),
                F.regexp_replace(F.regexp_replace(text, r"E.*|\.", ""), r"(?<=.)0+$", "").alias("digits"),
                F.substring_index(text, "E", -1).try_cast("int").alias("exponent"),
            ),
            _shifted,
        )
    )


def _shifted(parts: Column) -> Column:
    digits, exponent = parts.digits, parts.exponent
    fraction = F.substr(digits, exponent + 2)
    size = F.abs(exponent).cast("string")
    return (
        F.when(
            (exponent >= 0) & (exponent < 16),
            F.concat(
                F.rpad(digits, exponent + 1, F.lit("0")),
                F.lit("."),
                F.when(F.length(fraction) > 0, fraction).otherwise("0"),
            ),
        )
        .when(
            (exponent < 0) & (exponent >= -4),
            F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits),
        )
        .otherwise(
            F.concat(
                parts.mantissa,
                F.when(exponent < 0, "e-").otherwise("e+"),
                F.lpad(size, F.greatest(F.length(size), F.lit(2)), F.lit("0")),
            )
        )
    )


def value_text(column: Column, dtype: T.DataType) -> Column:
    """One result cell as text."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float_text(column)
    if isinstance(dtype, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    if isinstance(dtype, T.NullType):
        return F.lit(None).cast("string")
    return column.cast("string")


def safe_rate(numerator: Column, denominator: Column) -> Column:
    """A ratio rounded to 4 decimals; nothing over nothing is 0.0."""
    return F.coalesce(
        round_half_even(F.try_divide(numerator.cast("double"), denominator.cast("double")), 4),
        F.lit(0.0),
    )


def distort(value: Column, magnitude: Column, direction: Column) -> Column:
    return value * (F.lit(1.0) + direction * magnitude)


def coerce_number(column: Column) -> Column:
    """Text to number; unreadable text and what is not a number become 0.0."""
    return F.nanvl(F.coalesce(parse_number(column.cast("string")), F.lit(0.0)), F.lit(0.0))
