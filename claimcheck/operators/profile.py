"""Dataset profiling. Every report is one aggregate over one scan, turned to one row per column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from claimcheck.functions.guard import quote_ident
from claimcheck.functions.numbers import is_number_text, value_text
from claimcheck.functions.tables import header_lines, render_row
from claimcheck.functions.text import strip_text


Stat = Callable[[Column, T.StructField], Column]
_ORDERABLE = (T.AtomicType,)


def _col(name: str) -> Column:
    return F.col(quote_ident(name))


def _long(df: DataFrame, fields: list[T.StructField], stats: dict[str, Stat]) -> DataFrame:
    """Aggregate `stats` of every field in one pass and return one row per field."""
    aggregates = [
        make(_col(f.name), f).alias(f"{stat}_{i}")
        for i, f in enumerate(fields)
        for stat, make in stats.items()
    ]
    one_row = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggregates)
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
            *[F.col(f"{stat}_{i}").alias(stat) for stat in stats],
        )
        for i, f in enumerate(fields)
    ]
    if not rows:
        nothing = [F.lit(None).cast("bigint").alias(stat) for stat in stats]
        return one_row.limit(0).select(F.lit("").alias("column_name"), F.lit("").alias("column_type"), "n_rows", *nothing)
    return one_row.select("n_rows", F.inline(F.array(*rows)))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def schema_table(df: DataFrame) -> DataFrame:
    """Column names and types; no job is run."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, column_type string, nullable boolean, ordinal int"
    )


def null_counts(df: DataFrame) -> DataFrame:
    return _long(df, df.schema.fields, {"n_null": lambda c, f: F.count_if(c.isNull())}).select(
        "column_name", "n_null"
    )


def preview(df: DataFrame, n: object = 5, order_by: list[str] | None = None) -> DataFrame:
    """The first n rows, of the given order when there is one."""
    try:
        n = int(n)
    except (TypeError, ValueError):
        raise ValueError("n_preview must be an integer") from None
    if n < 0:
        raise ValueError("n_preview must be >= 0")
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def profile_report(df: DataFrame) -> DataFrame:
    """Row count, schema and null counts in one table."""
    ordinals = {f.name: i for i, f in enumerate(df.schema.fields)}
    fields = df.schema.fields
    long = _long(
        df,
        fields,
        {
            "n_null": lambda c, f: F.count_if(c.isNull()),
            "ordinal": lambda c, f: F.max(F.lit(ordinals[f.name])),
        },
    )
    return long.select("column_name", "ordinal", "column_type", "n_rows", "n_null")


def profile_text(df: DataFrame, n_preview: object = 5) -> str:
    """The whole profile as text: row count, schema, null counts and a preview."""
    head = preview(df, n_preview)
    report = profile_report(df).orderBy("ordinal").collect()
    lines = [r["line"] for r in head.select(render_row(df.schema).alias("line")).collect()]
    names = df.columns
    described = [f"| {r['column_name']} | {r['column_type']} |" for r in report]
    nulls = "| " + " | ".join(str(r["n_null"]) for r in report) + " |"
    return "\n".join(
        [
            f"row_count: {report[0]['n_rows'] if report else 0}",
            "",
            "schema:",
            header_lines(["column_name", "column_type"]),
            *described,
            "",
            "null_counts:",
            header_lines(names),
            nulls,
            "",
            f"preview ({len(lines)} rows):",
            header_lines(names),
            *lines,
        ]
    )


def _fields(df: DataFrame, *types: type) -> list[T.StructField]:
    return [f for f in df.schema.fields if isinstance(f.dataType, types)]


def blank_counts(df: DataFrame) -> DataFrame:
    """Blank, non-null values of every text column."""
    return _long(
        df, _fields(df, T.StringType), {"n_blank": lambda c, f: F.count_if(strip_text(c) == "")}
    ).select("column_name", "n_blank")


def numeric_text(df: DataFrame) -> DataFrame:
    """Text columns that hold numbers, and whether only blanks keep them from being numeric."""
    long = _long(
        df,
        _fields(df, T.StringType),
        {
            "n_number": lambda c, f: F.count_if(is_number_text(c)),
            "n_blank": lambda c, f: F.count_if(strip_text(c) == ""),
            "n_other": lambda c, f: F.count_if((strip_text(c) != "") & ~is_number_text(c)),
        },
    )
    kind = (
        F.when((F.col("n_number") == 0) | (F.col("n_other") > 0), "text")
        .when(F.col("n_blank") > 0, "number with blanks")
        .otherwise("number")
    )
    return long.select("column_name", "n_number", "n_blank", "n_other", kind.alias("kind"))


def _number_or_null(agg: Callable[[Column], Column], dtype: str = "double") -> Stat:
    def make(column: Column, field: T.StructField) -> Column:
        if isinstance(field.dataType, T.NumericType):
            return agg(column.cast("double"))
        return F.max(F.lit(None).cast(dtype))

    return make


def _extreme(agg: Callable[[Column], Column]) -> Stat:
    def make(column: Column, field: T.StructField) -> Column:
        if not isinstance(field.dataType, _ORDERABLE) or isinstance(field.dataType, T.VariantType):
            return F.max(F.lit(None).cast("string"))
        return value_text(agg(column), field.dataType)

    return make


def summarize(df: DataFrame, accuracy: int = 10_000, rsd: float = 0.05) -> DataFrame:
    """Per column: min, max, approx_unique, avg, std, q25, q50, q75, count, null_percentage.

    Distinct counts and quantiles are sketches of fixed size, each read in a scan of its own:
    beside sketches and text extremes the moments would leave compiled code.
    """
    def quantiles(column: Column) -> Column:
        return F.percentile_approx(column, [0.25, 0.5, 0.75], accuracy)

    scans = [
        {
            "avg": _number_or_null(F.avg),
            "std": _number_or_null(F.stddev_samp),
            "n_valid": lambda c, f: F.count(c),
        },
        {"min": _extreme(F.min), "max": _extreme(F.max)},
        {"approx_unique": lambda c, f: F.approx_count_distinct(_hashable(c, f), rsd)},
        {"quantiles": _number_or_null(quantiles, "array<double>")},
    ]
    first, *others = [_long(df, df.schema.fields, stats) for stats in scans]
    long = first
    for other, stats in zip(others, scans[1:]):
        long = long.join(other.select("column_name", *stats), "column_name")
    spread = {name: F.try_element_at("quantiles", F.lit(i + 1)) for i, name in enumerate(("q25", "q50", "q75"))}
    return _with_null_share(long.withColumns(spread).drop("quantiles"))


def sketch_bounds(df: DataFrame, summary: DataFrame, accuracy: int = 10_000, rsd: float = 0.05) -> DataFrame:
    """Whether each sketched figure of `summary` keeps its bound, NULL where there is none.

    A quantile may be off by a rank of rows / accuracy, a distinct count by three times `rsd`.
    """
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    quantiles = {r["column_name"]: r for r in summary.where(F.col("column_name").isin(list(numeric))).collect()}
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    ranks = []
    for name, row in quantiles.items():
        for q in shares:
            cell = _col(name).cast("double")
            ranks += [F.count_if(cell < row[q]).alias(f"{name}<{q}"), F.count_if(cell <= row[q]).alias(f"{name}={q}")]
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(_col(n)).alias(f"{n}|n") for n in numeric], *ranks).first()

    def kept(name: str, q: str) -> bool:
        wanted, off = shares[q] * seen[f"{name}|n"], seen[f"{name}|n"] / accuracy + 1
        return seen[f"{name}<{q}"] - off <= wanted <= seen[f"{name}={q}"] + off

    rows = [(name, *[kept(name, q) for q in shares]) for name in quantiles]
    schema = "column_name string, q25_kept boolean, q50_kept boolean, q75_kept boolean"
    near = F.abs(F.col("approx_unique") - F.col("n_unique")) <= 3 * rsd * F.col("n_unique") + 1
    return (
        summary.select("column_name", "approx_unique")
        .join(distinct_counts(df), "column_name", "left")
        .select("column_name", near.alias("unique_kept"))
        .join(df.sparkSession.createDataFrame(rows, schema), "column_name", "left")
    )


QUANTILES = {"q25": 25, "q50": 50, "q75": 75}
# Values of one quantile's range that may meet in one task.
RANGE_VALUES = 1_000_000


@dataclass
class _Range:
    """Where a quantile's value lies: `below` of the column's values are less than `low`, `upto` at most `high`."""

    name: str
    percent: int
    rank: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    upto: int = 0
    # How far around the wanted rank a sketch looks, as a share of the values in the range.
    near: float = 0.0

    def inside(self) -> Column:
        cell = _col(self.name).cast("double")
        return cell if self.low is None else F.when((cell >= F.lit(self.low)) & (cell <= F.lit(self.high)), cell)


def exact_quantiles(df: DataFrame, percents: dict[str, int] | None = None, accuracy: int = 10_000, most: int = RANGE_VALUES) -> DataFrame:
    """Per numeric column its quantiles as doubles: the least value that `percent` of the non-null values do not exceed.

    Selection without a sort, all columns and quantiles at once. A sketch proposes a narrow range around every
    quantile, a count of what lies below and inside proves it (or widens it), and ranges with more than `most` values
    are sketched again; each round divides them by about `accuracy` / 4. The values of the final ranges, grouped,
    hold the answers. Up to some billion values that is three passes, and two more for each factor of thousands.
    """
    percents = percents or QUANTILES
    names = [f.name for f in _fields(df, T.NumericType)]
    schema = T.StructType([T.StructField("column_name", T.StringType()), *[T.StructField(q, T.DoubleType()) for q in percents]])
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(_col(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    ranges = [
        _Range(name, percent, max(1, -(-counts[f"n{i}"] * percent // 100)), upto=counts[f"n{i}"], near=2 / accuracy)
        for i, name in enumerate(names) if counts[f"n{i}"]
        for percent in percents.values()
    ]
    wide = [r for r in ranges if r.upto > most]
    while wide:
        proposed = df.agg(*[
            F.percentile_approx(r.inside(), [max(0.0, min(1.0, (r.rank - r.below) / (r.upto - r.below) + d)) for d in (-r.near, r.near)], accuracy).alias(f"r{i}")
            for i, r in enumerate(wide)
        ]).first()
        cells = [_col(r.name).cast("double") for r in wide]
        proof = df.agg(*[
            c.alias(f"{kind}{i}")
            for i, cell in enumerate(cells)
            for kind, c in (("below", F.count_if(cell < F.lit(proposed[f"r{i}"][0]))), ("upto", F.count_if(cell <= F.lit(proposed[f"r{i}"][1]))))
        ]).first()
        left = []
        for i, r in enumerate(wide):
            before = r.upto - r.below
            if proof[f"below{i}"] < r.rank <= proof[f"upto{i}"]:
                r.low, r.high, r.below, r.upto = *proposed[f"r{i}"], proof[f"below{i}"], proof[f"upto{i}"]
                # One value, or a sketch too coarse to halve the range: what is inside is grouped as it is.
                if most < r.upto - r.below <= before // 2 and r.low < r.high:
                    left.append(r)
            elif r.near < 1:
                # A sketch off its bound: look further around.
                r.near *= 4
                left.append(r)
        wide = left
    found = {}
    if ranges:
        cells = [F.struct(F.lit(i).alias("i"), r.inside().alias("value")) for i, r in enumerate(ranges)]
        grouped = df.select(F.inline(F.array(*cells))).where("value IS NOT NULL").groupBy("i", "value").agg(F.count("*").alias("n"))
        # Two numbers per quantile.
        known = df.sparkSession.createDataFrame([(i, r.rank - r.below) for i, r in enumerate(ranges)], "i int, wanted long")
        upto = F.sum("n").over(Window.partitionBy("i").orderBy("value"))
        reached = grouped.withColumn("upto", upto).join(F.broadcast(known), "i").where("upto >= wanted")
        found = {r["i"]: r["value"] for r in reached.groupBy("i").agg(F.min("value").alias("value")).collect()}
    values = {(r.name, r.percent): found[i] for i, r in enumerate(ranges)}
    rows = [(name, *[values.get((name, p)) for p in percents.values()]) for name in names]
    return df.sparkSession.createDataFrame(rows, schema)


def summarize_exact(df: DataFrame) -> DataFrame:
    """`summarize` without sketches: exact distinct counts and quantiles.

    Distinct values are counted as (column, value) groups, combined before the shuffle.
    """
    long = _long(
        df,
        df.schema.fields,
        {
            "min": _extreme(F.min),
            "max": _extreme(F.max),
            "avg": _number_or_null(F.avg),
            "std": _number_or_null(F.stddev_samp),
            "n_valid": lambda c, f: F.count(c),
        },
    )
    return (
        _with_null_share(long)
        .join(distinct_counts(df), "column_name", "left")
        .withColumn("n_unique", F.coalesce("n_unique", F.lit(0).cast("bigint")))
        .join(exact_quantiles(df), "column_name", "left")
    )


def _hashable(column: Column, field: T.StructField) -> Column:
    return F.to_json(F.struct(column)) if not isinstance(field.dataType, _ORDERABLE) else column


def _with_null_share(long: DataFrame) -> DataFrame:
    share = F.try_divide((F.col("n_rows") - F.col("n_valid")) * 100.0, F.col("n_rows"))
    return (
        long.withColumn("null_percentage", share)
        .withColumnRenamed("n_rows", "count")
        .drop("n_valid")
    )


def distinct_counts(df: DataFrame) -> DataFrame:
    """Exact number of distinct non-null values per column."""
    cells = [
        F.struct(
            F.lit(f.name).alias("column_name"), _hashable(_col(f.name), f).cast("string").alias("value")
        )
        for f in df.schema.fields
    ]
    return (
        df.select(F.inline(F.array(*cells)))
        .where("value IS NOT NULL")
        .distinct()
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("n_unique"))
    )


def target_rate(df: DataFrame, column: str, value: object) -> DataFrame:
    """Share of rows whose column equals `value`."""
    return df.agg(F.avg((_col(column) == F.lit(value)).cast("double")).alias("rate"))


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per class."""
    counts = df.groupBy(_col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = F.col("n") / F.lit(df.count())
    return counts.select("class", "n", total.alias("share"))


def categorical_mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value; the smallest one of a tie."""
    return (
        df.groupBy(_col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(1)
    )


def scalar_facts(df: DataFrame, facts: dict[str, tuple[str, Column, Column | None]]) -> DataFrame:
    """Named scalars in one scan: {label: (count|sum|avg|min|max, value, condition or None)}."""
    makers = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    names = list(facts)
    aggregates = []
    for i, label in enumerate(names):
        kind, value, condition = facts[label]
        seen = value if condition is None else F.when(condition, value)
        aggregates.append(makers[kind](seen).cast("double").alias(f"f{i}"))
    rows = [
        F.struct(F.lit(label).alias("label"), F.col(f"f{i}").alias("value"))
        for i, label in enumerate(names)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
