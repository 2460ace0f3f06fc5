"""Recompute the value behind each evidence text.

Evidence of the common shape `SELECT agg(x) FROM data [WHERE col = v | col IN (...)]`,
`count(DISTINCT x)` included, is never run query by query. All claims filtering on one column share a single
`GROUP BY col` over the dataset, whatever their number, and meet their group in one
join. Other filtered aggregates share a scan with those that differ in literals only
(`templates`). The rest is run text by text, each distinct text once.

Texts are routed and joined to their results once each, however many claims rest on them; claims
meet their text's result by its digest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import batched, chain

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from claimcheck.functions.evidence import is_sql, row_count_query
from claimcheck.functions.guard import standard_literals, quote_ident, validate_query
from claimcheck.functions.numbers import parse_number, value_text
from claimcheck.functions.text import let, strip_text
from claimcheck.operators.checked import RefusedQuery, checked_sql
from claimcheck.operators.deadline import TimedOut, limited
from claimcheck.operators.ladder import ladder_rows
from claimcheck.operators.templates import blocks, run_block, with_template
from claimcheck.session import DATA_VIEW, ClaimSession, materialize, shared_dir

# Aggregates computed together in one pass over the dataset.
BATCH_AGGREGATES = 64
# Distinct texts run per round, and results held before they are written.
TEXT_ROUND = 256
RESULT_ROUND = 10_000
TEXT_THREADS = 8
FAMILY_THREADS = 8
SEPARATOR = "\x1f"
# Join keys that claims without a result are spread over.
SPREAD = 4096
# A text that more claims rest on than this (and more than one in HOT_SHARE) has its claims
# cut up for the join; at most HOT_SHARE texts can be that hot.
HOT_ROWS = 2_000_000
HOT_SHARE = 1_000
# Results made on the driver are broadcast up to this counted size.
BROADCAST_BYTES = 8 << 20

ARGUMENT = r"""(?:[^()'",;`]++|'[^'()\\]*'|"[^"()]*"|\((?:[^()'";`]++|'[^'()\\]*')*+\))+"""
_AGGREGATE = rf"(count|sum|avg|min|max)\s*\(\s*(\*|{ARGUMENT})\s*\)"
_TEXT = r"'(?:[^'\\]++|'')*+'"
_NUMBER = r"-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
VALUE = rf"(?:{_TEXT}|{_NUMBER})"
FILTER = (
    r'WHERE\s+(?:"([^"]+)"|([A-Za-z_][A-Za-z0-9_]*))\s*'
    rf"(?:=\s*({VALUE})|IN\s*\(\s*({VALUE}(?:\s*,\s*{VALUE})*)\s*\))"
)
FAMILY = (
    rf"(?is)\A\s*SELECT\s+{_AGGREGATE}(?:\s+AS\s+[A-Za-z_][A-Za-z0-9_]*)?"
    rf'\s+FROM\s+"?data"?(?:\s+{FILTER})?\s*;?\s*\z'
)
# Distinct values of an argument are grouped by key, so that counts over lists of keys add up.
DISTINCT = "DISTINCT "
_DISTINCT = r"(?i)\Adistinct\s+"
NOT_SHARED = r"(?i)--|/\*|\b(?:select|distinct|all|from|over|filter|within|rand|randn|uuid)\b"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _column_names(schema: T.StructType, *types: type) -> list[str]:
    return [f.name.lower() for f in schema.fields if isinstance(f.dataType, types)]


def evidence_route(evidence: Column, schema: T.StructType) -> Column:
    """How to recompute an evidence text, as one struct.

    `route` is 'family' or 'text'; a family carries its aggregate, the filter column
    ('' for the whole table), the filter values in canonical form and their join key.
    """

    # One match hands over all parts at once; a text that does not match stays as it is.
    split = F.split(F.regexp_replace(evidence, FAMILY, SEPARATOR.join(f"${i}" for i in range(1, 7))), SEPARATOR)

    def routed(parts: Column) -> Column:
        named = F.struct(
            F.lower(parts[0]).alias("aggregate"),
            strip_text(parts[1]).alias("argument"),
            F.lower(F.concat(parts[2], parts[3])).alias("column"),
            F.regexp_extract_all(F.concat(parts[4], parts[5]), F.lit(VALUE), F.lit(0)).alias("written"),
        )
        family = let(
            named, lambda p: let(canonical_values(p.column, p.written, schema), lambda v: _route(p, v))
        )
        return F.when(F.size(parts) == 6, family).otherwise(_text_route())

    return F.when(evidence.contains(SEPARATOR), _text_route()).otherwise(let(split, routed))


def _text_route() -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.lit("text").alias("route"),
        nothing.alias("aggregate"),
        nothing.alias("column"),
        F.lit(None).cast("array<string>").alias("values"),
        nothing.alias("key"),
    )


def canonical_values(column: Column, written: Column, schema: T.StructType) -> Column:
    """Filter values as the text of the column's type; an unsuitable one becomes NULL."""

    def text(v: Column) -> Column:
        return F.when(
            v.startswith("'"), F.replace(F.substr(v, F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'"))
        )

    def integer(v: Column) -> Column:
        return F.when(v.rlike("^-?[0-9]+$"), v.try_cast("bigint").cast("string"))

    def double(v: Column) -> Column:
        # Adding zero turns -0.0 into the 0.0 that groups are keyed by.
        return F.when(~v.startswith("'"), (v.try_cast("double") + F.lit(0.0)).cast("string"))

    values = (
        F.when(column == "", F.array().cast("array<string>"))
        .when(column.isin(_column_names(schema, T.StringType)), F.transform(written, text))
        .when(column.isin(_column_names(schema, *_INTEGRAL)), F.transform(written, integer))
        .when(
            column.isin(_column_names(schema, T.DoubleType, T.FloatType)), F.transform(written, double)
        )
        .otherwise(F.array(F.lit(None).cast("string")))
    )
    return F.array_sort(F.array_distinct(values))


def _route(parts: Column, values: Column) -> Column:
    return let(F.regexp_replace(parts.argument, _DISTINCT, ""), lambda bare: _family_route(parts, values, bare))


def _family_route(parts: Column, values: Column, bare: Column) -> Column:
    distinct = bare != parts.argument
    shared = (
        ~bare.rlike(NOT_SHARED)
        & ((bare != "*") | (parts.aggregate == "count") & ~distinct)
        & (~distinct | (parts.aggregate == "count"))
        & ~F.exists(values, lambda v: v.isNull())
    )
    return F.when(
        shared,
        F.struct(
            F.lit("family").alias("route"),
            F.concat(parts.aggregate, F.lit("("), F.when(distinct, DISTINCT).otherwise(""), bare, F.lit(")")).alias("aggregate"),
            parts.column.alias("column"),
            values.alias("values"),
            F.concat_ws(SEPARATOR, F.size(values).cast("string"), values).alias("key"),
        ),
    ).otherwise(_text_route())


@dataclass
class Family:
    """All aggregates claimed over one filter column ('' for the whole table)."""

    column: str
    aggregates: list[str]
    n_values: int
    types: dict[str, T.DataType] = field(default_factory=dict)
    # Aggregates Spark cannot analyse, and those whose shared pass fails at run time.
    errors: dict[str, str] = field(default_factory=dict)
    failed: list[str] = field(default_factory=list)


@dataclass
class Recomputed:
    """Results of one recompute run, ready to be attached to the evidences."""

    # One row per distinct text: its digest, value, error, row count and the value as a number.
    values: DataFrame
    # (text, join key) of the texts with the most claims, and into how many pieces their claims are cut.
    hot: list[tuple[str, str]] = field(default_factory=list)
    pieces: int = 1
    # What the column with the value as a number is called, if one is wanted.
    number: str | None = None


def _small(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """Broadcast rows the driver made itself, when it has counted their bytes."""
    size = sum(len(str(cell).encode()) for row in rows for cell in row)
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


RUN_ERRORS = (PySparkException, Py4JJavaError, RefusedQuery, TimedOut)
# Texts that share a scan may take this many times what one text may.
BLOCK_PATIENCE = 4
# Underscored names stay clear of whatever columns a table of claims brings along.
ERROR_SCHEMA = "_column string, _aggregate string, _family_error string"
FAMILY_SCHEMA = "_column string, _key string, _n_rows bigint, _raws map<string,string>"
TEXT_SCHEMA = "_run_text string, _text_raw string, _text_error string, _text_rows bigint"


def route_evidences(session: ClaimSession, evidences: DataFrame, evidence: str = "evidence") -> DataFrame:
    """Add `_runs` and `_guard_error` to a table of evidences, worked out once.

    Only SQL that carries no `implausible` reason may run; the guard is asked per distinct text (`routed_texts`).
    `_guard_error` is what it says of the other plausible evidences.
    """
    text = F.col(evidence)
    plausible = F.col("implausible").isNull() if "implausible" in evidences.columns else F.lit(True)
    chosen = evidences.withColumn("_runs", plausible & F.coalesce(is_sql(text), F.lit(False)))
    refused = F.when(plausible & ~F.col("_runs"), validate_query(text))
    return materialize(chosen.withColumn("_guard_error", refused), "routed")


def routed_texts(session: ClaimSession, running: DataFrame, evidence: str = "evidence") -> DataFrame:
    """(_run_text, _n, _guard_error, _route): the distinct texts, how many evidences hold each, and how to recompute it.

    A text that the guard refuses has no route.
    """
    texts = running.groupBy(F.col(evidence).alias("_run_text")).agg(F.count(F.lit(1)).alias("_n"))
    guarded = texts.withColumn("_guard_error", validate_query(F.col("_run_text")))
    route = F.when(F.col("_guard_error").isNull(), evidence_route(F.col("_run_text"), session.data.schema))
    return materialize(guarded.withColumn("_route", route), "texts")


def text_id(text: Column) -> Column:
    """Half of a text's SHA-256, by which claims and results meet."""
    return F.unhex(F.left(F.sha2(text, 256), F.lit(32)))


def recompute(session: ClaimSession, routed: DataFrame, evidence: str = "evidence") -> Recomputed:
    """Recompute every evidence of a routed table that is allowed to run."""
    every = routed_texts(session, routed.where("_runs"), evidence)
    texts = every.where("_guard_error IS NULL")
    families = _families(session, texts)
    with ThreadPoolExecutor(FAMILY_THREADS) as pool:
        results = list(pool.map(lambda f: _family_rows(session, texts, f), families))
    errors = [(f.column, a, message) for f in families for a, message in f.errors.items()]
    failed = [(f.column, a) for f in families for a in f.failed]
    error_rows = session.spark.createDataFrame(errors, ERROR_SCHEMA) if errors else None
    values = _values(
        texts,
        failed,
        families=reduce(DataFrame.unionByName, [rows for r in results for rows in r]) if results else None,
        errors=_small(error_rows, errors) if errors else None,
        alone=_text_rows(session, texts, failed),
    )
    hot = _hot_texts(every)
    most = max((r["_n"] for r in hot), default=0)
    return Recomputed(
        values=materialize(values.union(_refused(every)).withColumn("_number", parse_number(F.col("_raw"))), "results"),
        hot=[(r["_run_text"], r["key"]) for r in hot],
        pieces=-(-most // HOT_ROWS) or 1,
    )


def _hot_texts(texts: DataFrame) -> list:
    """The texts too many claims share, at most HOT_SHARE of them; small tables have none."""
    total = texts.agg(F.sum("_n")).first()[0] or 0
    if total <= HOT_ROWS:
        return []
    hot = texts.where(F.col("_n") > max(HOT_ROWS, total // HOT_SHARE))
    return hot.select("_run_text", "_n", F.coalesce("_route.key", F.lit("")).alias("key")).collect()


def _refused(texts: DataFrame) -> DataFrame:
    return texts.where("_guard_error IS NOT NULL").select(
        text_id(F.col("_run_text")).alias("_id"),
        F.lit(None).cast("string").alias("_raw"),
        _execution_error(F.col("_guard_error")).alias("_error"),
        F.lit(None).cast("bigint").alias("_rows"),
    )


def _values(
    texts: DataFrame, failed: list[tuple[str, str]], families: DataFrame | None, errors: DataFrame | None, alone: DataFrame | None
) -> DataFrame:
    """(_id, _raw, _error, _rows) of every distinct text.

    Every joined side holds one row per key.
    """
    by_text = _runs_as_text(F.col("_route"), failed)
    # Texts of the other kind match nothing; spread, they do not pile up in one join partition.
    nowhere = F.concat(F.lit("-"), F.pmod(F.xxhash64("_run_text"), F.lit(SPREAD)).cast("string"))
    joined = texts.select(
        text_id(F.col("_run_text")).alias("_id"),
        (~by_text).alias("_is_family"),
        F.when(by_text, nowhere).otherwise(F.col("_route.column")).alias("_column"),
        F.when(by_text, nowhere).otherwise(F.col("_route.key")).alias("_key"),
        F.when(~by_text, F.col("_route.aggregate")).alias("_aggregate"),
        F.when(by_text, F.col("_run_text")).otherwise(nowhere).alias("_run_text"),
    )
    for side, keys, schema in (
        (families, ["_column", "_key"], FAMILY_SCHEMA),
        (errors, ["_column", "_aggregate"], ERROR_SCHEMA),
        (alone, ["_run_text"], TEXT_SCHEMA),
    ):
        if side is not None:
            joined = joined.join(side, keys, "left")
        else:
            missing = [f for f in T.StructType.fromDDL(schema).fields if f.name not in keys]
            joined = joined.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    is_family = F.col("_is_family")
    empty = F.when(F.col("_aggregate").startswith("count("), "0").otherwise("")
    family_raw = F.when(F.col("_n_rows").isNull(), empty).otherwise(
        F.coalesce(F.try_element_at("_raws", "_aggregate"), F.lit(""))
    )
    error = F.when(is_family, _execution_error(F.col("_family_error"))).otherwise(F.col("_text_error"))
    return joined.select(
        "_id",
        F.when(error.isNull() & is_family, family_raw).otherwise(F.col("_text_raw")).alias("_raw"),
        error.alias("_error"),
        F.when(is_family, F.coalesce("_n_rows", F.lit(0).cast("bigint"))).otherwise(F.col("_text_rows")).alias("_rows"),
    )


def attach(routed: DataFrame, results: Recomputed, evidence: str = "evidence") -> DataFrame:
    """Add raw, error and evidence_row_count to the routed evidences, and raw as a number if results name that column.

    The joined side holds one row per text. The claims of a hot text are cut into pieces,
    each meeting its own copy of that text's row. Evidences that do not run are not joined.
    """
    plain = [c for c in routed.columns if c not in ("_runs", "_guard_error")]
    joined = routed.where("_runs").select(*map(quote_ident, plain), text_id(F.col(evidence)).alias("_id"))
    values, keys = results.values, ["_id"]
    if results.hot:
        is_hot = F.col("_id").isin([text_id(F.lit(text)) for text, _ in results.hot])
        spread_by = [c for c in plain if isinstance(routed.schema[c].dataType, (T.StringType, T.NumericType))]
        piece = F.pmod(F.xxhash64(*map(quote_ident, spread_by)), F.lit(results.pieces)).cast("int")
        joined = joined.withColumn("_piece", F.when(is_hot, piece).otherwise(0))
        copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(results.pieces - 1))).otherwise(F.array(F.lit(0)))
        values, keys = values.withColumn("_piece", F.explode(copies)), ["_id", "_piece"]
    ran = joined.join(values, keys, "left").select(
        *map(quote_ident, plain),
        F.col("_raw").alias("raw"),
        F.col("_error").alias("error"),
        F.col("_rows").alias("evidence_row_count"),
        *([F.col("_number").alias(results.number)] if results.number else []),
    )
    idle = routed.where("NOT _runs").select(
        *map(quote_ident, plain),
        F.lit(None).cast("string").alias("raw"),
        _execution_error(F.col("_guard_error")).alias("error"),
        F.lit(None).cast("bigint").alias("evidence_row_count"),
        *([F.lit(None).cast("double").alias(results.number)] if results.number else []),
    )
    return ran.union(idle)


def recomputed_values(session: ClaimSession, evidences: DataFrame, evidence: str = "evidence") -> DataFrame:
    """`evidences` with raw, error and evidence_row_count."""
    routed = route_evidences(session, evidences, evidence)
    return attach(routed, recompute(session, routed, evidence), evidence)


def _runs_as_text(route: Column, failed: list[tuple[str, str]]) -> Column:
    by_text = route.route == "text"
    for column, aggregate in failed:
        by_text = by_text | ((route.column == column) & (route.aggregate == aggregate))
    return by_text


def _execution_error(message: Column) -> Column:
    return F.concat(F.lit("query_sql failed to execute evidence: "), message)


def _families(session: ClaimSession, texts: DataFrame) -> list[Family]:
    """The distinct aggregates per filter column; claims themselves never reach the driver."""
    found: dict[str, Family] = {}
    members = (
        texts.where("_route.route = 'family'")
        .groupBy("_route.column", "_route.aggregate")
        .agg(F.max(F.size("_route.values")).alias("n_values"))
    )
    for row in members.toLocalIterator():
        family = found.setdefault(row["column"], Family(row["column"], [], 0))
        family.aggregates.append(row["aggregate"])
        family.n_values = max(family.n_values, row["n_values"])
    for family in found.values():
        for aggregate in sorted(family.aggregates):
            try:
                typed = checked_sql(session, f"SELECT {aggregate} AS v FROM {DATA_VIEW}")
                family.types[aggregate] = typed.schema["v"].dataType
            except (PySparkException, RefusedQuery) as error:
                family.errors[aggregate] = first_line(error)
    return list(found.values())


def _family_rows(session: ClaimSession, texts: DataFrame, family: Family) -> list[DataFrame]:
    claimed = texts.where(F.col("_route.column") == family.column)
    view = f"family_{uuid.uuid4().hex}"
    _filtered(session, family, claimed).createOrReplaceTempView(view)
    plain = [a for a in family.types if not _is_distinct(a)]
    chunks = [list(c) for c in batched(plain, BATCH_AGGREGATES)] or [[]]
    names = {aggregate: f"a{i}" for i, aggregate in enumerate(family.types)}
    parts = [p for chunk in chunks for p in _computed(session, family, view, chunk, names)]
    values = {a: _distinct_values(session, family, view, a) for a in family.types if _is_distinct(a)}
    session.spark.catalog.dropTempView(view)
    partials = reduce(lambda left, right: left.join(right.drop("n_rows"), "fkey"), parts)
    kept = [a for a in family.types if a not in family.failed]
    values = {a: found for a, found in values.items() if found is not None}
    for a, found in values.items():
        partials = partials.join(found.groupBy("fkey").agg(F.count("value").alias(names[a])), "fkey", "left")
    prefix = f"1{SEPARATOR}" if family.column else "0"
    rows = [_as_rows(family, partials, kept, names, F.concat(F.lit(prefix), "fkey"))]
    if family.n_values > 1:
        lists = claimed.where(F.size("_route.values") > 1).select("_route.key", "_route.values").distinct()
        totals = [F.sum("n_rows").alias("n_rows")]
        totals += [c for a in kept if a not in values for c in merged(a, names[a])]
        keyed = lists.select("key", F.explode("values").alias("fkey"))
        combined = keyed.join(partials, "fkey").groupBy("key").agg(*totals)
        for a, found in values.items():
            # The union of the keys' values: one that several keys hold counts once.
            union = keyed.join(found, "fkey").select("key", "value").distinct()
            combined = combined.join(union.groupBy("key").agg(F.count("value").alias(names[a])), "key", "left")
        rows.append(_as_rows(family, combined, kept, names, F.col("key")))
    return rows


def _is_distinct(aggregate: str) -> bool:
    return aggregate.startswith(f"count({DISTINCT}")


def _distinct_values(session: ClaimSession, family: Family, view: str, aggregate: str) -> DataFrame | None:
    """(fkey, value): the distinct values of an aggregate's argument per key; nothing if the pass fails."""
    argument = standard_literals(aggregate[len(f"count({DISTINCT}") : -1])
    key = f"cast({quote_ident(family.column)} AS {wide(dtype_of(session, family.column))})" if family.column else "''"
    by = f"{key}, {argument}" if family.column else argument
    try:
        return materialize(session.spark.sql(f"SELECT cast({key} AS string) AS fkey, {argument} AS value FROM {view} GROUP BY {by}"), "distinct-values")
    except RUN_ERRORS:
        family.failed.append(aggregate)
        return None


def _filtered(session: ClaimSession, family: Family, claimed: DataFrame) -> DataFrame:
    """The rows of the dataset that some claim of the family filters for."""
    if not family.column:
        return session.data
    values = claimed.select(F.explode("_route.values").alias("_value")).distinct()
    kind = wide(dtype_of(session, family.column))
    wanted = materialize(values.select(F.col("_value").cast(kind).alias("_value")), "values")
    # Spark knows the size of the written values: it broadcasts few and shuffles many.
    column = F.col(quote_ident(family.column)).cast(kind)
    return session.data.join(wanted, column == wanted["_value"], "left_semi")


def wide(dtype: T.DataType) -> str:
    return "string" if isinstance(dtype, T.StringType) else "bigint" if isinstance(dtype, _INTEGRAL) else "double"


def dtype_of(session: ClaimSession, column: str) -> T.DataType:
    return next(f.dataType for f in session.data.schema.fields if f.name.lower() == column)


def _computed(
    session: ClaimSession, family: Family, view: str, aggregates: list[str], names: dict[str, str]
) -> list[DataFrame]:
    """Run one shared pass; when it fails, run its aggregates one by one to find the culprit."""
    items = ["count(*) AS n_rows"]
    for aggregate in aggregates:
        items += partials(aggregate, names[aggregate], family.types[aggregate])
    if family.column:
        key = f"cast({quote_ident(family.column)} AS {wide(dtype_of(session, family.column))})"
        sql = f"SELECT cast({key} AS string) AS fkey, {', '.join(items)} FROM {view} GROUP BY {key}"
    else:
        sql = f"SELECT '' AS fkey, {', '.join(items)} FROM {view}"
    try:
        return [materialize(session.spark.sql(sql), "family")]
    except RUN_ERRORS:
        if not aggregates:
            raise
    if len(aggregates) == 1:
        family.failed.append(aggregates[0])
        return _computed(session, family, view, [], names)
    return [p for a in aggregates for p in _computed(session, family, view, [a], names)]


def _kind(aggregate: str) -> str:
    return aggregate.split("(", 1)[0]


def partials(aggregate: str, name: str, dtype: T.DataType) -> list[str]:
    """Mergeable parts of one aggregate as SQL select items."""
    argument = standard_literals(aggregate.split("(", 1)[1][:-1])
    if _kind(aggregate) == "avg" and isinstance(dtype, T.DoubleType):
        # As the engine does it: an average of whole numbers cannot overflow.
        return [f"sum(cast({argument} AS double)) AS {name}_sum", f"count({argument}) AS {name}_n"]
    if _kind(aggregate) == "avg":
        return [f"sum({argument}) AS {name}_sum", f"count({argument}) AS {name}_n"]
    return [f"{_kind(aggregate)}({argument}) AS {name}"]


def merged(aggregate: str, name: str) -> list[Column]:
    if _kind(aggregate) == "avg":
        return [F.try_sum(f"{name}_sum").alias(f"{name}_sum"), F.sum(f"{name}_n").alias(f"{name}_n")]
    merge = {"count": F.sum, "sum": F.try_sum, "min": F.min, "max": F.max}[_kind(aggregate)]
    return [merge(name).alias(name)]


def _as_rows(
    family: Family, partials: DataFrame, aggregates: list[str], names: dict[str, str], key: Column
) -> DataFrame:
    """Results as (column, key, n_rows, raws MAP<aggregate, text>)."""

    def raw(aggregate: str) -> Column:
        name, dtype = names[aggregate], family.types[aggregate]
        value = F.col(name) if _kind(aggregate) != "avg" else F.try_divide(f"{name}_sum", f"{name}_n")
        return value_text(value.cast(dtype), dtype)

    entries = [c for a in aggregates for c in (F.lit(a), raw(a))]
    raws = F.create_map(*entries) if entries else F.lit(None)
    return partials.select(
        F.lit(family.column).alias("_column"),
        key.alias("_key"),
        F.col("n_rows").cast("bigint").alias("_n_rows"),
        raws.cast("map<string,string>").alias("_raws"),
    )


def first_line(error: Exception) -> str:
    return (str(error).strip().splitlines() or [type(error).__name__])[0]


def run_query(session: ClaimSession, query: str) -> tuple[str | None, str | None]:
    """The one cell of a query's result as text, or why there is none."""
    try:
        result = checked_sql(session, query)
        width = len(result.columns)
        if width != 1:
            return None, f"{NOT_SINGLE}{width} columns"
        cell = result.toDF("v")
        text = value_text(F.col("v"), cell.schema["v"].dataType)
        with limited(session.spark, session.seconds):
            rows = cell.select(text.alias("v")).limit(2).collect()
    except RUN_ERRORS as error:
        return None, f"query_sql failed to execute evidence: {first_line(error)}"
    if len(rows) != 1:
        return None, f"{NOT_SINGLE}{'no rows' if not rows else 'more than one row'}"
    return rows[0]["v"] or "", None


NOT_SINGLE = (
    "could not extract a single value from the query result: expected a 1x1 result table, got "
)


def _run_text(session: ClaimSession, text: str, count_text: str | None) -> tuple:
    raw, error = run_query(session, text)
    n_rows, count_error = run_query(session, count_text) if count_text else (None, None)
    counted = n_rows is not None and count_error is None and n_rows.isdigit()
    return text, raw, error, int(n_rows) if counted else None


def _text_rows(session: ClaimSession, routed: DataFrame, failed: list[tuple[str, str]]) -> DataFrame | None:
    """Results of the remaining distinct texts: those of one template together, others one by one.

    Ranges over templates with many texts are answered by `ladder`, first groups by `tops`. Other texts pass through the driver a round at a time, and so do their results.
    """
    counted = routed.where(_runs_as_text(F.col("_route"), failed)).select("_run_text").withColumn("count_text", row_count_query(F.col("_run_text")))
    texts = materialize(with_template(counted, "_run_text"), "distinct-texts")
    # That module builds on this one.
    from claimcheck.operators.tops import top_rows

    climbed = ladder_rows(session, texts, run_query, RUN_ERRORS) + top_rows(session, texts, RUN_ERRORS)
    if climbed:
        climbed = [reduce(DataFrame.unionByName, climbed)]
        texts = materialize(texts.join(climbed[0].select("_run_text"), "_run_text", "left_anti"), "other-texts")
    path, done, spilled = shared_dir(session.spark, "texts"), [], False

    def alone(rows: Iterable[Row]) -> list[tuple]:
        return list(pool.map(lambda r: _run_text(session, r["_run_text"], r["count_text"]), rows))

    def in_time(block: list[Row]) -> tuple[list[tuple], list[Row]]:
        """A block out of time is halved, like one that fails, until the slow texts run alone."""
        patience = None if session.seconds is None else BLOCK_PATIENCE * session.seconds
        with limited(session.spark, patience) as late:
            done, rest = run_block(session, block, run_query, RUN_ERRORS)
        if len(block) < 2 or not (late.is_set() and rest):
            return done, rest
        half = len(block) // 2
        (a, b), (c, d) = in_time(block[:half]), in_time(block[half:])
        return a + c, b + d

    with ThreadPoolExecutor(TEXT_THREADS) as pool:
        shared = blocks(texts.where("template IS NOT NULL").orderBy("template").toLocalIterator())
        together = pool_rounds(shared, in_time, pool)
        rounds = (results + alone(rest) for results, rest in together)
        singles = map(alone, batched(texts.where("template IS NULL").toLocalIterator(), TEXT_ROUND))
        for results in chain(rounds, singles):
            done += results
            if len(done) >= RESULT_ROUND:
                session.spark.createDataFrame(done, TEXT_SCHEMA).write.mode("append").parquet(path)
                done, spilled = [], True
    last = session.spark.createDataFrame(done, TEXT_SCHEMA) if done else None
    if not spilled:
        found = [] if last is None else [last if climbed else _small(last, done)]
    else:
        if last is not None:
            last.write.mode("append").parquet(path)
        found = [session.spark.read.schema(TEXT_SCHEMA).parquet(path)]
    return reduce(DataFrame.unionByName, climbed + found) if climbed or found else None


def pool_rounds(items: Iterator, work: Callable, pool: ThreadPoolExecutor) -> Iterator:
    """Results of `work`, as many at a time as there are threads."""
    for some in batched(items, TEXT_THREADS):
        yield from pool.map(work, some)
