"""Evidence that asks for the first of its groups, any number of texts in one grouped pass.

`SELECT g | agg(x) FROM data [WHERE col = v | col IN (...)] GROUP BY g ORDER BY agg(y) [DESC] [, g] LIMIT 1`: texts
that differ in filter values only share one pass over the dataset, grouped by filter column and g. Its partial
aggregates are merged for every list of values, and a register of the best group so far is all that a list keeps.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F

from claimcheck.functions.guard import quote_ident
from claimcheck.functions.numbers import value_text
from claimcheck.functions.text import strip_text
from claimcheck.operators import recompute
from claimcheck.operators.checked import checked_sql
from claimcheck.session import ClaimSession, materialize

# Shapes with fewer texts run text by text.
TOP_TEXTS = 2

_NAME = r'(?:"([^"]+)"|([A-Za-z_][A-Za-z0-9_]*))'
_CALL = rf"(?:count|sum|avg|min|max)\s*\(\s*(?:\*|{recompute.ARGUMENT})\s*\)"
_PARTS = ["select_quoted", "select_name", "select_call", "where_quoted", "where_name", "one", "many", "group_quoted", "group_name", "order", "direction", "tie", "tie_direction"]
TOP = (
    rf"(?is)\A\s*SELECT\s+(?:{_NAME}|({_CALL}))(?:\s+AS\s+[A-Za-z_][A-Za-z0-9_]*)?\s+FROM\s+\"?data\"?(?:\s+{recompute.FILTER})?"
    rf"\s+GROUP\s+BY\s+{_NAME}\s+ORDER\s+BY\s+({_CALL})(?:\s+(ASC|DESC))?(?:\s*,\s*\"?([A-Za-z_][A-Za-z0-9_]*)\"?(?:\s+(ASC|DESC))?)?\s+LIMIT\s+1\s*;?\s*\z"
)
SHAPE = ["selected", "grouped", "ordered", "falling", "tied", "tie_falling", "filtered"]


def with_shape(session: ClaimSession, texts: DataFrame) -> DataFrame:
    """The texts of this form with the columns of SHAPE, and the filter's values and their key.

    selected is '' for the group itself; values that do not suit their column make no row.
    """
    split = F.split(F.regexp_replace("_run_text", TOP, recompute.SEPARATOR.join(f"${i}" for i in range(1, len(_PARTS) + 1))), recompute.SEPARATOR)
    part = lambda name: F.get("_parts", F.lit(_PARTS.index(name)))
    found = texts.where(~F.col("_run_text").contains(recompute.SEPARATOR)).withColumn("_parts", split).where(F.size("_parts") == len(_PARTS))
    group = F.lower(F.concat(part("group_quoted"), part("group_name")))
    selected = F.lower(F.concat(part("select_quoted"), part("select_name")))
    call = lambda name: _call(part(name))
    shaped = found.select(
        "_run_text", "count_text", selected.alias("_name"), call("select_call").alias("selected"), group.alias("grouped"), call("order").alias("ordered"),
        (F.lower(part("direction")) == "desc").alias("falling"), F.lower(part("tie")).alias("tied"), (F.lower(part("tie_direction")) == "desc").alias("tie_falling"),
        F.lower(F.concat(part("where_quoted"), part("where_name"))).alias("filtered"),
        F.regexp_extract_all(F.concat(part("one"), part("many")), F.lit(recompute.VALUE), F.lit(0)).alias("_written"),
    )
    shaped = shaped.withColumn("values", recompute.canonical_values(F.col("filtered"), F.col("_written"), session.data.schema))
    plain = ~F.concat_ws(" ", "selected", "ordered").rlike(recompute.NOT_SHARED)
    fits = ((F.col("_name") == F.col("grouped")) | (F.col("_name") == "")) & F.col("tied").isin("", F.col("grouped"))
    return shaped.where(plain & fits & ~F.exists("values", lambda v: v.isNull())).select(
        "_run_text", "count_text", *SHAPE, "values", F.concat_ws(recompute.SEPARATOR, F.size("values").cast("string"), "values").alias("key")
    )


def _call(text: Column) -> Column:
    """An aggregate with its name in lower case; '' stays as it is."""
    argument = F.regexp_extract(text, r"(?s)\A\w+\s*\((.*)\)\z", 1)
    return F.when(text == "", "").otherwise(F.concat(F.lower(F.regexp_extract(text, r"\A\w+", 0)), F.lit("("), strip_text(argument), F.lit(")")))


def top_rows(session: ClaimSession, texts: DataFrame, errors: tuple) -> list[DataFrame]:
    """Results of the texts of this form, as written tables; a shape that fails is left out.

    Where the order leaves several groups first, the least of them is taken. A filter that no row meets is an error,
    as it is for a text that runs alone.
    """
    shaped = materialize(with_shape(session, texts), "top-texts")
    shapes = shaped.groupBy(*SHAPE).agg(F.count("*").alias("n"), F.min("_run_text").alias("text")).where(F.col("n") >= TOP_TEXTS).collect()
    done = []
    for shape in shapes:
        own = shaped.where(reduce(Column.__and__, [F.col(c) == F.lit(shape[c]) for c in SHAPE]))
        try:
            done.append(materialize(_answers(session, own, shape), "tops"))
        except (*errors, ValueError):
            continue
    return done


def _answers(session: ClaimSession, own: DataFrame, shape: Row) -> DataFrame:
    accepted = checked_sql(session, shape["text"])
    if len(accepted.columns) != 1:
        raise ValueError("more than one column")
    aggregates = {"n": "count(*)", "o": shape["ordered"], "s": shape["selected"] or "count(*)"}
    types = {c: checked_sql(session, f"SELECT {a} AS v FROM data").schema["v"].dataType for c, a in aggregates.items()}
    lists = own.select("key", F.explode_outer("values").alias("fkey")).distinct().fillna("", ["fkey"])
    groups = materialize(_groups(session, own, shape, aggregates, types), "groups")
    merged = [c for name, a in aggregates.items() for c in recompute.merged(a, name)]
    of_lists = lists.join(groups, "fkey").groupBy("key", "g").agg(*merged)
    value = {c: _value(a, c).cast(types[c]) for c, a in aggregates.items()}
    place = lambda c: F.struct(c.isNotNull().alias("known"), c.alias("value"))
    ranked = of_lists.select("key", place(value["o"]).alias("o"), place(F.col("g")).alias("g"), value["n"].alias("n"), value["s"].alias("s"))
    # Nulls come first where the order rises and last where it falls, as the marks before the values do.
    best = ranked.groupBy("key").agg((F.max if shape["falling"] else F.min)("o").alias("best"))
    tied = ranked.join(best, "key").where(F.col("o").eqNullSafe(F.col("best")))
    last = F.max if shape["tied"] and shape["tie_falling"] else F.min
    chosen = tied.groupBy("key").agg(last(F.struct("g", "n", "s")).alias("top"))
    shown = F.col("top.s") if shape["selected"] else F.col("top.g.value")
    joined = own.join(chosen, "key", "left")
    missing = F.col("top").isNull()
    return joined.select(
        "_run_text",
        F.when(~missing, F.coalesce(value_text(shown, accepted.schema[0].dataType), F.lit(""))).alias("_text_raw"),
        F.when(missing, F.lit(f"{recompute.NOT_SINGLE}no rows")).alias("_text_error"),
        F.when(F.col("count_text").isNotNull(), F.col("top.n")).cast("long").alias("_text_rows"),
    )


def _groups(session: ClaimSession, own: DataFrame, shape: Row, aggregates: dict[str, str], types: dict) -> DataFrame:
    """(fkey, g, partial aggregates): the pass over the rows that some text filters for."""
    data, key = session.data, "''"
    if shape["filtered"]:
        wide = recompute.wide(recompute.dtype_of(session, shape["filtered"]))
        column = F.col(quote_ident(shape["filtered"])).cast(wide)
        wanted = materialize(own.select(F.explode("values").alias("v")).distinct().select(F.col("v").cast(wide).alias("_value")), "values")
        data, key = data.join(wanted, column == wanted["_value"], "left_semi"), f"cast({quote_ident(shape['filtered'])} AS {wide})"
    view = f"tops_{uuid.uuid4().hex}"
    data.createOrReplaceTempView(view)
    items = [p for name, a in aggregates.items() for p in recompute.partials(a, name, types[name])]
    group = quote_ident(shape["grouped"])
    by = f"{key}, {group}" if shape["filtered"] else group
    try:
        return session.spark.sql(f"SELECT cast({key} AS string) AS fkey, {group} AS g, {', '.join(items)} FROM {view} GROUP BY {by}")
    finally:
        session.spark.catalog.dropTempView(view)


def _value(aggregate: str, name: str) -> Column:
    return F.try_divide(f"{name}_sum", f"{name}_n") if aggregate.startswith("avg(") else F.col(name)
