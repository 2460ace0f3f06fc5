"""Dataset profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimcheck.catalog import derived, query, table
from claimcheck.functions.numbers import coerce_number
from claimcheck.operators import profile
from claimcheck.session import materialize, shared_dir
from claimcheck.sources.datasets import read_csv

# orders with missing, blank and non-numeric values put in by key.
DIRTY_ORDERS = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
       CASE WHEN o_orderkey % 97 = 0 THEN ' ' ELSE CAST(o_custkey AS STRING) END AS custkey_text,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 0 THEN ''
            ELSE o_orderpriority END AS o_orderpriority,
       o_orderstatus,
       o_totalprice,
       CASE WHEN o_orderkey % 107 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate
FROM orders
"""
DIRTY_COLUMNS = ["o_orderkey", "o_custkey", "custkey_text", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate"]
DIRTY_TEXT_COLUMNS = ["custkey_text", "o_orderpriority", "o_orderstatus"]
LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


@query("profile_row_count", "SELECT count(*)::BIGINT AS row_count FROM lineitem")
def row_count(spark, sf_dir):
    return profile.row_count(table(spark, sf_dir, "lineitem"))


@query(
    "profile_schema",
    _union(
        f"SELECT '{c}' AS column_name, {i} AS ordinal, count({c})::BIGINT AS n_valid FROM lineitem"
        for i, c in enumerate(LINEITEM)
    ),
)
def schema(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    valid = profile.profile_report(lineitem).select(
        "column_name", (F.col("n_rows") - F.col("n_null")).alias("n_valid")
    )
    return profile.schema_table(lineitem).join(valid, "column_name").select("column_name", "ordinal", "n_valid")


@query(
    "profile_null_counts",
    _union(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS n_null FROM ({DIRTY_ORDERS})"
        for c in DIRTY_COLUMNS
    ),
)
def null_counts(spark, sf_dir):
    return profile.null_counts(derived(spark, sf_dir, DIRTY_ORDERS, "orders"))


@query(
    "profile_preview",
    "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
)
def preview(spark, sf_dir):
    return profile.preview(table(spark, sf_dir, "orders"), 5, ["o_orderkey"])


@query(
    "profile_report",
    _union(
        f"SELECT '{c}' AS column_name, {i} AS ordinal, '{t}' AS column_type, count(*)::BIGINT AS n_rows, "
        f"(count(*) - count({c}))::BIGINT AS n_null FROM lineitem"
        for i, (c, t) in enumerate(LINEITEM.items())
    ),
)
def report(spark, sf_dir):
    return profile.profile_report(table(spark, sf_dir, "lineitem"))


def _summary_sql() -> str:
    parts = []
    for c, t in LINEITEM.items():
        number = t in ("bigint", "int", "double")
        avg = f"round(avg({c}), 4)" if number else "NULL::DOUBLE"
        std = f"round(stddev_samp({c}), 4)" if number else "NULL::DOUBLE"
        spread = ", ".join(
            f"{f'quantile_disc({c}, 0.{q})::DOUBLE' if number else 'NULL::DOUBLE'} AS q{q}" for q in (25, 50, 75)
        )
        parts.append(
            f"SELECT '{c}' AS column_name, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, "
            f"{avg} AS avg, {std} AS std, {spread}, count(DISTINCT {c})::BIGINT AS n_unique, count(*)::BIGINT AS count, "
            f"(100.0 * (count(*) - count({c})) / count(*))::DOUBLE AS null_percentage FROM lineitem"
        )
    return _union(parts)


@query("profile_summarize", _summary_sql())
def summarize(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return (
        profile.summarize_exact(lineitem)
        .withColumns({"avg": F.round("avg", 4), "std": F.round("std", 4)})
        .drop("column_type")
    )


@query("profile_summarize_approx")
def summarize_approx(spark, sf_dir):
    return profile.summarize(table(spark, sf_dir, "lineitem"))


_NUMERIC = "column_type NOT IN ('VARCHAR', 'DATE') AND column_type NOT LIKE 'TIMESTAMP%'"


@query(
    "profile_sketch_bounds",
    f"""
SELECT column_name, true AS unique_kept, CASE WHEN {_NUMERIC} THEN true END AS q25_kept,
  CASE WHEN {_NUMERIC} THEN true END AS q50_kept, CASE WHEN {_NUMERIC} THEN true END AS q75_kept
FROM (DESCRIBE SELECT * FROM lineitem)
""",
)
def sketch_bounds(spark, sf_dir):
    """The sketches of the summary against exact ranks and exact distinct counts."""
    lineitem = table(spark, sf_dir, "lineitem")
    return profile.sketch_bounds(lineitem, materialize(profile.summarize(lineitem), "summary"))


CUSTOMER_CSV = {
    "c_custkey": "int", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string",
}


@query(
    "csv_roundtrip_profile",
    _union(
        f"SELECT '{c}' AS column_name, {i} AS ordinal, '{t}' AS column_type, count(*)::BIGINT AS n_rows, "
        f"(count(*) - count({c}))::BIGINT AS n_null FROM customer"
        for i, (c, t) in enumerate(CUSTOMER_CSV.items())
    ),
)
def csv_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "customer-csv")
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    return profile.profile_report(read_csv(spark, path))


@query(
    "dq_blank_counts",
    _union(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE trim({c}) = '')::BIGINT AS n_blank FROM ({DIRTY_ORDERS})"
        for c in DIRTY_TEXT_COLUMNS
    ),
)
def blank_counts(spark, sf_dir):
    return profile.blank_counts(derived(spark, sf_dir, DIRTY_ORDERS, "orders"))


@query(
    "dq_numeric_text",
    "SELECT column_name, n_number, n_blank, n_other, CASE WHEN n_number = 0 OR n_other > 0 THEN 'text' "
    "WHEN n_blank > 0 THEN 'number with blanks' ELSE 'number' END AS kind FROM ("
    + _union(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE try_cast(trim({c}) AS DOUBLE) IS NOT NULL)::BIGINT AS n_number, "
        f"count(*) FILTER (WHERE trim({c}) = '')::BIGINT AS n_blank, "
        f"count(*) FILTER (WHERE trim({c}) <> '' AND try_cast(trim({c}) AS DOUBLE) IS NULL)::BIGINT AS n_other "
        f"FROM ({DIRTY_ORDERS})"
        for c in DIRTY_TEXT_COLUMNS
    )
    + ")",
)
def numeric_text(spark, sf_dir):
    return profile.numeric_text(derived(spark, sf_dir, DIRTY_ORDERS, "orders"))


@query(
    "dq_coerce_numeric",
    "SELECT o_orderkey, coalesce(try_cast(trim(custkey_text) AS DOUBLE), 0.0)::DOUBLE AS number, "
    f"coalesce(try_cast(trim(o_orderpriority) AS DOUBLE), 0.0)::DOUBLE AS other FROM ({DIRTY_ORDERS})",
)
def coerce_numeric(spark, sf_dir):
    return derived(spark, sf_dir, DIRTY_ORDERS, "orders").select(
        "o_orderkey",
        coerce_number(F.col("custkey_text")).alias("number"),
        coerce_number(F.col("o_orderpriority")).alias("other"),
    )


@query(
    "class_balance",
    "SELECT event_type AS class, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share "
    "FROM events GROUP BY event_type",
)
def class_balance(spark, sf_dir):
    balance = profile.class_balance(table(spark, sf_dir, "events"), "event_type")
    return balance.withColumn("share", F.round("share", 6))


@query(
    "categorical_mode",
    "SELECT o_orderpriority AS value, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 1",
)
def categorical_mode(spark, sf_dir):
    return profile.categorical_mode(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    "base_facts",
    """
SELECT 'urgent_share' AS label, round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0 END), 6)::DOUBLE AS value FROM orders
UNION ALL SELECT 'urgent_share_finished', round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0 END), 6)::DOUBLE FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'mean_price', round(avg(o_totalprice), 2)::DOUBLE FROM orders
UNION ALL SELECT 'mean_price_urgent', round(avg(o_totalprice), 2)::DOUBLE FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'n_finished', count(*)::DOUBLE FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'sum_custkey', sum(o_custkey)::DOUBLE FROM orders
UNION ALL SELECT 'target_rate', round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6)::DOUBLE FROM orders
""",
)
def base_facts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    urgent, finished = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F"
    facts = profile.scalar_facts(
        orders,
        {
            "urgent_share": ("avg", urgent.cast("double"), None),
            "urgent_share_finished": ("avg", urgent.cast("double"), finished),
            "mean_price": ("avg", F.col("o_totalprice"), None),
            "mean_price_urgent": ("avg", F.col("o_totalprice"), urgent),
            "n_finished": ("count", F.lit(1), finished),
            "sum_custkey": ("sum", F.col("o_custkey"), None),
        },
    )
    rate = profile.target_rate(orders, "o_orderstatus", "F").select(
        F.lit("target_rate").alias("label"), F.col("rate").alias("value")
    )
    digits = F.when(F.col("label").startswith("mean"), F.round("value", 2)).otherwise(F.round("value", 6))
    return facts.unionByName(rate).withColumn("value", digits)
