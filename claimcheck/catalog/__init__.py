"""Queries registered for checking and benchmarking, each beside the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimcheck.session import ClaimSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without `sql` only its rows can be checked."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Input rows made from the given tables with the SQL text the oracle shares."""
    session = ClaimSession(spark)
    for name in tables:
        table(session.spark, sf_dir, name).createOrReplaceTempView(name)
    return session.spark.sql(sql)


def load() -> None:
    """Import every module that registers queries."""
    from claimcheck.catalog import (  # noqa: F401
        baselines,
        claims,
        judging,
        lies,
        profiling,
        reporting,
        sql,
        transcripts,
    )
