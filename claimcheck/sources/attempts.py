"""The log of failed attempts: attempt, error, wall_clock_s, n_calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def attempt_log_summary(log: DataFrame) -> DataFrame:
    """Attempts, wall clock and calls per error text."""
    return log.groupBy("error").agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.round(F.sum("wall_clock_s"), 1).alias("wall_clock_s"),
        F.max("wall_clock_s").alias("longest_s"),
        F.sum("n_calls").alias("n_calls"),
    )


def write_attempt_log(log: DataFrame, path: str) -> None:
    log.select("attempt", "error", F.round("wall_clock_s", 1).alias("wall_clock_s"), "n_calls").write.mode(
        "append"
    ).json(path)
