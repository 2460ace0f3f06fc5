"""How well the judge does on planted cases.

Judged cases are counted once, per (class, magnitude, tampered). Everything else is
read from that table, whose size is the case grid's, not the number of cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimcheck.functions.numbers import ABS_TOL, safe_rate
from claimcheck.operators.planting import ATTACK_CLASSES, EXPECTED_VERDICT, MAGNITUDES
from claimcheck.session import materialize



def _caught() -> Column:
    return F.col("verdict") != "verified"


def outcome_counts(judged: DataFrame) -> DataFrame:
    """n, caught and mechanism counts per (attack_class, magnitude, tampered)."""
    expected = F.create_map(*[F.lit(x) for pair in EXPECTED_VERDICT.items() for x in pair])
    intended = F.try_element_at(expected, F.col("attack_class")) == F.col("verdict")
    return judged.groupBy("attack_class", "magnitude", "tampered").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(_caught()).alias("caught"),
        F.count_if(_caught() & intended).alias("intended"),
    )


def _total(value: Column, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0).cast("bigint"))


def overall(counts: DataFrame) -> DataFrame:
    lie, n, caught = F.col("tampered"), F.col("n"), F.col("caught")
    return (
        counts.agg(
            _total(caught, lie).alias("true_positives"),
            _total(n - caught, lie).alias("false_negatives"),
            _total(caught, ~lie).alias("false_positives"),
            _total(n - caught, ~lie).alias("true_negatives"),
        )
        .withColumn("precision", _share("true_positives", "false_positives"))
        .withColumn("recall", _share("true_positives", "false_negatives"))
        .withColumn("false_positive_rate", _share("false_positives", "true_negatives"))
    )


def _share(part: str, rest: str) -> Column:
    return safe_rate(F.col(part), F.col(part) + F.col(rest))


def mechanism_match(counts: DataFrame) -> DataFrame:
    """Caught lies that got the verdict their class is meant to draw."""
    return counts.agg(
        _total(F.col("caught"), F.col("tampered")).alias("caught"),
        _total(F.col("intended"), F.col("tampered")).alias("used_intended_mechanism"),
    ).withColumn("rate", safe_rate(F.col("used_intended_mechanism"), F.col("caught")))


def magnitude_key(magnitude: Column) -> Column:
    return F.regexp_replace(magnitude.cast("double").cast("string"), r"\.0$", "")


def _on_grid(counts: DataFrame, grid: DataFrame, keys: list[str], rate: str) -> DataFrame:
    """Caught and total per grid cell, empty cells zero."""
    sums = (
        counts.where("tampered")
        .groupBy(*keys)
        .agg(F.sum("caught").alias("caught"), F.sum("n").alias("n"))
    )
    zero = F.lit(0).cast("bigint")
    return grid.join(sums, keys, "left").select(
        *keys,
        F.coalesce("caught", zero).alias("caught"),
        F.coalesce("n", zero).alias("n"),
        safe_rate(F.coalesce("caught", zero), F.coalesce("n", zero)).alias(rate),
    )


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("magnitude", magnitude_key(F.col("magnitude")))


def by_class(counts: DataFrame, classes: list[str] = ATTACK_CLASSES) -> DataFrame:
    grid = counts.sparkSession.createDataFrame([(c,) for c in classes], "attack_class string")
    return _on_grid(counts, grid, ["attack_class"], "recall")


def by_magnitude(counts: DataFrame, magnitudes: list[float] = MAGNITUDES) -> DataFrame:
    grid = counts.sparkSession.createDataFrame([(m,) for m in magnitudes], "magnitude double")
    return _named(_on_grid(counts, grid, ["magnitude"], "recall"))


def by_cell(
    counts: DataFrame, classes: list[str] = ATTACK_CLASSES, magnitudes: list[float] = MAGNITUDES
) -> DataFrame:
    cells = [(c, m) for c in classes for m in magnitudes]
    grid = counts.sparkSession.createDataFrame(cells, "attack_class string, magnitude double")
    return _named(_on_grid(counts, grid, ["attack_class", "magnitude"], "catch_rate"))


def missed_cases(judged: DataFrame) -> DataFrame:
    """Lies that passed, in case order."""
    return (
        judged.where(F.col("tampered") & ~_caught())
        .select("case_idx", "base_label", "attack_class", "magnitude", "direction")
        .orderBy("case_idx")
    )


def headline(counts: DataFrame) -> DataFrame:
    """Catch rate of lies of 20 % and more, recall at 5 %, and both in one sentence."""
    swept = F.col("tampered") & F.col("magnitude").isin(MAGNITUDES)
    large, small = swept & (F.col("magnitude") >= 0.2), swept & (F.col("magnitude") == 0.05)
    sums = counts.agg(
        _total(F.col("caught"), large).alias("large_caught"),
        _total(F.col("n"), large).alias("large_n"),
        _total(F.col("caught"), small).alias("small_caught"),
        _total(F.col("n"), small).alias("small_n"),
    )
    large_rate = F.coalesce(F.try_divide(F.col("large_caught"), F.col("large_n")), F.lit(0.0))

    def percent(rate: Column) -> Column:
        return F.concat(F.rint(rate * 100.0).cast("bigint").cast("string"), F.lit("%"))

    return sums.select(
        large_rate.alias("catch_rate_large"),
        safe_rate(F.col("small_caught"), F.col("small_n")).alias("recall_small"),
    ).withColumn(
        "headline",
        F.concat(
            F.lit("The judge catches "),
            percent(F.col("catch_rate_large")),
            F.lit(" of distortions >=20%; at 5% catch-rate dips to "),
            percent(F.col("recall_small")),
            F.lit(f" (small distortions of small values fall under the abs_tol={ABS_TOL} floor)."),
        ),
    )


def base_gate(judged_bases: DataFrame) -> DataFrame:
    """Honest bases that do not verify; planting may go ahead only when there are none."""
    return judged_bases.where(_caught()).select("base_label", "verdict", "detail")


def write_metrics(judged: DataFrame, path: str, meta: dict[str, str] | None = None) -> None:
    """Write every metric table, with a meta row, as JSON under `path`."""
    judged = materialize(judged)
    counts = outcome_counts(judged)
    tables = {
        "overall": overall(counts),
        "mechanism_match": mechanism_match(counts),
        "by_class": by_class(counts),
        "by_magnitude": by_magnitude(counts),
        "by_class_magnitude": by_cell(counts),
        "headline": headline(counts),
        "missed_cases": missed_cases(judged),
        "meta": meta_row(counts, meta or {}),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def meta_row(counts: DataFrame, extra: dict[str, str]) -> DataFrame:
    """Case totals and the settings the cases were made with."""
    row = counts.agg(
        F.sum("n").alias("n_cases"),
        _total(F.col("n"), F.col("tampered")).alias("n_tampered"),
        _total(F.col("n"), ~F.col("tampered")).alias("n_clean_controls"),
    )
    return row.select(
        "*",
        F.array(*map(F.lit, ATTACK_CLASSES)).alias("attack_classes"),
        F.array(*map(F.lit, MAGNITUDES)).alias("magnitudes"),
        *[F.lit(value).alias(key) for key, value in extra.items()],
    )
