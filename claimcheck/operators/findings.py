"""Findings out of profiled facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimcheck.functions.numbers import float_text, number_text, percent_text, round_half_even


def generate_findings(facts: DataFrame, templates: DataFrame) -> DataFrame:
    """Render each fact (label, value) into the templates of its label.

    A template (label, kind, claim_template, evidence) is a 'rate', shown as a percentage
    and stored to 4 decimals, or a 'count', shown and stored as a whole number.
    """
    rate = F.col("kind") == "rate"
    value = F.when(rate, round_half_even(F.col("value"), 4)).otherwise(F.rint("value"))
    count_text = number_text(F.col("value"), F.lit(True))
    shown = F.when(rate, percent_text(F.col("value"), 1)).otherwise(count_text)
    return facts.join(templates, "label").select(
        *[c for c in facts.columns if c != "value"],
        F.replace(F.col("claim_template"), F.lit("{n}"), shown).alias("claim"),
        "evidence",
        F.lit("number").alias("value_kind"),
        value.alias("value_num"),
        F.when(rate, float_text(round_half_even(F.col("value"), 4))).otherwise(count_text).alias("value_text"),
    )
