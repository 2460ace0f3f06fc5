"""Plant controlled lies into honest base findings.

A bases table holds base_pos BIGINT (unique), base_label, evidence_sql, claim_template
(with one {n}), as_int, value DOUBLE, subset_evidence_sql and subset_value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimcheck.functions.numbers import distort, float_text, number_text

# Fixed values.
MAGNITUDES = [0.05, 0.20, 0.50, 2.00]
EXPECTED_VERDICT = {
    "value_swap": "contradicted",
    "claim_mismatch": "contradicted",
    "fabricated_evidence": "unverified",
    "alias_dodge": "unverified",
    "population_switch": "unverified",
}
ATTACK_CLASSES = list(EXPECTED_VERDICT)
UNSWEPT_CLASSES = ["population_switch"]


def directions(magnitude: float) -> list[int]:
    """Both signs, but only upwards from 100 % on, where minus would flip the number's sign."""
    return [1, -1] if magnitude < 1.0 else [1]


def case_grid(magnitudes: list[float], classes: list[str]) -> list[tuple[str, float, int]]:
    """(class, magnitude, direction) of every case one base can yield, the honest control first."""
    grid = [("clean", 0.0, 0)]
    for attack_class in classes:
        if attack_class in UNSWEPT_CLASSES:
            grid.append((attack_class, 0.0, 0))
        else:
            grid += [(attack_class, m, d) for m in magnitudes for d in directions(m)]
    return grid


def plant_rejects(bases: DataFrame) -> DataFrame:
    """Bases whose value is zero: no distortion of zero is a lie."""
    reason = F.concat(
        F.lit("base finding '"),
        "base_label",
        F.lit("' has value 0; distortions of 0 are still 0 (not a lie)"),
    )
    return bases.where(F.col("value") == 0).withColumn("problem", reason)


def render_claim(template: Column, number: Column) -> Column:
    return F.replace(template, F.lit("{n}"), number)


def honest_findings(bases: DataFrame) -> DataFrame:
    """Each base as an untampered finding."""
    shown = number_text(F.col("value"), F.col("as_int"))
    return bases.select(
        "base_pos",
        "base_label",
        render_claim(F.col("claim_template"), shown).alias("claim"),
        F.col("evidence_sql").alias("evidence"),
        F.lit("number").alias("value_kind"),
        F.col("value").alias("value_num"),
        F.when(F.col("as_int"), shown).otherwise(float_text(F.col("value"))).alias("value_text"),
    )


def generate_cases(
    bases: DataFrame,
    magnitudes: list[float] = MAGNITUDES,
    classes: list[str] = ATTACK_CLASSES,
    zero_bases: str = "raise",
) -> DataFrame:
    """One honest control per base plus its planted lies, as judgeable findings.

    Every base expands on its own against the constant case grid; its numbers are written
    out once, before it expands. Only bases are shuffled: a few bytes of them make many cases,
    so they are dealt out to all tasks. `case_idx` keeps the order (base, class, magnitude,
    direction). `zero_bases` is 'raise' or 'skip' (see `plant_rejects`).
    """
    grid = case_grid(magnitudes, classes)
    sizes = list(dict.fromkeys((magnitude, direction) for _, magnitude, direction in grid))
    cases = F.array(
        *[
            F.struct(
                F.lit(slot).cast("bigint").alias("slot"),
                F.lit(attack_class).alias("attack_class"),
                F.lit(float(magnitude)).alias("magnitude"),
                F.lit(direction).alias("direction"),
                F.lit(sizes.index((magnitude, direction))).alias("_size"),
            )
            for slot, (attack_class, magnitude, direction) in enumerate(grid)
        ]
    )
    if zero_bases == "raise":
        problem = F.concat(F.lit("base finding has value 0: "), "base_label")
        bases = bases.withColumn(
            "value", F.when(F.col("value") == 0, F.raise_error(problem).cast("double")).otherwise(F.col("value"))
        )
    else:
        bases = bases.where(F.col("value") != 0)
    cls = F.col("attack_class")
    switched, forged = cls == "population_switch", cls.isin("fabricated_evidence", "alias_dodge")
    lie = F.get("_lies", F.col("_size"))
    tasks = int(bases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = (
        bases.repartition(tasks, "base_pos")
        .select(
            "*",
            _written(F.col("value"), F.col("as_int")).alias("_honest"),
            F.when(F.col("subset_value").isNotNull(), _written(F.col("subset_value"), F.col("as_int"))).alias("_subset"),
            _lies(sizes).alias("_lies"),
        )
        .select("*", F.inline(cases))
        .where(~switched | (F.col("subset_evidence_sql").isNotNull() & F.col("subset_value").isNotNull()))
        .withColumn("_said", F.when(switched, F.col("_subset")).when(forged | (cls == "value_swap"), lie).otherwise(F.col("_honest")))
    )
    lie_text = lie.shown
    shown = (
        F.when(forged | (cls == "claim_mismatch"), lie_text)
        .when(switched, F.col("_subset.shown"))
        .otherwise(F.col("_honest.shown"))
    )
    whole = F.col("as_int") & cls.isin("clean", "claim_mismatch", "population_switch")
    return written.select(
        (F.col("base_pos") * len(grid) + F.col("slot")).alias("case_idx"),
        "base_label",
        "attack_class",
        "magnitude",
        "direction",
        (cls != "clean").alias("tampered"),
        render_claim(F.col("claim_template"), shown).alias("claim"),
        F.when(cls == "fabricated_evidence", F.concat(F.lit("SELECT "), lie_text, F.lit(" AS "), "base_label"))
        .when(cls == "alias_dodge", F.concat(F.lit("SELECT "), lie_text, F.lit(" AS data")))
        .when(switched, F.col("subset_evidence_sql"))
        .otherwise(F.col("evidence_sql"))
        .alias("evidence"),
        F.lit("number").alias("value_kind"),
        F.col("_said.value").alias("value_num"),
        F.when(whole, F.col("_said.shown")).otherwise(F.col("_said.plain")).alias("value_text"),
    )


def _written(value: Column, as_int: Column) -> Column:
    """A number with its text in a claim and its text as a value."""
    return F.struct(value.alias("value"), number_text(value, as_int).alias("shown"), float_text(value).alias("plain"))


def _lies(sizes: list[tuple[float, int]]) -> Column:
    """The base's value distorted by each (magnitude, direction), written out."""
    by = F.array(*[F.struct(F.lit(float(m)).alias("magnitude"), F.lit(d).alias("direction")) for m, d in sizes])
    lies = F.transform(by, lambda s: distort(F.col("value"), s.magnitude, s.direction))
    return F.transform(lies, lambda v: _written(v, F.col("as_int")))


def _overwrite(findings: DataFrame, evidence: str, changes: dict[str, Column]) -> DataFrame:
    hit = F.col("evidence") == evidence
    return findings.select(
        *[
            F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
            for c in findings.columns
        ]
    )


def _value(value: float) -> dict[str, Column]:
    return {
        "value_kind": F.lit("number"),
        "value_num": F.lit(float(value)),
        "value_text": F.lit(str(value)),
    }


def tamper_value(findings: DataFrame, evidence: str, claim: str, value: float) -> DataFrame:
    """Overwrite claim and value of the findings resting on `evidence`."""
    return _overwrite(findings, evidence, {"claim": F.lit(claim), **_value(value)})


def tamper_consistent(
    findings: DataFrame, evidence: str, claim: str, value: float, new_evidence: str
) -> DataFrame:
    """Overwrite claim, value and evidence together."""
    changes = {"claim": F.lit(claim), "evidence": F.lit(new_evidence), **_value(value)}
    return _overwrite(findings, evidence, changes)


def tamper(
    findings: DataFrame,
    evidence: str,
    value_lie: tuple[str, float] | None = None,
    consistent_lie: tuple[str, float, str] | None = None,
) -> DataFrame:
    """Apply one lie; the consistent one wins when both are asked for."""
    if consistent_lie:
        return tamper_consistent(findings, evidence, *consistent_lie)
    return tamper_value(findings, evidence, *value_lie) if value_lie else findings
