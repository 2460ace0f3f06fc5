"""Judge a table of findings: one verdict per claim, with the reason and the rows behind it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimcheck.functions.claims import claim_agrees
from claimcheck.functions.evidence import implausible_reason, is_sql, population_mismatch
from claimcheck.functions.guard import quote_ident
from claimcheck.functions.numbers import (
    ABS_TOL,
    REL_TOL,
    float_text,
    is_close,
    is_integer_text,
    parse_number,
)
from claimcheck.functions.runlogs import run_error, stdout_result, stdout_rows
from claimcheck.functions.text import fold, let, quoted, strip_text
from claimcheck.operators.recompute import attach, recompute, route_evidences
from claimcheck.session import ClaimSession, adopt

VERDICTS = ["verified", "unverified", "contradicted"]
NARROW_SHARE = 0.10
# Columns of a findings table. `value_text` is the claimed value as written;
# `value_num` is set when `value_kind` is 'number'.
FINDING_SCHEMA = (
    "finding_id string, report_id string, claim string, evidence string, "
    "value_kind string, value_num double, value_text string"
)


def provenance_note(evidence_rows: Column, total_rows: Column) -> Column:
    """'narrow_subset' when the evidence rests on under a tenth of the dataset."""
    share = F.try_divide(evidence_rows.cast("double"), total_rows.cast("double"))
    return F.when((total_rows > 0) & (share < NARROW_SHARE), "narrow_subset")


def provenance_caption(evidence_rows: Column, total_rows: Column, note: Column) -> Column:
    of_total = F.coalesce(F.concat(F.lit(" of "), total_rows.cast("string")), F.lit(""))
    narrow = (
        " Narrow subset (<10% of the dataset) -- read the claim's wording against this population."
    )
    return F.concat(
        F.lit("Evidence touched "),
        evidence_rows.cast("string"),
        of_total,
        F.lit(" rows."),
        F.when(note == "narrow_subset", narrow).otherwise(""),
    )


def recomputed_text(raw: Column) -> Column:
    """A recomputed number the way it is reported: plain integers, else a plain double."""

    def integer(digits: Column) -> Column:
        return F.coalesce(digits.try_cast("decimal(38,0)").cast("string"), digits)

    return F.when(
        is_integer_text(raw), let(F.replace(strip_text(raw), F.lit("_"), F.lit("")), integer)
    ).otherwise(float_text(parse_number(raw)))


# The rules; `_rule` has their order of precedence.
RULES = [
    ("unverified", "evidence_does_not_touch_data"),
    ("unverified", "not_recomputed"),
    ("unverified", "not_comparable"),
    ("contradicted", "value_differs"),
    ("contradicted", "claim_text_disagrees_with_value"),
    ("unverified", "population_mismatch_suspected"),
    ("verified", "value_matches"),
    ("unverified", "claim_incomplete"),
    ("unverified", "timed_out"),
]


# What a claim's words say of its value and of its evidence.
AGREES, MISMATCH, INCOMPLETE = "_claim_agrees", "_population_mismatch", "_incomplete"
PYTHON = "_python"
# The recomputed value as a number, where it has been read per distinct text.
NUMBER = "_read_number"


def with_claim_rules(findings: DataFrame, rel_tol: float = REL_TOL, abs_tol: float = ABS_TOL) -> DataFrame:
    """Findings with the rules that need their texts but not the recomputed value.

    Worked out before values are joined: claims and evidences cross that shuffle only if they are read behind it.
    """
    checked, is_numeric = F.col("implausible").isNull(), F.col("value_kind") == "number"
    return findings.withColumns(
        {
            AGREES: F.when(checked & is_numeric, claim_agrees(F.col("claim"), F.col("value_num"), rel_tol, abs_tol)),
            MISMATCH: F.when(checked, population_mismatch(F.col("evidence"), F.col("claim"))),
            INCOMPLETE: _incomplete(),
        }
    )


def with_verdict(recomputed: DataFrame, rel_tol: float = REL_TOL, abs_tol: float = ABS_TOL) -> DataFrame:
    """Apply the verdict precedence to findings carrying raw, error and implausible.

    The rule that decides is worked out once, as a number; verdict, reason and detail are
    separate columns read from it, so a query that counts verdicts renders no detail.
    """
    is_numeric = F.col("value_kind") == "number"
    if AGREES not in recomputed.columns:
        recomputed = with_claim_rules(recomputed, rel_tol, abs_tol)
    number = F.col(NUMBER) if NUMBER in recomputed.columns else parse_number(F.col("raw"))
    ruled = recomputed.withColumn("_number", F.when(is_numeric, number)).withColumn("_rule", _rule(rel_tol, abs_tol))
    verdict = F.element_at(F.array(*[F.lit(v) for v, _ in RULES]), F.col("_rule"))
    reason = F.element_at(F.array(*[F.lit(r) for _, r in RULES]), F.col("_rule"))
    shown = F.when(is_numeric, recomputed_text(F.col("raw"))).otherwise(F.col("raw"))
    kept = [
        quote_ident(c)
        for c in recomputed.columns
        if c not in ("raw", "error", "implausible", "evidence_row_count", AGREES, MISMATCH, INCOMPLETE, NUMBER)
    ]
    return ruled.select(
        *kept,
        verdict.alias("verdict"),
        reason.alias("reason"),
        _detail(shown, rel_tol, abs_tol).alias("detail"),
        F.when(verdict != "unverified", shown).alias("recomputed_text"),
        F.when(verdict != "unverified", F.col("_number")).alias("recomputed_num"),
        F.when(F.col("implausible").isNull(), F.col("evidence_row_count")).alias("evidence_row_count"),
    )


def _rule(rel_tol: float, abs_tol: float) -> Column:
    """Which of RULES decides, counted from 1."""
    is_numeric, number, value = F.col("value_kind") == "number", F.col("_number"), F.col("value_num")
    matches = F.when(is_numeric, is_close(number, value, rel_tol, abs_tol)).otherwise(
        fold(F.col("raw")) == fold(F.col("value_text"))
    )
    return (
        F.when(F.col("implausible").isNotNull(), 1)
        .when(F.col(INCOMPLETE), 8)
        .when(F.col("error").rlike(r"timed out after [0-9.e+-]+ s\z"), 9)
        .when(F.col("error").isNotNull(), 2)
        .when(is_numeric & number.isNull(), 3)
        .when(~F.coalesce(matches, F.lit(False)), 4)
        .when(is_numeric & ~F.col(AGREES), 5)
        .when(F.col(MISMATCH).isNotNull(), 6)
        .otherwise(7)
    )


def _incomplete() -> Column:
    """No claim, no kind of value, or no value of that kind."""
    kind = F.col("value_kind")
    return (
        F.col("claim").isNull()
        | kind.isNull()
        | ((kind == "number") & F.col("value_num").isNull())
        | ((kind == "string") & F.col("value_text").isNull())
    )


def _detail(shown: Column, rel_tol: float, abs_tol: float) -> Column:
    """The deciding rule in words."""
    rule, is_numeric = F.col("_rule"), F.col("value_kind") == "number"
    tolerances = F.lit(f" (rel_tol={rel_tol}, abs_tol={abs_tol})")
    claimed = F.when(F.col("value_kind") == "string", quoted(F.col("value_text"))).otherwise(F.col("value_text"))
    raw = quoted(F.col("raw"))

    def explained(*detail: str | Column) -> Column:
        return F.concat(F.element_at(F.array(*[F.lit(r) for _, r in RULES]), rule), F.lit(": "), *detail)

    compared = F.concat(
        F.lit("recomputed "),
        F.when(is_numeric, shown).otherwise(raw),
        F.when(rule == 4, " does NOT match claimed ").otherwise(" matches claimed "),
        claimed,
        F.when(is_numeric, tolerances).otherwise(" (string compare)"),
    )
    return (
        F.when(rule == 1, explained("implausible"))
        .when(rule.isin(2, 9), F.col("error"))
        .when(
            rule == 3,
            F.concat(
                F.lit("claimed value "), claimed, F.lit(" is numeric but the recomputed value "), raw,
                F.lit(" is not -- values are not comparable"),
            ),
        )
        .when(
            rule == 5,
            explained(
                F.lit("claim "), quoted(F.col("claim")),
                F.lit(" quotes no number matching the claimed value "), claimed, tolerances,
            ),
        )
        .when(rule == 8, explained(F.lit("the claim, its kind or its value is missing")))
        .when(rule == 6, explained(F.col(MISMATCH)))
        .otherwise(compared)
    )


def with_run_logs(findings: DataFrame, run_logs: DataFrame) -> DataFrame:
    """Take Python evidence's value and row count from captured runs (evidence, ok, stdout, error).

    Evidence is never executed here; a text without a captured run stays unchecked. Of several
    runs of one text the last counts, by the column `run_at` where the logs have it; without
    it, or among equals, a successful one.
    """
    order = ["run_at"] if "run_at" in run_logs.columns else []
    logs = (
        run_logs.groupBy("evidence")
        .agg(F.max(F.struct(*order, "ok", "stdout", "error")).alias("run"))
        .select(
            "evidence",
            run_error(F.col("run.ok"), F.col("run.stdout"), F.col("run.error")).alias("run_error"),
            stdout_result(F.col("run.stdout")).alias("run_raw"),
            stdout_rows(F.col("run.stdout")).alias("run_rows"),
            F.lit(True).alias("logged"),
        )
    )
    python = ~is_sql(F.col("evidence"))
    plain = [quote_ident(c) for c in findings.columns if c not in ("raw", "error", "evidence_row_count")]
    failed = F.when(F.col("logged").isNull(), "no captured run for Python evidence").otherwise(F.col("run_error"))
    return findings.join(logs, "evidence", "left").select(
        *plain,
        F.when(python, F.col("run_raw")).otherwise(F.col("raw")).alias("raw"),
        F.when(python, failed).otherwise(F.col("error")).alias("error"),
        F.when(python & F.col("run_error").isNull(), F.col("run_rows"))
        .otherwise(F.col("evidence_row_count"))
        .alias("evidence_row_count"),
    )


def judge_findings(
    spark: SparkSession,
    findings: DataFrame,
    dataset: DataFrame,
    dataset_path: str | None = None,
    run_logs: DataFrame | None = None,
    rel_tol: float = REL_TOL,
    abs_tol: float = ABS_TOL,
    seconds: float | None = None,
) -> DataFrame:
    """One verdict per finding, recomputed from `dataset`.

    A text that runs by itself longer than `seconds` is unverified, reason `timed_out`.

    The result belongs to a session of its own; `claimcheck.session.adopt` binds it to another.
    """
    session = ClaimSession(spark, seconds)
    session.register(dataset)
    findings = session.adopt(findings)
    plausible = findings.withColumn("implausible", implausible_reason(F.col("evidence"), dataset_path))
    ruled = with_claim_rules(plausible, rel_tol, abs_tol).withColumn(PYTHON, ~is_sql(F.col("evidence")))
    routed = route_evidences(session, ruled)
    results = recompute(session, routed)
    if run_logs is not None:
        recomputed = with_run_logs(attach(routed, results), session.adopt(run_logs))
    else:
        results.number = NUMBER
        recomputed = attach(routed, results).withColumn(
            "error", F.when(F.col(PYTHON), "no captured run for Python evidence").otherwise(F.col("error"))
        )
    total = session.data.count()
    return (
        with_verdict(recomputed.drop(PYTHON), rel_tol, abs_tol)
        .withColumn("total_rows", F.lit(total).cast("bigint"))
        .withColumn(
            "provenance_note", provenance_note(F.col("evidence_row_count"), F.col("total_rows"))
        )
    )


def judge_datasets(
    spark: SparkSession, findings: DataFrame, datasets: dict[str, DataFrame], **options
) -> DataFrame:
    """Judge findings over several datasets; `findings.dataset_id` names the one each is about.

    A finding about no dataset or an unknown one is `unverified`.
    """
    judged = [
        adopt(spark, judge_findings(spark, findings.where(F.col("dataset_id") == name), data, **options))
        for name, data in datasets.items()
    ]
    known = F.coalesce(F.col("dataset_id").isin(list(datasets)), F.lit(False))
    unknown = findings.where(~known)
    fixed = {
        "verdict": F.lit("unverified"),
        "reason": F.lit("unknown_dataset"),
        "detail": F.concat(F.lit("unknown_dataset: "), F.coalesce("dataset_id", F.lit("none named"))),
    }
    lost = unknown.select(
        *[
            F.col(quote_ident(f.name)) if f.name in findings.columns else fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in judged[0].schema
        ]
    )
    return reduce(DataFrame.unionByName, [*judged, lost])


def verdict_summary(judged: DataFrame, *keys: str) -> DataFrame:
    """Verdict counts per report, zeros kept."""
    return judged.groupBy(*keys).agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    )
