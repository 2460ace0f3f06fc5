"""Planted lies, and how well the judge finds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimcheck.catalog import derived, query, table
from claimcheck.catalog.judging import mixed_claims, MIXED_CLAIMS
from claimcheck.functions import numbers
from claimcheck.operators import planting, quality
from claimcheck.operators.findings import generate_findings
from claimcheck.plans.verify import judge_findings
from claimcheck.session import materialize

BASES = """
WITH per AS (
  SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS hi,
    sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0E0 ELSE 0.0E0 END) AS urgent
  FROM orders GROUP BY o_custkey),
facts AS (
  SELECT count(*) AS n, max(o_totalprice) AS hi,
    sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent,
    max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS finished_hi FROM orders)
SELECT k * 3 AS base_pos, concat('n_', k) AS base_label,
  concat('SELECT count(*) FROM data WHERE o_custkey = ', k) AS evidence_sql,
  'This buyer placed {n} purchases.' AS claim_template, true AS as_int, CAST(n AS DOUBLE) AS value,
  CAST(NULL AS STRING) AS subset_evidence_sql, CAST(NULL AS DOUBLE) AS subset_value FROM per
UNION ALL SELECT k * 3 + 1, concat('top_', k), concat('SELECT max(o_totalprice) FROM data WHERE o_custkey = ', k),
  'The top price of this buyer is {n}.', false, hi, NULL, NULL FROM per
UNION ALL SELECT k * 3 + 2, concat('urgent_', k),
  concat('SELECT avg(CASE WHEN o_orderpriority = ''1-URGENT'' THEN 1.0 ELSE 0 END) FROM data WHERE o_custkey = ', k),
  'The urgent share of this buyer is {n}.', false, urgent / CAST(n AS DOUBLE), NULL, NULL FROM per
UNION ALL SELECT -2, 'all_n', 'SELECT count(*) FROM data', 'There are {n} purchases.', true, CAST(n AS DOUBLE),
  'SELECT count(*) FROM data WHERE o_orderpriority = ''1-URGENT''', CAST(urgent AS DOUBLE) FROM facts
UNION ALL SELECT -1, 'all_top', 'SELECT max(o_totalprice) FROM data', 'The top price is {n}.', false, hi,
  'SELECT max(o_totalprice) FROM data WHERE o_orderstatus = ''F''', finished_hi FROM facts
"""

GRID = planting.case_grid(planting.MAGNITUDES, planting.ATTACK_CLASSES)
_GRID_ROWS = ", ".join(f"({i}, '{c}', {m}::DOUBLE, {d})" for i, (c, m, d) in enumerate(GRID))


def _text(value: str, as_int: str) -> str:
    """DuckDB text of a number in a claim."""
    trimmed = f"rtrim(rtrim(printf('%.4f', {value}), '0'), '.')"
    return f"CASE WHEN {as_int} THEN round_even({value}, 0)::BIGINT::VARCHAR ELSE {trimmed} END"


CASES_SQL = f"""
SELECT base_pos * {len(GRID)} + slot AS case_idx, *, CASE
    WHEN attack_class IN ('claim_mismatch', 'fabricated_evidence', 'alias_dodge') THEN lie_text
    WHEN attack_class = 'population_switch' THEN {_text('subset_value', 'as_int')} ELSE {_text('value', 'as_int')} END AS shown,
  CASE WHEN attack_class IN ('value_swap', 'fabricated_evidence', 'alias_dodge') THEN lie
    WHEN attack_class = 'population_switch' THEN subset_value ELSE value END AS value_num,
  CASE attack_class WHEN 'fabricated_evidence' THEN concat('SELECT ', lie_text, ' AS ', base_label)
    WHEN 'alias_dodge' THEN concat('SELECT ', lie_text, ' AS data')
    WHEN 'population_switch' THEN subset_evidence_sql ELSE evidence_sql END AS evidence
FROM (SELECT *, {_text('lie', 'as_int')} AS lie_text FROM (
  SELECT b.*, g.*, b.value * (1.0::DOUBLE + g.direction * g.magnitude) AS lie
  FROM ({BASES}) b CROSS JOIN (VALUES {_GRID_ROWS}) g(slot, attack_class, magnitude, direction)
  WHERE b.value <> 0 AND (g.attack_class <> 'population_switch' OR b.subset_value IS NOT NULL)))
"""


def bases(spark, sf_dir):
    return derived(spark, sf_dir, BASES, "orders")


VALUES = """
SELECT l_orderkey, l_linenumber, l_extendedprice AS value,
  CASE l_linenumber % 4 WHEN 0 THEN 0.05E0 WHEN 1 THEN 0.2E0 WHEN 2 THEN 0.5E0 ELSE 2.0E0 END AS magnitude,
  CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END AS direction
FROM lineitem
"""


@query(
    "distort",
    f"SELECT l_orderkey, l_linenumber, value * (1.0::DOUBLE + direction * magnitude) AS lie FROM ({VALUES})",
)
def distort(spark, sf_dir):
    lie = numbers.distort(F.col("value"), F.col("magnitude"), F.col("direction"))
    return derived(spark, sf_dir, VALUES, "lineitem").select("l_orderkey", "l_linenumber", lie.alias("lie"))


TEXT_VALUES = """
SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS as_int,
  CASE l_orderkey % 5 WHEN 0 THEN l_extendedprice / 7.0E0 WHEN 1 THEN -l_discount / 300.0E0
    WHEN 2 THEN l_quantity + 0.5E0 WHEN 3 THEN l_extendedprice + 0.00005E0 ELSE l_quantity / 32.0E0 END AS value
FROM lineitem
"""


@query(
    "render_number",
    f"SELECT l_orderkey, l_linenumber, {_text('value', 'as_int')} AS shown FROM ({TEXT_VALUES})",
)
def render_number(spark, sf_dir):
    shown = numbers.number_text(F.col("value"), F.col("as_int"))
    return derived(spark, sf_dir, TEXT_VALUES, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("shown"))


@query(
    "honest_findings",
    f"SELECT base_label, replace(claim_template, '{{n}}', {_text('value', 'as_int')}) AS claim, evidence_sql AS evidence, "
    f"value AS value_num FROM ({BASES})",
)
def honest_findings(spark, sf_dir):
    return planting.honest_findings(bases(spark, sf_dir)).select("base_label", "claim", "evidence", "value_num")


@query(
    "plant_cases",
    f"SELECT case_idx, base_label, attack_class, magnitude, direction, attack_class <> 'clean' AS tampered, "
    f"replace(claim_template, '{{n}}', shown) AS claim, evidence, 'number' AS value_kind, value_num, "
    f"CASE WHEN as_int AND attack_class IN ('clean', 'claim_mismatch', 'population_switch') THEN round_even(value_num, 0)::BIGINT::VARCHAR "
    f"ELSE value_num::VARCHAR END AS value_text FROM ({CASES_SQL})",
)
def plant_cases(spark, sf_dir):
    return planting.generate_cases(bases(spark, sf_dir), zero_bases="skip")


@query(
    "plant_rejects",
    f"SELECT base_label, concat('base finding ''', base_label, ''' has value 0; distortions of 0 are still 0 (not a lie)') "
    f"AS problem FROM ({BASES}) WHERE value = 0",
)
def plant_rejects(spark, sf_dir):
    return planting.plant_rejects(bases(spark, sf_dir)).select("base_label", "problem")


URGENT_EVIDENCE = "SELECT count(*) FROM data WHERE o_orderpriority = '1-URGENT'"
_URGENT = URGENT_EVIDENCE.replace("'", "''")


@query(
    "tamper_value",
    f"SELECT finding_id, CASE WHEN evidence = '{_URGENT}' THEN '75% were urgent.' ELSE claim END AS claim, evidence, "
    f"CASE WHEN evidence = '{_URGENT}' THEN 0.75 ELSE value_num END AS value_num FROM ({MIXED_CLAIMS})",
)
def tamper_value(spark, sf_dir):
    lied = planting.tamper(mixed_claims(spark, sf_dir), URGENT_EVIDENCE, value_lie=("75% were urgent.", 0.75))
    return lied.select("finding_id", "claim", "evidence", "value_num")


@query(
    "tamper_consistent",
    f"SELECT finding_id, CASE WHEN evidence = '{_URGENT}' THEN 'All urgent.' ELSE claim END AS claim, "
    f"CASE WHEN evidence = '{_URGENT}' THEN 'SELECT 1.0 AS share' ELSE evidence END AS evidence, "
    f"CASE WHEN evidence = '{_URGENT}' THEN 1.0 ELSE value_num END AS value_num FROM ({MIXED_CLAIMS})",
)
def tamper_consistent(spark, sf_dir):
    lied = planting.tamper(
        mixed_claims(spark, sf_dir),
        URGENT_EVIDENCE,
        value_lie=("75% were urgent.", 0.75),
        consistent_lie=("All urgent.", 1.0, "SELECT 1.0 AS share"),
    )
    return lied.select("finding_id", "claim", "evidence", "value_num")


CUSTOMER_FACTS = """
SELECT o_custkey, 'urgent' AS label,
  sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0E0 ELSE 0.0E0 END) / CAST(count(*) AS DOUBLE) AS value
FROM orders GROUP BY o_custkey
UNION ALL SELECT o_custkey, 'finished', CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE)
FROM orders GROUP BY o_custkey
"""


@query(
    "generate_findings",
    f"""
SELECT o_custkey, label, CASE label WHEN 'urgent' THEN concat(printf('%.1f', value * 100.0), '% of purchases were urgent.')
    ELSE concat(value::BIGINT, ' purchases are finished.') END AS claim,
  CASE label WHEN 'urgent' THEN round_even(value, 4) ELSE value END AS value_num
FROM ({CUSTOMER_FACTS})
""",
)
def findings_from_facts(spark, sf_dir):
    facts = derived(spark, sf_dir, CUSTOMER_FACTS, "orders")
    templates = facts.sparkSession.createDataFrame(
        [
            ("urgent", "rate", "{n} of purchases were urgent.", "SELECT 1"),
            ("finished", "count", "{n} purchases are finished.", "SELECT 2"),
        ],
        "label string, kind string, claim_template string, evidence string",
    )
    return generate_findings(facts, templates).select("o_custkey", "label", "claim", "value_num")


def _close(a: str, b: str) -> str:
    return f"abs({a} - {b}) <= greatest(0.01 * greatest(abs({a}), abs({b})), 0.01)"


CASE_VERDICTS = f"""
SELECT *, attack_class <> 'clean' AS tampered, CASE
    WHEN attack_class IN ('fabricated_evidence', 'alias_dodge', 'population_switch') THEN 'unverified'
    WHEN {_close('value', 'value_num')} AND {_close('shown::DOUBLE', 'value_num')} THEN 'verified'
    ELSE 'contradicted' END AS verdict
FROM ({CASES_SQL})
"""


def _overall_sql(judged: str) -> str:
    rate = "coalesce(round_even({0} / nullif({0} + {1}, 0)::DOUBLE, 4), 0.0)"
    return f"""
SELECT *, {rate.format('true_positives', 'false_positives')} AS precision,
  {rate.format('true_positives', 'false_negatives')} AS recall,
  {rate.format('false_positives', 'true_negatives')} AS false_positive_rate
FROM (SELECT count(*) FILTER (WHERE tampered AND verdict <> 'verified')::BIGINT AS true_positives,
  count(*) FILTER (WHERE tampered AND verdict = 'verified')::BIGINT AS false_negatives,
  count(*) FILTER (WHERE NOT tampered AND verdict <> 'verified')::BIGINT AS false_positives,
  count(*) FILTER (WHERE NOT tampered AND verdict = 'verified')::BIGINT AS true_negatives FROM ({judged}))
"""


@query("bench_overall", f"SELECT *, (SELECT count(*) FROM ({BASES}) WHERE value = 0) AS n_rejected_bases FROM ({_overall_sql(CASE_VERDICTS)})")
def bench_overall(spark, sf_dir):
    """Bases from the data, every lie planted, every case judged, outcomes counted."""
    # Judging writes the routed cases; a table of them before that would be read once.
    cases = planting.generate_cases(bases(spark, sf_dir), zero_bases="skip")
    judged = judge_findings(spark, cases, table(spark, sf_dir, "orders"))
    rejected = planting.plant_rejects(bases(spark, sf_dir)).count()
    return quality.overall(quality.outcome_counts(judged)).withColumn("n_rejected_bases", F.lit(rejected).cast("long"))


@query(
    "bench_base_gate",
    f"SELECT base_label, 'contradicted' AS verdict FROM ({BASES}) WHERE base_pos % 97 = 0",
)
def bench_base_gate(spark, sf_dir):
    """Bases whose value was misread (here: every 97th) must not pass."""
    broken = bases(spark, sf_dir).withColumn(
        "value", F.when(F.col("base_pos") % 97 == 0, F.col("value") * 3 + 1).otherwise(F.col("value"))
    )
    judged = judge_findings(spark, planting.honest_findings(broken), table(spark, sf_dir, "orders"))
    return quality.base_gate(judged).select("base_label", "verdict")


# Judged cases as a table of their own, one per line item.
JUDGED_CASES = """
SELECT l_orderkey * 8 + l_linenumber AS case_idx, concat('b', l_suppkey) AS base_label, attack_class,
  attack_class <> 'clean' AS tampered,
  CASE WHEN attack_class IN ('clean', 'population_switch') THEN 0.0E0 ELSE magnitude END AS magnitude,
  CASE WHEN attack_class IN ('clean', 'population_switch') THEN 0 WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END AS direction,
  CASE WHEN l_partkey % 10 < 4 THEN 'contradicted' WHEN l_partkey % 10 < 7 THEN 'unverified' ELSE 'verified' END AS verdict
FROM (SELECT *, CASE l_suppkey % 6 WHEN 0 THEN 'clean' WHEN 1 THEN 'value_swap' WHEN 2 THEN 'claim_mismatch'
    WHEN 3 THEN 'fabricated_evidence' WHEN 4 THEN 'population_switch' ELSE 'clean' END AS attack_class,
  CASE l_linenumber % 3 WHEN 0 THEN 0.05E0 WHEN 1 THEN 0.2E0 ELSE 2.0E0 END AS magnitude FROM lineitem) t
"""
_RATE = "coalesce(round_even(caught / nullif(n, 0)::DOUBLE, 4), 0.0)"
_CLASSES = ", ".join(f"('{c}')" for c in planting.ATTACK_CLASSES)
_MAGNITUDES = ", ".join(f"({m}::DOUBLE, '{m:g}')" for m in planting.MAGNITUDES)
_COUNTED = "count(c.verdict)::BIGINT AS n, count(*) FILTER (WHERE c.verdict <> 'verified')::BIGINT AS caught"


def judged_cases(spark, sf_dir):
    return derived(spark, sf_dir, JUDGED_CASES, "lineitem")


def _counts(spark, sf_dir):
    return materialize(quality.outcome_counts(judged_cases(spark, sf_dir)), "outcomes")


@query(
    "bench_mechanism",
    f"""
SELECT caught, used_intended_mechanism, coalesce(round_even(used_intended_mechanism / nullif(caught, 0)::DOUBLE, 4), 0.0) AS rate
FROM (SELECT count(*) FILTER (WHERE verdict <> 'verified')::BIGINT AS caught, count(*) FILTER (WHERE verdict =
  CASE WHEN attack_class IN ('value_swap', 'claim_mismatch') THEN 'contradicted' ELSE 'unverified' END)::BIGINT
  AS used_intended_mechanism FROM ({JUDGED_CASES}) WHERE tampered)
""",
)
def bench_mechanism(spark, sf_dir):
    return quality.mechanism_match(quality.outcome_counts(judged_cases(spark, sf_dir)))


@query(
    "bench_by_class",
    f"SELECT attack_class, caught, n, {_RATE} AS recall FROM (SELECT g.a AS attack_class, {_COUNTED} "
    f"FROM (VALUES {_CLASSES}) g(a) LEFT JOIN ({JUDGED_CASES}) c ON c.attack_class = g.a GROUP BY g.a)",
)
def bench_by_class(spark, sf_dir):
    return quality.by_class(_counts(spark, sf_dir))


@query(
    "bench_by_magnitude",
    f"SELECT magnitude, caught, n, {_RATE} AS recall FROM (SELECT g.k AS magnitude, {_COUNTED} "
    f"FROM (VALUES {_MAGNITUDES}) g(m, k) LEFT JOIN ({JUDGED_CASES}) c ON c.tampered AND c.magnitude = g.m GROUP BY g.k)",
)
def bench_by_magnitude(spark, sf_dir):
    return quality.by_magnitude(_counts(spark, sf_dir))


@query(
    "bench_by_cell",
    f"SELECT attack_class, magnitude, caught, n, {_RATE} AS catch_rate FROM (SELECT a.a AS attack_class, g.k AS magnitude, {_COUNTED} "
    f"FROM (VALUES {_CLASSES}) a(a) CROSS JOIN (VALUES {_MAGNITUDES}) g(m, k) LEFT JOIN ({JUDGED_CASES}) c "
    f"ON c.attack_class = a.a AND c.magnitude = g.m GROUP BY a.a, g.k)",
)
def bench_by_cell(spark, sf_dir):
    return quality.by_cell(_counts(spark, sf_dir))


@query(
    "bench_missed",
    f"SELECT case_idx, base_label, attack_class, magnitude, direction FROM ({JUDGED_CASES}) "
    "WHERE tampered AND verdict = 'verified' ORDER BY case_idx",
)
def bench_missed(spark, sf_dir):
    return quality.missed_cases(judged_cases(spark, sf_dir))


@query(
    "bench_headline",
    f"""
SELECT l.r AS catch_rate_large, round_even(s.r, 4) AS recall_small, concat('The judge catches ', round_even(l.r * 100, 0)::BIGINT,
  '% of distortions >=20%; at 5% catch-rate dips to ', round_even(round_even(s.r, 4) * 100, 0)::BIGINT,
  '% (small distortions of small values fall under the abs_tol=0.01 floor).') AS headline
FROM (SELECT count(*) FILTER (WHERE verdict <> 'verified') / count(*)::DOUBLE AS r FROM ({JUDGED_CASES}) WHERE tampered AND magnitude >= 0.2) l,
  (SELECT count(*) FILTER (WHERE verdict <> 'verified') / count(*)::DOUBLE AS r FROM ({JUDGED_CASES}) WHERE tampered AND magnitude = 0.05) s
""",
)
def bench_headline(spark, sf_dir):
    return quality.headline(quality.outcome_counts(judged_cases(spark, sf_dir)))


@query(
    "bench_metrics_meta",
    f"""
SELECT count(*)::BIGINT AS n_cases, count(*) FILTER (WHERE tampered)::BIGINT AS n_tampered,
  count(*) FILTER (WHERE NOT tampered)::BIGINT AS n_clean_controls, 'lineitem' AS dataset FROM ({JUDGED_CASES})
""",
)
def bench_metrics_meta(spark, sf_dir):
    counts = quality.outcome_counts(judged_cases(spark, sf_dir))
    return quality.meta_row(counts, {"dataset": "lineitem"}).drop("attack_classes", "magnitudes")
