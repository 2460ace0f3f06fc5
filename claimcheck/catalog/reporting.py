"""Report documents made from the customers, some of them broken in known ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimcheck.catalog import derived, query, table
from claimcheck.operators.baseline import Recipe
from claimcheck.plans.reports import verify_reports
from claimcheck.session import materialize, shared_dir
from claimcheck.sources import reports

_DATASET = """concat('{"name":"customers","rows":', c_custkey, ',"cols":5}')"""
_FINDINGS = """concat('[{"claim":"Balance is ', c_acctbal, '","evidence_sql_or_code":"SELECT 1 FROM data","value":', c_acctbal,
  '},{"claim":"Segment","evidence_sql_or_code":"SELECT 2 FROM data","value":"', c_mktsegment, '","extra":1}]')"""
_BASELINE = """'{"model":"LogisticRegression(random_state=1)","features":["a","b"],"metric_name":"roc_auc","metric_value":0.75}'"""
# kind 0 is valid, kind 10 too: it leaves out nothing but optional keys.
REPORTS = f"""
SELECT CAST(c_custkey AS STRING) AS report_id, c_custkey, c_acctbal, c_mktsegment, c_custkey % 12 AS kind, CASE c_custkey % 12
    WHEN 8 THEN '["not", "an object"]'
    WHEN 9 THEN '{{"broken": '
    ELSE concat('{{"dataset":', CASE c_custkey % 12 WHEN 1 THEN '{{"name":"","rows":7.5,"cols":true}}' WHEN 2 THEN '[]' ELSE {_DATASET} END,
      CASE WHEN c_custkey % 12 = 3 THEN '' ELSE concat(',"findings":', CASE c_custkey % 12 WHEN 4 THEN '[]'
        WHEN 5 THEN '[7,{{"claim":"","evidence_sql_or_code":5,"value":true}},{{"claim":"a","value":null}}]' ELSE {_FINDINGS} END) END,
      ',"data_quality_issues":', CASE c_custkey % 12 WHEN 6 THEN '["a",1]' WHEN 10 THEN '[]' ELSE '["one issue","two"]' END,
      ',"baseline":', CASE c_custkey % 12 WHEN 6 THEN 'null' WHEN 7 THEN '{{"model":"m","features":["a",2],"metric_name":"","metric_value":"0.9"}}'
        ELSE {_BASELINE} END,
      CASE c_custkey % 12 WHEN 10 THEN '' WHEN 11 THEN ',"caveats":null' ELSE ',"caveats":["one caveat"]' END, '}}') END AS json
FROM customer
"""


def _parsed(spark, sf_dir):
    return reports.parse_reports(derived(spark, sf_dir, REPORTS, "customer"))


# The texts of problems.
_PROBLEMS = {
    1: ["'dataset.name' must be a non-empty string", "'dataset.rows' must be an integer", "'dataset.cols' must be an integer"],
    2: ["'dataset' must be an object with name, rows, cols"],
    3: ["'findings' must be a list"],
    4: ["'findings' must not be empty"],
    5: [
        "findings[0] must be an object",
        "findings[1].claim must be a non-empty string",
        "findings[1].evidence_sql_or_code must be a non-empty string",
        "findings[1].value must be a string or number",
        "findings[2].evidence_sql_or_code must be a non-empty string",
        "findings[2].value must be a string or number",
    ],
    6: [
        "'data_quality_issues' must be a list of strings",
        "'baseline' must be an object with model, features, metric_name, metric_value",
    ],
    7: [
        "'baseline.features' must be a list of strings",
        "'baseline.metric_name' must be a non-empty string",
        "'baseline.metric_value' must be numeric",
    ],
    8: ["report must be a JSON object"],
    9: ["report must be a JSON object"],
    11: ["'caveats' must be a list of strings"],
}
_PROBLEM_CASES = " ".join(
    f"WHEN {kind} THEN '" + "; ".join(problems).replace("'", "''") + "'" for kind, problems in _PROBLEMS.items()
)


@query("report_problems", f"SELECT report_id, CASE kind {_PROBLEM_CASES} ELSE '' END AS problems FROM ({REPORTS})")
def report_problems(spark, sf_dir):
    problems = reports.report_problems(F.col("doc"))
    return _parsed(spark, sf_dir).select("report_id", F.array_join(problems, "; ").alias("problems"))


@query(
    "report_ingest",
    f"SELECT count(*)::BIGINT AS n_documents, count(*) FILTER (WHERE kind <> 9)::BIGINT AS n_parsed, "
    f"count(*) FILTER (WHERE kind IN (0, 10))::BIGINT AS n_valid FROM ({REPORTS})",
)
def report_ingest(spark, sf_dir):
    """Documents written one per line and read back."""
    path = shared_dir(spark, "reports")
    reports.write_documents(derived(spark, sf_dir, REPORTS, "customer"), path)
    read = reports.read_reports(spark, path, one_per_line=True)
    return read.agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count("doc").alias("n_parsed"),
        F.count_if(F.size(reports.report_problems(F.col("doc"))) == 0).alias("n_valid"),
    )


def _valid(spark, sf_dir):
    return reports.valid_reports(_parsed(spark, sf_dir))


FINDING_ROWS = f"""
SELECT concat(report_id, '#0') AS finding_id, report_id, 0 AS finding_pos, concat('Balance is ', c_acctbal) AS claim,
  'SELECT 1 FROM data' AS evidence, 'number' AS value_kind, c_acctbal AS value_num FROM ({REPORTS}) WHERE kind IN (0, 10)
UNION ALL SELECT concat(report_id, '#1'), report_id, 1, 'Segment', 'SELECT 2 FROM data', 'string', NULL FROM ({REPORTS}) WHERE kind IN (0, 10)
"""


@query("report_findings", FINDING_ROWS)
def report_findings(spark, sf_dir):
    return reports.report_findings(_valid(spark, sf_dir)).drop("value_text")


@query(
    "report_notes",
    f"""
SELECT report_id, 'issue' AS kind, 0 AS pos, 'one issue' AS text FROM ({REPORTS}) WHERE kind = 0
UNION ALL SELECT report_id, 'issue', 1, 'two' FROM ({REPORTS}) WHERE kind = 0
UNION ALL SELECT report_id, 'caveat', 0, 'one caveat' FROM ({REPORTS}) WHERE kind = 0
""",
)
def report_notes(spark, sf_dir):
    return reports.report_notes(_valid(spark, sf_dir))


@query(
    "report_datasets_baselines",
    f"SELECT report_id, 'customers' AS name, c_custkey AS rows, 5 AS cols, 'LogisticRegression(random_state=1)' AS model, "
    f"'a,b' AS features, 'roc_auc' AS metric_name, 0.75::DOUBLE AS metric_value, '' AS notes FROM ({REPORTS}) WHERE kind IN (0, 10)",
)
def report_datasets_baselines(spark, sf_dir):
    valid = _valid(spark, sf_dir)
    joined = reports.report_datasets(valid).join(reports.report_baselines(valid), "report_id")
    return joined.withColumn("features", F.array_join("features", ","))


@query(
    "report_roundtrip",
    f"""
SELECT report_id, 0::BIGINT AS part, concat('{{"dataset":{{"name":"customers","rows":', c_custkey, ',"cols":5}},"findings":[{{"claim":"Balance is ', c_acctbal,
  '","evidence_sql_or_code":"SELECT 1 FROM data","value":', c_acctbal, '}},{{"claim":"Segment","evidence_sql_or_code":"SELECT 2 FROM data","value":"',
  c_mktsegment, '"}}],"data_quality_issues":', CASE kind WHEN 0 THEN '["one issue","two"]' ELSE '[]' END,
  ',"baseline":{{"model":"LogisticRegression(random_state=1)","features":["a","b"],"metric_name":"roc_auc","metric_value":0.75,"notes":""}},"caveats":',
  CASE kind WHEN 0 THEN '["one caveat"]' ELSE '[]' END, '}}') AS json
FROM (SELECT report_id, c_custkey, kind, c_mktsegment,
  regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') AS c_acctbal FROM ({REPORTS}) WHERE kind IN (0, 10))
""",
)
def report_roundtrip(spark, sf_dir):
    valid = materialize(_valid(spark, sf_dir), "reports")
    nested = reports.nest_reports(
        reports.report_datasets(valid),
        reports.report_findings(valid),
        reports.report_baselines(valid),
        reports.report_notes(valid),
    )
    # JSON has one kind of number: a whole balance reads back without its ".0".
    return nested.withColumn("json", F.regexp_replace("json", r"Balance is (-?\d+)\.0\"", 'Balance is $1"'))


@query(
    "report_parts",
    f"""
SELECT r.report_id, f.finding_pos, f.claim, f.value_text, 2::BIGINT AS parts, kind = 0 AS has_notes, c_custkey::BIGINT AS rows, 0.75::DOUBLE AS metric_value
FROM (SELECT *, regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') AS balance FROM ({REPORTS}) WHERE kind IN (0, 10)) r,
  LATERAL (SELECT 0 AS finding_pos, 'Balance is ' || balance AS claim, balance AS value_text
    UNION ALL SELECT 1, 'Segment', c_mktsegment) f
""",
)
def report_parts(spark, sf_dir):
    """Reports written in parts of one finding each and joined again on reading."""
    valid = materialize(_valid(spark, sf_dir), "reports")
    written = reports.nest_reports(
        reports.report_datasets(valid),
        reports.report_findings(valid),
        reports.report_baselines(valid),
        reports.report_notes(valid),
        part_size=1,
    )
    path = shared_dir(spark, "parts")
    reports.write_documents(written, path)
    read = materialize(reports.valid_reports(reports.read_reports(spark, path, one_per_line=True)), "parts-read")
    parts = read.groupBy("report_id").agg(F.count(F.lit(1)).alias("parts"))
    notes = reports.report_notes(read).groupBy("report_id").agg(F.count(F.lit(1)).alias("notes"))
    rows = (
        reports.report_findings(read)
        .join(parts, "report_id")
        .join(notes, "report_id", "left")
        .join(reports.report_datasets(read), "report_id")
        .join(reports.report_baselines(read).drop("notes"), "report_id")
    )
    claim = F.regexp_replace("claim", r"^(Balance is -?\d+)\.0$", "$1")
    return rows.select(
        "report_id", "finding_pos", claim.alias("claim"), "value_text", "parts",
        (F.coalesce("notes", F.lit(0)) == 3).alias("has_notes"), "rows", "metric_value",
    )


# One report per nation; the counts of every second one are doubled, a few have no findings list.
_NATION_COUNT = "n * (1 + k % 2)"
NATION_REPORTS = f"""
SELECT CAST(k AS STRING) AS report_id, k, n, seg, concat('{{"dataset":{{"name":"nation ', k, '","rows":', n, ',"cols":5}},', CASE WHEN k % 10 = 9 THEN '' ELSE
  concat('"findings":[{{"claim":"There are ', {_NATION_COUNT}, ' customers","evidence_sql_or_code":"SELECT count(*) FROM data WHERE c_nationkey = ', k,
    '","value":', {_NATION_COUNT}, '}},{{"claim":"The last segment is ', seg, '","evidence_sql_or_code":"SELECT max(c_mktsegment) FROM data WHERE c_nationkey >= ', k,
    ' AND c_nationkey <= ', k, '","value":"', seg, '"}},{{"claim":"It is all","evidence_sql_or_code":"SELECT ', n, '","value":', n, '}}],') END,
  '"data_quality_issues":[],"baseline":{{"model":"DecisionTree(random_state=', k, ')","features":["c_acctbal"],"metric_name":"roc_auc","metric_value":0.5}}}}') AS json
FROM (SELECT c_nationkey AS k, count(*) AS n, max(c_mktsegment) AS seg FROM customer GROUP BY c_nationkey) t
"""


@query(
    "verified_reports",
    f"""
SELECT report_id, 0::BIGINT AS part, concat('{{"dataset":{{"name":"nation ', k, '","rows":', n, ',"cols":5}},"findings":[{{"claim":"There are ', {_NATION_COUNT},
    ' customers","evidence_sql_or_code":"SELECT count(*) FROM data WHERE c_nationkey = ', k, '","claimed_value":', {_NATION_COUNT},
    ',"verdict":"', CASE k % 2 WHEN 0 THEN 'verified' ELSE 'contradicted' END, '","recomputed_value":', n, ',"detail":"',
    'recomputed ', n, CASE k % 2 WHEN 0 THEN ' matches' ELSE ' does NOT match' END,
    ' claimed ', {_NATION_COUNT}, ' (rel_tol=0.01, abs_tol=0.01)","evidence_row_count":', n, ',"provenance_note":', note,
  '}},{{"claim":"The last segment is ', seg, '","evidence_sql_or_code":"SELECT max(c_mktsegment) FROM data WHERE c_nationkey >= ', k, ' AND c_nationkey <= ', k,
    '","claimed_value":"', seg, '","verdict":"verified","recomputed_value":"', seg, '","detail":"recomputed ''', seg, ''' matches claimed ''', seg,
    ''' (string compare)","evidence_row_count":', n, ',"provenance_note":', note,
  '}},{{"claim":"It is all","evidence_sql_or_code":"SELECT ', n, '","claimed_value":', n, ',"verdict":"unverified","recomputed_value":null,"detail":"',
    'evidence_does_not_touch_data: SQL evidence never references the `data` view in a FROM/JOIN clause -- it cannot have queried the real dataset',
    '","evidence_row_count":null,"provenance_note":null}}],"baseline":{{"model":"DecisionTree(random_state=', k,
    ')","features":["c_acctbal"],"metric_name":"roc_auc","claimed_value":0.5,"verdict":"unverified","recomputed_value":null,"detail":"',
    'cannot reproduce baseline: judge only knows how to retrain LogisticRegression from the report fields, got model spec ''DecisionTree(random_state=', k,
    ')''"}},"summary":{{"verified":', 2 - k % 2, ',"unverified":2,"contradicted":', k % 2, '}}}}') AS json
FROM (SELECT *, CASE WHEN n < 0.1 * (SELECT count(*) FROM customer) THEN '"narrow_subset"' ELSE 'null' END AS note FROM ({NATION_REPORTS}) WHERE k % 10 <> 9) r
""",
)
def verified_reports(spark, sf_dir):
    """Documents in, findings and baseline judged, whole documents out."""
    parsed = reports.parse_reports(derived(spark, sf_dir, NATION_REPORTS, "customer")).select("report_id", "doc")
    recipe = Recipe(key="c_custkey", target="c_mktsegment", positive="BUILDING")
    return verify_reports(spark, parsed, table(spark, sf_dir, "customer"), recipe)
