"""Verdicts end to end, on data with known answers."""

import pytest
from pyspark.sql import functions as F

from claimcheck.functions.evidence import implausible_reason
from claimcheck.operators import planting, quality, recompute
from claimcheck.operators.recompute import recomputed_values, run_query
from claimcheck.plans.verify import judge_datasets, judge_findings, verdict_summary, with_run_logs, with_verdict
from claimcheck.plans import verify
from claimcheck.session import ClaimSession

SCHEMA = (
    "finding_id string, report_id string, claim string, evidence string, "
    "value_kind string, value_num double, value_text string"
)
CHURN_RATE = "SELECT avg(CASE WHEN Churn = 'Yes' THEN 1.0 ELSE 0 END) AS churn_rate FROM data"
MODE = "SELECT Contract FROM data GROUP BY Contract ORDER BY count(*) DESC LIMIT 1"


def finding(name, claim, evidence, value):
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    kind = "number" if number else "boolean" if isinstance(value, bool) else "string"
    return (name, "r", claim, evidence, kind, float(value) if number else None, str(value))


FINDINGS = [
    # name, claim, evidence, value, verdict, reason, rows, note
    ("honest", "26.5% of customers churned.", CHURN_RATE, 0.2654, "verified", "value_matches", 7043, None),
    ("lie", "75% of customers churned.", CHURN_RATE, 0.75, "contradicted", "value_differs", 7043, None),
    ("text_lie", "75% of customers churned.", CHURN_RATE, 0.2654, "contradicted", "claim_text_disagrees_with_value", 7043, None),
    ("count_of_total", "1,869 of 7,043 churned.", CHURN_RATE, 0.2654, "contradicted", "claim_text_disagrees_with_value", 7043, None),
    ("no_from", "75% churned.", "SELECT 0.75 AS churn_rate", 0.75, "unverified", "evidence_does_not_touch_data", None, None),
    ("python", "90.", "print(0.90)", 0.9, "unverified", "evidence_does_not_touch_data", None, None),
    ("two_columns", "x", "SELECT Churn, tenure FROM data", 1, "unverified", "not_recomputed", 7043, None),
    ("many_rows", "x", "SELECT Churn FROM data", 1, "unverified", "not_recomputed", 7043, None),
    ("no_rows", "x", "SELECT Churn FROM data WHERE tenure < 0", 1, "unverified", "not_recomputed", 0, "narrow_subset"),
    ("bad_column", "x", "SELECT avg(nope) FROM data WHERE tenure = 0", 1, "unverified", "not_recomputed", 11, "narrow_subset"),
    ("bad_syntax", "x", "SELECT avg((tenure) FROM data", 1, "unverified", "not_recomputed", None, None),
    ("forbidden", "x", "SELECT count(*) FROM data WHERE Churn = 'load'", 1, "unverified", "not_recomputed", None, None),
    ("mode", "Month-to-month is most common.", MODE, "  month-TO-month ", "verified", "value_matches", 3875, None),
    ("mode_lie", "Two year is most common.", MODE, "Two year", "contradicted", "value_differs", 3875, None),
    ("mode_number", "x", MODE, 5, "unverified", "not_comparable", 3875, None),
    ("hidden", "The churn rate is 42.7%.", CHURN_RATE + " WHERE Contract='Month-to-month'", 0.4271, "unverified", "population_mismatch_suspected", 3875, None),
    ("shown", "Among month-to-month customers 42.7% churned.", CHURN_RATE + " WHERE Contract='Month-to-month'", 0.4271, "verified", "value_matches", 3875, None),
    ("hidden_lie", "The churn rate is 90%.", CHURN_RATE + " WHERE Contract='Month-to-month'", 0.9, "contradicted", "value_differs", 3875, None),
    ("tenure_zero", "New customers: 0.", CHURN_RATE + " WHERE tenure = 0", 0.0, "verified", "value_matches", 11, "narrow_subset"),
    ("cte", "11 are new.", "WITH f AS (SELECT * FROM data WHERE tenure=0) SELECT count(*) FROM f", 11, "verified", "value_matches", 11, "narrow_subset"),
    ("text_number", "0.5", "SELECT 1 / 2 FROM data LIMIT 1", "0.5", "verified", "value_matches", 7043, None),
    ("bool", "Yes.", "SELECT count(*) > 5 FROM data", True, "verified", "value_matches", 7043, None),
    ("literal_from", "x", "SELECT x FROM (SELECT 'FROM' AS x FROM data LIMIT 1) t", "FROM", "verified", "value_matches", 1, "narrow_subset"),
    ("quoted", "1,869 churned.", 'SELECT count(*) FROM "data" WHERE "Churn" = \'Yes\'', 1869, "verified", "value_matches", 1869, None),
    ("join", "x", "SELECT count(*) FROM data a JOIN data b ON a.customerID = b.customerID", 7043, "verified", "value_matches", 7043, None),
]


@pytest.fixture(scope="module")
def judged(spark, churn):
    findings = spark.createDataFrame([finding(*f[:4]) for f in FINDINGS], SCHEMA)
    return {r["finding_id"]: r for r in judge_findings(spark, findings, churn).collect()}


@pytest.mark.parametrize("expected", FINDINGS, ids=[f[0] for f in FINDINGS])
def test_verdict(judged, expected):
    name, *_, verdict, reason, rows, note = expected
    row = judged[name]
    assert (row["verdict"], row["reason"]) == (verdict, reason), row["detail"]
    if name == "literal_from":
        # The word inside the literal is taken for the clause only at top level.
        assert row["evidence_row_count"] == rows
        return
    assert (row["evidence_row_count"], row["provenance_note"]) == (rows, note)


def test_invariants(judged):
    for row in judged.values():
        assert (row["verdict"] == "unverified") == (row["recomputed_text"] is None)
        assert row["total_rows"] == 7043


def test_details(judged):
    assert judged["honest"]["detail"] == (
        "recomputed 0.2653698707936959 matches claimed 0.2654 (rel_tol=0.01, abs_tol=0.01)"
    )
    assert judged["quoted"]["detail"] == "recomputed 1869 matches claimed 1869 (rel_tol=0.01, abs_tol=0.01)"
    assert judged["mode_lie"]["detail"] == (
        "recomputed 'Month-to-month' does NOT match claimed 'Two year' (string compare)"
    )
    assert judged["mode_number"]["detail"] == (
        "claimed value 5 is numeric but the recomputed value 'Month-to-month' is not -- values are not comparable"
    )
    assert judged["no_from"]["detail"].startswith("evidence_does_not_touch_data: SQL evidence never references")
    assert "quotes no number matching the claimed value 0.2654" in judged["text_lie"]["detail"]
    assert judged["hidden"]["detail"].startswith(
        "population_mismatch_suspected: evidence filters on WHERE Contract='Month-to-month' but"
    )
    assert judged["forbidden"]["detail"].startswith("query_sql failed to execute evidence: disallowed keyword(s)")


def test_tolerance_boundary(spark, churn):
    rows = [finding("in", "x", "SELECT 1009 FROM data LIMIT 1", 1000), finding("out", "x", "SELECT 1011 FROM data LIMIT 1", 1000)]
    judged = judge_findings(spark, spark.createDataFrame(rows, SCHEMA), churn, abs_tol=0.5)
    assert {r["finding_id"]: r["verdict"] for r in judged.collect()} == {"in": "verified", "out": "contradicted"}


def test_python_evidence_uses_captured_runs(spark, churn):
    code = "pd.read_csv('/d.csv')\nprint(1)"
    logs = spark.createDataFrame(
        [(code, True, "RESULT: 0.2654\nROWS: 500", None), (code + "#", False, "", "exit 1")],
        "evidence string, ok boolean, stdout string, error string",
    )
    rows = [finding("logged", "26.5%", code, 0.2654), finding("failed", "x", code + "#", 1), finding("unlogged", "x", code + "##", 1)]
    judged = judge_findings(spark, spark.createDataFrame(rows, SCHEMA), churn, dataset_path="/d.csv", run_logs=logs)
    got = {r["finding_id"]: (r["verdict"], r["evidence_row_count"], r["provenance_note"]) for r in judged.collect()}
    assert got == {
        "logged": ("verified", 500, "narrow_subset"), "failed": ("unverified", None, None), "unlogged": ("unverified", None, None),
    }


def test_the_last_of_several_runs_counts(spark):
    """By run_at where the logs have it; without it a successful run goes before a failed one."""
    runs = [("py", 1, True, "RESULT: 9", None), ("py", 3, True, "RESULT: 5", None), ("py", 2, False, "", "exit 1"), ("x", 2, False, "", "exit 1"), ("x", 1, True, "RESULT: 7", None)]
    logs = spark.createDataFrame(runs, "evidence string, run_at int, ok boolean, stdout string, error string")
    schema = "evidence string, raw string, error string, evidence_row_count bigint"
    findings = spark.createDataFrame([("py", None, None, None), ("x", None, None, None)], schema)
    found = {r["evidence"]: (r["raw"], r["error"] is None) for r in with_run_logs(findings, logs).collect()}
    assert found["py"] == ("5", True) and not found["x"][1]
    found = {r["evidence"]: (r["raw"], r["error"] is None) for r in with_run_logs(findings, logs.drop("run_at")).collect()}
    assert found == {"py": ("9", True), "x": ("7", True)}


def test_families_agree_with_running_each_text(spark, orders):
    """The shared pass and the query-by-query path give the same cell and row count."""
    queries = [
        f"SELECT {agg} FROM data{where}"
        for agg in ("count(*)", "count(o_orderkey)", "sum(o_custkey)", "avg(o_custkey)", "min(o_totalprice)",
                    "max(o_orderpriority)", "avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END)",
                    "sum(length(trim(o_orderpriority)))", "max(o_orderdate)")
        for where in ("", " WHERE o_orderstatus = 'F'", " WHERE o_custkey = 7", " WHERE o_custkey IN (7, 8, 7, -1)",
                      " WHERE o_orderstatus IN ('F', 'nothing')", " WHERE o_totalprice = 1.5", " WHERE o_custkey = -1")
    ]
    # The same text with a comment is outside the shared shape.
    both = [(q, q) for q in queries] + [(q, q + " -- alone") for q in queries]
    session = ClaimSession(spark)
    session.register(orders)
    frame = session.spark.createDataFrame(both, "q string, evidence string")
    seen = {}
    for row in recomputed_values(session, frame).collect():
        seen.setdefault(row["q"], set()).add((row["raw"], row["error"], row["evidence_row_count"]))
    assert len(seen) == len(queries)
    assert all(len(answers) == 1 for answers in seen.values()), {q: a for q, a in seen.items() if len(a) > 1}


def test_one_failing_aggregate_does_not_spoil_its_family(spark, orders):
    queries = [
        "SELECT sum(1 / (o_custkey - 7)) FROM data WHERE o_custkey = 7",
        "SELECT sum(1 / (o_custkey - 7)) FROM data WHERE o_custkey = 8",
        "SELECT count(*) FROM data WHERE o_custkey = 7",
    ]
    session = ClaimSession(spark)
    session.register(orders)
    frame = session.spark.createDataFrame([(q,) for q in queries], "evidence string")
    got = {r["evidence"]: r for r in recomputed_values(session, frame).collect()}
    n7 = orders.where("o_custkey = 7").count()
    assert "DIVIDE_BY_ZERO" in got[queries[0]]["error"] and got[queries[0]]["evidence_row_count"] == n7
    assert float(got[queries[1]]["raw"]) == orders.where("o_custkey = 8").count()
    assert got[queries[2]]["raw"] == str(n7)


def test_partitioning_and_hot_texts_change_nothing(spark, orders):
    hot = [finding(str(i), "x", "SELECT count(*) FROM data WHERE o_custkey = 7", i % 3) for i in range(300)]
    cold = [finding(f"c{i}", "x", f"SELECT count(*) FROM data WHERE o_custkey = {i}", 9) for i in range(50)]
    findings = spark.createDataFrame(hot + cold, SCHEMA)
    runs = [
        {r["finding_id"]: (r["verdict"], r["evidence_row_count"]) for r in judge_findings(spark, f, orders.repartition(n)).collect()}
        for f, n in ((findings, 1), (findings.repartition(13), 7))
    ]
    assert runs[0] == runs[1] and len(runs[0]) == 350


def test_claims_of_a_hot_key_are_cut_up(spark, orders, monkeypatch):
    rows = [finding(f"h{i}", "x", "SELECT count(*) FROM data WHERE o_custkey = 7", 1) for i in range(200)]
    rows += [finding(f"w{i}", "x", "SELECT count(*) FROM data", 1500) for i in range(150)]
    rows += [finding(f"c{i}", "x", f"SELECT count(*) FROM data WHERE o_custkey = {i}", 1) for i in range(40)]
    findings = spark.createDataFrame(rows, SCHEMA)

    def outcome():
        return {r["finding_id"]: (r["verdict"], r["evidence_row_count"]) for r in judge_findings(spark, findings, orders).collect()}

    plain = outcome()
    monkeypatch.setattr(recompute, "HOT_ROWS", 30)
    monkeypatch.setattr(recompute, "HOT_SHARE", 10)
    seen = []
    attach = recompute.attach
    monkeypatch.setattr(verify, "attach", lambda routed, results: seen.append(results) or attach(routed, results))
    assert outcome() == plain
    assert sorted(key for _, key in seen[0].hot) == ["0", "1\x1f7"] and seen[0].pieces == 7


def test_texts_of_one_template_agree_with_running_them_alone(spark, monkeypatch):
    data = spark.range(60).selectExpr("id AS k", "id % 7 - 3 AS v", "concat('it''s ', id % 4) AS s", "date_add(date'2020-01-01', int(id)) AS d")
    session = ClaimSession(spark)
    session.register(data)
    texts = [f"SELECT avg(v) FROM data WHERE k > {i} AND s <> 'it''s {i % 4}'" for i in range(0, 80, 9)]
    texts += [f"select sum(1 / v) from data where k between {i} and {i + 2};" for i in range(0, 60, 3)]
    texts += [f"SELECT count(*) * 1.0 / count(v) FROM data WHERE k = -{i} OR k >= 59.5" for i in range(3)]
    texts += [f"SELECT max(s) FROM data WHERE d < DATE '2020-02-{i:02}' AND s LIKE '%{i % 4}'" for i in range(1, 9)]
    texts += [f"SELECT min(k), max(k) FROM data WHERE k > {i}" for i in range(3)]
    texts += [f"SELECT k FROM data WHERE k > {i}" for i in (57, 58, 59)]
    texts += [f"SELECT count(*) FROM data WHERE k > {i} GROUP BY v" for i in range(3)]
    texts += [f"SELECT count(*) FROM data WHERE k > {i}) OR (k < 3" for i in range(3)]
    texts += [f"SELECT count(*) FROM data WHERE k > (SELECT min(k) + {i} FROM data)" for i in range(3)]
    texts += [f"SELECT concat('max(', k) FROM data WHERE k = {i}" for i in range(3)]
    texts += [f"SELECT max('x from data where k') FROM data WHERE k = {i} AND s = 'from \\ {i}'" for i in range(3)]
    frame = session.spark.createDataFrame([(t,) for t in texts], "evidence string")

    def outcome():
        return {r["evidence"]: (r["raw"], r["error"] is None, r["evidence_row_count"]) for r in recomputed_values(session, frame).collect()}

    alone = []
    run_text = recompute._run_text
    monkeypatch.setattr(recompute, "_run_text", lambda s, text, count: alone.append(text) or run_text(s, text, count))
    shared = outcome()
    left = len(alone)
    assert not [t for t in alone if "avg(v)" in t or "max(s)" in t]
    assert sum("sum(1 / v)" in t for t in alone) < 20
    monkeypatch.setattr(recompute, "run_block", lambda session, block, *_: ([], block))
    assert outcome() == shared and len(alone) - left == len(texts)


def test_many_claimed_values(spark):
    data = spark.range(5000).selectExpr("id AS k", "id % 3 AS v")
    findings = spark.createDataFrame(
        [finding(str(i), "x", f"SELECT sum(v) FROM data WHERE k = {i}", i % 3) for i in range(3000)], SCHEMA
    )
    judged = judge_findings(spark, findings, data)
    assert judged.where("verdict = 'verified' AND evidence_row_count = 1").count() == 3000


def test_several_datasets(spark, orders, churn):
    rows = [("orders",) + finding("a", "x", "SELECT count(*) FROM data", 1500), ("churn",) + finding("b", "x", "SELECT count(*) FROM data", 7043)]
    findings = spark.createDataFrame(rows, "dataset_id string, " + SCHEMA)
    judged = judge_datasets(spark, findings, {"orders": orders, "churn": churn})
    assert {(r["finding_id"], r["verdict"], r["total_rows"]) for r in judged.collect()} == {
        ("a", "verified", 1500), ("b", "verified", 7043),
    }


def test_summary_keeps_zeros(spark):
    judged = spark.createDataFrame([("r1", "verified"), ("r1", "verified"), ("r2", "contradicted")], "report_id string, verdict string")
    got = {r["report_id"]: (r["verified"], r["unverified"], r["contradicted"]) for r in verdict_summary(judged, "report_id").collect()}
    assert got == {"r1": (2, 0, 0), "r2": (0, 0, 1)}


def test_missing_parts_never_verify(spark, orders):
    rows = [
        ("no_evidence", "r", "x", None, "number", 1.0, "1"),
        ("no_value", "r", "x", "SELECT count(*) FROM data", "number", None, None),
        ("no_text", "r", "x", "SELECT max(o_orderstatus) FROM data", "string", None, None),
        ("no_claim", "r", None, "SELECT count(*) FROM data", "number", 1500.0, "1500"),
    ]
    judged = judge_findings(spark, spark.createDataFrame(rows, SCHEMA), orders)
    assert {r["finding_id"]: r["verdict"] for r in judged.collect()} == {
        "no_evidence": "unverified", "no_value": "unverified", "no_text": "unverified", "no_claim": "unverified",
    }


def test_claims_may_bring_any_columns(spark, orders):
    findings = spark.createDataFrame([finding("a", "x", "SELECT count(*) FROM data WHERE o_custkey = 7", 1)], SCHEMA)
    extra = {name: F.lit(name) for name in ("key", "column", "route", "n_rows", "a.b", "aggregate")}
    judged = judge_findings(spark, findings.withColumns(extra).withColumn("m", F.create_map(F.lit(1), F.lit(2))), orders)
    row = judged.first()
    assert row["key"] == "key" and row["a.b"] == "a.b" and row["verdict"] == "contradicted"


RATE = "SELECT avg(CASE WHEN Churn='Yes' THEN 1.0 ELSE 0 END) FROM data"
# The nine published base findings and what they recompute to.
BASES = [
    ("churn_rate", RATE, "The overall churn rate is {n} (share of customers with Churn = Yes).", False, 0.2653698707936959,
     RATE + " WHERE Contract='Month-to-month'", 0.4270967741935484),
    ("senior_fraction", "SELECT avg(SeniorCitizen) FROM data", "The share of senior citizens is {n}.", False, 0.1621468124378816, None, None),
    ("m2m_churn_rate", RATE + " WHERE Contract='Month-to-month'", "Among month-to-month customers, the churn rate is {n}.", False, 0.4270967741935484, None, None),
    ("avg_tenure", "SELECT avg(tenure) FROM data", "The average customer tenure is {n} months.", False, 32.37114865824223,
     "SELECT avg(tenure) FROM data WHERE Contract='Two year'", 56.0),
    ("avg_monthly_charges", "SELECT avg(MonthlyCharges) FROM data", "The average monthly charge is {n} dollars.", False, 64.76169246059922,
     "SELECT avg(MonthlyCharges) FROM data WHERE InternetService='Fiber optic'", 91.50012919896615),
    ("blank_total_charges", "SELECT sum(CASE WHEN trim(TotalCharges)='' THEN 1 ELSE 0 END) FROM data",
     "{n} rows have a blank (whitespace-only) TotalCharges value.", True, 11.0, None, None),
    ("count_senior", "SELECT sum(SeniorCitizen) FROM data", "{n} customers are senior citizens.", True, 1142.0, None, None),
    ("count_churned", "SELECT count(*) FROM data WHERE Churn='Yes'", "{n} customers churned in total (Churn = Yes).", True, 1869.0, None, None),
    ("count_fiber", "SELECT count(*) FROM data WHERE InternetService='Fiber optic'", "{n} customers subscribe to fiber-optic internet.", True, 3096.0, None, None),
]
BASE_SCHEMA = (
    "base_pos bigint, base_label string, evidence_sql string, claim_template string, as_int boolean, value double, "
    "subset_evidence_sql string, subset_value double"
)


def assert_published(judged):
    counts = quality.outcome_counts(judged)
    overall = quality.overall(counts).first().asDict()
    assert overall == {
        "true_positives": 251, "false_negatives": 4, "false_positives": 0, "true_negatives": 9,
        "precision": 1.0, "recall": 0.9843, "false_positive_rate": 0.0,
    }
    assert tuple(quality.mechanism_match(counts).first()) == (251, 251, 1.0)
    assert {tuple(r) for r in quality.by_class(counts).collect()} == {
        ("value_swap", 61, 63, 0.9683), ("claim_mismatch", 61, 63, 0.9683), ("fabricated_evidence", 63, 63, 1.0),
        ("alias_dodge", 63, 63, 1.0), ("population_switch", 3, 3, 1.0),
    }
    assert {tuple(r) for r in quality.by_magnitude(counts).collect()} == {
        ("0.05", 68, 72, 0.9444), ("0.2", 72, 72, 1.0), ("0.5", 72, 72, 1.0), ("2", 36, 36, 1.0),
    }
    cells = {(r["attack_class"], r["magnitude"]): (r["caught"], r["n"], r["catch_rate"]) for r in quality.by_cell(counts).collect()}
    assert len(cells) == 20
    assert cells["value_swap", "0.05"] == (16, 18, 0.8889) and cells["population_switch", "2"] == (0, 0, 0.0)
    assert [tuple(r)[1:] for r in quality.missed_cases(judged).collect()] == [
        ("senior_fraction", "value_swap", 0.05, 1), ("senior_fraction", "value_swap", 0.05, -1),
        ("senior_fraction", "claim_mismatch", 0.05, 1), ("senior_fraction", "claim_mismatch", 0.05, -1),
    ]
    assert quality.headline(counts).first()["headline"] == (
        "The judge catches 100% of distortions >=20%; at 5% catch-rate dips to 94% "
        "(small distortions of small values fall under the abs_tol=0.01 floor)."
    )


def test_published_benchmark_from_published_values(spark):
    """The 264 cases judged against the published recomputed values."""
    bases = spark.createDataFrame([(i, *b) for i, b in enumerate(BASES)], BASE_SCHEMA)
    known = {b[1]: b[4] for b in BASES} | {b[5]: b[6] for b in BASES if b[5]}
    values = spark.createDataFrame([(e, repr(v)) for e, v in known.items()], "evidence string, raw string")
    cases = planting.generate_cases(bases)
    assert cases.count() == 264
    recomputed = cases.join(values, "evidence", "left").withColumns(
        {
            "error": F.lit(None).cast("string"),
            "implausible": implausible_reason(F.col("evidence")),
            "evidence_row_count": F.lit(None).cast("bigint"),
        }
    )
    assert_published(with_verdict(recomputed).cache())


def test_published_benchmark_on_data(spark, churn):
    """The same outcome when bases and verdicts are recomputed from a table with the published counts."""
    facts = {q: spark.createDataFrame([(q,)], "evidence string") for b in BASES for q in (b[1], b[5]) if q}
    session = ClaimSession(spark)
    session.register(churn)
    frame = session.spark.createDataFrame([(q,) for q in facts], "evidence string")
    known = {r["evidence"]: float(r["raw"]) for r in recomputed_values(session, frame).collect()}
    rows = [
        (i, label, sql, template, as_int, known[sql], subset, known.get(subset))
        for i, (label, sql, template, as_int, _, subset, _) in enumerate(BASES)
    ]
    bases = spark.createDataFrame(rows, BASE_SCHEMA)
    gate = quality.base_gate(judge_findings(spark, planting.honest_findings(bases), churn))
    assert gate.count() == 0
    assert_published(judge_findings(spark, planting.generate_cases(bases), churn).cache())


def test_distinct_counts_share_a_pass(spark, monkeypatch):
    """count(DISTINCT x) per key, over lists of keys and over the whole table: as run alone, without a text of its own."""
    data = spark.range(300).selectExpr("id % 7 AS k", "CASE WHEN id % 5 = 0 THEN NULL ELSE id % 11 END AS v", "concat('s', id % 3) AS s", "double(id % 4) AS x")
    session = ClaimSession(spark)
    session.register(data)
    texts = [f"SELECT count(DISTINCT v) FROM data WHERE k = {i}" for i in range(9)]
    texts += [f"select count( distinct  s ) from data where k in ({i}, {i + 2}, 99, {i})" for i in range(7)]
    texts += [f"SELECT count(DISTINCT x + v) AS n FROM data WHERE s = 's{i}'" for i in range(4)]
    texts += ["SELECT count(DISTINCT v) FROM data", "SELECT count(v) FROM data WHERE k = 3", "SELECT count(DISTINCT k) FROM data WHERE x IN (1, 2.0)"]
    alone = ["SELECT sum(DISTINCT v) FROM data WHERE k = 3", "SELECT count(DISTINCT v, s) FROM data WHERE k = 3", "SELECT count(DISTINCT *) FROM data WHERE k = 3"]
    alone += ["SELECT count(DISTINCT 1 / (v - v)) FROM data WHERE k = 3"]
    ran = []
    run_text = recompute._run_text
    monkeypatch.setattr(recompute, "_run_text", lambda s, text, count: ran.append(text) or run_text(s, text, count))
    frame = session.spark.createDataFrame([(t,) for t in texts + alone], "evidence string")
    got = {r["evidence"]: (r["raw"], r["evidence_row_count"]) for r in recomputed_values(session, frame).collect()}
    assert sorted(ran) == sorted(alone)
    for text in texts:
        where = text.lower().split(" from data")[1]
        assert got[text] == (run_query(session, text)[0], int(run_query(session, "SELECT count(*) FROM data" + where)[0])), text


def test_texts_and_evidences_that_do_not_run_stay_out_of_the_join(spark, churn):
    """Who counts verdicts joins values to claims that run, by key, without their texts."""
    rows = [
        (str(i), "r", "There are 7043 customers.", evidence, "number", 7043.0, "7043")
        for i, evidence in enumerate(["SELECT count(*) FROM data", "SELECT 7043 AS data", "DROP TABLE data", "SELECT count(*) FROM data WHERE Churn = 'Yes'"])
    ]
    findings = spark.createDataFrame(rows, "finding_id string, report_id string, claim string, evidence string, value_kind string, value_num double, value_text string")
    judged = judge_findings(spark, findings, churn)
    assert {r["finding_id"]: r["verdict"] for r in judged.collect()} == {"0": "verified", "1": "unverified", "2": "unverified", "3": "contradicted"}
    plans, carried = [judged.groupBy("verdict").count()._jdf.queryExecution().optimizedPlan()], []
    while plans:
        plan = plans.pop()
        inputs = [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "Join":
            carried.append({side.output().apply(i).name() for side in inputs for i in range(side.output().size())})
            assert "(_runs#" in inputs[0].toString() or "AND _runs#" in inputs[0].toString()
        plans += inputs
    assert carried and not {"claim", "evidence"} & set().union(*carried)


def test_a_text_is_routed_once_whatever_rests_on_it(spark, orders, monkeypatch):
    """Claims carry no route; the table of texts has one row per distinct text, the refused one included."""
    texts = ["SELECT count(*) FROM data WHERE o_custkey = 7", "SELECT max(o_custkey) FROM data", "SELECT count(*) FROM data WHERE o_orderstatus = 'load'"]
    rows = [finding(f"{i}-{j}", "x", text, 1) for i, text in enumerate(texts) for j in range(40)]
    rows += [finding(f"f{j}", "x", f"SELECT {j} AS data", j) for j in range(40)]
    tables = []
    materialize = recompute.materialize
    monkeypatch.setattr(recompute, "materialize", lambda *a: tables.append(materialize(*a)) or tables[-1])
    judged = judge_findings(spark, spark.createDataFrame(rows, SCHEMA), orders)
    details = {(r["finding_id"].split("-")[0], r["reason"]) for r in judged.where("verdict = 'unverified'").collect()}
    assert details == {("2", "not_recomputed"), *((f"f{j}", "evidence_does_not_touch_data") for j in range(40))}
    routed = [t for t in tables if "_route" in t.columns]
    assert [t.count() for t in routed] == [len(texts)]
