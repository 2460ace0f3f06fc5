import json

import pytest
from pyspark.sql import functions as F

from claimcheck.plans.verify import judge_findings
from claimcheck.sources import reports

REPORT = {
    "dataset": {"name": "subscribers", "rows": 7043, "cols": 21},
    "findings": [
        {"claim": "26.5% of them left", "evidence_sql_or_code": "SELECT avg(CASE WHEN Churn = 'Yes' THEN 1.0 ELSE 0 END) FROM data", "value": 0.2654},
        {"claim": "1,869 of them churned", "evidence_sql_or_code": "SELECT count(*) FROM data WHERE Churn = 'Yes'", "value": 1869},
        {"claim": "The longest contract", "evidence_sql_or_code": "SELECT max(Contract) FROM data", "value": "Two year"},
    ],
    "data_quality_issues": ["blank \"charges\""],
    "baseline": {"model": "LogisticRegression(random_state=42)", "features": ["tenure"], "metric_name": "roc_auc", "metric_value": 0.81, "notes": "n"},
    "caveats": ["one split"],
}


def changed(path, value="__missing__"):
    doc = json.loads(json.dumps(REPORT))
    *parents, last = path
    target = doc
    for key in parents:
        target = target[key]
    if value == "__missing__":
        del target[last]
    else:
        target[last] = value
    return doc


CASES = [
    (REPORT, []),
    (changed(["caveats"]), []),
    (changed(["baseline", "notes"]), []),
    (changed(["baseline"]), ["'baseline' must be an object with model, features, metric_name, metric_value"]),
    (changed(["findings"], []), ["'findings' must not be empty"]),
    (changed(["findings"], {}), ["'findings' must be a list"]),
    (changed(["findings", 1], 5), ["findings[1] must be an object"]),
    (changed(["findings", 0, "value"], True), ["findings[0].value must be a string or number"]),
    (changed(["findings", 0, "claim"], ""), ["findings[0].claim must be a non-empty string"]),
    (changed(["findings", 0, "evidence_sql_or_code"]), ["findings[0].evidence_sql_or_code must be a non-empty string"]),
    (changed(["baseline", "metric_value"], True), ["'baseline.metric_value' must be numeric"]),
    (changed(["baseline", "features"], "tenure"), ["'baseline.features' must be a list of strings"]),
    (changed(["baseline", "features"], []), []),
    (changed(["dataset", "rows"]), ["'dataset.rows' must be an integer"]),
    (changed(["dataset", "rows"], True), ["'dataset.rows' must be an integer"]),
    (changed(["dataset", "name"], ""), ["'dataset.name' must be a non-empty string"]),
    (changed(["data_quality_issues"], [1]), ["'data_quality_issues' must be a list of strings"]),
    (changed(["caveats"], None), ["'caveats' must be a list of strings"]),
    ([1], ["report must be a JSON object"]),
    (
        {},
        [
            "'dataset' must be an object with name, rows, cols", "'findings' must be a list",
            "'data_quality_issues' must be a list of strings",
            "'baseline' must be an object with model, features, metric_name, metric_value",
        ],
    ),
]


def parsed(spark, docs):
    rows = [(str(i), json.dumps(d)) for i, d in enumerate(docs)]
    return reports.parse_reports(spark.createDataFrame(rows, "report_id string, json string"))


def test_problems(spark):
    found = parsed(spark, [c[0] for c in CASES]).select("report_id", reports.report_problems(F.col("doc")).alias("p"))
    got = {r["report_id"]: r["p"] for r in found.collect()}
    for i, (_, expected) in enumerate(CASES):
        assert got[str(i)] == expected, i


def tables(spark, docs):
    valid = reports.valid_reports(parsed(spark, docs))
    return [f(valid) for f in (reports.report_datasets, reports.report_findings, reports.report_baselines, reports.report_notes)]


def test_round_trip(spark):
    nested = reports.nest_reports(*tables(spark, [REPORT, changed(["caveats"])])).collect()
    assert len(nested) == 2
    for row in nested:
        expected = json.loads(json.dumps(REPORT))
        if row["report_id"] == "1":
            expected["caveats"] = []
        assert json.loads(row["json"]) == expected


def test_long_report_continues_in_parts(spark, tmp_path):
    whole = tables(spark, [REPORT])
    nested = reports.nest_reports(*whole, part_size=2)
    parts = {r["part"]: json.loads(r["json"]) for r in nested.collect()}
    assert [len(parts[p]["findings"]) for p in (0, 1)] == [2, 1] and len(parts) == 2
    assert parts[1]["part"] == {"report_id": "0", "number": 1, "of": 2, "size": 2}
    assert parts[0]["dataset"] == parts[1]["dataset"] == REPORT["dataset"] and "baseline" in parts[1]
    reports.write_documents(nested, f"{tmp_path}/parts")
    read = reports.read_reports(spark, f"{tmp_path}/parts", one_per_line=True)
    assert reports.valid_reports(read).count() == 2 and reports.incomplete_reports(read).count() == 0
    back = [f(read) for f in (reports.report_datasets, reports.report_findings, reports.report_baselines, reports.report_notes)]
    for before, after in zip(whole, back):
        assert sorted(map(repr, before.collect())) == sorted(map(repr, after.collect()))
    lost = reports.incomplete_reports(read.where(F.try_variant_get("doc", "$.part.number", "int") == 1))
    assert [tuple(r) for r in lost.collect()] == [("0", 2, 1)]


def test_more_notes_than_findings(spark):
    nested = reports.nest_reports(*tables(spark, [changed(["caveats"], ["a", "b", "c", "d"])]), part_size=3)
    read = reports.parse_reports(nested.drop("part"))
    assert reports.valid_reports(read).count() == 2
    notes = reports.report_notes(read).where("kind = 'caveat'").orderBy("pos").collect()
    assert [(r["pos"], r["text"]) for r in notes] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_equal_lines_are_reports_of_their_own(spark, tmp_path):
    (tmp_path / "reports.jsonl").write_text((json.dumps(REPORT) + "\n") * 3)
    read = reports.valid_reports(reports.read_reports(spark, str(tmp_path), one_per_line=True))
    assert reports.report_findings(read).select("finding_id").distinct().count() == 9


def test_report_without_findings_is_written(spark):
    datasets, findings, baselines, notes = tables(spark, [REPORT])
    nested = reports.nest_reports(datasets, findings.where("false"), baselines, notes.where("false")).collect()
    assert [json.loads(r["json"])["findings"] for r in nested] == [[]]
    judged = findings.where("false").withColumns(
        {"verdict": F.lit("v"), "recomputed_text": F.lit("7"), "detail": F.lit("d"),
         "evidence_row_count": F.lit(1).cast("bigint"), "provenance_note": F.lit("")}
    )
    checked = baselines.withColumns(
        {"verdict": F.lit("verified"), "recomputed_value": F.col("metric_value"), "detail": F.lit("d")}
    )
    (row,) = reports.judged_reports(judged, datasets, checked).collect()
    assert json.loads(row["json"])["summary"] == {"verified": 1, "unverified": 0, "contradicted": 0}


def test_files_in_judged_documents_out(spark, churn, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps(REPORT, indent=2))
    read = reports.valid_reports(reports.read_reports(spark, str(tmp_path)))
    judged = judge_findings(spark, reports.report_findings(read), churn)
    baselines = reports.report_baselines(read).withColumns(
        {"verdict": F.lit("verified"), "recomputed_value": F.col("metric_value"), "detail": F.lit("d")}
    )
    session = judged.sparkSession
    documents = reports.judged_reports(judged, datasets=None).collect()
    assert len(documents) == 2
    doc = json.loads(documents[0]["json"])
    assert doc["summary"] == {"verified": 3, "unverified": 0, "contradicted": 0}
    assert doc["findings"][1] == {
        "claim": "1,869 of them churned", "evidence_sql_or_code": "SELECT count(*) FROM data WHERE Churn = 'Yes'",
        "claimed_value": 1869, "verdict": "verified", "recomputed_value": 1869,
        "detail": "recomputed 1869 matches claimed 1869 (rel_tol=0.01, abs_tol=0.01)",
        "evidence_row_count": 1869, "provenance_note": None,
    }
    assert doc["findings"][0]["recomputed_value"] == 0.2653698707936959
    assert session is not spark and baselines.count() == 2
    out = f"{tmp_path}/out"
    reports.write_documents(reports.judged_reports(judged), out)
    assert spark.read.text(out).count() == 2


def test_judged_document_with_dataset_and_baseline(spark):
    datasets, findings, baselines, _ = tables(spark, [REPORT])
    judged = findings.withColumns(
        {"verdict": F.lit("contradicted"), "recomputed_text": F.lit("7"), "detail": F.lit("d"),
         "evidence_row_count": F.lit(1).cast("bigint"), "provenance_note": F.lit("narrow_subset")}
    )
    judged_baselines = baselines.withColumns(
        {"verdict": F.lit("unverified"), "recomputed_value": F.lit(None).cast("double"), "detail": F.lit("d")}
    )
    doc = json.loads(reports.judged_reports(judged, datasets, judged_baselines).first()["json"])
    assert doc["dataset"] == REPORT["dataset"]
    assert doc["summary"] == {"verified": 0, "unverified": 1, "contradicted": 3}
    assert doc["baseline"]["recomputed_value"] is None and doc["baseline"]["claimed_value"] == 0.81
    assert [f["claimed_value"] for f in doc["findings"]] == [0.2654, 1869, "Two year"]


@pytest.mark.parametrize("broken", ["not json", ""])
def test_unreadable_document(spark, broken):
    frame = reports.parse_reports(spark.createDataFrame([("x", broken)], "report_id string, json string"))
    assert frame.select(reports.report_problems(F.col("doc"))).first()[0] == ["report must be a JSON object"]


def test_documents_are_dealt_out_and_parsed_once(spark):
    """Documents of one file are checked by all tasks, each parsed once however often the check mentions it."""
    texts = ['{"broken": ', "[]", json.dumps(REPORT)]
    frame = spark.createDataFrame([(str(i), texts[i % 3]) for i in range(300)], "report_id string, json string").coalesce(1)
    valid = reports.valid_reports(reports.parse_reports(frame))
    plan = valid._jdf.queryExecution().optimizedPlan()
    assert plan.toString().lower().count("parsejson(") == 1
    rows = valid.select("report_id", F.spark_partition_id().alias("task")).collect()
    assert {r["report_id"] for r in rows} == {str(i) for i in range(2, 300, 3)}
    assert len({r["task"] for r in rows}) > 1
