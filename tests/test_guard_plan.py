"""What a text may read and call, seen in its plan; and inputs that must neither vanish nor verify."""

import pytest
from pyspark.sql import functions as F

from claimcheck.functions.numbers import coerce_number
from claimcheck.operators.baseline import stratified_split
from claimcheck.operators.checked import RefusedQuery, checked_sql
from claimcheck.operators.guarded_sql import query_sql
from claimcheck.operators.recompute import run_query
from claimcheck.plans.verify import judge_datasets, judge_findings
from claimcheck.session import ClaimSession, shared_dir

FINDINGS = "finding_id string, report_id string, claim string, evidence string, value_kind string, value_num double, value_text string"


@pytest.fixture(scope="module")
def session(spark, orders):
    session = ClaimSession(spark)
    session.register(orders)
    orders.sparkSession.range(3).createOrReplaceGlobalTempView("secret_t")
    return session


@pytest.mark.parametrize(
    "text",
    [
        "SELECT IDENTIFIER('java' || '_method')('java.lang.System', 'getProperty', 'user.name') FROM data",
        "SELECT max(IDENTIFIER('refl' || 'ect')('java.lang.System', 'getProperty', 'user.name')) FROM data",
        "SELECT count(*) FROM data CROSS JOIN global_temp.secret_t",
        "SELECT count(*) FROM data WHERE o_custkey IN (SELECT id FROM global_temp.secret_t)",
        "WITH d AS (SELECT id FROM global_temp.secret_t) SELECT count(*) FROM d",
        "SELECT count(*) FROM range(10)",
    ],
)
def test_refused_by_plan(session, text):
    with pytest.raises(RefusedQuery):
        checked_sql(session, text)
    assert not query_sql(session, text).ok
    value, error = run_query(session, text)
    assert value is None and "disallowed" in error


@pytest.mark.parametrize(
    "text",
    [
        "WITH data2 AS (SELECT * FROM data) SELECT count(*) FROM data2 a JOIN data b ON a.o_orderkey = b.o_orderkey",
        "SELECT count(*) FROM data WHERE o_orderstatus = 'identifier (x)'",
        "SELECT count(*) FROM (VALUES (1), (2)) AS t(x) WHERE x IN (SELECT o_custkey FROM data)",
    ],
)
def test_accepted_by_plan(session, text):
    assert query_sql(session, text).ok


def test_findings_cannot_read_other_tables(spark, orders, session):
    rows = [("x", "r", "3 rows", "SELECT count(*) FROM data RIGHT JOIN global_temp.secret_t ON false", "number", 3.0, "3")]
    assert judge_findings(spark, spark.createDataFrame(rows, FINDINGS), orders).first()["verdict"] == "unverified"


def test_findings_about_unknown_datasets_stay(spark, orders):
    rows = [(str(i), "r", "1500 orders", "SELECT count(*) FROM data", "number", 1500.0, "1500", d) for i, d in enumerate(["orders", "other", None])]
    judged = judge_datasets(spark, spark.createDataFrame(rows, FINDINGS + ", dataset_id string"), {"orders": orders})
    found = {r["finding_id"]: (r["verdict"], r["reason"]) for r in judged.collect()}
    assert found == {"0": ("verified", "value_matches"), "1": ("unverified", "unknown_dataset"), "2": ("unverified", "unknown_dataset")}


def test_negative_zero_and_large_averages(spark):
    data = spark.createDataFrame([(-0.0, 2**62), (0.0, 2**62), (0.0, 2**62), (1.0, 2)], "x double, big long")
    texts = [
        ("zero", "SELECT count(*) FROM data WHERE x = -0.0", 3.0),
        ("big", "SELECT avg(big) FROM data WHERE x IN (0, 0.0)", float(2**62)),
    ]
    rows = [(name, "r", f"it is {value:.0f}", text, "number", value, str(value)) for name, text, value in texts]
    judged = judge_findings(spark, spark.createDataFrame(rows, FINDINGS), data)
    assert {r["finding_id"]: r["recomputed_num"] for r in judged.collect()} == {name: value for name, _, value in texts}


def test_not_a_number_becomes_zero(spark):
    frame = spark.createDataFrame([("nan",), ("NaN",), ("2",), (None,)], "t string")
    assert [r["n"] for r in frame.select(coerce_number(F.col("t")).alias("n")).collect()] == [0.0, 0.0, 2.0, 0.0]


def test_split_keeps_rows_without_key(spark):
    frame = spark.createDataFrame([(None if i % 2 else i, i % 4 // 2) for i in range(400)], "k long, y int")
    split = stratified_split(frame, "k", "y", 1)
    assert split.count() == 400 and split.where("is_test IS NULL").count() == 0
    assert split.where("k IS NULL").select("y", "is_test").distinct().groupBy("y").count().where("count > 1").count() == 0


def test_shared_folder_is_below_the_checkpoint_folder(spark):
    assert shared_dir(spark, "x").startswith(spark.sparkContext.getCheckpointDir())
