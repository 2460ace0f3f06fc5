"""Deadlines: what does not end in time is unverified, everything else keeps its verdict."""

import threading
import time

import pytest

from claimcheck.operators import baseline, recompute
from claimcheck.operators.deadline import TimedOut, limited
from claimcheck.operators.recompute import recomputed_values
from claimcheck.plans.verify import judge_findings
from claimcheck.session import ClaimSession

# Takes minutes: a product of the rows with themselves, nothing of which can be left out.
SLOW = "(SELECT count(*) FROM data a JOIN data b ON a.k <> b.k JOIN data c ON hash(a.k, b.k, c.k) % 7 <> 3)"


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(3000).selectExpr("id AS k", "id % 7 AS v").repartition(8)


def test_a_slow_text_is_unverified_and_the_others_keep_their_verdicts(spark, data):
    rows = [
        ("slow", "x", f"SELECT {SLOW} AS n FROM data LIMIT 1", "number", 3000.0, "3000"),
        ("family", "there are 3000 rows", "SELECT count(*) FROM data", "number", 3000.0, "3000"),
        ("alone", "there are 7 values", "SELECT count(*) FROM (SELECT DISTINCT v FROM data) t", "number", 7.0, "7"),
        *[(f"block{i}", f"there are {2999 - i} rows over {i}", f"SELECT count(*) FROM data WHERE k > {i}", "number", 2999.0 - i, "x") for i in range(3)],
    ]
    findings = spark.createDataFrame(rows, "finding_id string, claim string, evidence string, value_kind string, value_num double, value_text string")
    start = time.time()
    judged = {r["finding_id"]: r for r in judge_findings(spark, findings, data, seconds=5).collect()}
    assert time.time() - start < 100
    assert (judged["slow"]["verdict"], judged["slow"]["reason"]) == ("unverified", "timed_out")
    assert judged["slow"]["detail"].endswith("timed out after 5 s")
    assert {i for i, r in judged.items() if r["verdict"] == "verified"} == {i for i, *_ in rows} - {"slow"}


def test_a_block_out_of_time_is_halved(spark, data, monkeypatch):
    """One text makes its block slow; the others are answered from smaller blocks or alone."""
    sizes = []
    scan = recompute.run_block

    def slow_block(session, block, *rest):
        sizes.append(len(block))
        if any("k > 13" in r["_run_text"] for r in block):
            try:
                session.spark.sql(f"SELECT {SLOW} AS n FROM data LIMIT 1").collect()
            except recompute.RUN_ERRORS:
                return [], block
        return scan(session, block, *rest)

    monkeypatch.setattr(recompute, "run_block", slow_block)
    monkeypatch.setattr(recompute, "BLOCK_PATIENCE", 1)
    session = ClaimSession(spark, seconds=4)
    session.register(data)
    texts = [f"SELECT count(*) FROM data WHERE k > {i}" for i in range(10, 18)]
    found = recomputed_values(session, session.spark.createDataFrame([(t,) for t in texts], "evidence string"))
    assert {r["evidence"]: r["raw"] for r in found.collect()} == {t: str(2999 - i) for i, t in zip(range(10, 18), texts)}
    assert sizes[0] == 8 and sorted(sizes)[:2] == [1, 1]


def test_the_limit_holds_for_its_own_thread(spark, data):
    session = ClaimSession(spark)
    session.register(data)
    counts = []

    def other():
        for _ in range(10):
            counts.append(session.spark.sql("SELECT count(*) FROM data").first()[0])

    thread = threading.Thread(target=other)
    thread.start()
    with pytest.raises(TimedOut, match="timed out after 1 s"), limited(spark, 1):
        session.spark.sql(f"SELECT {SLOW} AS n FROM data LIMIT 1").collect()
    thread.join()
    assert counts == [3000] * 10
    with limited(spark, 60), pytest.raises(ZeroDivisionError):
        1 / 0
    with limited(spark, None):
        assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert spark.range(5).count() == 5


def test_slow_training_is_unverified(spark, monkeypatch):
    frame = spark.range(200).selectExpr("id", "id % 2 AS y", "double(id % 13) AS x")
    baselines = spark.createDataFrame([("LogisticRegression(random_state=1)", ["x"], "accuracy", 0.5, "")], "model string, features array<string>, metric_name string, metric_value double, notes string")
    recipe = baseline.Recipe(key="id", target="y", positive=1)
    monkeypatch.setattr(baseline, "split_metrics", lambda split, *_: split.crossJoin(split).crossJoin(split.limit(150)).selectExpr("count(hash(*))").repartition(1).collect() and time.sleep(60))
    row = baseline.verify_baselines(baselines, frame, recipe, seconds=0.2).first()
    assert row["verdict"] == "unverified"
