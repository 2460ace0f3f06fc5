"""First groups from one grouped pass, against running every text alone."""

import random

from pyspark.sql import functions as F

from claimcheck.functions.evidence import row_count_query
from claimcheck.operators import recompute, tops
from claimcheck.operators.recompute import recomputed_values, run_query
from claimcheck.session import ClaimSession


def test_first_groups_agree_with_running_alone(spark, monkeypatch):
    rng = random.Random(9)
    some = lambda value: None if rng.random() < 0.15 else value
    rows = [(some(rng.randrange(6)), some(rng.choice("abc")), some(rng.randrange(100)), some(rng.random()), rng.randrange(4)) for _ in range(200)]
    session = ClaimSession(spark)
    session.register(spark.createDataFrame(rows, "k int, g string, v int, x double, h int"))
    filters = ["", *[f"WHERE k = {i} " for i in range(8)], *[f"WHERE k IN ({i}, {i + 2}, 77) " for i in range(4)], "WHERE g = 'a' ", "WHERE g = 'nothing' "]
    shapes = [
        "SELECT g FROM data {w}GROUP BY g ORDER BY count(*) DESC, g LIMIT 1",
        "select \"g\" AS first from data {w}group by \"g\" order by count(*), g desc limit 1;",
        "SELECT h FROM data {w}GROUP BY h ORDER BY sum(v) DESC, h LIMIT 1",
        "SELECT g FROM data {w}GROUP BY g ORDER BY max(x) ASC LIMIT 1",
        "SELECT avg(v) FROM data {w}GROUP BY g ORDER BY avg(x) DESC, g LIMIT 1",
        "SELECT count(*) FROM data {w}GROUP BY h ORDER BY min(x) DESC LIMIT 1",
    ]
    texts = sorted({s.format(w=w) for s in shapes for w in filters})
    others = ["SELECT g FROM data GROUP BY g ORDER BY count(*) DESC, h LIMIT 1", "SELECT h FROM data GROUP BY g ORDER BY count(*) DESC LIMIT 1"]
    others += ["SELECT g FROM data GROUP BY g ORDER BY count(DISTINCT v) DESC, g LIMIT 1", "SELECT g FROM data WHERE k > 3 GROUP BY g ORDER BY count(*) DESC, g LIMIT 1"]
    ran = []
    monkeypatch.setattr(tops, "TOP_TEXTS", 1)
    run_text = recompute._run_text
    monkeypatch.setattr(recompute, "_run_text", lambda s, text, count: ran.append(text) or run_text(s, text, count))
    frame = session.spark.createDataFrame([(t,) for t in texts + others], "evidence string").withColumn("counting", row_count_query(F.col("evidence")))
    got = {r["evidence"]: r for r in recomputed_values(session, frame).collect()}
    assert sorted(ran) == sorted(others)
    for text in rng.sample(texts, 45):
        raw, error = run_query(session, text)
        row = got[text]
        assert (row["raw"], row["error"]) == (raw, error), text
        counted, failed = run_query(session, row["counting"])
        assert row["evidence_row_count"] == (None if failed else int(counted)), text


def test_a_shape_that_fails_runs_text_by_text(spark):
    session = ClaimSession(spark)
    session.register(spark.range(20).selectExpr("id % 3 AS k", "id % 5 AS g", "id AS v"))
    texts = [f"SELECT g FROM data WHERE k = {i} GROUP BY g ORDER BY sum(1 / (v - 4)) DESC LIMIT 1" for i in range(3)]
    texts += [f"SELECT nothing FROM data WHERE k = {i} GROUP BY nothing ORDER BY count(*) DESC LIMIT 1" for i in range(3)]
    frame = session.spark.createDataFrame([(t,) for t in texts], "evidence string")
    got = {r["evidence"]: (r["raw"], r["error"] is None) for r in recomputed_values(session, frame).collect()}
    for text in texts:
        raw, error = run_query(session, text)
        assert got[text] == (raw, error is None)
