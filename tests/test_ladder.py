"""Ranges answered from a ladder, against running every text alone."""

import random

import pytest
from pyspark.sql import functions as F

from claimcheck.operators import ladder, recompute, templates
from claimcheck.operators.recompute import RUN_ERRORS, recomputed_values, run_query
from claimcheck.session import ClaimSession

SCHEMA = "k int, s string, d date, x double, n bigint, f boolean, m decimal(10,2)"
WHERE = {
    "k > {a}": True,
    "{a} >= k": True,
    "k BETWEEN {a} AND {b}": True,
    "k >= {a} AND k < {b} AND k > 3": True,
    "x <= {a}.5": True,
    "x > {a} AND s = '{c}'": True,
    "s >= '{c}' AND s < 'z'": True,
    "d >= DATE '2020-01-{day}' AND d <= DATE '2020-02-{day}'": True,
    "k > {a} AND s <> '{c}'": True,
    "k + 0 = {a}": True,
    "n = {a} AND k = {b} AND x < 5.5": True,
    "k > {a} AND (x < 5 OR s = 'b')": True,
    "s IN ('{c}', 'q')": True,
    "m > {a}": False,
    "s > {a}": False,
}
SELECT = {
    "count(*)": True,
    "sum(n)": True,
    "avg(x) AS mean": True,
    "max(s)": True,
    "min(d)": True,
    "sum(CASE WHEN f THEN 1 ELSE 0 END) / count(*)": True,
    "round(100.0 * count(x) / count(*), 2) + max(k)": True,
    "concat(min(s), '-', max(s))": True,
    "count(*) FILTER (WHERE f)": False,
    "median(k)": False,
}


def rows(rng, n=400):
    dates = [f"2020-{m:02d}-{d:02d}" for m in (1, 2, 3) for d in (1, 9, 28)]
    some = lambda value: None if rng.random() < 0.1 else value
    return [
        (some(rng.randrange(30)), some(rng.choice("abcqz")), some(rng.choice(dates)), some(rng.choice([0.0, -0.0, 5.5, 1e9, float("nan"), rng.randrange(30) / 2])),
         some(rng.randrange(8)), some(rng.random() < 0.4), "1.25")
        for _ in range(n)
    ]


@pytest.fixture(scope="module")
def session(spark):
    session = ClaimSession(spark)
    data = spark.createDataFrame(rows(random.Random(7)), "k int, s string, d string, x double, n bigint, f boolean, m string")
    session.register(data.withColumn("d", F.to_date("d")).withColumn("m", F.col("m").cast("decimal(10,2)")))
    return session


def texts_of(where, select, rng, n):
    return {
        f"SELECT {select} FROM data WHERE " + where.format(a=rng.randrange(33), b=rng.randrange(33), c=rng.choice("abcxyz"), day=f"{rng.randrange(1, 29):02d}")
        for _ in range(n)
    }


def climbed(session, texts, monkeypatch):
    monkeypatch.setattr(ladder, "LADDER_TEXTS", 2)
    frame = session.spark.createDataFrame([(t, t) for t in sorted(texts)], "_run_text string, count_text string")
    shaped = templates.with_template(frame, "_run_text")
    return {r["_run_text"]: r for rows in ladder.ladder_rows(session, shaped, run_query, RUN_ERRORS) for r in rows.collect()}


def test_every_condition_agrees_with_running_alone(session, monkeypatch):
    rng = random.Random(4)
    texts = {w: texts_of(w, "count(*)", rng, 6) | texts_of(w, "max(k)", rng, 3) for w in WHERE}
    found = climbed(session, set().union(*texts.values()), monkeypatch)
    assert set(found) == set().union(*[texts[w] for w, shared in WHERE.items() if shared])
    for text, row in found.items():
        alone, _ = run_query(session, text)
        count, _ = run_query(session, "SELECT count(*) FROM data WHERE " + text.split(" WHERE ")[1])
        assert (row["_text_raw"], row["_text_error"], row["_text_rows"]) == (alone, None, int(count)), text


def test_every_aggregate_agrees_with_running_alone(session, monkeypatch):
    rng = random.Random(5)
    texts = {s: texts_of("k BETWEEN {a} AND {b}", s, rng, 8) for s in SELECT}
    found = climbed(session, set().union(*texts.values()), monkeypatch)
    for select, own in texts.items():
        assert bool(own & set(found)) == SELECT[select]
        for text in own:
            alone, error = run_query(session, text)
            if text in found:
                same = found[text]["_text_raw"] == alone
                assert same or abs(float(found[text]["_text_raw"]) - float(alone)) < 1e-9 * abs(float(alone)), text
            else:
                # Only what fails over no rows is left to run alone.
                assert error is not None or not SELECT[select], text


def test_distinct_values_of_the_ranged_column(session, monkeypatch):
    rng = random.Random(1)
    texts = texts_of("k BETWEEN {a} AND {b}", "count(DISTINCT k)", rng, 10)
    found = climbed(session, texts, monkeypatch)
    assert {t: r["_text_raw"] for t, r in found.items()} == {t: run_query(session, t)[0] for t in texts}
    assert climbed(session, texts_of("k BETWEEN {a} AND {b}", "count(DISTINCT s)", rng, 10), monkeypatch) == {}


def test_many_sets_of_other_literals_and_failing_passes_run_as_before(session, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(ladder, "OTHER_SETS", 2)
    assert climbed(session, texts_of("k > {a} AND s <> '{c}'", "count(*)", rng, 20), monkeypatch) == {}
    assert climbed(session, texts_of("k > {a}", "max(1 / (n - 3))", rng, 5), monkeypatch) == {}
    assert climbed(session, {f"SELECT count(*) FROM data WHERE nothing > {a}" for a in range(5)}, monkeypatch) == {}


def test_the_number_of_passes_does_not_follow_the_number_of_texts(session, monkeypatch):
    """With a ladder no block of literals is scanned, whatever the number of texts."""
    rng = random.Random(3)
    monkeypatch.setattr(ladder, "LADDER_TEXTS", 5)
    monkeypatch.setattr(recompute, "run_block", lambda *a: pytest.fail("a block was scanned"))
    passes = []
    partials = ladder.Ladder._partials
    monkeypatch.setattr(ladder.Ladder, "_partials", lambda self, *a: passes.append(1) or partials(self, *a))
    for n in (20, 40):
        passes.clear()
        texts = texts_of("k > {a} AND k < {b}", "count(*)", rng, n) | texts_of("k <= {a}", "sum(n)", rng, n)
        frame = session.spark.createDataFrame([(t,) for t in texts], "evidence string")
        got = {r["evidence"]: (r["raw"], r["evidence_row_count"]) for r in recomputed_values(session, frame).collect()}
        for text in sorted(texts)[:5]:
            assert got[text][0] == run_query(session, text)[0]
        assert len(passes) == 1
