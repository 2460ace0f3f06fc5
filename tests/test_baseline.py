import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimcheck.operators import baseline


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x, z = rng.normal(size=600), rng.normal(size=600)
    y = (rng.uniform(size=600) < 1 / (1 + np.exp(-(1.5 * x - z)))).astype(int)
    rows = [(i, "Yes" if y[i] else "No", float(x[i]), float(z[i] * 10 + 3), " " if i % 50 == 0 else str(i)) for i in range(600)]
    return spark.createDataFrame(rows, "id long, churn string, x double, z double, t string").cache()


RECIPE = baseline.Recipe(key="id", target="churn", positive="Yes", coerce=["t"])
MODEL = "LogisticRegression(random_state=42, max_iter=200)"


def test_split_takes_a_fifth_of_each_class(table):
    split = baseline.training_table(table, RECIPE, 42)
    counts = {(r["_target"], r["is_test"]): r["n"] for r in split.groupBy("_target", "is_test").agg(F.count("*").alias("n")).collect()}
    for cls in (0, 1):
        n = counts[cls, True] + counts[cls, False]
        assert counts[cls, True] == math.ceil(n / 5)
    again = baseline.training_table(table.repartition(7), RECIPE, 42)
    assert split.where("is_test").select("id").exceptAll(again.where("is_test").select("id")).count() == 0
    other = baseline.training_table(table, RECIPE, 43)
    assert split.where("is_test").select("id").exceptAll(other.where("is_test").select("id")).count() > 0


def test_threshold_split_is_near_a_fifth(spark):
    share = baseline.threshold_split(spark.range(20_000), "id", 1).agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert abs(share - 0.2) < 0.02


def test_standardize_uses_population_deviation_of_train_rows(spark):
    frame = spark.createDataFrame([(1.0, 5.0, False), (3.0, 5.0, False), (9.0, 5.0, True)], "a double, b double, is_test boolean")
    rows = baseline.standardize(frame, ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(-1.0, 0.0), (1.0, 0.0), (7.0, 0.0)]


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("range_rows", [1_000_000, 10])
@pytest.mark.parametrize("levels", [1, 7, 5000])
def test_auc_matches_brute_force(spark, monkeypatch, levels, range_rows):
    monkeypatch.setattr(baseline, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(levels)
    pairs = [(float(s) / levels, int(y)) for s, y in zip(rng.integers(0, levels, 900), rng.integers(0, 2, 900))]
    frame = spark.createDataFrame(pairs, "score double, label int")
    assert baseline.roc_auc(frame).first()[0] == pytest.approx(auc(pairs), abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    assert baseline.roc_auc(spark.createDataFrame([(0.5, 1)], "score double, label int")).first()[0] is None


def test_fit_solves_the_penalised_problem(table):
    """The fitted probabilities satisfy the optimality condition of L2-regularised regression, C = 1."""
    split = baseline.training_table(table, RECIPE, 42)
    scaled = baseline.standardize(split, ["x", "z"]).cache()
    train = scaled.where(~F.col("is_test"))
    everything = scaled.where(~F.col("is_test")).withColumn("is_test", F.lit(True)).unionByName(train)
    scored = baseline.fit_predict(everything, ["x", "z"], "_target", 500).select("x", "z", "label", "score").toPandas()
    logit = np.log(scored.score / (1 - scored.score))
    w = np.linalg.lstsq(np.c_[scored.x, scored.z, np.ones(len(scored))], logit, rcond=None)[0]
    error = scored.score - scored.label
    assert abs((error * scored.x).sum() + w[0]) < 1e-3 and abs((error * scored.z).sum() + w[1]) < 1e-3
    assert abs(error.sum()) < 1e-3


def test_verify_baselines(spark, table):
    honest = baseline.train_metrics(table, RECIPE, ["x", "z", "t"], 42, 200)
    features = ["x", "z", "t"]
    rows = [
        ("honest", MODEL, features, "roc_auc", honest["roc_auc"], "verified"),
        ("accuracy", MODEL, features, "accuracy", honest["accuracy"], "verified"),
        ("near", MODEL, features, "roc_auc", honest["roc_auc"] + 5e-7, "verified"),
        ("far", MODEL, features, "roc_auc", honest["roc_auc"] + 5e-6, "contradicted"),
        ("forest", "RandomForestClassifier(random_state=1)", features, "roc_auc", 0.8, "unverified"),
        ("seedless", "LogisticRegression()", features, "roc_auc", 0.8, "unverified"),
        ("metric", MODEL, features, "f1", 0.8, "unverified"),
        ("none", MODEL, [], "roc_auc", 0.8, "unverified"),
        ("missing", MODEL, ["x", "gone"], "roc_auc", 0.8, "unverified"),
        ("text", MODEL, ["churn"], "roc_auc", 0.8, "unverified"),
    ]
    frame = spark.createDataFrame(
        rows, "name string, model string, features array<string>, metric_name string, metric_value double, expected string"
    )
    got = {r["name"]: r for r in baseline.verify_baselines(frame, table, RECIPE).collect()}
    assert {n: r["verdict"] for n, r in got.items()} == {r[0]: r[5] for r in rows}
    assert all((r["recomputed_value"] is None) == (r["verdict"] == "unverified") for r in got.values())
    value = honest["roc_auc"]
    assert got["honest"]["detail"] == (
        "retrained LogisticRegression(random_state=42, max_iter=200) on ['x', 'z', 't']: recomputed "
        f"roc_auc={value:.4f} matches claimed {value:.4f} (rel_tol=1e-06, abs_tol=1e-09)"
    )
    assert got["metric"]["detail"].startswith("unsupported metric_name 'f1'")
    assert got["missing"]["detail"] == "retraining failed: no numeric column gone"
