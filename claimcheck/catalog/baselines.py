"""The baseline classifier and its re-check."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimcheck.catalog import derived, query, table
from claimcheck.operators import baseline
from claimcheck.session import materialize

SEED = 42

TARGETS = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target, o_totalprice, o_custkey FROM orders"
SPLIT = f"""
SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5(concat(o_orderkey, ':{SEED}')))
  <= (count(*) OVER (PARTITION BY target) * 20 + 99) // 100 AS is_test FROM ({TARGETS})
"""


def _targets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.withColumn("target", baseline.binary_target(F.col("o_orderstatus"), "F"))


@query("ml_target", f"SELECT o_orderkey, target FROM ({TARGETS})")
def ml_target(spark, sf_dir):
    return _targets(spark, sf_dir).select("o_orderkey", "target")


@query("ml_split", f"SELECT o_orderkey, is_test FROM ({SPLIT})")
def ml_split(spark, sf_dir):
    split = baseline.stratified_split(_targets(spark, sf_dir), "o_orderkey", "target", SEED)
    return split.select("o_orderkey", "is_test")


@query(
    "ml_standardize",
    f"""
WITH split AS ({SPLIT}),
stats AS (SELECT avg(o_totalprice) AS pm, stddev_pop(o_totalprice) AS ps, avg(o_custkey) AS cm, stddev_pop(o_custkey) AS cs
          FROM split WHERE NOT is_test)
SELECT o_orderkey, round((o_totalprice - pm) / ps, 4) AS o_totalprice, round((o_custkey - cm) / cs, 4) AS o_custkey FROM split, stats
""",
)
def ml_standardize(spark, sf_dir):
    split = baseline.stratified_split(_targets(spark, sf_dir), "o_orderkey", "target", SEED)
    scaled = baseline.standardize(split, ["o_totalprice", "o_custkey"])
    return scaled.select(
        "o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"), F.round("o_custkey", 4).alias("o_custkey")
    )


SCORES = """
SELECT l_quantity + l_discount AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  CASE WHEN l_quantity + l_discount >= 25.0E0 THEN 1 ELSE 0 END AS prediction
FROM lineitem
"""


@query("ml_accuracy", f"SELECT round(avg((label = prediction)::INT), 6) AS accuracy FROM ({SCORES})")
def ml_accuracy(spark, sf_dir):
    scored = derived(spark, sf_dir, SCORES, "lineitem")
    return baseline.accuracy(scored).select(F.round("accuracy", 6).alias("accuracy"))


@query(
    "ml_roc_auc",
    f"""
WITH g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM ({SCORES}) GROUP BY score),
w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round((sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)))::DOUBLE, 9) AS roc_auc FROM w
""",
)
def ml_roc_auc(spark, sf_dir):
    scored = derived(spark, sf_dir, SCORES, "lineitem")
    return baseline.roc_auc(scored).select(F.round("roc_auc", 9).alias("roc_auc"))


def labelled_documents(spark, sf_dir):
    """doc_id, quality and three numeric features; one of them arrives as text."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", r"\s+")).alias("n_words"),
        F.regexp_count("text", F.lit(r"\n")).cast("string").alias("n_lines"),
        "lang",
    )
    return documents.join(table(spark, sf_dir, "labels"), "doc_id")


RECIPE = baseline.Recipe(key="doc_id", target="quality", positive=1, coerce=["n_lines"])
FEATURES = ["n_chars", "n_words", "n_lines"]


@query("ml_fit_predict")
def ml_fit_predict(spark, sf_dir):
    table_ = baseline.training_table(labelled_documents(spark, sf_dir), RECIPE, SEED)
    # Written once: statistics, training and scoring each read it.
    split = materialize(table_.select("doc_id", "_target", "is_test", *FEATURES), "split")
    scaled = baseline.standardize(split, FEATURES)
    return baseline.fit_predict(scaled, FEATURES, "_target", 100).select("doc_id", "label", "score", "prediction")


@query(
    "baseline_verdicts",
    """
SELECT * FROM (VALUES
  ('honest', 'roc_auc', 'verified', true, NULL), ('near', 'roc_auc', 'verified', true, NULL),
  ('off', 'roc_auc', 'contradicted', true, NULL), ('accuracy', 'accuracy', 'verified', true, NULL),
  ('forest', 'roc_auc', 'unverified', false, concat('cannot reproduce baseline: judge only knows how to retrain ',
    'LogisticRegression from the report fields, got model spec ', chr(39), 'RandomForestClassifier(random_state=1)', chr(39))),
  ('seedless', 'roc_auc', 'unverified', false, concat('cannot reproduce baseline deterministically: ',
    'no random_state found in model spec ', chr(39), 'LogisticRegression(max_iter=100)', chr(39))),
  ('column', 'roc_auc', 'unverified', false, 'retraining failed: no numeric column no_such_column')
) AS t(name, metric_name, verdict, recomputed, refusal)
""",
)
def baseline_verdicts(spark, sf_dir):
    """A true metric, two near ones, a false one, and specs that cannot be retrained."""
    data = labelled_documents(spark, sf_dir)
    honest = baseline.train_metrics(data, RECIPE, FEATURES, SEED, 100)
    model = f"LogisticRegression(random_state={SEED}, max_iter=100)"
    rows = [
        ("honest", model, FEATURES, "roc_auc", honest["roc_auc"]),
        ("near", model, FEATURES, "roc_auc", honest["roc_auc"] * (1 + 5e-7)),
        ("off", model, FEATURES, "roc_auc", honest["roc_auc"] * (1 + 5e-6)),
        ("accuracy", model, FEATURES, "accuracy", honest["accuracy"]),
        ("forest", "RandomForestClassifier(random_state=1)", FEATURES, "roc_auc", 0.9),
        ("seedless", "LogisticRegression(max_iter=100)", FEATURES, "roc_auc", 0.9),
        ("column", model, ["n_chars", "no_such_column"], "roc_auc", 0.9),
    ]
    baselines = spark.createDataFrame(
        rows, "name string, model string, features array<string>, metric_name string, metric_value double"
    )
    return baseline.verify_baselines(baselines, data, RECIPE).select(
        "name",
        "metric_name",
        "verdict",
        F.col("recomputed_value").isNotNull().alias("recomputed"),
        F.when(F.col("verdict") == "unverified", F.col("detail")).alias("refusal"),
    )


SPECS = """
SELECT o_orderkey, o_custkey, o_orderkey % 7 AS kind, CASE o_orderkey % 7
    WHEN 0 THEN concat('LogisticRegression(random_state=', o_custkey, ', max_iter=500)')
    WHEN 1 THEN concat('  LogisticRegression (max_iter = ', o_custkey, ', random_state = 7)')
    WHEN 2 THEN 'LogisticRegression(C=1.0)'
    WHEN 3 THEN concat('RandomForestClassifier(random_state=', o_custkey, ')')
    WHEN 4 THEN concat('a LogisticRegression model, random_state=', o_custkey)
    ELSE 'LogisticRegression(random_state=3)' END AS model,
  CASE WHEN o_orderkey % 7 = 5 THEN 'f1' WHEN o_orderkey % 2 = 0 THEN 'roc_auc' ELSE 'accuracy' END AS metric_name,
  CASE WHEN o_orderkey % 7 = 6 THEN 'gone' WHEN o_orderkey % 14 = 0 THEN '' ELSE 'o_totalprice' END AS feature
FROM orders
"""


@query(
    "baseline_spec_parse",
    f"""
SELECT o_orderkey, CASE kind WHEN 3 THEN 'RandomForestClassifier' WHEN 4 THEN NULL ELSE 'LogisticRegression' END AS model_class,
  CASE kind WHEN 0 THEN o_custkey WHEN 1 THEN 7 WHEN 2 THEN NULL WHEN 3 THEN o_custkey WHEN 4 THEN o_custkey ELSE 3 END::BIGINT AS random_state,
  CASE kind WHEN 0 THEN 500 WHEN 1 THEN o_custkey ELSE 1000 END::BIGINT AS max_iter
FROM ({SPECS})
""",
)
def baseline_spec_parse(spark, sf_dir):
    specs = baseline.parse_spec(derived(spark, sf_dir, SPECS, "orders"))
    return specs.select("o_orderkey", "model_class", "random_state", "max_iter")


@query(
    "baseline_gate",
    f"""
SELECT o_orderkey, CASE
    WHEN kind IN (3, 4) THEN concat('cannot reproduce baseline: judge only knows how to retrain LogisticRegression from the report fields, got model spec ''', model, '''')
    WHEN kind = 2 THEN concat('cannot reproduce baseline deterministically: no random_state found in model spec ''', model, '''')
    WHEN kind = 5 THEN 'unsupported metric_name ''f1'': judge can only recompute [''accuracy'', ''roc_auc''] for the reproducible LogisticRegression recipe'
    WHEN feature = '' THEN 'baseline.features is empty; nothing to retrain on'
    WHEN feature = 'gone' THEN 'retraining failed: no numeric column gone' END AS refusal
FROM ({SPECS})
""",
)
def baseline_gate(spark, sf_dir):
    specs = derived(spark, sf_dir, SPECS, "orders").withColumn(
        "features", F.filter(F.array("feature"), lambda f: f != "")
    )
    gated = baseline.baseline_gate(baseline.parse_spec(specs), table(spark, sf_dir, "orders").schema)
    return gated.select("o_orderkey", "refusal")
