import pytest
from pyspark.sql import functions as F

from claimcheck.operators import planting, quality
from tests.test_judge import BASE_SCHEMA

BASES = [
    (0, "rate", "SELECT avg(x) FROM data", "The rate is {n}.", False, 0.5, "SELECT avg(x) FROM data WHERE a='b'", 0.75),
    (1, "count", "SELECT count(*) FROM data", "{n} rows.", True, 200.0, None, None),
]


@pytest.fixture(scope="module")
def cases(spark):
    return planting.generate_cases(spark.createDataFrame(BASES, BASE_SCHEMA)).cache()


def one(cases, label, attack_class, magnitude, direction):
    row = cases.where(
        (F.col("base_label") == label) & (F.col("attack_class") == attack_class)
        & (F.col("magnitude") == magnitude) & (F.col("direction") == direction)
    ).collect()
    assert len(row) == 1
    return row[0]["claim"], row[0]["evidence"], row[0]["value_num"], row[0]["value_text"]


def test_counts_and_order(cases):
    rows = cases.orderBy("case_idx").collect()
    assert len(rows) == 59
    by_class = {}
    for row in rows:
        by_class[row["attack_class"]] = by_class.get(row["attack_class"], 0) + 1
        assert row["tampered"] == (row["attack_class"] != "clean")
        assert not (row["magnitude"] >= 1 and row["direction"] < 0)
    assert by_class == {
        "clean": 2, "value_swap": 14, "claim_mismatch": 14, "fabricated_evidence": 14, "alias_dodge": 14, "population_switch": 1,
    }
    first = [(r["attack_class"], r["magnitude"], r["direction"]) for r in rows[:4]]
    assert first == [("clean", 0.0, 0), ("value_swap", 0.05, 1), ("value_swap", 0.05, -1), ("value_swap", 0.2, 1)]
    assert rows[29]["attack_class"] == "population_switch" and rows[30]["base_label"] == "count"


def test_each_lie(cases):
    assert one(cases, "rate", "clean", 0.0, 0) == ("The rate is 0.5.", "SELECT avg(x) FROM data", 0.5, "0.5")
    assert one(cases, "rate", "value_swap", 0.2, 1) == ("The rate is 0.5.", "SELECT avg(x) FROM data", 0.6, "0.6")
    assert one(cases, "rate", "claim_mismatch", 2.0, 1) == ("The rate is 1.5.", "SELECT avg(x) FROM data", 0.5, "0.5")
    assert one(cases, "rate", "fabricated_evidence", 0.5, -1) == ("The rate is 0.25.", "SELECT 0.25 AS rate", 0.25, "0.25")
    assert one(cases, "count", "alias_dodge", 0.05, 1) == ("210 rows.", "SELECT 210 AS data", 210.0, "210.0")
    assert one(cases, "count", "clean", 0.0, 0) == ("200 rows.", "SELECT count(*) FROM data", 200.0, "200")
    assert one(cases, "rate", "population_switch", 0.0, 0) == (
        "The rate is 0.75.", "SELECT avg(x) FROM data WHERE a='b'", 0.75, "0.75",
    )


def test_zero_base(spark):
    bases = spark.createDataFrame([(0, "zero", "SELECT 1", "{n}", True, 0.0, None, None), *BASES[1:]], BASE_SCHEMA)
    with pytest.raises(Exception, match="value 0: zero"):
        planting.generate_cases(bases).collect()
    assert planting.generate_cases(bases, zero_bases="skip").count() == 29
    assert [r["base_label"] for r in planting.plant_rejects(bases).collect()] == ["zero"]


def test_tampering(spark):
    findings = spark.createDataFrame(
        [("a", "E", "number", 1.0, "1"), ("b", "F", "string", None, "x")],
        "claim string, evidence string, value_kind string, value_num double, value_text string",
    )
    value = planting.tamper(findings, "E", value_lie=("lie", 0.75)).collect()
    assert tuple(value[0]) == ("lie", "E", "number", 0.75, "0.75") and tuple(value[1]) == ("b", "F", "string", None, "x")
    both = planting.tamper(findings, "E", ("lie", 0.75), ("big lie", 0.9, "SELECT 0.9")).collect()
    assert tuple(both[0]) == ("big lie", "SELECT 0.9", "number", 0.9, "0.9")
    assert planting.tamper(findings, "E").collect() == findings.collect()


def judged(spark, rows):
    return spark.createDataFrame(
        [(i, "b", *r) for i, r in enumerate(rows)],
        "case_idx long, base_label string, attack_class string, magnitude double, direction int, tampered boolean, verdict string",
    )


def test_mixed_scenario(spark):
    counts = quality.outcome_counts(
        judged(
            spark,
            [("value_swap", 0.05, 1, True, "contradicted"), ("value_swap", 0.2, 1, True, "verified"),
             ("fabricated_evidence", 0.5, 1, True, "unverified"), ("population_switch", 0.0, 0, True, "contradicted"),
             ("clean", 0.0, 0, False, "verified"), ("clean", 0.0, 0, False, "unverified")],
        )
    )
    overall = quality.overall(counts).first()
    assert tuple(overall) == (3, 1, 1, 1, 0.75, 0.75, 0.5)
    assert tuple(quality.mechanism_match(counts).first()) == (3, 2, 0.6667)
    assert {r["magnitude"] for r in quality.by_magnitude(counts).collect()} == {"0.05", "0.2", "0.5", "2"}
    classes = {r["attack_class"]: tuple(r)[1:] for r in quality.by_class(counts).collect()}
    assert classes["value_swap"] == (1, 2, 0.5) and classes["alias_dodge"] == (0, 0, 0.0)


def test_nothing_judged(spark):
    counts = quality.outcome_counts(judged(spark, []))
    assert tuple(quality.overall(counts).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0)
    assert tuple(quality.mechanism_match(counts).first()) == (0, 0, 0.0)


def test_metrics_are_written(spark, tmp_path):
    quality.write_metrics(judged(spark, [("value_swap", 0.05, 1, True, "verified")]), str(tmp_path), {"dataset": "d"})
    assert spark.read.json(f"{tmp_path}/missed_cases").count() == 1
    meta = spark.read.json(f"{tmp_path}/meta").first()
    assert (meta["n_cases"], meta["n_tampered"], meta["dataset"]) == (1, 1, "d")


def test_numbers_are_written_before_a_base_expands(spark):
    """Behind the expansion nothing is rendered, and bases of one partition keep every task busy."""
    cases = planting.generate_cases(spark.createDataFrame(BASES, BASE_SCHEMA).coalesce(1))
    plans = [cases._jdf.queryExecution().optimizedPlan()]
    while plans[0].nodeName() != "Generate":
        assert "lambda" not in plans[0].simpleString(100_000)
        plans = [plans[0].children().apply(0)]
    assert cases.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
