"""Text rules as (input, expected) tables."""

import math

import pytest
from pyspark.sql import functions as F

from claimcheck.functions import claims, evidence, guard, numbers, runlogs, tables, text


def apply(spark, rule, inputs):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in frame.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()]


def check(spark, rule, cases):
    assert apply(spark, rule, [c[0] for c in cases]) == [c[1] for c in cases]


def test_parse_number(spark):
    check(
        spark,
        numbers.parse_number,
        [("12", 12.0), (" +7 ", 7.0), ("-1_000.5", -1000.5), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("", None),
         ("  ", None), ("Month-to-month", None), ("1.0d", None), ("1__0", None), ("0x1F", None), ("1 2", None),
         ("-inf", -math.inf), ("Infinity", math.inf), ("1e999", math.inf)],
    )
    assert math.isnan(apply(spark, numbers.parse_number, ["NaN"])[0])


def test_parse_row_count(spark):
    check(spark, numbers.parse_row_count, [("12", 12), (" 7 ", 7), ("many", None), ("-1", None), ("1.5", None)])


def test_is_close_follows_relative_or_absolute_tolerance(spark):
    pairs = [
        (1000.0, 1009.0), (1000.0, 1011.0), (0.0, 0.01), (0.0, 0.0101), (math.nan, math.nan), (math.inf, math.inf),
        (math.inf, 1.0), (-5.0, -5.04), (2.0, -2.0),
    ]
    frame = spark.createDataFrame(pairs, "a double, b double")
    got = [r[0] for r in frame.select(numbers.is_close(F.col("a"), F.col("b"))).collect()]
    assert got == [math.isclose(a, b, rel_tol=0.01, abs_tol=0.01) for a, b in pairs]


VALUES = [
    0.1, 1.00005, 2.00015, 0.03125, -0.00001, 1e10, 1e16, 123456789.125, 0.0001, 1.5e-5, 2.5, 0.12345, 1e-7, -0.0,
    32.37114865824223, 1e22, 100.0, 0.002, 1234567.0, 0.99995, 7.00005, 1e15 / 3, -2.5, 3.5, 0.0,
]


def test_numbers_render_and_round_exactly(spark):
    frame = spark.createDataFrame([(v,) for v in VALUES], "v double")
    v = F.col("v")
    rows = frame.select(
        v, numbers.fixed_text(v, 4).alias("fixed"), numbers.number_text(v, F.lit(False)).alias("short"),
        numbers.number_text(v, F.lit(True)).alias("whole"), numbers.float_text(v).alias("plain"),
        numbers.round_half_even(v, 4).alias("rounded"), numbers.percent_text(v).alias("percent"),
    ).collect()
    for row in rows:
        value = row["v"]
        fixed = f"{value:.4f}"
        assert row["fixed"] == fixed
        assert row["short"] == (fixed.rstrip("0").rstrip(".") or "0")
        assert row["whole"] == str(round(value))
        assert row["plain"] == repr(value)
        assert row["rounded"] == round(value, 4)
        if abs(value) < 1e9:
            assert row["percent"] == f"{value:.1%}"


def test_safe_rate_of_nothing_is_zero(spark):
    frame = spark.createDataFrame([(0, 0), (1, 32), (2, 3), (1, 1)], "a long, b long")
    got = [r[0] for r in frame.select(numbers.safe_rate(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, round(1 / 32, 4), round(2 / 3, 4), 1.0]


def test_distort(spark):
    frame = spark.createDataFrame([(100.0, 0.2, 1), (100.0, 0.2, -1), (0.5, 2.0, 1)], "v double, m double, d int")
    got = [r[0] for r in frame.select(numbers.distort(F.col("v"), F.col("m"), F.col("d"))).collect()]
    assert got == [120.0, 80.0, 1.5]


def test_claim_numbers(spark):
    check(
        spark,
        claims.claim_numbers,
        [("26.5%", [26.5, 0.265]), ("26.5 percent", [26.5, 0.265]), ("26.5 per cent of", [26.5, 0.265]),
         ("26 percentage points", [26.0]), ("1,869 churned", [1869.0]), ("none", []), ("-5 and 2021.", [5.0, 2021.0])],
    )


@pytest.mark.parametrize(
    ("claim", "agrees"),
    [("75% churned", False), ("In 2021, 26.5% churned", True), ("1,869 of 7,043 churned", False), ("Many churned", True)],
)
def test_claim_agreement(spark, claim, agrees):
    assert apply(spark, lambda c: claims.claim_agrees(c, F.lit(0.2654)), [claim]) == [agrees]


def test_token_disclosure(spark):
    words = F.array(*map(F.lit, ["churned", "in", "total", "fib"]))
    check(
        spark,
        lambda t: claims.token_disclosed(t, words),
        [("churn", True), ("chu", False), ("in", True), ("totally", True), ("fiber", False), ("to", False)],
    )


def test_evidence_kind_and_plausibility(spark):
    cases = [
        ("SELECT 0.75 AS churn_rate", True, False),
        ("SELECT 0.75 AS data", True, False),
        ("  with f as (select * FROM  data) select 1 from f", True, True),
        ('SELECT 1 FROM "data"', True, True),
        ("SELECT 1 FROM a, data", True, False),
        ("SELECT 1 FROM (data)", True, False),
        ("SELECT 1 /* FROM data */", True, True),
        ("(SELECT 1 FROM data)", False, False),
        ("SUMMARIZE data", False, False),
        ("print(0.90)", False, False),
        ("pd.read_csv('/d.csv')", False, True),
        ("", False, False),
    ]
    assert apply(spark, evidence.is_sql, [c[0] for c in cases]) == [c[1] for c in cases]
    touches = apply(spark, lambda e: evidence.touches_data(e, "/d.csv"), [c[0] for c in cases])
    assert touches == [c[2] for c in cases]


def test_mask_parens_keeps_positions(spark):
    check(
        spark,
        evidence.mask_parens,
        [("a(b)c", "a   c"), ("(a(b)c)d", "       d"), ("a)b(c", "a b  "), ("", ""), ("é(ü)😀(x)y", "é   😀   y")],
    )


def test_row_count_query(spark):
    check(
        spark,
        evidence.row_count_query,
        [("SELECT avg(x) FROM data WHERE a='b';", "SELECT count(*) FROM data WHERE a='b'"),
         ("WITH f AS (SELECT * FROM data WHERE t=0) SELECT avg(x) FROM f",
          "WITH f AS (SELECT * FROM data WHERE t=0) SELECT count(*) FROM f"),
         ("SELECT '😀', x FROM data", "SELECT count(*) FROM data"),
         ("SELECT 'FROM' AS l, x FROM data", "SELECT count(*) FROM' AS l, x FROM data"),
         ("SELECT 1", None), ("print(1)", None)],
    )


def test_where_clause(spark):
    check(
        spark,
        evidence.where_clause,
        [("SELECT x FROM data WHERE a='b' GROUP  BY c", " a='b' "), ("SELECT x FROM data", None),
         ("SELECT x FROM data WHERE a='b' UNION SELECT 1", None), ("SELECT x FROM (SELECT 1 WHERE a) t", None),
         ("SELECT x FROM data WHERE a WHERE b", None), ("SELECT x FROM data WHERE a = 'NO LIMIT'", " a = 'NO ")],
    )


@pytest.mark.parametrize(
    ("query", "claim", "fires"),
    [
        ("SELECT avg(x) FROM data WHERE Contract='Month-to-month'", "The churn rate is 42.7%.", True),
        ("SELECT avg(x) FROM data WHERE Contract='Month-to-month'", "Among month customers it is 42.7%.", False),
        ("SELECT avg(x) FROM data WHERE Contract='Month-to-month'", "By contract it is 42.7%.", False),
        ('SELECT avg(x) FROM data WHERE "Contract" IN (\'Two year\', \'One year\')', "It is 6%.", True),
        ("SELECT avg(x) FROM data WHERE tenure > 60", "It is 6%.", False),
        ("SELECT avg(x) FROM data WHERE a = 'b' AND c = 'd'", "It is 6%.", False),
        ("SELECT avg(x) FROM data WHERE Churn = 'Yes'", "Customers who churned pay 6.", False),
        ("SELECT avg(x) FROM data", "It is 6%.", False),
        ("df[df.Contract == 'x']", "It is 6%.", False),
    ],
)
def test_population_mismatch(spark, query, claim, fires):
    reason = apply(spark, lambda e: evidence.population_mismatch(e, F.lit(claim)), [query])[0]
    assert (reason is not None) == fires


GUARD = [
    ("SELECT 1 AS one;", None),
    ("summarize data", None),
    ("WITH x AS (SELECT transform(a, v -> v) FROM data) SELECT * FROM x JOIN data USING (a)", None),
    ("   ", "empty query"),
    ("SELECT 1; SELECT 2", "multiple statements"),
    ("INSERT INTO data VALUES (1)", "'INSERT'"),
    ("UPDATE data SET a = 1", "'UPDATE'"),
    ("DROP TABLE data", "'DROP'"),
    ("ATTACH '/tmp/x'", "'ATTACH'"),
    ("COPY data TO '/tmp/x'", "'COPY'"),
    ("SELECT * FROM read_csv_auto('/etc/passwd')", "read_csv_auto"),
    ("SELECT * FROM glob('/etc/*')", "glob"),
    ("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "insert"),
    ("SELECT reflect('java.lang.System', 'exit') FROM data", "reflect"),
    ("SELECT TRANSFORM(a) USING 'cat' FROM data", "script clause"),
    ("SELECT TRANSFORM(a) USING/**/'cat' FROM data", "script clause"),
    ("WITH x AS (SELECT 1) FROM x MAP a USING 'cat'", "script clause"),
]


def test_guard(spark):
    got = apply(spark, guard.validate_query, [q for q, _ in GUARD])
    for (query, expected), message in zip(GUARD, got, strict=True):
        assert message is None if expected is None else message and expected in message, (query, message)


def test_standard_literals():
    assert guard.standard_literals("SELECT 1.0, .5, a.b, x1.5, '1.0', \"2.0\", 3e5, 10") == (
        "SELECT 1.0D, .5D, a.b, x1.5, '1.0', \"2.0\", 3e5, 10"
    )
    assert guard.standard_literals(r"SELECT 'a\b'") == r"SELECT 'a\\b'"


def test_stdout(spark):
    outs = [
        "x\nRESULT: 5\ndone", "result: a\nRESULT: b", "1\n2\nROWS: 3\n", "ROWS: 3", "rows: many\n7", "  \n 9 \n",
    ]
    assert apply(spark, runlogs.stdout_result, outs) == ["5", "b", "2", "ROWS: 3", "7", "9"]
    assert apply(spark, runlogs.stdout_rows, outs) == [None, None, 3, 3, None, None]


def test_run_message(spark):
    rows = [(True, "out", "warn", None), (False, "", "trace", "exit 1"), (False, "", "", None)]
    frame = spark.createDataFrame(rows, "ok boolean, stdout string, stderr string, error string")
    got = [r[0] for r in frame.select(runlogs.run_message(*map(F.col, frame.columns))).collect()]
    assert got == ["out", "exit 1\ntrace", "unknown error"]


def test_table_text_round_trip(spark):
    frame = spark.createDataFrame([(1, None, 2.0, True)], "a int, b string, c double, d boolean")
    line = frame.select(tables.render_row(frame.schema)).first()[0]
    assert line == "| 1 |  | 2.0 | True |"
    doc = tables.header_lines(frame.columns) + "\n" + line
    parsed = apply(spark, tables.parse_table, [doc, "no table", "| only |"])
    assert parsed[0].asDict(True) == {"header": ["a", "b", "c", "d"], "rows": [["1", "", "2.0", "True"]]}
    assert parsed[1:] == [None, None]
    assert apply(spark, tables.single_value, ["| v |\n| --- |\n| 5 |", doc]) == ["5", None]


def test_truncate(spark):
    assert apply(spark, lambda t: text.truncate_text(t, 3), ["abc", "abcd"]) == [
        "abc", "abc\n... (truncated at 3 chars)",
    ]


def test_quick_answers_are_those_of_the_rules(spark):
    """Where plain text decides, it decides as the patterns do."""
    cores = [
        "SELECT 1 AS data", "With f as (select 1) select x from f", "SELECT x JOıN data", 'SELECT x FROM "data"', "SELECT x FROM dataX", "SELECT éFROM data ",
        "select a from data", "select Load from data", "select loads from data", "select a from data; x", "select identifier('a') from data", "ſELECT 1 FROM data",
        "select map x using 'y' from data", "SELECTx FROM data", "SELECT", "", "print(1)", "describe data", "select 'identifier(' from data", "WİTH x from data",
    ]
    texts = [a + c + b for c in cores for a in ("", " ", "\xa0", "\x85") for b in ("", " ; ", "　", ";")]
    plain = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    word = lambda t: F.upper(F.regexp_extract(plain(t), "^([A-Za-z]+)", 1))
    assert apply(spark, text.strip_text, texts) == apply(spark, plain, texts)
    assert apply(spark, evidence.is_sql, texts) == apply(spark, lambda t: word(t).isin("SELECT", "WITH"), texts)
    reads = lambda t: word(t).isin("SELECT", "WITH") & t.rlike(evidence.READS_DATA)
    assert apply(spark, evidence.touches_data, texts) == apply(spark, reads, texts)
    refused = lambda t: text.let(F.regexp_replace(plain(t), r";\z", ""), guard._refusal)
    assert apply(spark, guard.validate_query, texts) == apply(spark, refused, texts)
