"""Rules on evidence and claim texts. Texts are made per row of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimcheck.catalog import derived, query, table
from claimcheck.functions import claims, evidence, numbers, runlogs
from claimcheck.functions.text import fold
from claimcheck.plans.verify import provenance_caption, provenance_note

DATASET_PATH = "/warehouse/orders.csv"

EVIDENCE_TEXTS = f"""
SELECT o_orderkey, CAST(o_custkey AS STRING) AS k, o_orderkey % 12 AS kind,
  CASE o_orderkey % 12
    WHEN 0 THEN concat('SELECT avg(x) FROM data WHERE o_custkey = ', o_custkey)
    WHEN 1 THEN concat('  with f AS (SELECT * FROM data WHERE a = ', o_custkey, ') SELECT avg(x) FROM f;')
    WHEN 2 THEN concat('SELECT ', o_custkey, ' AS data')
    WHEN 3 THEN concat('pd.read_csv("{DATASET_PATH}").head(', o_custkey, ')')
    WHEN 4 THEN concat('print(', o_custkey, ')')
    WHEN 5 THEN concat('SELECT count(*) from "DATA" GROUP BY k', o_custkey)
    WHEN 6 THEN concat('SELECT ', o_custkey, ' FROM datax JOIN  data ON true')
    WHEN 7 THEN concat('SELECT ', o_custkey, ' FROM database')
    WHEN 8 THEN concat('(SELECT ', o_custkey, ' FROM data)')
    WHEN 9 THEN concat('SELECT ''FROM'' AS f', o_custkey, ', x FROM data')
    WHEN 10 THEN concat('SUMMARIZE data -- ', o_custkey)
    ELSE concat('SELECT f((a + b) * ', o_custkey, ') AS v FROM data WHERE g(x) = 1 ORDER BY (v) LIMIT 1')
  END AS evidence
FROM orders
"""


def _evidence(spark, sf_dir):
    return derived(spark, sf_dir, EVIDENCE_TEXTS, "orders")


@query(
    "evidence_kind",
    f"SELECT o_orderkey, CASE WHEN kind IN (3, 4, 8, 10) THEN 'python' ELSE 'sql' END AS evidence_kind FROM ({EVIDENCE_TEXTS})",
)
def evidence_kind(spark, sf_dir):
    kind = F.when(evidence.is_sql(F.col("evidence")), "sql").otherwise("python")
    return _evidence(spark, sf_dir).select("o_orderkey", kind.alias("evidence_kind"))


@query(
    "evidence_touches_data",
    f"SELECT o_orderkey, kind NOT IN (2, 4, 7, 8, 10) AS touches, "
    f"CASE WHEN kind IN (2, 7) THEN 'sql' WHEN kind IN (4, 8, 10) THEN 'python' END AS refused_as FROM ({EVIDENCE_TEXTS})",
)
def evidence_touches_data(spark, sf_dir):
    text = F.col("evidence")
    reason = evidence.implausible_reason(text, DATASET_PATH)
    return _evidence(spark, sf_dir).select(
        "o_orderkey",
        evidence.touches_data(text, DATASET_PATH).alias("touches"),
        F.lower(F.substring_index(reason, " ", 1)).alias("refused_as"),
    )


@query(
    "mask_parens",
    f"""
SELECT o_orderkey, CASE kind
    WHEN 0 THEN concat('SELECT avg    FROM data WHERE o_custkey = ', k)
    WHEN 3 THEN concat('pd.read_csv', repeat(' ', {len(DATASET_PATH) + 4}), '.head', repeat(' ', length(k) + 2))
    WHEN 4 THEN concat('print', repeat(' ', length(k) + 2))
    WHEN 5 THEN concat('SELECT count    from "DATA" GROUP BY k', k)
    WHEN 8 THEN repeat(' ', length(k) + 19)
    WHEN 11 THEN concat('SELECT f', repeat(' ', length(k) + 12), ' AS v FROM data WHERE g    = 1 ORDER BY     LIMIT 1')
    WHEN 1 THEN concat('  with f AS ', repeat(' ', length(k) + 31), ' SELECT avg    FROM f;')
    ELSE evidence END AS masked
FROM ({EVIDENCE_TEXTS})
""",
)
def mask_parens(spark, sf_dir):
    return _evidence(spark, sf_dir).select("o_orderkey", evidence.mask_parens(F.col("evidence")).alias("masked"))


@query(
    "row_count_rewrite",
    f"""
SELECT o_orderkey, CASE kind
    WHEN 0 THEN concat('SELECT count(*) FROM data WHERE o_custkey = ', k)
    WHEN 1 THEN concat('with f AS (SELECT * FROM data WHERE a = ', k, ') SELECT count(*) FROM f')
    WHEN 5 THEN concat('SELECT count(*) from "DATA" GROUP BY k', k)
    WHEN 6 THEN 'SELECT count(*) FROM datax JOIN  data ON true'
    WHEN 7 THEN 'SELECT count(*) FROM database'
    WHEN 9 THEN concat('SELECT count(*) FROM'' AS f', k, ', x FROM data')
    WHEN 11 THEN 'SELECT count(*) FROM data WHERE g(x) = 1 ORDER BY (v) LIMIT 1'
  END AS count_query
FROM ({EVIDENCE_TEXTS})
""",
)
def row_count_rewrite(spark, sf_dir):
    return _evidence(spark, sf_dir).select(
        "o_orderkey", evidence.row_count_query(F.col("evidence")).alias("count_query")
    )


WHERE_TEXTS = """
SELECT o_orderkey, CAST(o_custkey AS STRING) AS k, o_orderkey % 10 AS kind,
  CASE o_orderkey % 10
    WHEN 0 THEN concat('SELECT avg(x) FROM data WHERE Seg = ''Buyer ', o_custkey, '''')
    WHEN 1 THEN concat('SELECT avg(x) FROM data WHERE "Seg Name" IN (''a-', o_custkey, ''', ''it''''s'') GROUP  BY y;')
    WHEN 2 THEN concat('SELECT avg(x) FROM data WHERE n > ', o_custkey, ' ORDER BY 1')
    WHEN 3 THEN concat('SELECT avg(x) FROM data WHERE a = ''', o_custkey, ''' AND b = ''c''')
    WHEN 4 THEN concat('SELECT a FROM data WHERE a = ''', o_custkey, ''' UNION SELECT a FROM data')
    WHEN 5 THEN concat('SELECT avg(x) FROM (SELECT * FROM data WHERE a = ''', o_custkey, ''') t')
    WHEN 6 THEN concat('WITH f AS (SELECT * FROM data WHERE a = ''x'') SELECT x FROM f WHERE Kind_of = ''v', o_custkey, ''' LIMIT 1')
    WHEN 7 THEN concat('SELECT ', o_custkey, ' FROM data')
    WHEN 8 THEN concat('SELECT x FROM data WHERE a = ''NO LIMIT ', o_custkey, '''')
    ELSE concat('SELECT x FROM data where a=''b', o_custkey, ''' having count(*) > 1')
  END AS evidence
FROM orders
"""


@query(
    "where_clause",
    f"""
SELECT o_orderkey, CASE kind
    WHEN 0 THEN concat('Seg = ''Buyer ', k, '''')
    WHEN 1 THEN concat('"Seg Name" IN (''a-', k, ''', ''it''''s'')')
    WHEN 2 THEN concat('n > ', k)
    WHEN 3 THEN concat('a = ''', k, ''' AND b = ''c''')
    WHEN 6 THEN concat('Kind_of = ''v', k, '''')
    WHEN 8 THEN 'a = ''NO'
    WHEN 9 THEN concat('a=''b', k, '''')
  END AS clause
FROM ({WHERE_TEXTS})
""",
)
def where_clause(spark, sf_dir):
    texts = derived(spark, sf_dir, WHERE_TEXTS, "orders")
    return texts.select("o_orderkey", F.trim(evidence.where_clause(F.col("evidence"))).alias("clause"))


@query(
    "where_predicate_tokens",
    f"""
SELECT o_orderkey,
  CASE kind WHEN 0 THEN 'seg' WHEN 1 THEN 'seg name' WHEN 6 THEN 'kind of' WHEN 9 THEN 'a' END AS column_tokens,
  CASE kind WHEN 0 THEN concat('buyer ', k) WHEN 1 THEN concat('a ', k, ' it s') WHEN 6 THEN concat('v', k)
    WHEN 9 THEN concat('b', k) END AS value_tokens
FROM ({WHERE_TEXTS})
""",
)
def where_predicate_tokens(spark, sf_dir):
    texts = derived(spark, sf_dir, WHERE_TEXTS, "orders")
    parsed = texts.select(
        "o_orderkey", evidence.where_tokens(evidence.where_clause(F.col("evidence"))).alias("t")
    )
    return parsed.select(
        "o_orderkey",
        F.array_join("t.columns", " ").alias("column_tokens"),
        F.array_join("t.values", " ").alias("value_tokens"),
    )


NUMBER_TEXTS = """
SELECT o_orderkey, o_custkey, o_orderkey % 14 AS kind,
  CASE o_orderkey % 14
    WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN concat('  +', o_custkey, ' ')
    WHEN 2 THEN concat('-', o_custkey, '.25') WHEN 3 THEN concat('1_', 100 + o_custkey % 900)
    WHEN 4 THEN concat(o_custkey, 'e2') WHEN 5 THEN '.5' WHEN 6 THEN concat(o_custkey, '.')
    WHEN 7 THEN concat(o_custkey, '.0d') WHEN 8 THEN '' WHEN 9 THEN concat('P', o_custkey)
    WHEN 10 THEN '1__0' WHEN 11 THEN ' NaN' WHEN 12 THEN '-Infinity' ELSE '0x1F' END AS text
FROM orders
"""


@query(
    "parse_number",
    f"""
SELECT o_orderkey, CASE kind WHEN 11 THEN 'nan' WHEN 12 THEN '-inf' WHEN 0 THEN 'finite' WHEN 1 THEN 'finite'
    WHEN 2 THEN 'finite' WHEN 3 THEN 'finite' WHEN 4 THEN 'finite' WHEN 5 THEN 'finite' WHEN 6 THEN 'finite'
    ELSE 'none' END AS reading,
  CASE kind WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey WHEN 2 THEN -(o_custkey + 0.25)
    WHEN 3 THEN 1000 + 100 + o_custkey % 900 WHEN 4 THEN o_custkey * 100 WHEN 5 THEN 0.5 WHEN 6 THEN o_custkey END::DOUBLE AS number
FROM ({NUMBER_TEXTS})
""",
)
def parse_number(spark, sf_dir):
    parsed = derived(spark, sf_dir, NUMBER_TEXTS, "orders").select(
        "o_orderkey", numbers.parse_number(F.col("text")).alias("n")
    )
    reading = (
        F.when(F.col("n").isNull(), "none")
        .when(F.isnan("n"), "nan")
        .when(F.abs("n") == float("inf"), numbers.float_text(F.col("n")))
        .otherwise("finite")
    )
    number = F.when(reading == "finite", F.col("n"))
    return parsed.select("o_orderkey", reading.alias("reading"), number.alias("number"))


VALUE_PAIRS = """
SELECT o_orderkey, o_totalprice AS a, o_totalprice * (1.0E0 + CAST(o_orderkey % 9 - 4 AS DOUBLE) * 0.004E0) AS b,
       CAST(o_orderkey % 3 AS DOUBLE) * 0.006E0 AS c
FROM orders
"""


@query(
    "numeric_compare",
    f"""
SELECT o_orderkey, abs(a - b) <= greatest(0.01 * greatest(abs(a), abs(b)), 0.01) AS close,
       c = 0.0 OR c <= 0.01 AS near_zero FROM ({VALUE_PAIRS})
""",
)
def numeric_compare(spark, sf_dir):
    return derived(spark, sf_dir, VALUE_PAIRS, "orders").select(
        "o_orderkey",
        numbers.is_close(F.col("a"), F.col("b")).alias("close"),
        numbers.is_close(F.col("c"), F.lit(0.0)).alias("near_zero"),
    )


LABEL_PAIRS = """
SELECT o_orderkey, o_orderpriority AS raw, o_orderkey % 4 AS kind,
  CASE o_orderkey % 4 WHEN 0 THEN concat('  ', lower(o_orderpriority), ' ') WHEN 1 THEN upper(o_orderpriority)
    WHEN 2 THEN concat(o_orderpriority, '.') ELSE '5-LOW' END AS claimed
FROM orders
"""


@query(
    "categorical_compare",
    f"SELECT o_orderkey, CASE WHEN kind <= 1 THEN true WHEN kind = 2 THEN false ELSE raw = '5-LOW' END AS same FROM ({LABEL_PAIRS})",
)
def categorical_compare(spark, sf_dir):
    return derived(spark, sf_dir, LABEL_PAIRS, "orders").select(
        "o_orderkey", (fold(F.col("raw")) == fold(F.col("claimed"))).alias("same")
    )


CLAIM_TEXTS = """
SELECT o_orderkey, o_custkey, o_orderkey % 7 AS kind,
  CASE o_orderkey % 7
    WHEN 0 THEN concat('In 2021, ', o_custkey, '.5% of buyers left.')
    WHEN 1 THEN concat('About ', o_custkey, ' per cent, or ', o_custkey, ' percent.')
    WHEN 2 THEN concat('1,', 100 + o_custkey % 900, ' of 7,043 buyers')
    WHEN 3 THEN 'No number at all.'
    WHEN 4 THEN concat('A percentage of ', o_custkey, ' percentage points')
    WHEN 5 THEN concat('from -', o_custkey, ' to ', o_custkey, '.25')
    ELSE concat('v', o_custkey, 'x') END AS claim
FROM orders
"""


@query(
    "claim_numbers",
    f"""
SELECT o_orderkey, CAST(u.pos - 1 AS INTEGER) AS pos, u.n FROM (
  SELECT o_orderkey, CASE kind
    WHEN 0 THEN [2021.0, o_custkey + 0.5, (o_custkey + 0.5) / 100.0::DOUBLE]
    WHEN 1 THEN [o_custkey, o_custkey / 100.0::DOUBLE, o_custkey, o_custkey / 100.0::DOUBLE]
    WHEN 2 THEN [1100 + o_custkey % 900, 7043]
    WHEN 3 THEN []
    WHEN 5 THEN [o_custkey, o_custkey + 0.25]
    ELSE [o_custkey] END::DOUBLE[] AS ns
  FROM ({CLAIM_TEXTS})), LATERAL (SELECT unnest(ns) AS n, generate_subscripts(ns, 1) AS pos) u
""",
)
def claim_numbers(spark, sf_dir):
    texts = derived(spark, sf_dir, CLAIM_TEXTS, "orders")
    return texts.select("o_orderkey", F.posexplode(claims.claim_numbers(F.col("claim"))).alias("pos", "n"))


@query(
    "document_numbers",
    r"""
SELECT doc_id, len(ns)::BIGINT AS n_numbers, list_max(ns) AS largest, list_min(ns) AS smallest FROM (
  SELECT doc_id, flatten(list_transform(list_zip(
      regexp_extract_all(text, '(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(%|per\s*cent\b)?', 1),
      regexp_extract_all(text, '(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(%|per\s*cent\b)?', 2)),
    lambda z: CASE WHEN z[2] <> '' THEN [replace(z[1], ',', '')::DOUBLE, replace(z[1], ',', '')::DOUBLE / 100.0::DOUBLE]
      ELSE [replace(z[1], ',', '')::DOUBLE] END)) AS ns FROM documents)
""",
)
def document_numbers(spark, sf_dir):
    """Numerals of whole documents; a percentage adds its hundredth to the list."""
    ns = claims.claim_numbers(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", ns.alias("ns")).select(
        "doc_id",
        F.size("ns").cast("bigint").alias("n_numbers"),
        F.array_max("ns").alias("largest"),
        F.array_min("ns").alias("smallest"),
    )


@query(
    "claim_agreement",
    f"""
SELECT o_orderkey, CASE kind
    WHEN 0 THEN abs(2021 - o_custkey) <= greatest(0.01 * greatest(2021, o_custkey), 0.01)
      OR 0.5 <= greatest(0.01 * (o_custkey + 0.5), 0.01)
      OR abs((o_custkey + 0.5) / 100 - o_custkey) <= greatest(0.01 * greatest(o_custkey, (o_custkey + 0.5) / 100), 0.01)
    WHEN 2 THEN abs(1100 + o_custkey % 900 - o_custkey) <= greatest(0.01 * greatest(1100 + o_custkey % 900, o_custkey), 0.01)
      OR abs(7043 - o_custkey) <= 0.01 * greatest(7043, o_custkey)
    ELSE true END AS agrees
FROM ({CLAIM_TEXTS})
""",
)
def claim_agreement(spark, sf_dir):
    texts = derived(spark, sf_dir, CLAIM_TEXTS, "orders")
    agrees = claims.claim_agrees(F.col("claim"), F.col("o_custkey").cast("double"))
    return texts.select("o_orderkey", agrees.alias("agrees"))


@query(
    "tokens",
    """
SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (
  SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents)
""",
)
def tokens(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", claims.tokens(F.col("text")).alias("t"))
    return found.select(
        "doc_id",
        F.size("t").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"),
    )


TOKEN_TEXTS = """
SELECT o_orderkey, o_orderkey % 6 AS kind,
  CASE o_orderkey % 6 WHEN 0 THEN 'churn' WHEN 1 THEN 'to' WHEN 2 THEN concat('seg', o_custkey)
    WHEN 3 THEN 'orderstatus' WHEN 4 THEN 'fib' ELSE 'optics' END AS token,
  concat('Customers churned in order; segment seg', o_custkey, ' fibers total optic') AS claim
FROM orders
"""


@query(
    "token_disclosure",
    f"SELECT o_orderkey, kind NOT IN (1, 4) AS disclosed FROM ({TOKEN_TEXTS})",
)
def token_disclosure(spark, sf_dir):
    texts = derived(spark, sf_dir, TOKEN_TEXTS, "orders")
    disclosed = claims.token_disclosed(F.col("token"), claims.tokens(F.col("claim")))
    return texts.select("o_orderkey", disclosed.alias("disclosed"))


POPULATION_TEXTS = """
SELECT c_custkey, c_mktsegment, c_custkey % 6 AS kind,
  CASE WHEN c_custkey % 6 = 4 THEN concat('SELECT avg(c_acctbal) FROM data WHERE c_acctbal > ', c_custkey)
       WHEN c_custkey % 6 = 5 THEN concat('SELECT avg(c_acctbal) FROM data WHERE c_mktsegment IN (''', c_mktsegment, ''', ''NONE'')')
       ELSE concat('SELECT avg(c_acctbal) FROM data WHERE c_mktsegment = ''', c_mktsegment, '''') END AS evidence,
  CASE c_custkey % 6 WHEN 1 THEN concat('Among ', lower(c_mktsegment), ' buyers the average balance is high.')
       WHEN 2 THEN 'By mktsegment, the average balance is high.'
       WHEN 3 THEN concat('The average balance of the ', left(c_mktsegment, 5), ' group is high.')
       ELSE 'The average balance is high.' END AS claim
FROM customer
"""


@query(
    "population_mismatch",
    f"""
SELECT c_custkey, CASE kind
    WHEN 0 THEN concat('c_mktsegment = ''', c_mktsegment, '''')
    WHEN 5 THEN concat('c_mktsegment IN (''', c_mktsegment, ''', ''NONE'')') END AS hidden_filter
FROM ({POPULATION_TEXTS})
""",
)
def population_mismatch(spark, sf_dir):
    texts = derived(spark, sf_dir, POPULATION_TEXTS, "customer")
    reason = evidence.population_mismatch(F.col("evidence"), F.col("claim"))
    hidden = F.regexp_extract(reason, "^evidence filters on WHERE (.*) but the claim text", 1)
    return texts.select("c_custkey", hidden.alias("hidden_filter"))


ROW_COUNTS = """
SELECT o_custkey, count(*) AS n, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE count(*) * (5 + o_custkey % 11) END AS total
FROM orders GROUP BY o_custkey
"""


@query(
    "provenance",
    f"SELECT o_custkey, CASE WHEN n::DOUBLE / total < 0.1 THEN 'narrow_subset' END AS note FROM ({ROW_COUNTS})",
)
def provenance(spark, sf_dir):
    return derived(spark, sf_dir, ROW_COUNTS, "orders").select(
        "o_custkey", provenance_note(F.col("n"), F.col("total")).alias("note")
    )


@query(
    "provenance_caption",
    f"""
SELECT o_custkey, concat('Evidence touched ', n, coalesce(' of ' || total::BIGINT, ''), ' rows.',
  CASE WHEN n::DOUBLE / total < 0.1
    THEN ' Narrow subset (<10% of the dataset) -- read the claim''s wording against this population.' ELSE '' END) AS caption
FROM ({ROW_COUNTS})
""",
)
def caption(spark, sf_dir):
    counts = derived(spark, sf_dir, ROW_COUNTS, "orders")
    note = provenance_note(F.col("n"), F.col("total"))
    return counts.select("o_custkey", provenance_caption(F.col("n"), F.col("total"), note).alias("caption"))


RUN_LOGS = """
SELECT event_id, event_type <> 'error' AS ok, event_id % 7 AS kind, CAST(event_id AS STRING) AS k,
  CASE WHEN event_type = 'error' THEN '' ELSE CASE event_id % 7
    WHEN 0 THEN concat('loading', chr(10), 'RESULT: ', event_id, chr(10), 'done.')
    WHEN 1 THEN concat('result:  ', event_id, chr(10), 'ROWS: ', event_id % 100, chr(10), 'Result: again ', event_id)
    WHEN 2 THEN concat('first', chr(10), event_id, chr(10), ' rows: 12', chr(10))
    WHEN 3 THEN concat('ROWS: ', event_id)
    WHEN 4 THEN concat('ROWS: 3', chr(10), 'ROWS: many', chr(10), 'RESULT: a', event_id)
    WHEN 5 THEN concat('   ', chr(10), chr(10), event_id, '  ')
    ELSE concat('see RESULT: ', event_id, chr(13), chr(10), 'ROWS: -4') END END AS stdout,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN concat('Traceback ', event_id) ELSE '' END AS stderr,
  CASE WHEN event_type = 'error' AND event_id % 3 > 0 THEN concat('exit code ', event_id % 5) END AS error
FROM events
"""


def _run_logs(spark, sf_dir):
    return derived(spark, sf_dir, RUN_LOGS, "events")


@query(
    "stdout_result",
    f"""
SELECT event_id, CASE WHEN ok THEN CASE kind WHEN 1 THEN concat('again ', k) WHEN 3 THEN concat('ROWS: ', k)
    WHEN 4 THEN concat('a', k) WHEN 6 THEN concat('see RESULT: ', k) ELSE k END END AS raw
FROM ({RUN_LOGS})
""",
)
def stdout_result(spark, sf_dir):
    return _run_logs(spark, sf_dir).select("event_id", runlogs.stdout_result(F.col("stdout")).alias("raw"))


@query(
    "stdout_rows",
    f"""
SELECT event_id, CASE WHEN ok THEN CASE kind WHEN 1 THEN event_id % 100 WHEN 2 THEN 12 WHEN 3 THEN event_id END END::BIGINT AS n_rows
FROM ({RUN_LOGS})
""",
)
def stdout_rows(spark, sf_dir):
    return _run_logs(spark, sf_dir).select("event_id", runlogs.stdout_rows(F.col("stdout")).alias("n_rows"))


@query(
    "run_log_messages",
    f"""
SELECT event_id, NOT ok AS is_error, CASE WHEN ok THEN stdout
    ELSE concat(coalesce(error, 'unknown error'), CASE WHEN stderr <> '' THEN concat(chr(10), stderr) ELSE '' END) END AS content
FROM ({RUN_LOGS})
""",
)
def run_log_messages(spark, sf_dir):
    message = runlogs.run_message(F.col("ok"), F.col("stdout"), F.col("stderr"), F.col("error"))
    return _run_logs(spark, sf_dir).select("event_id", (~F.col("ok")).alias("is_error"), message.alias("content"))
