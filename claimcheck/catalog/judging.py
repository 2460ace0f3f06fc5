"""Recomputed values and verdicts over claims made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimcheck.catalog import derived, query, table
from claimcheck.functions.numbers import parse_number
from claimcheck.operators.recompute import recomputed_values
from claimcheck.plans.verify import VERDICTS, judge_findings, verdict_summary
from claimcheck.session import ClaimSession
from claimcheck.sources.reports import judged_reports

# Half of the claims are distorted.
CUSTOMER_CLAIMS = """
SELECT CAST(o_custkey AS STRING) AS finding_id, CAST(o_custkey % 50 AS STRING) AS report_id, o_custkey,
  concat('customer ', o_custkey, ' placed ', count(*), ' purchases') AS claim,
  concat('SELECT count(*) FROM data WHERE o_custkey = ', o_custkey) AS evidence,
  'number' AS value_kind,
  CAST(count(*) AS DOUBLE) * (1.0E0 + 0.5E0 * CAST(o_custkey % 2 AS DOUBLE)) AS value_num,
  CAST(CAST(count(*) AS DOUBLE) * (1.0E0 + 0.5E0 * CAST(o_custkey % 2 AS DOUBLE)) AS STRING) AS value_text,
  count(*) AS n
FROM orders GROUP BY o_custkey
"""


@query(
    "customer_claims",
    f"""
SELECT finding_id, CASE WHEN o_custkey % 2 = 0 THEN 'verified' ELSE 'contradicted' END AS verdict,
  CASE WHEN o_custkey % 2 = 0 THEN 'value_matches' ELSE 'value_differs' END AS reason,
  n::DOUBLE AS recomputed_num, n::BIGINT AS evidence_row_count,
  CASE WHEN n::DOUBLE / (SELECT count(*) FROM orders) < 0.1 THEN 'narrow_subset' END AS provenance_note
FROM ({CUSTOMER_CLAIMS})
""",
)
def customer_claims(spark, sf_dir):
    claims = derived(spark, sf_dir, CUSTOMER_CLAIMS, "orders")
    judged = judge_findings(spark, claims, table(spark, sf_dir, "orders"))
    return judged.select(
        "finding_id", "verdict", "reason", "recomputed_num", "evidence_row_count", "provenance_note"
    )


# One claim of every kind per customer; `kind` decides the verdict it must get.
DATASET_PATH = "/warehouse/orders.csv"
N_KINDS = 16
MIXED_CLAIMS = f"""
WITH per AS (
  SELECT o_custkey AS k, count(*) AS n, max(o_orderstatus) AS s FROM orders GROUP BY o_custkey),
pairs AS (
  SELECT a.k, a.n, a.s, a.n + coalesce(b.n, 0) AS n2 FROM per a LEFT JOIN per b ON b.k = a.k + 1),
facts AS (
  SELECT sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent,
         sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS finished, count(*) AS total FROM orders)
SELECT concat(CAST(k AS STRING), '-', CAST(kind AS STRING)) AS finding_id, CAST(k % 50 AS STRING) AS report_id,
  k, kind, n, n2, urgent, finished, total,
  CASE kind
    WHEN 1 THEN concat('Buyer ', k, ' placed ', n, ' purchases.')
    WHEN 2 THEN concat('There were ', n * 2 + 5, ' purchases.')
    WHEN 5 THEN concat('The last status of buyer ', k, ' is ', s, '.')
    WHEN 6 THEN 'The last status is Z.'
    WHEN 7 THEN concat('In total there are ', urgent, ' purchases.')
    WHEN 9 THEN concat('Buyers ', k, ' and ', k + 1, ' placed ', n2, ' purchases.')
    WHEN 11 THEN concat('There are ', urgent, ' 1-URGENT purchases.')
    WHEN 12 THEN 'That buyer placed nothing.'
    WHEN 13 THEN concat('There are ', finished, ' finished purchases.')
    ELSE concat('Buyer ', k, ' placed ', n, ' purchases.') END AS claim,
  CASE kind
    WHEN 3 THEN concat('SELECT ', n, ' AS n')
    WHEN 4 THEN concat('SELECT avg(no_such_column) FROM data WHERE o_custkey = ', k)
    WHEN 5 THEN concat('SELECT max(o_orderstatus) AS s FROM data WHERE "o_custkey" = ', k, ';')
    WHEN 6 THEN concat('select MAX(o_orderstatus) from data where o_custkey=', k)
    WHEN 7 THEN 'SELECT count(*) FROM data WHERE o_orderpriority = ''1-URGENT'''
    WHEN 8 THEN concat('SELECT max(o_orderstatus) FROM data WHERE o_custkey = ', k)
    WHEN 9 THEN concat('SELECT count(*) FROM data WHERE o_custkey IN (', k, ', ', k + 1, ', ', k, ')')
    WHEN 10 THEN 'SELECT count(*) FROM data WHERE o_orderstatus = ''load'''
    WHEN 11 THEN 'SELECT sum(CASE WHEN o_orderpriority = ''1-URGENT'' THEN 1 ELSE 0 END) FROM data'
    WHEN 12 THEN concat('SELECT count(*) FROM data WHERE o_custkey = ', -1 - k)
    WHEN 13 THEN 'WITH f AS (SELECT * FROM data WHERE o_orderstatus = ''F'') SELECT count(*) FROM f'
    WHEN 14 THEN concat('print(len(pd.read_csv("{DATASET_PATH}")), ', k, ')')
    WHEN 15 THEN 'SELECT o_orderstatus, count(*) FROM data GROUP BY o_orderstatus'
    ELSE concat('SELECT count(*) FROM data WHERE o_custkey = ', k) END AS evidence,
  CASE WHEN kind IN (5, 6) THEN 'string' ELSE 'number' END AS value_kind,
  CASE WHEN kind IN (5, 6) THEN NULL ELSE CAST(claimed AS DOUBLE) END AS value_num,
  CASE kind WHEN 5 THEN concat(' ', lower(s)) WHEN 6 THEN 'Z' ELSE CAST(claimed AS STRING) END AS value_text
FROM (
  SELECT p.*, f.*, u.kind, CASE u.kind WHEN 1 THEN n * 2 + 1 WHEN 7 THEN urgent WHEN 9 THEN n2 WHEN 11 THEN urgent
    WHEN 12 THEN 0 WHEN 13 THEN finished ELSE n END AS claimed
  FROM pairs p CROSS JOIN facts f CROSS JOIN (VALUES {', '.join(f'({i})' for i in range(N_KINDS))}) u(kind)
  WHERE u.kind IN (p.k % {N_KINDS}, (p.k + 5) % {N_KINDS})) t
"""
MIXED_VERDICTS = f"""
SELECT *, CASE kind
    WHEN 1 THEN 'value_differs' WHEN 2 THEN 'claim_text_disagrees_with_value'
    WHEN 3 THEN 'evidence_does_not_touch_data' WHEN 4 THEN 'not_recomputed' WHEN 6 THEN 'value_differs'
    WHEN 7 THEN 'population_mismatch_suspected' WHEN 8 THEN 'not_comparable' WHEN 10 THEN 'not_recomputed'
    WHEN 14 THEN 'not_recomputed' WHEN 15 THEN 'not_recomputed' ELSE 'value_matches' END AS reason,
  CASE WHEN kind IN (1, 2, 6) THEN 'contradicted' WHEN kind IN (3, 4, 7, 8, 10, 14, 15) THEN 'unverified'
    ELSE 'verified' END AS verdict,
  CASE WHEN kind IN (3, 10, 14, 15) THEN NULL WHEN kind = 7 THEN urgent WHEN kind = 9 THEN n2
    WHEN kind = 11 THEN total WHEN kind = 12 THEN 0 WHEN kind = 13 THEN finished ELSE n END::BIGINT AS evidence_row_count
FROM ({MIXED_CLAIMS})
"""


def mixed_claims(spark, sf_dir):
    return derived(spark, sf_dir, MIXED_CLAIMS, "orders")


def judged_mixed(spark, sf_dir):
    return judge_findings(
        spark, mixed_claims(spark, sf_dir), table(spark, sf_dir, "orders"), dataset_path=DATASET_PATH
    )


@query(
    "judged_findings",
    f"""
SELECT finding_id, verdict, reason, evidence_row_count, total::BIGINT AS total_rows,
  CASE WHEN evidence_row_count::DOUBLE / total < 0.1 THEN 'narrow_subset' END AS provenance_note,
  CASE WHEN verdict = 'unverified' OR kind IN (5, 6) THEN NULL WHEN kind IN (7, 11) THEN urgent WHEN kind = 9 THEN n2
    WHEN kind = 12 THEN 0 WHEN kind = 13 THEN finished ELSE n END::DOUBLE AS recomputed_num
FROM ({MIXED_VERDICTS})
""",
)
def judged_findings(spark, sf_dir):
    return judged_mixed(spark, sf_dir).select(
        "finding_id", "verdict", "reason", "evidence_row_count", "total_rows", "provenance_note", "recomputed_num"
    )


@query(
    "verdict_summary",
    f"""
SELECT report_id, count(*) FILTER (WHERE verdict = 'verified')::BIGINT AS verified,
  count(*) FILTER (WHERE verdict = 'unverified')::BIGINT AS unverified,
  count(*) FILTER (WHERE verdict = 'contradicted')::BIGINT AS contradicted
FROM ({MIXED_VERDICTS}) GROUP BY report_id
""",
)
def summary(spark, sf_dir):
    return verdict_summary(judged_mixed(spark, sf_dir), "report_id")


@query(
    "evidence_row_count",
    f"SELECT finding_id, evidence_row_count FROM ({MIXED_VERDICTS})",
)
def evidence_row_count(spark, sf_dir):
    """Rows behind each evidence; one that is refused, reads no table or is Python has none."""
    session = ClaimSession(spark)
    session.register(table(spark, sf_dir, "orders"))
    claims = session.adopt(mixed_claims(spark, sf_dir))
    return recomputed_values(session, claims).select("finding_id", "evidence_row_count")


# A finding's place in its report.
POSITION = f"CAST(floor(k / 50) * {N_KINDS} + kind AS BIGINT)"


@query(
    "judged_report_json",
    f"""
WITH v AS (SELECT *, {POSITION} // 10000 AS part FROM ({MIXED_VERDICTS})),
whole AS (SELECT report_id, count(*) FILTER (WHERE verdict = 'verified') AS verified,
  count(*) FILTER (WHERE verdict = 'unverified') AS unverified,
  count(*) FILTER (WHERE verdict = 'contradicted') AS contradicted FROM v GROUP BY report_id)
SELECT v.report_id, part, count(*)::BIGINT AS n_findings, count(*) FILTER (WHERE evidence_row_count IS NULL)::BIGINT AS n_without_rows,
  any_value(w.verified)::BIGINT AS verified,
  any_value(w.unverified)::BIGINT AS unverified,
  any_value(w.contradicted)::BIGINT AS contradicted
FROM v JOIN whole w ON w.report_id = v.report_id GROUP BY v.report_id, part
""",
)
def judged_report_json(spark, sf_dir):
    """Judged documents, read back to what they say."""
    judged = judged_mixed(spark, sf_dir).withColumn(
        "finding_pos", F.floor(F.col("k") / 50) * N_KINDS + F.col("kind")
    )
    documents = judged_reports(judged)
    doc = F.parse_json("json")
    findings = F.variant_get(doc, "$.findings", "array<variant>")
    without = F.filter(findings, lambda f: F.try_variant_get(f, "$.evidence_row_count", "bigint").isNull())
    return documents.select(
        "report_id",
        "part",
        F.size(findings).cast("bigint").alias("n_findings"),
        F.size(without).cast("bigint").alias("n_without_rows"),
        *[F.try_variant_get(doc, f"$.summary.{v}", "bigint").alias(v) for v in VERDICTS],
    )


FAMILY_EVIDENCE = """
SELECT k, kind, CASE kind
    WHEN 0 THEN concat('SELECT count(*) FROM data WHERE o_custkey = ', k)
    WHEN 1 THEN concat('SELECT max(o_totalprice) AS m FROM data WHERE o_custkey = ', k)
    WHEN 2 THEN concat('SELECT min(o_orderkey) FROM data WHERE o_custkey IN (', k, ',', k + 1, ',', k + 2, ')')
    WHEN 3 THEN concat('SELECT avg(CASE WHEN o_orderpriority = ''1-URGENT'' THEN 1.0 ELSE 0 END) FROM data WHERE o_custkey = ', k)
    WHEN 4 THEN concat('SELECT sum(o_orderkey) FROM data WHERE o_custkey IN (', k, ', ', k + 1, ')')
    WHEN 5 THEN concat('SELECT count(o_orderstatus) FROM data WHERE o_orderpriority = ''', p, '''')
    ELSE concat('SELECT avg(o_totalprice) FROM data WHERE o_custkey = ', -1 - k) END AS evidence, p
FROM (SELECT o_custkey AS k, max(o_orderpriority) AS p FROM orders GROUP BY o_custkey) c
CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) u(kind)
"""


@query(
    "recompute_families",
    f"""
WITH per AS (
  SELECT o_custkey AS c, count(*) AS n, max(o_totalprice) AS hi, min(o_orderkey) AS lo, sum(o_orderkey) AS s,
    sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0 END) AS urgent FROM orders GROUP BY 1),
pri AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT e.k, e.kind, CASE e.kind
    WHEN 0 THEN a.n::DOUBLE WHEN 1 THEN a.hi
    WHEN 2 THEN least(a.lo, coalesce(b.lo, a.lo), coalesce(d.lo, a.lo))::DOUBLE
    WHEN 3 THEN round(a.urgent / a.n, 6)::DOUBLE WHEN 4 THEN (a.s + coalesce(b.s, 0))::DOUBLE
    WHEN 5 THEN pri.n::DOUBLE END AS value,
  CASE e.kind WHEN 2 THEN a.n + coalesce(b.n, 0) + coalesce(d.n, 0) WHEN 4 THEN a.n + coalesce(b.n, 0)
    WHEN 5 THEN pri.n WHEN 6 THEN 0 ELSE a.n END::BIGINT AS evidence_row_count
FROM ({FAMILY_EVIDENCE}) e JOIN per a ON a.c = e.k LEFT JOIN per b ON b.c = e.k + 1
LEFT JOIN per d ON d.c = e.k + 2 JOIN pri ON pri.p = e.p
""",
)
def recompute_families(spark, sf_dir):
    session = ClaimSession(spark)
    session.register(table(spark, sf_dir, "orders"))
    texts = session.adopt(derived(spark, sf_dir, FAMILY_EVIDENCE, "orders"))
    value = F.when(F.col("kind") == 3, F.round(parse_number(F.col("raw")), 6)).otherwise(parse_number(F.col("raw")))
    return recomputed_values(session, texts).select("k", "kind", value.alias("value"), "evidence_row_count")


# Shapes no family covers: each distinct text runs once, whatever the number of claims.
TEXT_EVIDENCE = """
SELECT o_orderkey, o_orderkey % 8 AS kind, CASE o_orderkey % 8
    WHEN 0 THEN 'SELECT o_orderpriority FROM data GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1'
    WHEN 1 THEN 'WITH f AS (SELECT * FROM data WHERE o_orderstatus = ''F'') SELECT count(*) FROM f'
    WHEN 2 THEN 'SELECT count(DISTINCT o_custkey) FROM data WHERE o_totalprice > 100000'
    WHEN 3 THEN 'SELECT o_custkey, o_orderkey FROM data'
    WHEN 4 THEN 'SELECT o_orderkey FROM data WHERE o_orderkey < 0'
    WHEN 5 THEN 'SELECT o_orderstatus FROM data'
    WHEN 6 THEN 'SELECT 1 / (count(*) - count(*)) FROM data'
    ELSE 'SELECT max(n) FROM (SELECT count(*) AS n FROM data GROUP BY o_custkey) t' END AS evidence
FROM orders
"""


@query(
    "recompute_sql",
    f"""
WITH facts AS (
  SELECT (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_value,
    (SELECT count(*) FROM orders GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1) AS mode_n,
    (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS finished,
    (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_totalprice > 100000) AS buyers,
    (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS large,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) AS most,
    (SELECT count(DISTINCT o_custkey) FROM orders) AS n_buyers,
    (SELECT count(*) FROM orders) AS total)
SELECT o_orderkey, CASE kind WHEN 0 THEN mode_value WHEN 1 THEN finished::VARCHAR WHEN 2 THEN buyers::VARCHAR
    WHEN 7 THEN most::VARCHAR END AS raw,
  kind IN (3, 4, 5, 6) AS failed,
  CASE kind WHEN 0 THEN mode_n WHEN 1 THEN finished WHEN 2 THEN large WHEN 3 THEN total WHEN 4 THEN 0 WHEN 5 THEN total
    WHEN 6 THEN total WHEN 7 THEN n_buyers END::BIGINT AS evidence_row_count
FROM ({TEXT_EVIDENCE}) CROSS JOIN facts
""",
)
def recompute_sql(spark, sf_dir):
    session = ClaimSession(spark)
    session.register(table(spark, sf_dir, "orders"))
    texts = session.adopt(derived(spark, sf_dir, TEXT_EVIDENCE, "orders"))
    return recomputed_values(session, texts).select(
        "o_orderkey", "raw", F.col("error").isNotNull().alias("failed"), "evidence_row_count"
    )


# One text per key and shape: ranges, conjunctions, BETWEEN, DISTINCT, arithmetic around aggregates, dates, no match.
FILTER_EVIDENCE = """
SELECT k, kind, CASE kind
    WHEN 0 THEN concat('SELECT count(*) FROM data WHERE o_custkey > ', k)
    WHEN 1 THEN concat('SELECT count(DISTINCT o_custkey) FROM data WHERE o_custkey BETWEEN ', k, ' AND ', k + 20)
    WHEN 2 THEN concat('SELECT max(o_orderkey) AS m FROM data WHERE o_custkey < ', k, ' AND o_orderpriority <> ''', p, '''')
    WHEN 3 THEN concat('SELECT round(100.0 * sum(CASE WHEN o_orderstatus = ''F'' THEN 1 ELSE 0 END) / count(*), 3) FROM data WHERE o_custkey <= ', k)
    WHEN 4 THEN concat('SELECT count(*) FROM data WHERE "o_custkey" = ', k, ' AND o_orderdate >= DATE ''199', k % 8, '-03-01'';')
    ELSE concat('SELECT min(o_orderkey) FROM data WHERE o_custkey + 0 = ', -1 - k) END AS evidence
FROM (SELECT o_custkey AS k, max(o_orderpriority) AS p FROM orders GROUP BY o_custkey) c
CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) u(kind)
"""


@query(
    "recompute_filters",
    """
WITH c AS (
  SELECT o_custkey AS k, count(*)::BIGINT AS n, max(o_orderpriority) AS p, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1
), by_p AS (
  SELECT o_custkey AS k, o_orderpriority AS p, count(*) AS n, max(o_orderkey) AS hi FROM orders GROUP BY 1, 2
), upto AS (
  SELECT k, sum(n) OVER (ORDER BY k) AS le, sum(f) OVER (ORDER BY k) AS f_le, sum(n) OVER () AS total,
    count(*) OVER (ORDER BY k RANGE BETWEEN CURRENT ROW AND 20 FOLLOWING) AS buyers,
    sum(n) OVER (ORDER BY k RANGE BETWEEN CURRENT ROW AND 20 FOLLOWING) AS near FROM c
), other AS (
  SELECT c.k, sum(b.n) AS n, max(b.hi) AS hi FROM c JOIN by_p b ON b.k < c.k AND b.p <> c.p GROUP BY c.k
), late AS (
  SELECT o_custkey AS k, count(*) AS n FROM orders
  WHERE CAST(o_orderdate AS DATE) >= CAST(concat('199', o_custkey % 8, '-03-01') AS DATE) GROUP BY 1
)
SELECT c.k, kind, CASE kind WHEN 0 THEN total - le WHEN 1 THEN buyers WHEN 2 THEN o.hi WHEN 3 THEN round(100.0 * f_le / le, 3)
    WHEN 4 THEN coalesce(l.n, 0) END::DOUBLE AS value,
  CASE kind WHEN 0 THEN total - le WHEN 1 THEN near WHEN 2 THEN coalesce(o.n, 0) WHEN 3 THEN le WHEN 4 THEN coalesce(l.n, 0) ELSE 0 END::BIGINT
    AS evidence_row_count
FROM c JOIN upto u ON u.k = c.k LEFT JOIN other o ON o.k = c.k LEFT JOIN late l ON l.k = c.k
CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) v(kind)
""",
)
def recompute_filters(spark, sf_dir):
    """Filters beyond equality: the texts of one template share a scan."""
    session = ClaimSession(spark)
    session.register(table(spark, sf_dir, "orders"))
    texts = session.adopt(derived(spark, sf_dir, FILTER_EVIDENCE, "orders"))
    return recomputed_values(session, texts).select(
        "k", "kind", parse_number(F.col("raw")).alias("value"), "evidence_row_count"
    )


# Distinct values of one customer's rows, of three customers' and of everything.
DISTINCT_EVIDENCE = """
SELECT k, kind, CASE kind
    WHEN 0 THEN concat('SELECT count(DISTINCT o_orderpriority) FROM data WHERE o_custkey = ', k)
    WHEN 1 THEN concat('SELECT count(DISTINCT o_orderpriority) FROM data WHERE o_custkey IN (', k, ', ', k + 1, ', ', k + 2, ')')
    ELSE 'SELECT count(DISTINCT o_custkey) FROM data' END AS evidence
FROM (SELECT DISTINCT o_custkey AS k FROM orders) c CROSS JOIN (VALUES (0), (1), (2)) u(kind)
"""


@query(
    "recompute_distinct",
    """
WITH c AS (SELECT DISTINCT o_custkey AS k FROM orders), near AS (
  SELECT c.k, count(DISTINCT o_orderpriority) AS v, count(*) AS n FROM c JOIN orders o ON o.o_custkey BETWEEN c.k AND c.k + 2 GROUP BY c.k
), own AS (
  SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS v, count(*) AS n FROM orders GROUP BY 1
), whole AS (SELECT count(DISTINCT o_custkey) AS v, count(*) AS n FROM orders)
SELECT own.k, kind, CASE kind WHEN 0 THEN own.v WHEN 1 THEN near.v ELSE whole.v END::VARCHAR AS raw,
  CASE kind WHEN 0 THEN own.n WHEN 1 THEN near.n ELSE whole.n END::BIGINT AS evidence_row_count
FROM own JOIN near USING (k) CROSS JOIN whole CROSS JOIN (VALUES (0), (1), (2)) u(kind)
""",
)
def recompute_distinct(spark, sf_dir):
    """Distinct counts per key and over lists of keys, in the grouped pass of their filter column."""
    session = ClaimSession(spark)
    session.register(table(spark, sf_dir, "orders"))
    texts = session.adopt(derived(spark, sf_dir, DISTINCT_EVIDENCE, "orders"))
    return recomputed_values(session, texts).select("k", "kind", "raw", "evidence_row_count")


# The first group by count or by an extreme, of one customer's rows and of two customers'; an aggregate of it; no rows.
TOP_EVIDENCE = """
SELECT k, kind, CASE kind
    WHEN 0 THEN concat('SELECT o_orderpriority FROM data WHERE o_custkey = ', k, ' GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1')
    WHEN 1 THEN concat('SELECT "o_orderstatus" AS s FROM data WHERE o_custkey IN (', k, ', ', k + 1, ') GROUP BY "o_orderstatus" ORDER BY max(o_orderkey) LIMIT 1;')
    WHEN 2 THEN concat('SELECT min(o_orderkey) FROM data WHERE o_custkey = ', k, ' GROUP BY o_orderpriority ORDER BY count(*), o_orderpriority DESC LIMIT 1')
    ELSE concat('SELECT o_orderpriority FROM data WHERE o_custkey = -', k + 1, ' GROUP BY o_orderpriority ORDER BY count(*) DESC LIMIT 1') END AS evidence
FROM (SELECT DISTINCT o_custkey AS k FROM orders) c CROSS JOIN (VALUES (0), (1), (2), (3)) u(kind)
"""


@query(
    "recompute_tops",
    """
WITH p AS (
  SELECT o_custkey AS k, o_orderpriority AS g, count(*) AS n, min(o_orderkey) AS low FROM orders GROUP BY 1, 2
), most AS (
  SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, g) = 1
), least AS (
  SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY n, g DESC) = 1
), pairs AS (
  SELECT c.k, o_orderstatus AS g, count(*) AS n, max(o_orderkey) AS high
  FROM (SELECT DISTINCT o_custkey AS k FROM orders) c JOIN orders o ON o.o_custkey IN (c.k, c.k + 1) GROUP BY 1, 2
), two AS (
  SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY k ORDER BY high) = 1
)
SELECT m.k, kind, CASE kind WHEN 0 THEN m.g WHEN 1 THEN t.g WHEN 2 THEN l.low::VARCHAR END AS raw, kind = 3 AS failed,
  CASE kind WHEN 0 THEN m.n WHEN 1 THEN t.n WHEN 2 THEN l.n END::BIGINT AS evidence_row_count
FROM most m JOIN least l USING (k) JOIN two t USING (k) CROSS JOIN (VALUES (0), (1), (2), (3)) u(kind)
""",
)
def recompute_tops(spark, sf_dir):
    """Evidence with GROUP BY, ORDER BY and LIMIT 1: one grouped pass a shape, a register of the best group per text."""
    session = ClaimSession(spark)
    session.register(table(spark, sf_dir, "orders"))
    texts = session.adopt(derived(spark, sf_dir, TOP_EVIDENCE, "orders"))
    return recomputed_values(session, texts).select(
        "k", "kind", "raw", F.col("error").isNotNull().alias("failed"), "evidence_row_count"
    )
