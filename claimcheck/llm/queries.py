"""The operators applied to the given tables, each beside the SQL it must agree with, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimcheck.llm import (
    byte_bpe, chat, collocations, html_text, line_dedup, packing, pii, prefix_trie, quality, simhash, token_counts, top_k, warc,
)
from claimcheck.llm.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)
    return digest_pieces(pieces)


def digest_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op2_quality_rules", sql="""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, text, lang, source, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM base
), shapes AS (
  SELECT doc_id, lang, source, text, w, len(w) AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' ')) AS grams
  FROM words
), unnested AS (
  SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM shapes
), often AS (
  SELECT doc_id, i FROM unnested QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM often, range(5) AS r(k) GROUP BY doc_id
), features AS (
  SELECT s.doc_id, lang, source, n_words, word_chars, n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM shapes s LEFT JOIN repeated r ON r.doc_id = s.doc_id
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols * 1000 // greatest(word_chars, 1) AS symbols, n_dup_lines * 1000 // greatest(n_words, 1) AS dup_lines,
    word_chars * 10 // greatest(n_words, 1) AS word_length
  FROM features
), rates AS (
  UNPIVOT (SELECT doc_id, lang, source, symbols, dup_lines, word_length FROM judged WHERE NOT base_failed)
  ON symbols, dup_lines, word_length INTO NAME name VALUE v
), buckets AS (
  SELECT lang, source, name, CASE WHEN v < 16 THEN v ELSE (v >> (length(bin(v)) - 5)::BIGINT) << (length(bin(v)) - 5)::BIGINT END AS low FROM rates
), by_source AS (
  SELECT lang, source, name, count(*) AS n, quantile_disc(low, 0.25) AS q25, quantile_disc(low, 0.5) AS q50 FROM buckets GROUP BY ALL
), by_lang AS (
  SELECT lang, name, count(*) AS n, quantile_disc(low, 0.25) AS q25, quantile_disc(low, 0.5) AS q50 FROM buckets GROUP BY ALL
), overall AS (
  SELECT name, count(*) AS n, quantile_disc(low, 0.25) AS q25, quantile_disc(low, 0.5) AS q50 FROM buckets GROUP BY ALL
), picked AS (
  SELECT s.lang, s.source, s.name,
    (s.n * s.q25 + 10 * ((l.n * l.q25 + 10 * o.q25) // (l.n + 10))) // (s.n + 10) AS q25,
    (s.n * s.q50 + 10 * ((l.n * l.q50 + 10 * o.q50) // (l.n + 10))) // (s.n + 10) AS q50
  FROM by_source s JOIN by_lang l USING (lang, name) JOIN overall o USING (name)
), limits AS (
  SELECT lang, source, name, q50 + 3 * (q50 - q25) + CASE name WHEN 'symbols' THEN 20 WHEN 'dup_lines' THEN 30 ELSE 60 END AS most FROM picked
)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND symbols <= a.most AND dup_lines <= b.most AND word_length <= c.most AS kept
FROM judged j
LEFT JOIN limits a ON a.lang = j.lang AND a.source = j.source AND a.name = 'symbols'
LEFT JOIN limits b ON b.lang = j.lang AND b.source = j.source AND b.name = 'dup_lines'
LEFT JOIN limits c ON c.lang = j.lang AND c.source = j.source AND c.name = 'word_length'
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op3_warc", sql="""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages
), led AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS leader FROM payloads
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(digest, (g * 5 + 1)::BIGINT, 5))::BIGINT) >> (15 - 5 * j)::BIGINT) & 31) + 1, 1)), '')), '')
    AS payload_digest,
  CASE WHEN leader = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN leader <> page_id THEN leader END AS refers_to
FROM led
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.page_records(warc.read_archives(spark, folder)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op4_bpe_codec")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE)
    decoded = byte_bpe.decode(encoded.select("doc_id", "ids"), BYTE_BPE)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


LINE_DEDUP_SQL = """
lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), marked AS (
  SELECT *, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM keyed
)"""


@query("op5_line_dedup", sql=f"""
WITH {LINE_DEDUP_SQL}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cache = table(spark, sf_dir, "documents"), shared_dir(spark, "token-counts")
    # Misses first, so that the counts returned are hits.
    token_counts.fill_cache(docs, PIECE_BPE, cache)
    return token_counts.count_tokens(docs, PIECE_BPE, cache)


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    place = lambda s: F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"])
    keyed = lambda c: F.array_sort(F.transform(c, lambda s: F.struct(s["start"], place(s), s["end"], s["kind"])))
    text = lambda c: F.array_join(F.transform(keyed(c), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(text("base_spans"), 256).alias("base_sha256"),
        text(F.concat("base_spans", "hidden_spans")).alias("spans"),
    )


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links"
    )


@query("op9_top_k", sql="""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long"), top_k.quantised(F.col("embedding")).alias("v")
    )
    return top_k.top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)


@query("op10_chat", sql="""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(16 + length(role) + length(text) + length(regexp_replace(role || text, '[^<>\\\\]', '', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(-7), F.lit(i), F.lit(r), F.lit(said)) for i, r in enumerate(("user", "assistant"))]))
    )
    formatted = chat.format_chats(turns.union(extra))
    back = formatted.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.loss_text(F.col("segments"))})
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op13_prefix_trie", sql="""
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT conv_id, t, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
  FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.t[1:h], []), c.t[h + 1:]) AS t
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, d, t[1:d] AS p, CASE WHEN d > 0 THEN len(regexp_extract_all(t[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS w, len(t) = d AS ends
  FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d AS depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids
  FROM prefixes GROUP BY d, p
), children AS (
  SELECT depth - 1 AS depth, p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.p = n.p
), below AS (
  SELECT k AS depth, p[1:k] AS p, sum((n_convs - 1) * w)::BIGINT AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM counted) GROUP BY ALL
)
SELECT c.conv_id, c.depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, sha256(c.ids) AS ends_sha256
FROM counted c JOIN below b ON b.depth = c.depth AND b.p = c.p LEFT JOIN nodes u ON u.depth = c.depth - 1 AND u.p = c.p[1:c.depth - 1]
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = prefix_trie.read_chats(table(spark, sf_dir, "conversations"))
    keep = F.crc32(F.col("conv_id").cast("string")) % 4
    rebuilt = prefix_trie.graft(chats, F.col("conv_id") - F.col("conv_id") % 20, keep.cast("int"))
    return prefix_trie.prefix_trie(rebuilt).drop("node")


# On the given pages the article is what the article element holds.
@query("op12_html_text", sql="""
WITH articles AS (
  SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '') AS a FROM pages
), blocks AS (
  SELECT page_id, url, list_transform(string_split(regexp_replace(a, '<[^>]*>', chr(1), 'g'), chr(1)), lambda b: trim(regexp_replace(
    replace(replace(replace(replace(replace(b, '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS b
  FROM articles
)
SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text,
  length(array_to_string(list_filter(b, lambda x: x <> ''), chr(10))) AS n_chars
FROM blocks
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op11_collocations", sql="""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT doc_id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT doc_id, lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM words, range(1, 6) AS s(size) WHERE len(w) >= size
), f AS (
  SELECT lang, size, phrase, count(*) AS a, min(doc_id) AS doc_id FROM grams GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT f.*, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size > 1
), scored AS (
  SELECT c.lang, c.phrase, c.size, c.w, c.a, c.doc_id, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ') JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT s.* FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM f WHERE f.lang = s.lang AND f.size > s.size AND 100 * f.a >= 100 * s.a AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, k AS cut, doc_id
FROM kept QUALIFY rank <= 2000
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
