"""Registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontam, exactdedup, langid, licenses, lm, merkle, packing, quality, search, simhash, tokens, toolcalls, warc
from .common import id_remainder, table


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, n = quality.judge_counts(docs)
    return out.select(
        "doc_id",
        *[F.col(n[c]).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col(n["base_failed"]).alias("base_failed"),
        F.col(n["kept"]).alias("kept"),
        F.col(n["clean_probability"]).alias("clean_probability"),
    )


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_texts(docs, id_remainder("doc_id", 7) == 2)


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    calls, results = toolcalls.calls_of_turns(turns)
    out = toolcalls.link_calls(calls, results, toolcalls.TURN_SCHEMAS, toolcalls.other_turns(turns))
    return out.withColumnRenamed("grp", "conv_id")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > tokens.LIMIT).alias("over_limit")
    )


def op5_warc(spark, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 3) == 1
    model = langid.fit_languages(docs, ~held_out)
    out, lang, score = langid.identify(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", held_out.alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score")
    )


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_license_scans(spark, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exactdedup.memberships(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(spark, sf_dir)


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_lm_scoring,
        op3_chat_formatting,
        op4_token_counts,
        op5_warc,
        op6_best_fit_packing,
        op7_language_id,
        op8_benchmark_decontamination,
        op9_simhash_near_dedup,
        op10_license_scans,
        op11_exact_dedup,
        op12_merkle_manifest,
        op13_lexical_search,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"

# The other queries have no SQL: fitted models (1, 2, 7), tokeniser merges
# (4, 6), BM25 with word shingles (8), XXH64 fingerprints (9) and compressed
# sizes (10); tests hold them against brute force.
SQL: dict[str, str] = {
    "op3_chat_formatting": rf"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
c AS (
  SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name,
         len(regexp_extract_all(text, '{_WORD}')) AS words
  FROM t WHERE role IN ('user', 'system')
),
a AS (SELECT conv_id, turn, text FROM t WHERE role = 'assistant'),
j AS (
  SELECT c.*, a.text AS content, CASE WHEN a.conv_id IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
    list_sort(list_filter([
      CASE WHEN name = 'reply' AND c.turn >= 2 THEN c.conv_id || ':' || (c.turn - 2) END,
      CASE WHEN name = 'reply' AND c.turn >= 1 THEN c.conv_id || ':' || (c.turn - 1) END], lambda x: x IS NOT NULL)) AS deps,
    list_filter([
      CASE WHEN name = 'reply' AND length(c.text) < 1 THEN 'question: too short' END,
      CASE WHEN name = 'reply' AND length(c.text) > 300 THEN 'question: too long' END,
      CASE WHEN name = 'reply' AND words < 1 THEN 'words: too small' END,
      CASE WHEN name = 'reply' AND words > 60 THEN 'words: too large' END,
      CASE WHEN name = 'configure' AND length(c.text) < 1 THEN 'text: too short' END,
      CASE WHEN name = 'configure' AND length(c.text) > 250 THEN 'text: too long' END], lambda x: x IS NOT NULL) AS errs
  FROM c LEFT JOIN a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1
)
SELECT conv_id, conv_id || ':' || turn AS call_id, name, turn AS position, turn AS order_major, 0 AS order_minor, status,
  len(errs) AS n_errors, array_to_string(errs, '; ') AS errors,
  '{{"arguments":' || CASE name WHEN 'reply' THEN '{{"question":' || CAST(to_json(text) AS VARCHAR) || ',"words":' || words || '}}'
      ELSE '{{"text":' || CAST(to_json(text) AS VARCHAR) || '}}' END
    || ',"content":' || CASE WHEN content IS NULL THEN 'null' ELSE CAST(to_json(content) AS VARCHAR) END
    || ',"depends_on":' || CAST(to_json(deps) AS VARCHAR) || ',"errors":' || CAST(to_json(errs) AS VARCHAR)
    || ',"id":"' || conv_id || ':' || turn || '","name":"' || name || '","role":"call","status":"' || status || '"}}' AS json
FROM j
UNION ALL
SELECT a.conv_id, a.conv_id || ':' || (a.turn - 1), NULL, a.turn, a.turn, 0, 'orphan_result', 0, '',
  '{{"content":' || CAST(to_json(a.text) AS VARCHAR) || ',"id":"' || a.conv_id || ':' || (a.turn - 1)
    || '","role":"tool","status":"orphan_result"}}'
FROM a ANTI JOIN c ON a.conv_id = c.conv_id AND a.turn = c.turn + 1
UNION ALL
SELECT conv_id, conv_id || ':' || turn, role, turn, turn, 0, 'other_turn', 0, '',
  '{{"content":' || CAST(to_json(text) AS VARCHAR) || ',"id":"' || conv_id || ':' || turn
    || '","role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"status":"other_turn"}}'
FROM t WHERE role IS NULL OR role NOT IN ('user', 'system', 'assistant')""",
    "op5_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
),
m AS (SELECT digest, max(page_id) AS first_id FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN m ON p.digest = m.digest AND p.n >= 1000""",
    "op11_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op12_merkle_manifest": """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') AS f_id,
    coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS f_kind,
    coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS f_chars,
    coalesce(octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1), '-') AS f_more,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS f_text,
    list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
      lambda crc, c: list_reduce([xor(crc, c)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents
),
leaf AS (
  SELECT doc_id, lang, sha256(f_id || f_kind || f_chars || f_text) AS node,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(f_id || f_kind || f_more || f_text) END AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM d
),
tree AS (
  SELECT lang, 0 AS level, pos, n, node FROM leaf
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n
),
top AS (
  SELECT lang, node, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
),
crown AS (
  SELECT 0 AS level, pos, n, node FROM top
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, pos // 2, n
),
climb AS (
  SELECT doc_id, lang, 0 AS level, pos, n, coalesce(changed, node) AS node, '' AS proof FROM leaf
  UNION ALL
  SELECT c.doc_id, c.lang, c.level + 1, c.pos // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.pos % 2 = 1 THEN coalesce(s.node, '') || c.node ELSE c.node || coalesce(s.node, '') END), c.proof || coalesce(s.node, '')
  FROM climb c LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.pos = xor(c.pos, 1)
  WHERE c.n > 1
),
rise AS (
  SELECT c.doc_id, c.lang, 0 AS level, t.pos, t.n, c.node, c.proof FROM climb c JOIN top t ON t.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.lang, c.level + 1, c.pos // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.pos % 2 = 1 THEN coalesce(s.node, '') || c.node ELSE c.node || coalesce(s.node, '') END), c.proof || coalesce(s.node, '')
  FROM rise c LEFT JOIN crown s ON s.level = c.level AND s.pos = xor(c.pos, 1)
  WHERE c.n > 1
)
SELECT l.doc_id, l.node AS leaf, t.node AS subroot, r.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified
FROM leaf l JOIN rise f ON f.doc_id = l.doc_id AND f.n = 1 JOIN top t ON t.lang IS NOT DISTINCT FROM l.lang
CROSS JOIN (SELECT node FROM crown WHERE n = 1) r""",
    "op13_lexical_search": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS terms FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
postings AS (SELECT doc_id, len(terms)::BIGINT AS n, u.term, count(*) AS tf FROM d, unnest(terms) AS u(term) GROUP BY ALL),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, stats GROUP BY term, n_docs
),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN postings USING (term), stats GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
}
