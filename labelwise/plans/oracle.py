"""Independent SQL (DuckDB dialect) for each registered query.

Written from the operator semantics, not generated from the Spark plans:
dedup here groups on the text itself (Spark groups on its digest), the
split uses DuckDB's own md5 and hex cast, tokens come from
``regexp_split_to_array``.
"""

from __future__ import annotations

from ..functions.text import NON_LETTER, WHITESPACE, WHITESPACE_CLASS
from ..operators.chat import CHATML
from ..spec import CHINESE_REVIEWS
from . import bindings as B

S = B.SPEC


def lit(s: str) -> str:
    """SQL string literal; control characters via chr()."""
    parts, buf = [], ""
    for ch in s:
        if ch == "'" :
            buf += "''"
        elif ord(ch) < 32 or ch in WHITESPACE and ch != " ":
            if buf:
                parts.append(f"'{buf}'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append(f"'{buf}'")
    return "(" + " || ".join(parts) + ")"


WS = lit(WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def bucket(key: str, seed: int, n: int) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) % {n})"


def number(key: str, seed: int = S.seed) -> str:
    return f"CAST(('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT)"


def below(share: float) -> str:
    return f"{share!r} * 4294967296.0"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{NON_LETTER}'), lambda t: t <> '')"


def space_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WHITESPACE_CLASS}]+'), lambda t: t <> '')"


POS, NEG = lit(S.positive), lit(S.negative)

BASE_CTES = f"""
lab AS (
  SELECT d.doc_id, d.text, d.n_chars, l.toxic AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
sp AS (
  SELECT *, CASE WHEN b < {below(0.8)} THEN 'train' WHEN b < {below(0.9)} THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT *, {number('doc_id')} AS b FROM lab)
),
st AS (
  SELECT split, doc_id, {strip('text')} AS input,
         CASE label WHEN 0 THEN {POS} WHEN 1 THEN {NEG} END AS output, n_chars
  FROM sp WHERE length({strip('text')}) > 0
),
rec AS (
  SELECT split, doc_id, {lit(S.instruction)} AS instruction, input, output, n_chars
  FROM st
  WHERE doc_id IN (SELECT min(doc_id) FROM st GROUP BY split, output, input)
)"""

FIT_CTES = f"""
tk AS (
  SELECT doc_id, split, output, token
  FROM (SELECT DISTINCT doc_id, split, output, unnest(list_distinct({tokens('input')})) AS token FROM rec)
),
cls AS (
  SELECT count(*) FILTER (WHERE output = {POS}) AS np, count(*) FILTER (WHERE output = {NEG}) AS nn
  FROM rec WHERE split = 'train'
),
cnt AS (
  SELECT token, count(*) FILTER (WHERE output = {POS}) AS dp, count(*) FILTER (WHERE output = {NEG}) AS dn
  FROM tk WHERE split = 'train' GROUP BY token
),
w AS (
  SELECT token, dp, dn, weight FROM (
    SELECT token, dp, dn,
      CAST(round(CAST({B.SCALE} AS DOUBLE) * ln(((dp + 1) / CAST(np + 2 AS DOUBLE)) / ((dn + 1) / CAST(nn + 2 AS DOUBLE)))) AS BIGINT) AS weight
    FROM cnt, cls WHERE dp + dn >= {B.MIN_DF}
  ) WHERE abs(weight) >= {int(round(B.MIN_WEIGHT * B.SCALE))}
),
prior AS (
  SELECT CAST(round(CAST({B.SCALE} AS DOUBLE) * ln(CAST(np AS DOUBLE) / CAST(nn AS DOUBLE))) AS BIGINT) AS prior FROM cls
)"""

BASE_WORDS = "[" + ", ".join(lit(w) for w in B.BASE_WORDS) + "]"

PRED_CTES = f"""
test AS (SELECT * FROM rec WHERE split = 'test'),
tsum AS (
  SELECT t.doc_id, sum(w.weight) AS s FROM tk t JOIN w ON t.token = w.token
  WHERE t.split = 'test' GROUP BY t.doc_id
),
raw AS (
  SELECT 'base' AS mode, doc_id, input, output, n_chars,
         CASE WHEN list_has_any({tokens('input')}, {BASE_WORDS}) THEN {NEG} ELSE {POS} END AS raw_output
  FROM test
  UNION ALL
  SELECT 'tuned', t.doc_id, t.input, t.output, t.n_chars,
         CASE WHEN (SELECT prior FROM prior) + coalesce(s.s, 0) >= 0 THEN {POS} ELSE {NEG} END
  FROM test t LEFT JOIN tsum s ON t.doc_id = s.doc_id
),
pr AS (
  SELECT mode, doc_id AS "index", input, output AS expected, raw_output,
         CASE WHEN starts_with(raw_output, {POS}) THEN {POS}
              WHEN starts_with(raw_output, {NEG}) THEN {NEG} END AS predicted,
         n_chars / 10000.0 AS latency_sec
  FROM raw
),
preds AS (
  SELECT *, coalesce(predicted = expected, false) AS correct,
         coalesce(predicted IN ({POS}, {NEG}), false) AS valid_format
  FROM pr
),
cnts AS (
  SELECT mode, count(*) AS total,
    count(*) FILTER (WHERE correct) AS n_correct,
    count(*) FILTER (WHERE valid_format) AS n_valid,
    sum(latency_sec) AS latency_sum,
    count(*) FILTER (WHERE expected = {POS} AND predicted = {POS}) AS pos_as_pos,
    count(*) FILTER (WHERE expected = {POS} AND predicted = {NEG}) AS pos_as_neg,
    count(*) FILTER (WHERE expected = {POS} AND predicted IS NULL) AS pos_invalid,
    count(*) FILTER (WHERE expected = {NEG} AND predicted = {NEG}) AS neg_as_neg,
    count(*) FILTER (WHERE expected = {NEG} AND predicted = {POS}) AS neg_as_pos,
    count(*) FILTER (WHERE expected = {NEG} AND predicted IS NULL) AS neg_invalid
  FROM preds GROUP BY mode
),
lab_scores AS (
  SELECT *,
    coalesce(pos_as_pos / nullif(CAST(pos_as_pos + neg_as_pos AS DOUBLE), 0), 0.0) AS pos_p,
    coalesce(pos_as_pos / nullif(CAST(pos_as_pos + pos_as_neg + pos_invalid AS DOUBLE), 0), 0.0) AS pos_r,
    coalesce(neg_as_neg / nullif(CAST(neg_as_neg + pos_as_neg AS DOUBLE), 0), 0.0) AS neg_p,
    coalesce(neg_as_neg / nullif(CAST(neg_as_neg + neg_as_pos + neg_invalid AS DOUBLE), 0), 0.0) AS neg_r
  FROM cnts
),
f1s AS (
  SELECT *,
    coalesce(2 * pos_p * pos_r / nullif(pos_p + pos_r, 0), 0.0) AS pos_f1,
    coalesce(2 * neg_p * neg_r / nullif(neg_p + neg_r, 0), 0.0) AS neg_f1
  FROM lab_scores
),
met AS (
  SELECT mode, total,
    coalesce(n_correct / nullif(CAST(total AS DOUBLE), 0), 0.0) AS accuracy,
    (pos_f1 + neg_f1) / 2.0 AS macro_f1,
    coalesce(n_valid / nullif(CAST(total AS DOUBLE), 0), 0.0) AS format_valid_rate,
    coalesce(latency_sum / nullif(CAST(total AS DOUBLE), 0), 0.0) AS avg_latency_sec
  FROM f1s
),
fails AS (
  SELECT *, row_number() OVER (PARTITION BY mode ORDER BY "index") AS rank FROM preds WHERE NOT correct
),
errs AS (
  SELECT mode, rank, "index", expected, predicted,
         substr(replace(raw_output, chr(10), ' '), 1, {S.snippet_chars}) AS raw_snippet,
         substr(replace(input, chr(10), ' '), 1, {S.snippet_chars}) AS snippet
  FROM fails WHERE rank <= {S.failures_per_mode}
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


EVAL = with_(BASE_CTES, FIT_CTES, PRED_CTES)


def _prompt_sql(instr: str, text: str) -> str:
    t = CHATML
    sys_msg = lit(f"{t.open}system{t.role_sep}{S.system_prompt}{t.close}")
    user_open = lit(f"{t.open}user{t.role_sep}")
    tail = lit(f"{t.close}{t.generation_prompt}")
    return f"({sys_msg} || {user_open} || {instr} || {lit(S.user_separator)} || {text} || {tail})"


PROMPT = _prompt_sql("instruction", "input")
TARGET = f"({strip('output')} || {lit(CHATML.eos)})"

ENCODE = with_(
    BASE_CTES,
    f"""
pt AS (SELECT doc_id, {space_tokens(PROMPT)} AS p, {space_tokens(PROMPT + ' || ' + TARGET)} AS f0 FROM rec),
sz AS (SELECT doc_id, p, f0[1:{S.max_length}] AS f FROM pt),
enc AS (
  SELECT doc_id, len(p) AS n_prompt, len(f) AS n_full, len(f) - least(len(p), len(f)) AS n_supervised,
         array_to_string(f[len(p) + 1:], ' ') AS label_str, least(len(p), len(f)) AS n_masked
  FROM sz WHERE len(f) > len(p)
)""",
)

CS = CHINESE_REVIEWS


def _cn(x):
    return lit(x)


SQL: dict[str, str] = {
    "prepare_records": with_(BASE_CTES) + " SELECT split, doc_id, instruction, input, output FROM rec",
    "split_records": with_(BASE_CTES) + " SELECT doc_id, split FROM sp",
    "split_stats": with_(BASE_CTES)
    + """ SELECT s.split, CAST(coalesce(c.records, 0) AS BIGINT) AS records,
        CAST(coalesce(c.positive, 0) AS BIGINT) AS positive, CAST(coalesce(c.negative, 0) AS BIGINT) AS negative
      FROM (VALUES ('train'), ('valid'), ('test')) s(split)
      LEFT JOIN (SELECT split, count(*) AS records,
                   count(*) FILTER (WHERE output = """
    + POS
    + """) AS positive,
                   count(*) FILTER (WHERE output = """
    + NEG
    + """) AS negative FROM rec GROUP BY split) c ON s.split = c.split""",
    "normalize_labels": f"""
      WITH r AS (
        SELECT doc_id, CASE doc_id % 5
          WHEN 0 THEN CASE WHEN toxic = 0 THEN ' Positive ' ELSE ' Negative ' END
          WHEN 1 THEN CASE WHEN toxic = 0 THEN 'POS' ELSE 'NEG' END
          WHEN 2 THEN CASE WHEN toxic = 0 THEN '1' ELSE '0' END
          WHEN 3 THEN CASE WHEN toxic = 0 THEN {lit(chr(9) + 'positive' + chr(0xA0))} ELSE {lit(chr(0x3000) + 'negative' + chr(10))} END
          ELSE CASE WHEN toxic = 0 THEN 'Good' ELSE 'bad' END END AS raw_label
        FROM labels)
      SELECT doc_id, raw_label,
        CASE WHEN lower({strip('raw_label')}) IN ({", ".join(lit(a) for a in S.positive_aliases)}) THEN {POS}
             WHEN lower({strip('raw_label')}) IN ({", ".join(lit(a) for a in S.negative_aliases)}) THEN {NEG} END AS output
      FROM r""",
    "cap_records": with_(
        BASE_CTES,
        f"""
      ranked AS (SELECT split, doc_id, output,
                   row_number() OVER (PARTITION BY split ORDER BY md5('{S.seed}|' || CAST(doc_id AS VARCHAR)), doc_id) AS rn
                 FROM rec)""",
    )
    + """ SELECT split, doc_id, output FROM ranked
      WHERE rn <= CASE split WHEN 'train' THEN 200 WHEN 'valid' THEN 20 WHEN 'test' THEN 20 END""",
    "head_records": with_(
        BASE_CTES,
        """
      ranked AS (SELECT split, doc_id, output, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS rn FROM rec)""",
    )
    + """ SELECT split, doc_id, output FROM ranked
      WHERE split = 'test' OR rn <= 64""",
    "chat_messages": with_(BASE_CTES)
    + f""" SELECT doc_id, CAST(0 AS BIGINT) AS pos, 'system' AS role, {lit(S.system_prompt)} AS content FROM rec
      UNION ALL
      SELECT doc_id, CAST(1 AS BIGINT), 'user', instruction || {lit(S.user_separator)} || input FROM rec""",
    "render_prompt": with_(BASE_CTES) + f" SELECT doc_id, {PROMPT} AS prompt, {TARGET} AS target FROM rec",
    "conversation_sizes": f"""
      WITH seg AS (
        SELECT conv_id, length({lit(CHATML.open)} || role || {lit(CHATML.role_sep)} || text || {lit(CHATML.close)}) AS n FROM conversations
        UNION ALL
        SELECT DISTINCT conv_id, length({lit(CHATML.generation_prompt)}) FROM conversations
      )
      SELECT c.conv_id, CAST(c.n_turns AS BIGINT) AS n_turns, CAST(c.n_user AS BIGINT) AS n_user,
             CAST(c.n_assistant AS BIGINT) AS n_assistant, CAST(s.prompt_chars AS BIGINT) AS prompt_chars
      FROM (SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'user') AS n_user,
                   count(*) FILTER (WHERE role = 'assistant') AS n_assistant FROM conversations GROUP BY conv_id) c
      JOIN (SELECT conv_id, sum(n) AS prompt_chars FROM seg GROUP BY conv_id) s ON c.conv_id = s.conv_id""",
    "conversation_segments": f"""
      SELECT conv_id, CAST(turn AS BIGINT) AS turn,
             {lit(CHATML.open)} || role || {lit(CHATML.role_sep)} || text || {lit(CHATML.close)} AS segment
      FROM conversations
      UNION ALL
      SELECT conv_id, CAST(max(turn) + 1 AS BIGINT), {lit(CHATML.generation_prompt)} FROM conversations GROUP BY conv_id""",
    "encode_examples": ENCODE
    + " SELECT doc_id, CAST(n_prompt AS BIGINT) AS n_prompt, CAST(n_full AS BIGINT) AS n_full,"
    " CAST(n_supervised AS BIGINT) AS n_supervised, label_str, CAST(n_masked AS BIGINT) AS n_masked FROM enc",
    "pad_batches": ENCODE
    + f""",
      b AS (SELECT doc_id, n_full, {bucket('doc_id', S.seed, 8)} AS shard FROM enc),
      r AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1) // 8 AS batch_id FROM b),
      m AS (SELECT *, max(n_full) OVER (PARTITION BY shard, batch_id) AS max_len FROM r)
      SELECT CAST(shard AS BIGINT) AS shard, CAST(batch_id AS BIGINT) AS batch_id, doc_id, CAST(max_len AS BIGINT) AS max_len,
             CAST(max_len - n_full AS BIGINT) AS n_pad, CAST(max_len AS BIGINT) AS padded_len,
             CAST(max_len - n_full AS BIGINT) AS mask_zeros
      FROM m""",
    "extract_labels": f"""
      WITH r AS (
        SELECT doc_id,
          CASE WHEN toxic = 0 THEN {_cn(CS.positive)} ELSE {_cn(CS.negative)} END AS word,
          CASE WHEN toxic = 0 THEN {_cn(CS.negative)} ELSE {_cn(CS.positive)} END AS other,
          CASE WHEN toxic = 0 THEN {_cn(CS.positive_signals[1])} ELSE {_cn(CS.negative_signals[1])} END AS syn,
          doc_id % 6 AS k
        FROM labels),
      o AS (
        SELECT doc_id, CASE k
          WHEN 0 THEN ' ' || word || chr(10)
          WHEN 1 THEN other || {_cn("，但有")} || word
          WHEN 2 THEN {_cn("答案：")} || word
          WHEN 3 THEN syn
          WHEN 4 THEN {_cn("不是")} || word || {_cn("，是")} || other
          ELSE {_cn("不知道")} END AS raw_output
        FROM r),
      c AS (SELECT doc_id, raw_output, replace({strip('raw_output')}, {_cn("：")}, ':') AS x FROM o),
      h AS (SELECT *,
          ({" OR ".join(f"contains(x, {_cn(w)})" for w in CS.positive_signals)}) AS hp,
          ({" OR ".join(f"contains(x, {_cn(w)})" for w in CS.negative_signals)}) AS hn FROM c)
      SELECT doc_id, raw_output,
        CASE WHEN starts_with(x, {_cn(CS.positive)}) THEN {_cn(CS.positive)}
             WHEN starts_with(x, {_cn(CS.negative)}) THEN {_cn(CS.negative)}
             WHEN hp AND NOT hn THEN {_cn(CS.positive)}
             WHEN hn AND NOT hp THEN {_cn(CS.negative)} END AS predicted
      FROM h""",
    "fit_token_weights": with_(BASE_CTES, FIT_CTES) + " SELECT token, dp, dn, weight FROM w",
    "token_document_counts": with_(BASE_CTES, FIT_CTES) + " SELECT token, CAST(dp AS BIGINT) AS dp, CAST(dn AS BIGINT) AS dn FROM cnt",
    "score_base": EVAL + """ SELECT "index", expected, raw_output, predicted, correct, valid_format FROM preds WHERE mode = 'base'""",
    "score_tuned": EVAL + """ SELECT "index", expected, raw_output, predicted, correct, valid_format FROM preds WHERE mode = 'tuned'""",
    "score_base_all": with_(BASE_CTES)
    + f""" SELECT doc_id AS "index", output AS expected,
         CASE WHEN list_has_any({tokens('input')}, {BASE_WORDS}) THEN {NEG} ELSE {POS} END AS predicted,
         (CASE WHEN list_has_any({tokens('input')}, {BASE_WORDS}) THEN {NEG} ELSE {POS} END) = output AS correct
       FROM rec""",
    "eval_metrics": EVAL
    + """ SELECT mode, total, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
        round(format_valid_rate, 6) AS format_valid_rate, round(avg_latency_sec, 6) AS avg_latency_sec FROM met""",
    "per_label_metrics": EVAL
    + f""" SELECT mode, {POS} AS label, round(pos_p, 6) AS precision, round(pos_r, 6) AS recall, round(pos_f1, 6) AS f1 FROM f1s
       UNION ALL
       SELECT mode, {NEG}, round(neg_p, 6), round(neg_r, 6), round(neg_f1, 6) FROM f1s""",
    "confusion": EVAL
    + " SELECT mode, pos_as_pos, pos_as_neg, pos_invalid, neg_as_neg, neg_as_pos, neg_invalid FROM cnts",
    "mode_deltas": EVAL
    + """ SELECT round((t.accuracy - b.accuracy) * 100.0, 4) AS accuracy_pp, round((t.macro_f1 - b.macro_f1) * 100.0, 4) AS macro_f1_pp
       FROM met b JOIN met t ON b.mode = 'base' AND t.mode = 'tuned'""",
    "side_by_side": EVAL
    + """ SELECT b."index", b.expected, b.predicted AS base, t.predicted AS tuned,
         CASE WHEN b.correct AND t.correct THEN 'both' WHEN NOT b.correct AND t.correct THEN 'fixed'
              WHEN b.correct AND NOT t.correct THEN 'broken' ELSE 'neither' END AS outcome
       FROM preds b JOIN preds t ON b."index" = t."index" AND b.mode = 'base' AND t.mode = 'tuned'""",
    "error_cases": EVAL + """ SELECT mode, CAST(rank AS BIGINT) AS rank, "index", expected, predicted, raw_snippet, snippet FROM errs""",
    "display_predictions": EVAL
    + f""" SELECT mode, "index", coalesce(nullif(predicted, ''), {lit(S.undetermined_text)}) AS label_text,
         coalesce(nullif(raw_output, ''), {lit(S.no_output_text)}) AS raw_text,
         printf('%.2f', latency_sec) || 's' AS latency_text FROM preds""",
}

SQL["jsonl_roundtrip"] = SQL["prepare_records"]
SQL["stream_prepare"] = SQL["prepare_records"]
SQL["stream_prepare_within"] = with_(BASE_CTES) + " SELECT split, input, output FROM rec"
SQL["predictions_jsonl"] = EVAL + """ SELECT mode, "index", expected, raw_output, predicted, round(latency_sec, 6) AS latency_sec FROM preds"""

_SRC_NAMES = "SELECT DISTINCT 'reviews_' || source AS name FROM documents"
SQL["registry_upsert"] = with_(
    BASE_CTES,
    f"""
old AS (SELECT name, 'reviews/' || substr(name, 9) || '/train.jsonl' AS file_name FROM ({_SRC_NAMES})),
new AS (SELECT DISTINCT 'reviews_' || d.source AS name FROM sp JOIN documents d ON sp.doc_id = d.doc_id WHERE sp.split = 'test'),
newe AS (SELECT name, 'reviews/' || substr(name, 9) || '/test.jsonl' AS file_name FROM new),
up AS (SELECT * FROM old WHERE name NOT IN (SELECT name FROM newe) UNION ALL SELECT * FROM newe)""",
) + " SELECT name, file_name, 'instruction' AS prompt, 'input' AS query, 'output' AS response FROM up"

SQL["mapped_columns"] = with_(BASE_CTES) + " SELECT instruction AS prompt, input AS query, output AS response FROM rec"


def _req_mode(k: str) -> str:
    return f"CASE {k} WHEN 1 THEN 'base' WHEN 2 THEN 'tuned' WHEN 3 THEN 'draft' END"


def _validated(src: str) -> str:
    return f"""
v AS (
  SELECT *, nullif(concat_ws('; ',
      CASE WHEN text IS NULL THEN 'text missing' END,
      CASE WHEN length(text) < 1 THEN 'text shorter than 1' END,
      CASE WHEN length(text) > 2000 THEN 'text longer than 2000' END,
      CASE WHEN mode NOT IN ('base', 'tuned') THEN 'unknown mode ' || mode END), '') AS reason
  FROM (SELECT request_id, text, coalesce(mode0, 'tuned') AS mode FROM ({src}))
)"""


SQL["validate_requests"] = (
    with_(
        _validated(
            f"SELECT conv_id || ':' || turn AS request_id, text, {_req_mode('(conv_id + turn) % 4')} AS mode0 FROM conversations"
        )
    )
    + " SELECT request_id, mode, reason IS NULL AS accepted, reason FROM v"
)

_DOC_REQ = f"SELECT doc_id AS request_id, text, {_req_mode('doc_id % 4')} AS mode0 FROM documents"
SERVE = with_(
    BASE_CTES,
    FIT_CTES,
    _validated(_DOC_REQ),
    f"""
ok AS (SELECT request_id, mode, {strip('text')} AS text FROM v WHERE reason IS NULL),
rt AS (SELECT DISTINCT request_id, unnest(list_distinct({tokens('text')})) AS token FROM ok WHERE mode = 'tuned'),
rs AS (SELECT rt.request_id, sum(w.weight) AS s FROM rt JOIN w ON rt.token = w.token GROUP BY rt.request_id),
resp AS (
  SELECT request_id, mode,
         CASE WHEN list_has_any({tokens('text')}, {BASE_WORDS}) THEN {NEG} ELSE {POS} END AS raw_output
  FROM ok WHERE mode = 'base'
  UNION ALL
  SELECT ok.request_id, ok.mode,
         CASE WHEN (SELECT prior FROM prior) + coalesce(rs.s, 0) >= 0 THEN {POS} ELSE {NEG} END
  FROM ok LEFT JOIN rs ON ok.request_id = rs.request_id WHERE ok.mode = 'tuned'
)""",
)
SQL["stream_scoring"] = SERVE + " SELECT request_id, mode, raw_output AS label, raw_output FROM resp"
SQL["stream_rejects"] = SERVE + " SELECT request_id, mode, reason FROM v WHERE reason IS NOT NULL"
SQL["stream_metrics"] = (
    EVAL
    + " SELECT mode, total, n_correct, n_valid, pos_as_pos, pos_as_neg, pos_invalid, neg_as_neg, neg_as_pos, neg_invalid FROM cnts"
)

_MODE_ORD = "(SELECT * FROM (VALUES ('base', 0), ('tuned', 1)) t(mode, mode_ord))"
_FIXED_LINES = [
    (0, -1, 0, "# Evaluation report"),
    (0, -1, 1, ""),
    (0, -1, 2, f"Task: binary text classification; a valid answer is `{S.positive}` or `{S.negative}`."),
    (0, -1, 3, ""),
    (0, -1, 4, "| mode | Accuracy | Macro F1 | Format Valid | Avg Latency |"),
    (0, -1, 5, "| --- | ---: | ---: | ---: | ---: |"),
    (2, -1, 0, ""),
    (2, -1, 1, "## Confusion counts"),
    (2, -1, 2, ""),
    (4, -1, 0, "## Example errors"),
    (4, -1, 1, ""),
]
_CELLS = ("pos_as_pos", "pos_as_neg", "pos_invalid", "neg_as_neg", "neg_as_pos", "neg_invalid")
SQL["report_lines"] = EVAL + ", mo AS " + _MODE_ORD + " SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT {a} AS section, {b} AS mode_ord, {c} AS line_no, {lit(d)} AS line" for a, b, c, d in _FIXED_LINES]
    + [
        "SELECT 1, mo.mode_ord, 0, '| ' || m.mode || ' | ' || printf('%.2f%%', m.accuracy * 100) || ' | ' || "
        "printf('%.2f%%', m.macro_f1 * 100) || ' | ' || printf('%.2f%%', m.format_valid_rate * 100) || ' | ' || "
        "printf('%.2f', m.avg_latency_sec) || 's |' FROM met m JOIN mo ON m.mode = mo.mode",
        "SELECT 3, mo.mode_ord, 0, '### ' || c.mode FROM cnts c JOIN mo ON c.mode = mo.mode",
    ]
    + [
        f"SELECT 3, mo.mode_ord, {i + 1}, '- `{name}`: ' || CAST(c.{name} AS VARCHAR) FROM cnts c JOIN mo ON c.mode = mo.mode"
        for i, name in enumerate(_CELLS)
    ]
    + [
        f"SELECT 3, mo.mode_ord, {len(_CELLS) + 1}, '' FROM cnts c JOIN mo ON c.mode = mo.mode",
        "SELECT 5, mode_ord, 0, '### ' || mode FROM mo",
        "SELECT 5, mo.mode_ord, e.rank, '- expected `' || e.expected || '`, predicted `' || coalesce(e.predicted, 'None') || "
        "'`, output: ' || e.raw_snippet || '; text: ' || e.snippet FROM errs e JOIN mo ON e.mode = mo.mode",
        "SELECT 5, mode_ord, 1, '- no errors.' FROM mo WHERE mode NOT IN (SELECT mode FROM errs)",
        f"SELECT 5, mode_ord, {S.failures_per_mode + 1}, '' FROM mo",
    ]
) + ")"

SQL["exact_split_records"] = """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('""" + str(S.seed) + """|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rk,
                  count(*) OVER () AS n FROM labels),
s AS (SELECT *, CAST(ceil(0.2 * n) AS BIGINT) AS hold FROM r),
t AS (SELECT *, n - hold AS n_train, hold - CAST(ceil(0.5 * hold) AS BIGINT) AS n_valid FROM s)
SELECT doc_id, CASE WHEN rk < n_train THEN 'train' WHEN rk < n_train + n_valid THEN 'valid' ELSE 'test' END AS split FROM t"""

_CN_POS = ", ".join(lit(a) for a in CS.positive_aliases)
_CN_NEG = ", ".join(lit(a) for a in CS.negative_aliases)
SQL["quarantined_labels"] = f"""
WITH r AS (
  SELECT d.doc_id, d.text, CASE l.doc_id % 4
      WHEN 0 THEN CASE WHEN l.toxic = 0 THEN '1' ELSE '0' END
      WHEN 1 THEN CASE WHEN l.toxic = 0 THEN ' POS ' ELSE 'neg' END
      WHEN 2 THEN CASE WHEN l.toxic = 0 THEN 'good' ELSE 'bad' END
      ELSE CASE WHEN l.toxic = 0 THEN {lit(CS.positive_aliases[4])} ELSE {lit(CS.negative_aliases[4])} END END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, label AS raw_label FROM r
WHERE length({strip('text')}) > 0
  AND lower({strip('label')}) NOT IN ({_CN_POS}) AND lower({strip('label')}) NOT IN ({_CN_NEG})"""

SQL["first_available_source"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
SQL["metrics_lookup"] = SQL["eval_metrics"]
SQL["report_file"] = "SELECT line FROM (" + SQL["report_lines"] + ")"
SQL["publish_dataset"] = SQL["prepare_records"]

_SMOKE = (
    FIT_CTES.replace("FROM rec WHERE split = 'train'", "FROM rec WHERE split = 'train' AND doc_id IN (SELECT doc_id FROM smoke)")
    .replace("FROM tk WHERE split = 'train'", "FROM tk WHERE split = 'train' AND doc_id IN (SELECT doc_id FROM smoke)")
    .replace(f"dp + dn >= {B.MIN_DF}", "dp + dn >= 2")
    .replace(f">= {int(round(B.MIN_WEIGHT * B.SCALE))}", f">= {B.SCALE}")
)
SQL["fit_smoke_weights"] = (
    with_(BASE_CTES, "\nsmoke AS (SELECT doc_id FROM rec WHERE split = 'train' ORDER BY doc_id LIMIT 64)", _SMOKE)
    + " SELECT token, dp, dn, weight FROM w"
)

SQL["score_external"] = (
    EVAL + """ SELECT "index", expected, raw_output, predicted, correct, true AS timed FROM preds WHERE mode = 'base'"""
)

SQL["score_tuned_all"] = with_(
    BASE_CTES,
    FIT_CTES,
    """
asum AS (SELECT t.doc_id, sum(w.weight) AS s FROM tk t JOIN w ON t.token = w.token GROUP BY t.doc_id),
ar AS (SELECT r.doc_id, r.output, CASE WHEN (SELECT prior FROM prior) + coalesce(a.s, 0) >= 0 THEN """
    + POS
    + " ELSE "
    + NEG
    + """ END AS predicted
       FROM rec r LEFT JOIN asum a ON r.doc_id = a.doc_id)""",
) + """ SELECT doc_id AS "index", output AS expected, predicted, predicted = output AS correct FROM ar"""

SQL["stats_document"] = with_(
    BASE_CTES,
    """
st3 AS (SELECT s.split, coalesce(c.records, 0) AS records, coalesce(c.positive, 0) AS positive, coalesce(c.negative, 0) AS negative
        FROM (VALUES ('train'), ('valid'), ('test')) s(split)
        LEFT JOIN (SELECT split, count(*) AS records,
                          count(*) FILTER (WHERE output = """
    + POS
    + """) AS positive,
                          count(*) FILTER (WHERE output = """
    + NEG
    + """) AS negative FROM rec GROUP BY split) c ON s.split = c.split)""",
) + """ SELECT '{' || string_agg('"' || split || '":{"records":' || records || ',"positive":' || positive
          || ',"negative":' || negative || '}', ',' ORDER BY split) || '}' AS json FROM st3"""

SQL["encode_python_tokenizer"] = SQL["encode_examples"]

SQL["pad_global_batches"] = ENCODE + """,
  r AS (SELECT doc_id, n_full, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id FROM enc),
  m AS (SELECT *, max(n_full) OVER (PARTITION BY batch_id) AS max_len FROM r)
  SELECT CAST(batch_id AS BIGINT) AS batch_id, doc_id, CAST(max_len AS BIGINT) AS max_len,
         CAST(max_len - n_full AS BIGINT) AS n_pad, CAST(max_len AS BIGINT) AS padded_len FROM m"""

SQL["jsonl_positions"] = with_(BASE_CTES) + " SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, split, instruction, input, output FROM rec"

# --- cases the plain tables do not show ---------------------------------------------

SQL["prepare_numbered_splits"] = with_(
    BASE_CTES,
    f"""
num AS (SELECT split, doc_id, text, label, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS row_idx FROM sp),
nst AS (
  SELECT split, row_idx, {strip('text')} AS input, CASE label WHEN 0 THEN {POS} WHEN 1 THEN {NEG} END AS output
  FROM num WHERE length({strip('text')}) > 0
)""",
) + " SELECT split, min(row_idx) AS row_idx, input, output FROM nst GROUP BY split, input, output"

_MD5_OF_ID = f"md5('{S.seed}|' || CAST(doc_id AS VARCHAR))"
SQL["large_cap"] = with_(
    BASE_CTES,
    f"""
ranked AS (
  SELECT split, doc_id, row_number() OVER (PARTITION BY split ORDER BY {_MD5_OF_ID}) AS seeded,
         row_number() OVER (PARTITION BY split ORDER BY CAST(doc_id AS VARCHAR)) AS head
  FROM rec
),
lim AS (SELECT *, CASE split WHEN 'train' THEN 150 WHEN 'valid' THEN 15 ELSE 1000000000 END AS n FROM ranked)""",
) + """ SELECT 'seeded' AS kind, split, doc_id FROM lim WHERE seeded <= n
       UNION ALL SELECT 'seeded name', split, doc_id FROM lim WHERE seeded <= n
       UNION ALL SELECT 'head name', split, doc_id FROM lim WHERE head <= n"""

SQL["score_two_models"] = with_(BASE_CTES) + f"""
  SELECT 'base' AS mode, doc_id AS "index", {POS} AS predicted, output = {POS} AS correct FROM rec WHERE split = 'test'
  UNION ALL SELECT 'tuned', doc_id, {NEG}, output = {NEG} FROM rec WHERE split = 'test'"""

_MIXED = with_(
    BASE_CTES,
    f"""
mix AS (
  SELECT doc_id, output AS expected,
    CASE doc_id % 5 WHEN 0 THEN output WHEN 4 THEN CASE output WHEN {POS} THEN {NEG} ELSE {POS} END END AS predicted,
    CASE doc_id % 5 WHEN 0 THEN output WHEN 1 THEN '' WHEN 2 THEN 'no idea' WHEN 3 THEN 'good or bad'
      ELSE CASE output WHEN {POS} THEN {NEG} ELSE {POS} END END AS raw_output
  FROM rec
)""",
)
SQL["invalid_predictions"] = _MIXED + f"""
  SELECT 'mixed' AS mode, doc_id AS "index", coalesce(predicted, {lit(S.undetermined_text)}) AS label_text,
         coalesce(nullif(raw_output, ''), {lit(S.no_output_text)}) AS raw_text FROM mix"""
SQL["invalid_metrics"] = _MIXED + f""",
c AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE predicted = expected) AS ok, count(predicted) AS valid,
    count(*) FILTER (WHERE expected = {POS} AND predicted = {POS}) AS pos_as_pos,
    count(*) FILTER (WHERE expected = {POS} AND predicted = {NEG}) AS pos_as_neg,
    count(*) FILTER (WHERE expected = {POS} AND predicted IS NULL) AS pos_invalid,
    count(*) FILTER (WHERE expected = {NEG} AND predicted = {NEG}) AS neg_as_neg,
    count(*) FILTER (WHERE expected = {NEG} AND predicted = {POS}) AS neg_as_pos,
    count(*) FILTER (WHERE expected = {NEG} AND predicted IS NULL) AS neg_invalid
  FROM mix
)
SELECT 'mixed' AS mode, total, round(ok / CAST(total AS DOUBLE), 6) AS accuracy,
  round((coalesce(2.0 * pos_as_pos / nullif(2 * pos_as_pos + pos_as_neg + pos_invalid + neg_as_pos, 0), 0)
       + coalesce(2.0 * neg_as_neg / nullif(2 * neg_as_neg + neg_as_pos + neg_invalid + pos_as_neg, 0), 0)) / 2, 6) AS macro_f1,
  round(valid / CAST(total AS DOUBLE), 6) AS format_valid_rate,
  pos_as_pos, pos_as_neg, pos_invalid, neg_as_neg, neg_as_pos, neg_invalid FROM c"""
SQL["empty_metrics"] = "SELECT count(*) AS n_modes FROM labels WHERE false"
SQL["pad_contents"] = f"""
  SELECT doc_id, n_pad, n_pad AS pad_ids, n_masked + n_pad AS ignored, n_full AS attended
  FROM ({SQL['pad_batches']}) JOIN ({SQL['encode_examples']}) USING (doc_id)"""
SQL["registry_targets"] = with_(
    BASE_CTES,
    f"""
old AS (SELECT name, 'reviews/' || substr(name, 9) || '/train.jsonl' AS file_name FROM ({_SRC_NAMES})),
new AS (SELECT DISTINCT 'reviews_' || d.source AS name FROM sp JOIN documents d ON sp.doc_id = d.doc_id WHERE sp.split = 'test'),
newe AS (SELECT name, 'reviews/' || substr(name, 9) || '/test.jsonl' AS file_name FROM new)""",
) + """ SELECT 'project' AS target, name, file_name FROM old WHERE name NOT IN (SELECT name FROM newe)
       UNION ALL SELECT 'project', name, file_name FROM newe
       UNION ALL SELECT 'consumer', name, file_name FROM newe
       UNION ALL SELECT 'consumer', 'consumer_own', 'own.jsonl'"""
SQL["jsonl_blank_lines"] = with_(
    BASE_CTES, "n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, doc_id, output FROM rec)"
) + """ SELECT 'all' AS kind, row_idx, doc_id, output FROM n
       UNION ALL SELECT 'first', row_idx, doc_id, output FROM n WHERE row_idx < 40"""

SQL["stats_with_instruction"] = (
    f"SELECT {lit(S.instruction)} AS instruction, split, records, positive, negative FROM ({SQL['split_stats']})"
)
SQL["metrics_document"] = EVAL + f""",
sides AS (
  SELECT mode, {POS} AS label, pos_p AS p, pos_r AS r, pos_f1 AS f FROM f1s
  UNION ALL SELECT mode, {NEG}, neg_p, neg_r, neg_f1 FROM f1s
)
SELECT mode, label, met.total, round(met.accuracy, 6) AS accuracy, round(met.macro_f1, 6) AS macro_f1,
  pos_as_pos, pos_as_neg, pos_invalid, neg_as_neg, neg_as_pos, neg_invalid,
  round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1
FROM met JOIN cnts USING (mode) JOIN sides USING (mode)"""

# --- versions, isolation, vocabulary, second fitter, keyed streams -------------------

_REGISTRIES = with_(
    BASE_CTES,
    f"""
old AS (SELECT name, 'reviews/' || substr(name, 9) || '/train.jsonl' AS file_name FROM ({_SRC_NAMES})),
new AS (SELECT DISTINCT 'reviews_' || d.source AS name FROM sp JOIN documents d ON sp.doc_id = d.doc_id WHERE sp.split = 'test'),
newe AS (SELECT name, 'reviews/' || substr(name, 9) || '/test.jsonl' AS file_name FROM new)""",
)
SQL["registry_versions"] = _REGISTRIES + """ SELECT 'before' AS seen, CAST(1 AS BIGINT) AS version, name, file_name FROM old
  UNION ALL SELECT 'after', 3, name, file_name FROM old WHERE name NOT IN (SELECT name FROM newe)
  UNION ALL SELECT 'after', 3, name, file_name FROM newe
  UNION ALL SELECT 'after', 3, 'late_writer', 'late.jsonl'"""
SQL["published_versions"] = with_(BASE_CTES) + """ SELECT 'before' AS seen, doc_id, input, output FROM rec
  UNION ALL SELECT 'after', doc_id, input, output FROM rec WHERE split = 'train'"""
SQL["isolated_scoring"] = with_(
    BASE_CTES,
    f"""
ans AS (
  SELECT doc_id, output, length(input) % 7 = 0 AS bad,
         CASE WHEN list_has_any({tokens('input')}, {BASE_WORDS}) THEN {NEG} ELSE {POS} END AS said
  FROM rec
)""",
) + """ SELECT doc_id AS "index", output AS expected, CASE WHEN bad THEN '' ELSE said END AS raw_output,
    CASE WHEN NOT bad THEN said END AS predicted, NOT bad AND said = output AS correct,
    CASE WHEN bad THEN 'ValueError: unreadable text' END AS error FROM ans"""
SQL["score_tuned_large"] = SQL["score_tuned_all"]
SQL["score_hashed"] = with_(
    BASE_CTES,
    f"""
feat AS (
  SELECT DISTINCT doc_id, split, output, CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT) % {1 << 12} AS f
  FROM (SELECT doc_id, split, output, unnest({tokens('input')}) AS token FROM rec)
),
cls AS (
  SELECT count(*) FILTER (WHERE output = {POS}) AS np, count(*) FILTER (WHERE output = {NEG}) AS nn FROM rec WHERE split = 'train'
),
cnt AS (
  SELECT f, count(*) FILTER (WHERE output = {POS}) AS dp, count(*) FILTER (WHERE output = {NEG}) AS dn
  FROM feat WHERE split = 'train' GROUP BY f
),
fw AS (
  SELECT f, weight FROM (
    SELECT f, CAST(round(CAST({B.SCALE} AS DOUBLE) * ln(((dp + 1) / CAST(np + 2 AS DOUBLE)) / ((dn + 1) / CAST(nn + 2 AS DOUBLE)))) AS BIGINT) AS weight
    FROM cnt, cls WHERE dp + dn >= {B.MIN_DF}
  ) WHERE abs(weight) >= {B.SCALE}
),
tot AS (
  SELECT rec.doc_id, CAST(round(CAST({B.SCALE} AS DOUBLE) * ln(CAST(any_value(np) AS DOUBLE) / CAST(any_value(nn) AS DOUBLE))) AS BIGINT)
           + CAST(coalesce(sum(weight), 0) AS BIGINT) AS score
  FROM rec CROSS JOIN cls LEFT JOIN feat ON feat.doc_id = rec.doc_id LEFT JOIN fw ON fw.f = feat.f GROUP BY rec.doc_id
)""",
) + f" SELECT doc_id, score, CASE WHEN score >= 0 THEN {POS} ELSE {NEG} END AS answer FROM tot"

_VOCABULARY = f"""
words AS (
  SELECT doc_id, split, {space_tokens(PROMPT)} AS p, {space_tokens(PROMPT + ' || ' + TARGET)} AS t FROM rec
),
voc AS (
  SELECT token, n, row_number() OVER (ORDER BY n DESC, encode(token)) AS id
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM words WHERE split = 'train') GROUP BY token HAVING count(*) >= 2)
)"""
SQL["learned_vocabulary"] = with_(BASE_CTES, _VOCABULARY) + " SELECT token, id, n FROM voc"
SQL["encode_vocabulary"] = with_(
    BASE_CTES,
    _VOCABULARY,
    f"""
cut AS (SELECT doc_id, len(p) AS n_prompt, t[1:{S.max_length}] AS f FROM words),
pieces AS (
  SELECT doc_id, n_prompt, unnest(f) AS token, unnest(range(len(f))) AS pos FROM cut WHERE len(f) > n_prompt
)""",
) + """ SELECT doc_id, string_agg(coalesce(id, 0), ' ' ORDER BY pos) AS input_ids,
    string_agg(CASE WHEN pos < n_prompt THEN -100 ELSE coalesce(id, 0) END, ' ' ORDER BY pos) AS labels
  FROM pieces LEFT JOIN voc USING (token) GROUP BY doc_id"""
SQL["vocabulary_round_trip"] = with_(BASE_CTES, _VOCABULARY) + """ SELECT doc_id, count(*) AS n_tokens, count(*) - count(id) AS n_unknown,
    string_agg(CASE WHEN id IS NULL THEN '?' ELSE token END, ' ' ORDER BY pos) AS decoded
  FROM (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM words) LEFT JOIN voc USING (token) GROUP BY doc_id"""

SQL["stream_prepare_stateful"] = SQL["prepare_records"]
SQL["stream_late_rows"] = with_(
    BASE_CTES,
    """
arr AS (SELECT split, input, output, doc_id % 10 AS part, doc_id * 1000 // (SELECT max(doc_id) FROM lab) AS arrived FROM st)""",
) + """ SELECT DISTINCT split, input, output FROM arr
  WHERE part <= 8 OR arrived > (SELECT max(arrived) - 600 FROM arr WHERE part < 8)"""
SQL["stream_labels"] = with_(BASE_CTES) + " SELECT split, doc_id, input, output FROM st WHERE doc_id % 50 * 10 <= 300"
SQL["stream_requests"] = (
    with_(_validated(f"SELECT conv_id * 1000 + turn AS request_id, text, {_req_mode('((conv_id + turn) % 4)')} AS mode0 FROM conversations"))
    + " SELECT request_id, mode, reason IS NULL AS accepted, reason FROM v"
)
SQL["mixed_predictions_jsonl"] = _MIXED + """
  SELECT 'mixed' AS mode, doc_id AS "index", expected, raw_output, predicted, predicted IS NULL AS spelled FROM mix"""
SQL["named_splits"] = f"""
  SELECT 'three' AS layout, doc_id, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'valid' ELSE 'test' END AS split
  FROM labels WHERE doc_id % 10 < 9
  UNION ALL
  SELECT 'two', doc_id, CASE WHEN doc_id % 10 >= 8 THEN 'test' WHEN {number('doc_id')} < {below(0.1)} THEN 'valid' ELSE 'train' END FROM labels"""
