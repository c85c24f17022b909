"""Registered queries: one per operator family, each ``(spark, sf_dir) ->
DataFrame`` over the driver's tables.

Output columns are flat scalars; doubles are rounded to 6 places and
integers are ``bigint`` so that a second engine can compare values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat, encode as enc, evaluate as ev, report as rep
from ..operators.fit import token_counts
from ..operators.prepare import TEXT_COLUMNS, to_records
from ..operators.prepare import split_stats as _split_stats
from ..operators.ranks import global_positions
from ..operators.score import LexiconScorer, PandasScorer, run_modes, score
from ..operators.splits import head_limit, seeded_cap
from ..spec import CHINESE_REVIEWS
from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _r(c: str, n: int = 6):
    return F.round(F.col(c), n).alias(c)


def _b(c: str):
    return F.col(c).cast("bigint").alias(c)


def _records(spark, sf_dir):
    """The prepared table, written once per session (downstream steps read
    it, as the later stages of a prepare -> train -> evaluate workflow read
    the prepared files)."""
    return B.Workspace.of(spark, sf_dir).records()


# --- preparation -------------------------------------------------------------


@query
def prepare_records(spark, sf_dir):
    """P1-P5, L5 (+ L1/L2 split scope)."""
    return B.records(spark, sf_dir).select("split", "doc_id", "instruction", "input", "output")


@query
def split_records(spark, sf_dir):
    """L1 + L2: keyed-hash 80/10/10 split of every labelled row."""
    return B.split_rows(spark, sf_dir).select("doc_id", "split")


@query
def split_stats(spark, sf_dir):
    """A1: per-split counts after dedup."""
    return _split_stats(_records(spark, sf_dir), B.SPEC).select(
        "split", _b("records"), _b("positive"), _b("negative")
    )


@query
def exact_split_records(spark, sf_dir):
    """L1 + L2 with exact 80/10/10 part sizes (two-step rule)."""
    from ..operators.splits import canonical_splits

    labs = B.table(spark, sf_dir, "labels").select("doc_id")
    return canonical_splits(labs, B.KEY, B.SPEC.seed, exact=True).select("doc_id", "split")


@query
def quarantined_labels(spark, sf_dir):
    """P4 in quarantine mode (fixed Chinese vocabulary): rows a strict run
    would fail on, from spellings derived from (toxic, doc_id % 4)."""
    from ..operators.prepare import quarantined

    cn = CHINESE_REVIEWS
    k = F.pmod(F.col("doc_id"), F.lit(4))
    pos = F.col("toxic") == 0
    raw = (
        F.when(k == 0, F.when(pos, F.lit("1")).otherwise(F.lit("0")))
        .when(k == 1, F.when(pos, F.lit(" POS ")).otherwise(F.lit("neg")))
        .when(k == 2, F.when(pos, F.lit("good")).otherwise(F.lit("bad")))
        .otherwise(F.when(pos, F.lit(cn.positive_aliases[4])).otherwise(F.lit(cn.negative_aliases[4])))
    )
    df = B.table(spark, sf_dir, "documents").select("doc_id", "text").join(
        B.table(spark, sf_dir, "labels").select("doc_id", raw.alias("label")), "doc_id"
    )
    return quarantined(df, cn, key="doc_id")


@query
def normalize_labels(spark, sf_dir):
    """P4 over string spellings derived from (toxic, doc_id % 5)."""
    labs = B.table(spark, sf_dir, "labels")
    k = F.pmod(F.col("doc_id"), F.lit(5))
    pos = F.col("toxic") == 0
    raw = (
        F.when(k == 0, F.when(pos, F.lit(" Positive ")).otherwise(F.lit(" Negative ")))
        .when(k == 1, F.when(pos, F.lit("POS")).otherwise(F.lit("NEG")))
        .when(k == 2, F.when(pos, F.lit("1")).otherwise(F.lit("0")))
        .when(k == 3, F.when(pos, F.lit("\tpositive\u00a0")).otherwise(F.lit("\u3000negative\n")))
        .otherwise(F.when(pos, F.lit("Good")).otherwise(F.lit("bad")))
    )
    df = labs.select("doc_id", raw.alias("raw_label"))
    from ..functions.labels import normalize_label

    return df.select("doc_id", "raw_label", normalize_label(df, "raw_label", B.SPEC).alias("output"))


@query
def cap_records(spark, sf_dir):
    """L3: seeded per-split caps (train 200, valid 20, test 20)."""
    recs = _records(spark, sf_dir)
    return seeded_cap(recs, {"train": 200, "valid": 20, "test": 20}, B.KEY, B.SPEC.seed).select(
        "split", "doc_id", "output"
    )


@query
def head_records(spark, sf_dir):
    """L4 / M6: first 64 train and 64 valid records by key; test whole."""
    recs = _records(spark, sf_dir)
    return head_limit(recs, {"train": 64, "valid": 64, "test": 0}, B.KEY).select("split", "doc_id", "output")


# --- prompts and encoding ----------------------------------------------------


@query
def chat_messages(spark, sf_dir):
    """P7 flattened to rows."""
    return chat.flatten_messages(_records(spark, sf_dir), B.KEY, B.SPEC).select(
        "doc_id", _b("pos"), "role", "content"
    )


@query
def render_prompt(spark, sf_dir):
    """P8 + P9."""
    return chat.with_prompts(_records(spark, sf_dir), B.SPEC).select("doc_id", "prompt", "target")


@query
def conversation_sizes(spark, sf_dir):
    """P8 over ``conversations``: per-conversation turns and prompt size."""
    conv = B.table(spark, sf_dir, "conversations")
    return chat.conversation_summary(conv).select(
        "conv_id", _b("n_turns"), _b("n_user"), _b("n_assistant"), _b("prompt_chars")
    )


@query
def conversation_segments(spark, sf_dir):
    """P8 over ``conversations``: rendered segments in (conv_id, turn) order."""
    conv = B.table(spark, sf_dir, "conversations")
    return chat.conversation_segments(conv).select("conv_id", _b("turn"), "segment")


def _encoded(spark, sf_dir):
    return enc.encode(chat.with_prompts(_records(spark, sf_dir), B.SPEC), max_length=B.SPEC.max_length, keep_tokens=True)


@query
def encode_examples(spark, sf_dir):
    """Sizes and the supervised token text of each kept row."""
    return _encoded(spark, sf_dir).select(
        "doc_id",
        _b("n_prompt"),
        _b("n_full"),
        _b("n_supervised"),
        F.array_join("supervised_tokens", " ").alias("label_str"),
        F.size(F.filter("labels", lambda x: x == F.lit(-100))).cast("bigint").alias("n_masked"),
    )


@query
def encode_python_tokenizer(spark, sf_dir):
    """P10-P13 with a Python tokeniser plugged in as an Arrow pandas UDF."""
    e = enc.encode(
        chat.with_prompts(_records(spark, sf_dir), B.SPEC),
        max_length=B.SPEC.max_length,
        tokenizer=enc.pandas_tokenizer(B.whitespace_tokenizer),
        keep_tokens=True,
    )
    return e.select(
        "doc_id",
        _b("n_prompt"),
        _b("n_full"),
        _b("n_supervised"),
        F.array_join("supervised_tokens", " ").alias("label_str"),
        F.size(F.filter("labels", lambda x: x == F.lit(-100))).cast("bigint").alias("n_masked"),
    )


@query
def pad_batches(spark, sf_dir):
    """L7 + P14: batches of 8 in 8 hash shards, padded to the batch max."""
    padded = enc.pad_batches(_encoded(spark, sf_dir), B.KEY, batch_size=8, shards=8, seed=B.SPEC.seed)
    return padded.select(
        _b("shard"),
        _b("batch_id"),
        "doc_id",
        _b("max_len"),
        _b("n_pad"),
        F.size("input_ids").cast("bigint").alias("padded_len"),
        F.size(F.filter("attention_mask", lambda x: x == 0)).cast("bigint").alias("mask_zeros"),
    )


# --- output parsing, fit, scoring ---------------------------------------------


@query
def pad_global_batches(spark, sf_dir):
    """L7 + P14 with global consecutive batches of 8 (key order)."""
    padded = enc.pad_batches(_encoded(spark, sf_dir), B.KEY, batch_size=8, layout="global")
    return padded.select(
        _b("batch_id"),
        "doc_id",
        _b("max_len"),
        _b("n_pad"),
        F.size("labels").cast("bigint").alias("padded_len"),
    )


@query
def extract_labels(spark, sf_dir):
    """P16 (fixed Chinese vocabulary) on outputs derived from (toxic, doc_id % 6)."""
    from ..functions.labels import extract_label

    s = CHINESE_REVIEWS
    labs = B.table(spark, sf_dir, "labels")
    k = F.pmod(F.col("doc_id"), F.lit(6))
    word = F.when(F.col("toxic") == 0, F.lit(s.positive)).otherwise(F.lit(s.negative))
    other = F.when(F.col("toxic") == 0, F.lit(s.negative)).otherwise(F.lit(s.positive))
    syn = F.when(F.col("toxic") == 0, F.lit(s.positive_signals[1])).otherwise(F.lit(s.negative_signals[1]))
    raw = (
        F.when(k == 0, F.concat(F.lit(" "), word, F.lit("\n")))
        .when(k == 1, F.concat(other, F.lit("，但有"), word))
        .when(k == 2, F.concat(F.lit("答案："), word))
        .when(k == 3, syn)
        .when(k == 4, F.concat(F.lit("不是"), word, F.lit("，是"), other))
        .otherwise(F.lit("不知道"))
    )
    df = labs.select("doc_id", raw.alias("raw_output"))
    return df.select("doc_id", "raw_output", extract_label("raw_output", s).alias("predicted"))


@query
def fit_token_weights(spark, sf_dir):
    """M4 on the train split: kept tokens with counts and integer weights."""
    ws = B.Workspace.of(spark, sf_dir)
    return ws.weights().table(spark).select("token", _b("dp"), _b("dn"), _b("weight"))


@query
def fit_smoke_weights(spark, sf_dir):
    """M6 + M4: fit on the first 64 train records (the smoke-run cap)."""
    from ..operators.fit import fit_token_weights as fit

    train = head_limit(B.Workspace.of(spark, sf_dir).split("train"), {"train": 64}, B.KEY)
    w = fit(train, B.SPEC, min_df=2, min_weight=1.0, scale=B.SCALE)
    return w.table(spark).select("token", _b("dp"), _b("dn"), _b("weight"))


@query
def token_document_counts(spark, sf_dir):
    """M4's counting stage over the whole train split (every token)."""
    train = B.Workspace.of(spark, sf_dir).split("train")
    return token_counts(train, B.SPEC).select("token", _b("dp"), _b("dn"))


def _scored(spark, sf_dir, mode):
    ws = B.Workspace.of(spark, sf_dir)
    return ws.predictions().filter(F.col("mode") == mode).select(
        "index", "expected", "raw_output", "predicted", "correct", "valid_format"
    )


@query
def score_base(spark, sf_dir):
    """M3 + P16-P18 on the test split."""
    return _scored(spark, sf_dir, "base")


@query
def score_tuned(spark, sf_dir):
    """M5 + P16-P18 on the test split."""
    return _scored(spark, sf_dir, "tuned")


@query
def score_external(spark, sf_dir):
    """M1(b) / M2 / U2: a Python model scored with mapInPandas (built once
    per worker, each row timed) over the test split."""
    test = B.Workspace.of(spark, sf_dir).split("test")
    p = score(test, PandasScorer(B.lexicon_model), "external", B.SPEC, key=B.KEY)
    return p.select("index", "expected", "raw_output", "predicted", "correct", (F.col("latency_sec") >= 0).alias("timed"))


@query
def score_tuned_all(spark, sf_dir):
    """M5 over every prepared record (all splits), not materialised."""
    ws = B.Workspace.of(spark, sf_dir)
    p = score(ws.records(), ws.weights(), "tuned", B.SPEC, key=B.KEY, latency=B.latency_standin(), keep_input=False)
    return p.select("index", "expected", "predicted", "correct")


@query
def score_base_all(spark, sf_dir):
    """M3 over every prepared record (all splits), not materialised."""
    recs = _records(spark, sf_dir)
    p = score(recs, LexiconScorer(B.SPEC, B.BASE_WORDS), "base", B.SPEC, key=B.KEY, latency=B.latency_standin())
    return p.select("index", "expected", "predicted", "correct")


# --- evaluation ----------------------------------------------------------------


def _preds(spark, sf_dir):
    return B.Workspace.of(spark, sf_dir).predictions()


@query
def eval_metrics(spark, sf_dir):
    """Flagship: J1 + A2-A4 + A6 for modes base and tuned."""
    m = ev.metrics(_preds(spark, sf_dir), B.SPEC)
    return m.select(
        "mode", _b("total"), _r("accuracy"), _r("macro_f1"), _r("format_valid_rate"), _r("avg_latency_sec")
    )


@query
def per_label_metrics(spark, sf_dir):
    """A5."""
    return ev.per_label(_preds(spark, sf_dir), B.SPEC).select("mode", "label", _r("precision"), _r("recall"), _r("f1"))


@query
def confusion(spark, sf_dir):
    """A7."""
    return ev.confusion(_preds(spark, sf_dir), B.SPEC).select("mode", *[_b(c) for c in ev.CONFUSION_COLUMNS])


@query
def mode_deltas(spark, sf_dir):
    """J2."""
    m = ev.metrics(_preds(spark, sf_dir), B.SPEC)
    return ev.mode_deltas(m, "base", "tuned").select(_r("accuracy_pp", 4), _r("macro_f1_pp", 4))


@query
def side_by_side(spark, sf_dir):
    """J3."""
    return ev.side_by_side(_preds(spark, sf_dir), "base", "tuned")


@query
def error_cases(spark, sf_dir):
    """L6 + P19."""
    ws = B.Workspace.of(spark, sf_dir)
    return rep.error_cases(_preds(spark, sf_dir), B.SPEC, texts=ws.test_texts()).select(
        "mode", _b("rank"), "index", "expected", "predicted", "raw_snippet", "snippet"
    )


@query
def display_predictions(spark, sf_dir):
    """P20 + P21."""
    return rep.display(_preds(spark, sf_dir), B.SPEC)


@query
def report_lines(spark, sf_dir):
    """R1."""
    preds = _preds(spark, sf_dir)
    texts = B.Workspace.of(spark, sf_dir).test_texts()
    # one row per mode / k rows per mode: cut lineage once (reliable
    # checkpoint in the shared folder) instead of re-aggregating per section
    B.Workspace.of(spark, sf_dir)  # ensures the shared folder is set
    c = ev.counts(preds, B.SPEC).checkpoint()
    errors = rep.error_cases(preds, B.SPEC, texts=texts).checkpoint()
    lines = rep.report_lines(
        ev.metrics_from_counts(c),
        c.select("mode", *ev.CONFUSION_COLUMNS),
        errors,
        B.MODES,
        B.SPEC,
    )
    return lines.select(_b("section"), _b("mode_ord"), _b("line_no"), "line")


# --- sources, sinks, registry ---------------------------------------------------


@query
def jsonl_roundtrip(spark, sf_dir):
    """S3 + S2: prepared records through JSON Lines and back (FAILFAST)."""
    from ..session import scratch_path
    from ..sources.readers import read_jsonl
    from ..sources.sinks import write_records

    path = scratch_path(spark, "records-jsonl")
    write_records(B.Workspace.of(spark, sf_dir).records().drop("n_chars"), path, fmt="json", partition_by="split")
    schema = "doc_id bigint, instruction string, input string, output string"
    return read_jsonl(spark, path, schema, key=B.KEY).select("split", "doc_id", "instruction", "input", "output")


@query
def jsonl_positions(spark, sf_dir):
    """S3 + S2 in the original file layout: all records written as JSON Lines
    without a key (range-ordered part files, no single-task write), read back
    with each record's 0-based line position."""
    from ..session import scratch_path
    from ..sources.readers import read_jsonl

    path = scratch_path(spark, "all-jsonl")
    columns = ("split", "instruction", "input", "output")
    _records(spark, sf_dir).orderBy(B.KEY).select(*columns).write.mode("overwrite").json(path)
    back = read_jsonl(spark, path, ", ".join(f"{c} string" for c in columns))
    return back.select(_b("row_idx"), *columns)


@query
def predictions_jsonl(spark, sf_dir):
    """Predictions through JSON Lines with ``predicted: null`` kept."""
    from ..session import scratch_path
    from ..sources.readers import read_jsonl
    from ..sources.sinks import write_predictions

    path = scratch_path(spark, "predictions-jsonl")
    preds = _preds(spark, sf_dir).join(B.Workspace.of(spark, sf_dir).test_texts(), "index")
    write_predictions(preds, path)
    schema = "index bigint, input string, expected string, raw_output string, predicted string, latency_sec double"
    back = read_jsonl(spark, path, schema, key="index")
    return back.select("mode", "index", "expected", "raw_output", "predicted", _r("latency_sec"))


@query
def stats_document(spark, sf_dir):
    """Split stats as one JSON document keyed by split."""
    from ..sources.sinks import json_document

    stats = _split_stats(B.Workspace.of(spark, sf_dir).records(), B.SPEC).drop("split_ord")
    return json_document(stats, key="split")


def _registries(spark, sf_dir):
    from ..sources import registry as R

    docs = B.table(spark, sf_dir, "documents")
    old = R.entries(
        docs.select(F.concat(F.lit("reviews_"), F.col("source")).alias("name")).distinct(),
        F.concat(F.lit("reviews/"), F.substring("name", 9, 1000), F.lit("/train.jsonl")),
    )
    test_sources = (
        B.split_rows(spark, sf_dir).filter(F.col("split") == "test").select("doc_id")
        .join(docs.select("doc_id", "source"), "doc_id")
        .select(F.concat(F.lit("reviews_"), F.col("source")).alias("name"))
        .distinct()
    )
    new = R.entries(test_sources, F.concat(F.lit("reviews/"), F.substring("name", 9, 1000), F.lit("/test.jsonl")))
    return old, new


@query
def registry_upsert(spark, sf_dir):
    """Per-source registry entries; sources seen in the test split are
    re-pointed, the others kept."""
    from ..sources import registry as R

    from ..session import scratch_path

    old, new = _registries(spark, sf_dir)
    current, following = scratch_path(spark, "registry"), scratch_path(spark, "registry")
    R.write_registry(old, current)
    R.upsert_all(new, {current: following})
    up = R.read_registry(spark, following)
    return up.select(
        "name",
        "file_name",
        F.col("columns")["prompt"].alias("prompt"),
        F.col("columns")["query"].alias("query"),
        F.col("columns")["response"].alias("response"),
    )


@query
def mapped_columns(spark, sf_dir):
    """Prepared records under their logical role names."""
    from ..sources.registry import mapped_columns as mc

    return mc(_records(spark, sf_dir))


# --- requests and streams --------------------------------------------------------

REQ_MODES = {0: None, 1: "base", 2: "tuned", 3: "draft"}


def _request_mode(k):
    expr = F.lit(None).cast("string")
    for i, m in REQ_MODES.items():
        if m is not None:
            expr = F.when(k == i, F.lit(m)).otherwise(expr)
    return expr


@query
def validate_requests(spark, sf_dir):
    """P22 on every conversation message as a request."""
    from ..streaming.serve import validate_requests as vr

    conv = B.table(spark, sf_dir, "conversations")
    req = conv.select(
        F.concat_ws(":", "conv_id", "turn").alias("request_id"),
        "text",
        _request_mode(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))).alias("mode"),
    )
    return vr(req).select("request_id", "mode", "accepted", "reason")


def _doc_requests(spark, sf_dir, stream: bool):
    docs = (
        B.stream_table(spark, sf_dir, "documents")
        if stream
        else B.table(spark, sf_dir, "documents")
    )
    return docs.select(
        F.col("doc_id").alias("request_id"),
        "text",
        "n_chars",
        _request_mode(F.pmod(F.col("doc_id"), F.lit(4))).alias("mode"),
    )


def _serve_run(spark, sf_dir):
    """Run the serving stream once per workspace; both of its sinks are read
    by the queries below."""
    from ..session import scratch_path
    from ..streaming.serve import start_serving

    ws = B.Workspace.of(spark, sf_dir)
    if "serve" not in ws.runs:
        out, dead, ck = (scratch_path(spark, n) for n in ("responses", "dead-letter", "serve-ckpt"))
        q = start_serving(
            _doc_requests(spark, sf_dir, True), ws.scorers(), B.SPEC, out, dead, ck, latency=B.latency_standin()
        )
        q.awaitTermination()
        ws.runs["serve"] = (out, dead)
    return ws.runs["serve"]


@query
def stream_scoring(spark, sf_dir):
    """Documents streamed as requests, validated and scored per mode."""
    out, _ = _serve_run(spark, sf_dir)
    return spark.read.parquet(out).select("request_id", "mode", "label", "raw_output")


@query
def stream_rejects(spark, sf_dir):
    """The dead-letter side of the same stream."""
    _, dead = _serve_run(spark, sf_dir)
    return spark.read.parquet(dead).select("request_id", "mode", "reason")


@query
def stream_metrics(spark, sf_dir):
    """Running per-mode counts over the prediction table as a stream."""
    from ..session import scratch_path
    from ..streaming.metrics import latest, start_metrics

    ws = B.Workspace.of(spark, sf_dir)
    static = ws.predictions()
    stream = spark.readStream.schema(static.schema).parquet(ws._preds)
    out, ck = scratch_path(spark, "stream-metrics"), scratch_path(spark, "stream-metrics-ckpt")
    start_metrics(stream, B.SPEC, out, ck).awaitTermination()
    return latest(spark, out).select(
        "mode", _b("total"), _b("n_correct"), _b("n_valid"), *[_b(c) for c in ev.CONFUSION_COLUMNS]
    )


@query
def stream_prepare(spark, sf_dir):
    """Streaming P2-P5 + first-wins dedup; equals ``prepare_records``."""
    from ..operators.splits import canonical_splits
    from ..session import scratch_path
    from ..streaming.prepare import prepared, start_prepare

    docs = B.stream_table(spark, sf_dir, "documents")
    labs = B.table(spark, sf_dir, "labels").select(B.KEY, F.col("toxic").alias("label"))
    rows = canonical_splits(docs.select(B.KEY, "text").join(labs, B.KEY), B.KEY, B.SPEC.seed)
    out, ck = scratch_path(spark, "stream-prepare"), scratch_path(spark, "stream-prepare-ckpt")
    for q in start_prepare(rows, B.SPEC, B.KEY, out, ck, class_names=B.CLASS_NAMES):
        q.awaitTermination()
    return prepared(spark, out, B.KEY).select("split", "doc_id", "instruction", "input", "output")


@query
def stream_prepare_within(spark, sf_dir):
    """X4 with state bounded by a watermark (ids stand for seconds
    after 10^9, as a watermark starts at 0 and drops what is not above it): which of
    equal records arrives first is open, so the key is not returned."""
    from ..operators.splits import canonical_splits
    from ..session import scratch_path
    from ..streaming.prepare import start_prepare_within

    docs = B.stream_table(spark, sf_dir, "documents").select(B.KEY, "text", F.timestamp_seconds(F.col(B.KEY) + 10**9).alias("at"))
    labs = B.table(spark, sf_dir, "labels").select(B.KEY, F.col("toxic").alias("label"))
    rows = canonical_splits(docs.join(labs, B.KEY), B.KEY, B.SPEC.seed)
    out, ck = scratch_path(spark, "stream-within"), scratch_path(spark, "stream-within-ckpt")
    start_prepare_within(rows, B.SPEC, B.KEY, "at", "3650 days", out, ck, class_names=B.CLASS_NAMES).awaitTermination()
    return spark.read.parquet(out).select("split", "input", "output")


@query
def first_available_source(spark, sf_dir):
    """The first candidate with a text column (a missing path and a table
    of another shape are skipped)."""
    from ..sources.readers import read_first

    base = sf_dir.rstrip("/")
    candidates = [f"{base}/reviews.parquet", f"{base}/labels.parquet", f"{base}/documents.parquet"]
    df = read_first(spark, candidates, require=[TEXT_COLUMNS])
    return df.select("doc_id", "text", "lang", "source", "n_chars")


@query
def metrics_lookup(spark, sf_dir):
    """S5 + S9: the written metrics table read back; an absent table reads
    as empty (unioned in to show it)."""
    from ..session import scratch_path
    from ..sources.readers import read_optional

    ws = B.Workspace.of(spark, sf_dir)
    schema = "mode string, total bigint, accuracy double, macro_f1 double, format_valid_rate double, avg_latency_sec double"
    m = read_optional(spark, ws.metrics_path(), schema).unionByName(
        read_optional(spark, scratch_path(spark, "never-written"), schema)
    )
    return m.select("mode", _b("total"), _r("accuracy"), _r("macro_f1"), _r("format_valid_rate"), _r("avg_latency_sec"))


@query
def report_file(spark, sf_dir):
    """The report written as one ordered text file, read back."""
    from ..session import scratch_path
    from ..sources.sinks import write_report

    path = scratch_path(spark, "report")
    write_report(report_lines(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def publish_dataset(spark, sf_dir):
    """The prepared table published to a fresh target, read back."""
    from ..session import scratch_path
    from ..sources.sinks import publish

    ws = B.Workspace.of(spark, sf_dir)
    ws.records()
    out = publish(spark, ws._records, scratch_path(spark, "published"))
    return out.select("split", "doc_id", "instruction", "input", "output")


# --- cases the plain tables do not show --------------------------------------------


@query
def prepare_numbered_splits(spark, sf_dir):
    """P1-P5, L5 on rows numbered anew inside each split, as separate split
    files are: a row is (split, row_idx)."""
    rows = B.split_rows(spark, sf_dir).select("split", B.KEY, "text", "label")
    numbered = global_positions(rows, B.KEY, group="split").withColumnRenamed("pos", "row_idx")
    recs = to_records(numbered, B.SPEC, key="row_idx", class_names=B.CLASS_NAMES)
    return recs.select("split", _b("row_idx"), "input", "output")


@query
def large_cap(spark, sf_dir):
    """L3 / L4 by string and integer keys, half of the records of a split."""
    recs = _records(spark, sf_dir).select("split", B.KEY, F.col(B.KEY).cast("string").alias("name"))
    limits = {"train": 150, "valid": 15}
    parts = [
        seeded_cap(recs, limits, B.KEY, B.SPEC.seed).select(F.lit("seeded").alias("kind"), "split", B.KEY),
        seeded_cap(recs, limits, "name", B.SPEC.seed).select(F.lit("seeded name").alias("kind"), "split", B.KEY),
        head_limit(recs, limits, "name").select(F.lit("head name").alias("kind"), "split", B.KEY),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def score_two_models(spark, sf_dir):
    """Two Python models built by one function, each under its mode."""
    test = B.Workspace.of(spark, sf_dir).split("test")
    scorers = {
        "base": PandasScorer(B.constant_model(B.SPEC.positive)),
        "tuned": PandasScorer(B.constant_model(B.SPEC.negative), batched=False),
    }
    return run_modes(test, scorers, B.MODES, B.SPEC, key=B.KEY).select("mode", "index", "predicted", "correct")


class _MixedAnswers:
    """A stand-in model that, by key, answers right, nothing, something
    unknown, both labels, or wrong."""

    def apply(self, df, key, text_col):
        k, e = F.pmod(F.col(key), F.lit(5)), F.col("output")
        pos, neg = F.lit(B.SPEC.positive), F.lit(B.SPEC.negative)
        return df.withColumn(
            "raw_output",
            F.when(k == 0, F.concat(F.lit(" "), e))
            .when(k == 1, F.lit(""))
            .when(k == 2, F.lit("no idea"))
            .when(k == 3, F.lit("good or bad"))
            .otherwise(F.when(e == pos, neg).otherwise(pos)),
        )


def _mixed(spark, sf_dir):
    recs = B.Workspace.of(spark, sf_dir).records()
    return score(recs, _MixedAnswers(), "mixed", B.SPEC, key=B.KEY, latency=B.latency_standin(), keep_input=False)


@query
def invalid_predictions(spark, sf_dir):
    """P16-P18, P21 with empty, unknown, ambiguous and wrong answers."""
    shown = rep.display(_mixed(spark, sf_dir), B.SPEC).select("mode", "index", "label_text", "raw_text")
    return shown


@query
def mixed_predictions_jsonl(spark, sf_dir):
    """S4 + S2: predictions of which most have no label, ``"predicted": null``
    kept in the files and in what comes back."""
    from ..session import scratch_path
    from ..sources.readers import read_jsonl
    from ..sources.sinks import write_predictions

    path = scratch_path(spark, "mixed-jsonl")
    texts = _records(spark, sf_dir).select(F.col(B.KEY).cast("bigint").alias("index"), "input")
    write_predictions(_mixed(spark, sf_dir).join(texts, "index"), path)
    lines = spark.read.text(path).select(F.col("value").contains('"predicted":null').alias("spelled"), F.get_json_object("value", "$.index").cast("bigint").alias("index"))
    schema = "index bigint, input string, expected string, raw_output string, predicted string, latency_sec double"
    back = read_jsonl(spark, path, schema, key="index")
    return back.join(lines, "index").select("mode", "index", "expected", "raw_output", "predicted", "spelled")


@query
def named_splits(spark, sf_dir):
    """L1 + L2 by split names: a ``validation`` part renamed (and a part of
    another name dropped), and a tenth of train carved where there is none."""
    from ..operators.splits import canonical_splits

    labs = B.table(spark, sf_dir, "labels").select(B.KEY)
    k = F.pmod(F.col(B.KEY), F.lit(10))
    three = F.when(k < 6, "train").when(k < 8, "validation").when(k < 9, "test").otherwise("unsupervised")
    two = F.when(k < 8, "train").otherwise("test")
    cases = [("three", three), ("two", two)]
    parts = [canonical_splits(labs.withColumn("split", c), B.KEY, B.SPEC.seed).select(F.lit(n).alias("layout"), B.KEY, "split") for n, c in cases]
    return parts[0].unionByName(parts[1])


@query
def invalid_metrics(spark, sf_dir):
    """A2, A3, A6, A7 when three answers of five are invalid."""
    c = ev.counts(_mixed(spark, sf_dir), B.SPEC)
    m = ev.metrics_from_counts(c).select("mode", _b("total"), _r("accuracy"), _r("macro_f1"), _r("format_valid_rate"))
    return m.join(c.select("mode", *[_b(x) for x in ev.CONFUSION_COLUMNS]), "mode")


@query
def empty_metrics(spark, sf_dir):
    """No predictions, no metric rows."""
    none = _mixed(spark, sf_dir).filter(F.col("index") < 0)
    return ev.metrics(none, B.SPEC).agg(F.count("*").alias("n_modes"))


@query
def pad_contents(spark, sf_dir):
    """The padded arrays' contents, not only their sizes."""
    pad = chat.CHATML.pad_token_id
    p = enc.pad_batches(_encoded(spark, sf_dir), B.KEY, batch_size=8, shards=8, seed=B.SPEC.seed)
    count = lambda c, v: F.size(F.filter(c, lambda x: x == F.lit(v))).cast("bigint")
    tail = F.slice("input_ids", F.col("n_full") + 1, F.col("n_pad"))
    return p.select(
        "doc_id",
        _b("n_pad"),
        count(tail, pad).alias("pad_ids"),
        count("labels", -100).alias("ignored"),
        count("attention_mask", 1).alias("attended"),
    )


@query
def registry_targets(spark, sf_dir):
    """Two registries with different entries, each updated by itself."""
    from ..session import scratch_path
    from ..sources import registry as R

    old, new = _registries(spark, sf_dir)
    own = R.entries(spark.createDataFrame([("consumer_own",)], "name string"), F.lit("own.jsonl"))
    paths = {t: (scratch_path(spark, "registry"), scratch_path(spark, "registry")) for t in ("project", "consumer")}
    R.write_registry(old, paths["project"][0])
    R.write_registry(own, paths["consumer"][0])
    R.upsert_all(new, dict(paths.values()))
    out = [
        R.read_registry(spark, following).select(F.lit(t).alias("target"), "name", "file_name")
        for t, (_, following) in paths.items()
    ]
    return out[0].unionByName(out[1])


@query
def jsonl_blank_lines(spark, sf_dir):
    """Records between empty, tab and wide-space lines; a limit counts
    records only."""
    from ..session import scratch_path
    from ..sources.readers import read_jsonl

    path = scratch_path(spark, "blank-jsonl")
    recs = _records(spark, sf_dir).select(B.KEY, F.to_json(F.struct("doc_id", "output")).alias("value"))
    blanks = F.array(F.col("value"), F.lit(""), F.lit("\t"), F.lit("\u3000"))
    recs.orderBy(B.KEY).select(F.explode(blanks).alias("value")).write.text(path)
    back = read_jsonl(spark, path, "doc_id bigint, output string")
    first = read_jsonl(spark, path, "doc_id bigint, output string", limit=40)
    return back.select(F.lit("all").alias("kind"), _b("row_idx"), "doc_id", "output").unionByName(
        first.select(F.lit("first").alias("kind"), _b("row_idx"), "doc_id", "output")
    )


@query
def stats_with_instruction(spark, sf_dir):
    """The run's stats document, parsed back."""
    from ..sources.sinks import stats_document as document

    stats = _split_stats(B.Workspace.of(spark, sf_dir).records(), B.SPEC).drop("split_ord")
    shape = "instruction string, splits map<string, struct<records: bigint, positive: bigint, negative: bigint>>"
    doc = document(stats, B.SPEC.instruction).select(F.from_json("json", shape).alias("d"))
    return doc.select("d.instruction", F.explode("d.splits").alias("split", "n")).select("instruction", "split", "n.*")


@query
def metrics_document(spark, sf_dir):
    """The run's metrics document with nested label scores and confusion
    cells, parsed back."""
    from ..sources.sinks import metrics_document as document

    cells = ", ".join(f"{c}: bigint" for c in ev.CONFUSION_COLUMNS)
    shape = (
        "map<string, struct<total: bigint, accuracy: double, macro_f1: double, "
        f"confusion: struct<{cells}>, per_label: map<string, struct<precision: double, recall: double, f1: double>>>>"
    )
    doc = document(ev.counts(_preds(spark, sf_dir), B.SPEC), B.SPEC).select(F.from_json("json", shape).alias("d"))
    rows = doc.select(F.explode("d").alias("mode", "m")).select("mode", "m.*")
    flat = rows.select("mode", "total", "accuracy", "macro_f1", "confusion.*", F.explode("per_label").alias("label", "s"))
    return flat.select(
        "mode", "label", _b("total"), _r("accuracy"), _r("macro_f1"),
        *[_b(c) for c in ev.CONFUSION_COLUMNS], F.round("s.precision", 6).alias("precision"),
        F.round("s.recall", 6).alias("recall"), F.round("s.f1", 6).alias("f1"),
    )


# --- versions, isolation, vocabulary, second fitter, keyed streams -------------------


@query
def registry_versions(spark, sf_dir):
    """S8 on a versioned registry: a second writer is overtaken by the first
    between its read and its claim, and makes its version again; a reader from
    before keeps the version it had."""
    from ..session import scratch_path
    from ..sources import registry as R
    from ..sources.versions import VersionedTable

    old, new = _registries(spark, sf_dir)
    table = VersionedTable(spark, scratch_path(spark, "registry-versions"))
    first = R.upsert_version(table, old)
    before = R.read_registry(spark, first.path)
    other = R.entries(spark.createDataFrame([("late_writer",)], "name string"), F.lit("late.jsonl"))
    overtaken = []

    def slow_writer(current):
        if not overtaken:
            overtaken.append(R.upsert_version(table, new))
        return R.upsert(current, other)

    table.update(slow_writer, R.REGISTRY_SCHEMA)
    after = table.read(R.REGISTRY_SCHEMA)
    number = table.current().number
    show = lambda df, seen, n: df.select(F.lit(seen).alias("seen"), F.lit(n).cast("bigint").alias("version"), "name", "file_name")
    return show(before, "before", first.number).unionByName(show(after, "after", number))


@query
def published_versions(spark, sf_dir):
    """S7 into a versioned target: the table published twice; the frame made
    after the first still reads the first."""
    from ..session import scratch_path
    from ..sources.sinks import publish_version
    from ..sources.versions import VersionedTable

    ws = B.Workspace.of(spark, sf_dir)
    ws.records()
    target = VersionedTable(spark, scratch_path(spark, "published-versions"))
    publish_version(spark, ws._records, target)
    before = target.read()
    part = scratch_path(spark, "published-part")
    ws.split("train").drop("split").write.parquet(part)
    publish_version(spark, part, target)
    show = lambda df, seen: df.select(F.lit(seen).alias("seen"), "doc_id", "input", "output")
    return show(before, "before").unionByName(show(target.read(), "after"))


@query
def isolated_scoring(spark, sf_dir):
    """A batched model that raises on some texts; these get no answer
    and a reason, all others theirs."""
    scorer = PandasScorer(B.fragile_model, batched=True, isolate=True, call_rows=64)
    p = score(_records(spark, sf_dir), scorer, "external", B.SPEC, key=B.KEY)
    return p.select("index", "expected", "raw_output", "predicted", "correct", "error")


@query
def score_tuned_large(spark, sf_dir):
    """M5 over every record by the plan for weights too large to broadcast."""
    from dataclasses import replace

    ws = B.Workspace.of(spark, sf_dir)
    large = replace(ws.weights(), n_bytes=None)
    p = score(ws.records(), large, "tuned", B.SPEC, key=B.KEY, latency=B.latency_standin(), keep_input=False)
    return p.select("index", "expected", "predicted", "correct")


HASH_BITS = 12


@query
def score_hashed(spark, sf_dir):
    """M4 + M5 on hashed features: log-odds of each feature, all records scored."""
    from ..operators.fit import fit_token_weights as fit
    from ..operators.logistic import feature_tokens

    ws = B.Workspace.of(spark, sf_dir)
    w = fit(ws.split("train"), B.SPEC, min_df=B.MIN_DF, min_weight=1.0, scale=B.SCALE, tokens=feature_tokens(HASH_BITS))
    scores = w.scores(ws.records(), B.KEY, "input")
    return scores.select("doc_id", _b("score"), w.answer(F.col("score")).alias("answer"))


@query
def fit_logistic(spark, sf_dir):
    """M4, the second fitter, against the first on the test split."""
    from ..operators.logistic import fit_logistic as fit

    ws = B.Workspace.of(spark, sf_dir)
    model = fit(ws.split("train"), B.SPEC)
    p = score(ws.split("test"), model, "logistic", B.SPEC, key=B.KEY, keep_input=False)
    both = p.unionByName(ws.predictions().filter(F.col("mode") == "tuned").select(*p.columns))
    return ev.metrics(both, B.SPEC).select("mode", _b("total"), _r("accuracy"), _r("macro_f1"))


def _prompt_tokens(spark, sf_dir):
    from ..functions.text import space_tokens

    rows = chat.with_prompts(_records(spark, sf_dir), B.SPEC)
    return rows.select("split", B.KEY, space_tokens(F.concat("prompt", "target")).alias("tokens"))


def _vocabulary(spark, sf_dir):
    """The vocabulary of the train split, learned once per workspace."""
    from ..operators.vocabulary import learn_vocabulary

    ws = B.Workspace.of(spark, sf_dir)
    if "vocabulary" not in ws.runs:
        train = _prompt_tokens(spark, sf_dir).filter(F.col("split") == "train")
        ws.runs["vocabulary"] = learn_vocabulary(train, F.col("tokens"), min_count=2)
    return ws.runs["vocabulary"]


@query
def learned_vocabulary(spark, sf_dir):
    """Dense ids of the train split's tokens by falling count."""
    return _vocabulary(spark, sf_dir).table(spark).select("token", _b("id"), "n")


@query
def encode_vocabulary(spark, sf_dir):
    """P10-P13 with the learned ids (broadcast form)."""
    rows = chat.with_prompts(_records(spark, sf_dir), B.SPEC)
    e = enc.encode(rows, max_length=B.SPEC.max_length, ids=_vocabulary(spark, sf_dir).ids(spark))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return e.select("doc_id", join("input_ids"), join("labels"))


@query
def vocabulary_round_trip(spark, sf_dir):
    """Whole prompts to ids and back by the joined form."""
    voc = _vocabulary(spark, sf_dir)
    there = voc.encode(_prompt_tokens(spark, sf_dir), "tokens", "ids", broadcast=False)
    back = voc.decode(there, "ids", "back")
    unknown = F.size(F.filter("ids", lambda x: x == voc.unknown)).cast("bigint")
    text = F.array_join(F.transform("back", lambda t: F.coalesce(t, F.lit("?"))), " ")
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), unknown.alias("n_unknown"), text.alias("decoded"))


@query
def stream_prepare_stateful(spark, sf_dir):
    """X4 with keyed state: rows arrive in four files (of a large table one for
    each part that a scan of it reads) out of order, half of them at a time, and
    a closing row lets the watermark pass; equals ``prepare_records``."""
    from ..session import scratch_path
    from ..streaming.stateful import start_prepare_stateful

    at = F.timestamp_seconds(F.col(B.KEY) + 10**9).alias("at")
    rows = B.split_rows(spark, sf_dir).select("split", B.KEY, "text", "label", at)
    folder = scratch_path(spark, "stateful-rows")
    half = max(2, B.scan_parts(spark, sf_dir, "documents") // 2)
    rows.repartition(2 * half, F.xxhash64(B.KEY)).write.parquet(folder)
    closing = spark.sql("SELECT 'train' AS split, -1 AS doc_id, 'end' AS text, 0 AS label, timestamp_seconds(10000000000) AS at")
    closing.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields]).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", half).parquet(folder)
    out, ck = scratch_path(spark, "stateful-out"), scratch_path(spark, "stateful-ckpt")
    start_prepare_stateful(stream, B.SPEC, B.KEY, "at", "3650 days", out, ck, class_names=B.CLASS_NAMES).awaitTermination()
    return spark.read.parquet(out).select("split", "doc_id", "instruction", "input", "output")


@query
def stream_late_rows(spark, sf_dir):
    """X4 within a watermark that passes: three arrivals, the last of which
    holds rows older than the watermark; these are dropped.  An arrival is as
    many files as its rows come in and one micro-batch: the query stops after
    each and goes on from its checkpoint."""
    from ..session import scratch_path
    from ..streaming.prepare import one_batch_a_run, start_prepare_within

    lab = B.split_rows(spark, sf_dir)
    most = lab.agg(F.max(B.KEY)).first()[0]
    second = F.floor(F.col(B.KEY) * 1000 / F.lit(most)).cast("bigint")
    rows = lab.select("split", B.KEY, "text", "label", F.timestamp_seconds(second + 10**9).alias("at"))
    folder, last = scratch_path(spark, "late-rows"), F.col(B.KEY) % 10
    out, ck = scratch_path(spark, "late-out"), scratch_path(spark, "late-ckpt")
    for part in (last < 8, last == 8, last == 9):
        rows.filter(part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        with one_batch_a_run(spark):
            start_prepare_within(stream, B.SPEC, B.KEY, "at", "600 seconds", out, ck, class_names=B.CLASS_NAMES).awaitTermination()
    return spark.read.parquet(out).select("split", "input", "output")


@query
def stream_labels(spark, sf_dir):
    """X4 with labels as a stream of their own: a label up to 300 seconds after
    its text joins, a later one does not."""
    from ..operators.splits import canonical_splits
    from ..session import scratch_path
    from ..streaming.prepare import rocksdb_state, trigger
    from ..streaming.stateful import labelled_stream

    at = F.timestamp_seconds(F.col(B.KEY) + 10**9)
    texts = B.stream_table(spark, sf_dir, "documents").select(B.KEY, "text", at.alias("text_at"))
    labels = B.stream_table(spark, sf_dir, "labels").select(
        B.KEY, F.col("toxic").alias("label"), F.timestamp_seconds(F.col(B.KEY) + 10**9 + F.col(B.KEY) % 50 * 10).alias("label_at")
    )
    joined = labelled_stream(texts, labels, B.KEY, "text_at", "label_at", "300 seconds")
    recs = to_records(canonical_splits(joined, B.KEY, B.SPEC.seed), B.SPEC, key=B.KEY, class_names=B.CLASS_NAMES, dedup=False)
    out, ck = scratch_path(spark, "labelled-out"), scratch_path(spark, "labelled-ckpt")
    with rocksdb_state(spark):
        trigger(recs.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck), True).start().awaitTermination()
    return spark.read.parquet(out).select("split", "doc_id", "input", "output")


@query
def stream_requests(spark, sf_dir):
    """X1 from the replayable request log: two batches, a stop, a third batch
    and a restart from the checkpoint; every request is answered once."""
    from ..session import scratch_path
    from ..streaming.prepare import trigger
    from ..streaming.requests import RequestLog, append_requests
    from ..streaming.serve import validate_requests as vr

    conv = B.table(spark, sf_dir, "conversations")
    number = F.col("conv_id") + F.col("turn")
    requests = conv.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "text", _request_mode(F.pmod(number, F.lit(4))).alias("mode")
    )
    folder, out, ck = (scratch_path(spark, n) for n in ("request-log", "request-answers", "request-ckpt"))
    spark.dataSource.register(RequestLog)
    third = F.pmod(F.col("request_id"), F.lit(3))

    def run():
        stream = vr(spark.readStream.format("request_log").load(folder))
        trigger(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck), True).start().awaitTermination()

    append_requests(requests.filter(third == 0), folder)
    append_requests(requests.filter(third == 1), folder)
    run()
    append_requests(requests.filter(third == 2), folder)
    run()
    run()
    return spark.read.parquet(out).select("request_id", "mode", "accepted", "reason")
