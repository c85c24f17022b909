import os

from pyspark.sql import functions as F

from labelwise.operators.fit import fit_token_weights
from labelwise.operators.score import LexiconScorer, PandasScorer, parse_modes, run_modes, score
from labelwise.plans import bindings as B
from labelwise.spec import ENGLISH_REVIEWS as EN
from labelwise.streaming.serve import serve_batch

SF = "/root/testdata/sf0.001"


def _model():
    return lambda text: "negative" if "bad" in text else "positive, I think"


def test_pandas_scorer(spark):
    df = spark.createDataFrame([(1, "so bad", EN.negative), (2, "fine", EN.positive)], "row_idx bigint, input string, output string")
    p = {r["index"]: r for r in score(df, PandasScorer(_model), "ext", EN).collect()}
    assert p[1].predicted == EN.negative and p[2].predicted == EN.positive and p[2].raw_output == "positive, I think"
    assert all(r.latency_sec >= 0 for r in p.values())


def test_modes_parse_and_validate(spark):
    assert parse_modes(" base, ,tuned,base ") == ["base", "tuned"]
    df = spark.createDataFrame([(1, "x", EN.positive)], "row_idx bigint, input string, output string")
    try:
        run_modes(df, {"base": LexiconScorer(EN, ["bad"])}, "base,nope", EN)
    except ValueError as e:
        assert "nope" in str(e)
    else:
        raise AssertionError("unknown mode accepted")


def test_fit_and_score_partition_invariant(spark):
    recs = B.records(spark, SF)
    train = recs.filter(F.col("split") == "train")
    w1 = fit_token_weights(train.coalesce(1), EN, min_df=2, min_weight=0.5)
    w8 = fit_token_weights(train.repartition(8), EN, min_df=2, min_weight=0.5)
    t1 = sorted(map(tuple, w1.table(spark).collect()))
    t8 = sorted(map(tuple, w8.table(spark).collect()))
    assert t1 == t8 and len(t1) > 0
    s1 = sorted((r.row_idx if "row_idx" in r else r.doc_id, r.raw_output) for r in w1.apply(recs.coalesce(1), "doc_id", "input").collect())
    s8 = sorted((r.row_idx if "row_idx" in r else r.doc_id, r.raw_output) for r in w8.apply(recs.repartition(8), "doc_id", "input").collect())
    assert s1 == s8


def test_stream_twins_equal_batch(spark):
    from labelwise.plans.queries import QUERIES

    ws = B.Workspace.of(spark, SF)
    batch_req = QUERIES["stream_scoring"].__globals__["_doc_requests"](spark, SF, False)
    ok, bad = serve_batch(batch_req, ws.scorers(), EN, latency=B.latency_standin())
    s_ok = QUERIES["stream_scoring"](spark, SF)
    s_bad = QUERIES["stream_rejects"](spark, SF)
    key = lambda df, cols: sorted(map(tuple, df.select(*cols).collect()))
    assert key(ok, ["request_id", "mode", "label"]) == key(s_ok, ["request_id", "mode", "label"])
    assert key(bad, ["request_id", "reason"]) == key(s_bad, ["request_id", "reason"])
    prep = QUERIES["prepare_records"](spark, SF)
    sprep = QUERIES["stream_prepare"](spark, SF)
    assert key(prep, prep.columns) == key(sprep, prep.columns)
    from labelwise.operators.evaluate import counts

    c = counts(ws.predictions(), EN).drop("latency_sum")
    sc = QUERIES["stream_metrics"](spark, SF)
    cols = ["mode", "total", "n_correct", "pos_as_pos", "neg_as_neg"]
    assert key(c, cols) == key(sc, cols)


def test_external_scorer_checks_before_running(spark):
    df = spark.createDataFrame([(1, "x", EN.positive)], "row_idx bigint, input string, output string")

    def missing():
        raise FileNotFoundError("model artefact not found: /nowhere")

    try:
        score(df, PandasScorer(_model, check=missing), "ext", EN)
    except FileNotFoundError as e:
        assert "/nowhere" in str(e)
    else:
        raise AssertionError("check did not run")


def test_stream_prepare_first_wins_across_batches(spark, tmp_dir):
    """Duplicates split over micro-batches and arriving in reverse key
    order still keep the smallest key; the dedup state lives in RocksDB."""
    from labelwise.operators.prepare import to_records
    from labelwise.streaming.prepare import ROCKSDB_PROVIDER, prepared, start_prepare

    rows = [(k, "same text" if k % 3 else f"text {k}", k % 2, "train") for k in range(30, 0, -1)]
    schema = "doc_id bigint, text string, label int, split string"
    src = os.path.join(tmp_dir, "x4-src")
    for i in range(3):  # one file per micro-batch, later files hold smaller keys
        spark.createDataFrame(rows[i * 10 : (i + 1) * 10], schema).coalesce(1).write.parquet(f"{src}/f{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out, ck = os.path.join(tmp_dir, "x4-out"), os.path.join(tmp_dir, "x4-ck")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    for q in start_prepare(stream, EN, "doc_id", out, ck, class_names=None, compact_every=1):
        q.awaitTermination()
    assert spark.conf.get(provider, None) == before  # the caller's settings stay
    with open(f"{ck}/firsts/offsets/0") as f:
        assert ROCKSDB_PROVIDER in f.read()
    assert spark.read.parquet(f"{out}/bases").select("upto").distinct().count() >= 1
    got = sorted(map(tuple, prepared(spark, out, "doc_id").select("doc_id", "input", "output").collect()))
    want = to_records(spark.createDataFrame(rows, schema), EN, key="doc_id")
    assert got == sorted(map(tuple, want.select("doc_id", "input", "output").collect()))
    assert [k for k, t, _ in got if t == "same text"] == [1, 2]  # first of each label wins


def test_stream_prepare_continuous_trigger(spark, tmp_dir):
    """X4 with processing-time triggers: both queries run side by side, the
    dedup query trailing the staging table; the result equals the batch."""
    from labelwise.operators.prepare import to_records
    from labelwise.streaming.prepare import prepared, start_prepare

    rows = [(k, f"t{k % 4}", k % 2, "train") for k in range(40, 0, -1)]
    schema = "doc_id bigint, text string, label int, split string"
    src = os.path.join(tmp_dir, "x4c-src")
    for i in range(2):
        spark.createDataFrame(rows[i * 20 : (i + 1) * 20], schema).coalesce(1).write.parquet(f"{src}/f{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out, ck = os.path.join(tmp_dir, "x4c-out"), os.path.join(tmp_dir, "x4c-ck")
    q1, q2 = start_prepare(stream, EN, "doc_id", out, ck, available_now=False)
    try:
        q1.processAllAvailable()
        q2.processAllAvailable()
    finally:
        q1.stop()
        q2.stop()
    got = sorted(map(tuple, prepared(spark, out, "doc_id").select("doc_id", "input", "output").collect()))
    want = to_records(spark.createDataFrame(rows, schema), EN, key="doc_id")
    assert got == sorted(map(tuple, want.select("doc_id", "input", "output").collect())) and len(got) == 4


def test_stream_prepare_keys_numbered_per_split(spark, tmp_dir):
    """The same key in two splits names two rows; bases change nothing."""
    from labelwise.operators.prepare import to_records
    from labelwise.streaming.prepare import prepared, start_prepare

    rows = [(0, "a", 1, "train"), (1, "a", 1, "train"), (0, "b", 1, "test"), (1, "c", 1, "test"), (2, "c", 1, "test")]
    schema = "row_idx bigint, text string, label int, split string"
    src = os.path.join(tmp_dir, "x4k-src")
    for i, r in enumerate(reversed(rows)):
        spark.createDataFrame([r], schema).write.parquet(f"{src}/f{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    want = [("test", 0, "b"), ("test", 1, "c"), ("train", 0, "a")]
    for every in (1, 2, 50):
        out, ck = os.path.join(tmp_dir, f"x4k-out{every}"), os.path.join(tmp_dir, f"x4k-ck{every}")
        for q in start_prepare(stream, EN, "row_idx", out, ck, compact_every=every):
            q.awaitTermination()
        assert sorted(map(tuple, prepared(spark, out, "row_idx").select("split", "row_idx", "input").collect())) == want
    batch = to_records(spark.createDataFrame(rows, schema), EN, key="row_idx")
    assert sorted(map(tuple, batch.select("split", "row_idx", "input").collect())) == want


def test_stream_prepare_within_a_watermark(spark, tmp_dir):
    from labelwise.streaming.prepare import start_prepare_within

    src = os.path.join(tmp_dir, "x4w-src")
    schema = "row_idx bigint, text string, label int, split string, at timestamp"
    day = "2024-01-0{} 00:00:00"
    parts = [[(1, "a", 1, 1), (2, "b", 1, 1)], [(3, "a", 1, 2), (4, "a", 0, 2)], [(5, "c", 1, 9)], [(8, "d", 1, 9)], [(6, "a", 1, 9), (7, "b", 1, 1)]]
    for i, part in enumerate(parts):
        df = spark.createDataFrame([(k, t, y, "train", day.format(d)) for k, t, y, d in part], schema.replace("timestamp", "string"))
        df.withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{src}/f{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out, ck = os.path.join(tmp_dir, "x4w-out"), os.path.join(tmp_dir, "x4w-ck")
    start_prepare_within(stream, EN, "row_idx", "at", "3 days", out, ck).awaitTermination()
    got = sorted(r.row_idx for r in spark.read.parquet(out).collect())
    # 3 repeats 1 in time; 6 repeats it after its state has gone; 7 is too late
    assert got == [1, 2, 4, 5, 6, 8]


def _says(answer):
    def build():
        return lambda text: answer

    return build


def test_models_from_one_function_stay_apart(spark):
    df = spark.createDataFrame([(i, "x", EN.positive) for i in range(8)], "row_idx bigint, input string, output string")
    scorers = {"base": PandasScorer(_says(EN.positive)), "tuned": PandasScorer(_says(EN.negative))}
    for _ in range(2):
        got = {(r.mode, r.predicted) for r in run_modes(df, scorers, "base,tuned", EN).collect()}
        assert got == {("base", EN.positive), ("tuned", EN.negative)}


def test_batched_model_and_repeated_ids(spark):
    rows = [(1, "so bad", EN.negative), (1, "fine", EN.positive), (1, "fine", EN.positive), (2, "bad", EN.positive)]
    df = spark.createDataFrame(rows, "row_idx bigint, input string, output string")
    batched = PandasScorer(lambda: lambda texts: ["negative" if "bad" in t else "positive" for t in texts], batched=True)
    assert sorted((r["index"], r.predicted) for r in score(df, batched, "m", EN).collect()) == [
        (1, "negative"), (1, "positive"), (1, "positive"), (2, "negative")
    ]
    train = spark.createDataFrame([(i, "bad" if i % 2 else "fine", EN.negative if i % 2 else EN.positive) for i in range(40)], "row_idx bigint, input string, output string")
    w = fit_token_weights(train, EN, min_df=2, min_weight=0.5)
    for keep in (True, False):
        got = sorted((r["index"], r.predicted, r.expected) for r in score(df, w, "m", EN, keep_input=keep).collect())
        assert got == [(1, "negative", "negative"), (1, "positive", "positive"), (1, "positive", "positive"), (2, "negative", "positive")]


def test_signals_must_not_contain_opposites():
    import pytest

    with pytest.raises(ValueError, match="opposite"):
        EN.with_(negative_signals=("unfavourable",))
