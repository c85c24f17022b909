"""Plan properties the design relies on at scale (checked on small data)."""

import re

from pyspark.sql import functions as F

from labelwise.operators.fit import fit_token_weights, token_counts
from labelwise.operators.prepare import records_from_pair, to_records
from labelwise.operators.report import error_cases
from labelwise.plans import bindings as B
from labelwise.spec import CHINESE_REVIEWS as CN
from labelwise.spec import ENGLISH_REVIEWS as EN

SF = "/root/testdata/sf0.001"


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def exchanges(text: str) -> list[str]:
    """Input column lists of every Exchange node in a formatted plan."""
    blocks = re.split(r"\n\(\d+\) ", text)
    return [b for b in blocks if b.startswith("Exchange")]


def test_token_counts_aggregate_before_shuffle(spark, capsys):
    p = plan(token_counts(B.Workspace.of(spark, SF).split("train"), EN), capsys)
    assert "partial_count" in p
    # tokenised once: the letter-run split appears in one operator only
    assert p.count("split(lower(input") <= 1


def test_tuned_scoring_moves_no_text(spark, capsys):
    ws = B.Workspace.of(spark, SF)
    scored = ws.weights().apply(ws.split("test"), B.KEY, "input")
    p = plan(scored, capsys)
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    for ex in exchanges(p):
        assert "input" not in ex.split("Arguments")[0]


def test_prediction_shuffle_carries_only_needed_columns(spark, capsys):
    """M5 through ``score``: the per-document aggregate shuffles the key,
    the expected label, the latency input and the partial sum -- not the
    instruction or other record columns."""
    from labelwise.operators.score import score

    ws = B.Workspace.of(spark, SF)
    p = plan(score(ws.records(), ws.weights(), "tuned", EN, key=B.KEY, latency=B.latency_standin(), keep_input=False), capsys)
    shuffles = [ex.split("Arguments")[0] for ex in exchanges(p)]
    assert shuffles
    for ex in shuffles:
        assert "instruction" not in ex and "input" not in ex and "split" not in ex


def test_error_cases_limit_before_shuffle(spark, capsys):
    ws = B.Workspace.of(spark, SF)
    p = plan(error_cases(ws.predictions(), EN, texts=ws.test_texts()), capsys)
    assert "WindowGroupLimit" in p and "Partial" in p


def test_dedup_shuffles_digests_not_text(spark, capsys):
    docs = B.table(spark, SF, "documents")
    recs = records_from_pair(docs, B.split_labels(spark, SF), EN, B.KEY, class_names=B.CLASS_NAMES)
    p = plan(recs, capsys)
    agg_exchanges = [ex for ex in exchanges(p) if "__d" in ex]
    assert agg_exchanges and all("text" not in ex.split("Arguments")[0] for ex in agg_exchanges)
    # the optimizer is free to broadcast the small key set: no text moves then
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_hot_text_third_of_rows(spark):
    n = 3000
    rows = [("train", i, "same words" if i % 3 == 0 else f"text {i}", "1" if i % 2 else "0") for i in range(n)]
    df = spark.createDataFrame(rows, "split string, row_idx bigint, text string, label string").repartition(8)
    got = {(r.input, r.output): r.row_idx for r in to_records(df, CN).collect() if r.input == "same words"}
    # one survivor per label, each the smallest key of its group
    assert got == {("same words", CN.negative): 0, ("same words", CN.positive): 3}
    assert to_records(df, CN).count() == 2 + (n - n // 3)


def test_hot_token_in_every_row(spark):
    rows = [(i, f"common {'bad' if i % 2 else 'fine'} w{i % 50}", EN.negative if i % 2 else EN.positive) for i in range(4000)]
    df = spark.createDataFrame(rows, "row_idx bigint, input string, output string").repartition(8)
    w = fit_token_weights(df, EN, min_df=5, min_weight=1.0)
    t = {r.token: r for r in w.table(spark).collect()}
    assert "common" not in t and t["bad"].weight < 0 < t["fine"].weight
    pred = {r.row_idx: r.raw_output for r in w.apply(df, "row_idx", "input").collect()}
    assert all(pred[i] == (EN.negative if i % 2 else EN.positive) for i in range(4000))


def test_scratch_scope_removes_its_folders_only(spark):
    import os

    from labelwise.operators.splits import first_by_key
    from labelwise.session import local_path, scratch_path, scratch_scope, shared_dir

    def folders():
        return set(os.listdir(local_path(shared_dir(spark))))

    outside = scratch_path(spark, "outside")
    spark.range(3).write.parquet(outside)
    before = folders()
    with scratch_scope(spark):
        assert first_by_key(spark.range(50), "id", 7).count() == 7
        with scratch_scope(spark):
            spark.range(3).write.parquet(scratch_path(spark, "inner"))
            during = folders()
        assert len(during - before) == 2 and len(folders() - before) == 1
    assert folders() == before and spark.read.parquet(outside).count() == 3
