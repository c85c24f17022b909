"""Versioned tables, learned vocabularies, the second fitter, large weights
and failure isolation."""

import os
import random
import threading
import time
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwise.functions import bloom
from labelwise.operators import logistic, vocabulary
from labelwise.operators.fit import fit_token_weights
from labelwise.operators.score import PandasScorer, isolated, score
from labelwise.plans import bindings as B
from labelwise.sources import registry as R
from labelwise.sources.sinks import publish_version
from labelwise.sources.versions import Overtaken, VersionedTable
from labelwise.spec import ENGLISH_REVIEWS as EN

SF = "/root/testdata/sf0.001"


# --- versions --------------------------------------------------------------------


def _entries(spark, *names):
    return R.entries(spark.createDataFrame([(n,) for n in names], "name string"), F.concat("name", F.lit(".jsonl")))


def _names(df):
    return sorted(r["name"] for r in df.select("name").collect())


def test_readers_see_old_or_new(spark, tmp_dir):
    table = VersionedTable(spark, f"{tmp_dir}/t")
    assert table.current() is None and _names(table.read(R.REGISTRY_SCHEMA)) == []
    with pytest.raises(FileNotFoundError):
        table.read()
    one = R.upsert_version(table, _entries(spark, "a", "b"))
    frame = table.read()
    two = R.upsert_version(table, _entries(spark, "b", "c"))
    assert (one.number, two.number) == (1, 2)
    assert _names(frame) == ["a", "b"] and _names(table.read()) == ["a", "b", "c"]
    assert _names(table.read(at=one)) == ["a", "b"]
    assert table.is_current(two) and not table.is_current(one)


def test_overtaken_writers_lose_nothing(spark, tmp_dir):
    table = VersionedTable(spark, f"{tmp_dir}/t")
    base = R.upsert_version(table, _entries(spark, "base"))
    table.write(R.upsert(table.read(), _entries(spark, "x")), base)
    with pytest.raises(Overtaken):
        table.write(R.upsert(table.read(at=base), _entries(spark, "y")), base)
    assert _names(table.read()) == ["base", "x"]
    writers = [threading.Thread(target=R.upsert_version, args=(table, _entries(spark, f"w{i}"))) for i in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert _names(table.read()) == ["base", *[f"w{i}" for i in range(4)], "x"]
    assert [v.number for v in table.versions()] == list(range(1, 7))


def test_old_versions_and_orphans_go(spark, tmp_dir):
    table = VersionedTable(spark, f"{tmp_dir}/t", keep=2, grace=0.0)
    for i in range(4):
        table.replace(spark.range(i + 1))
        time.sleep(0.05)
    assert [v.number for v in table.versions()] == [3, 4]
    assert len(os.listdir(f"{tmp_dir}/t/data")) == 2 and table.read().count() == 4
    os.makedirs(f"{tmp_dir}/t/data/left-by-a-dead-writer")
    time.sleep(1.1)
    table.prune()
    assert "left-by-a-dead-writer" not in os.listdir(f"{tmp_dir}/t/data")
    with pytest.raises(ValueError):
        VersionedTable(spark, f"{tmp_dir}/t", keep=1)


def test_publish_version_keeps_partition_folders(spark, tmp_dir):
    spark.range(6).withColumn("split", F.when(F.col("id") < 2, "a").otherwise("b")).write.partitionBy("split").parquet(f"{tmp_dir}/source")
    table = VersionedTable(spark, f"{tmp_dir}/target")
    version = publish_version(spark, f"{tmp_dir}/source", table)
    assert {n for n in os.listdir(version.path) if n.startswith("split=")} == {"split=a", "split=b"}
    assert table.read().count() == 6
    with pytest.raises(FileNotFoundError):
        publish_version(spark, f"{tmp_dir}/absent", table)


# --- vocabulary ------------------------------------------------------------------


def _bags(seed=2, n=300):
    rng = random.Random(seed)
    words = [f"t{int(rng.paretovariate(0.8))}" for _ in range(500)] + ["é", "", "x" * 400]
    rows = [(i, [rng.choice([*words, "the", "the", "the"]) for _ in range(rng.randrange(30))]) for i in range(n)]
    return rows + [(n, None), (n + 1, []), (n + 2, [None, "the", None]), (n + 2, ["unheard of"])]


def test_vocabulary_ids_are_dense_and_by_count(spark):
    rows = _bags()
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    counts = Counter(t for _, ts in rows for t in ts or [] if t is not None)
    want = [t for t, n in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode())) if n >= 2]
    for parts in (1, 6):
        voc = vocabulary.learn_vocabulary(df.repartition(parts), F.col("tokens"), min_count=2, first_id=5)
        table = voc.table(spark).orderBy("id").collect()
        assert [(r["token"], r["id"], r["n"]) for r in table] == [(t, 5 + i, counts[t]) for i, t in enumerate(want)]
        assert voc.size == len(want)
    top = vocabulary.learn_vocabulary(df, F.col("tokens"), size=3)
    assert [r["token"] for r in top.table(spark).orderBy("id").collect()] == want[:3]
    with pytest.raises(ValueError):
        vocabulary.learn_vocabulary(df, F.col("tokens"), first_id=0)


@pytest.mark.parametrize("frequent", [1 << 15, 2])
def test_both_lookups_agree_and_decode(spark, monkeypatch, frequent):
    monkeypatch.setattr(vocabulary, "FREQUENT", frequent)
    rows = _bags(5)
    df = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(4)
    voc = vocabulary.learn_vocabulary(df, F.col("tokens"), min_count=2)
    ids = {r["token"]: r["id"] for r in voc.table(spark).collect()}
    key = lambda r: (r[0], str(r[1]))
    want = sorted(((i, None if ts is None else [ids.get(t, 0) for t in ts]) for i, ts in rows), key=key)
    near = voc.encode(df, "tokens", broadcast=True)
    far = voc.encode(df, "tokens", broadcast=False)
    assert sorted(((r["id"], r["ids"]) for r in near.collect()), key=key) == want
    assert sorted(((r["id"], r["ids"]) for r in far.collect()), key=key) == want
    for r in voc.decode(near, "ids", "back").collect():
        assert r["back"] == (None if r["tokens"] is None else [t if t in ids else None for t in r["tokens"]])
    with pytest.raises(ValueError):
        replace(voc, n_bytes=1 << 40).ids(spark)


# --- second fitter ---------------------------------------------------------------


def test_logistic_against_a_dense_solution(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{j}" for j in np.flatnonzero(rng.random(12) < 0.3)) for _ in range(300)]
    labels = [EN.negative if ("w3" in t.split()) != (rng.random() < 0.1) else EN.positive for t in texts]
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, labels, strict=True))], "row_idx long, input string, output string")
    one = logistic.fit_logistic(df.coalesce(1), EN, bits=6, l2=1e-2, tolerance=1e-7)
    many = logistic.fit_logistic(df.repartition(8), EN, bits=6, l2=1e-2, tolerance=1e-7)
    assert one.steepest <= 1e-7 and many.steepest <= 1e-7 and abs(one.loss - many.loss) < 1e-9
    weights = lambda m: {r["feature"]: r["weight"] for r in m.table(spark).collect()}
    a, b = weights(one), weights(many)
    assert all(abs(a.get(f, 0) - b.get(f, 0)) <= 1 for f in a.keys() | b.keys()) and abs(one.bias - many.bias) <= 1
    # the optimum: gradient zero in a dense computation
    feats = [r["f"] for r in df.orderBy("row_idx").select(logistic.hashed_features(F.col("input"), 6).alias("f")).collect()]
    x = np.zeros((300, 64))
    for i, f in enumerate(feats):
        x[i, f] = 1
    y = np.array([1.0 if t == EN.positive else -1.0 for t in labels])
    w = np.array([a.get(i, 0) for i in range(64)]) / one.scale
    pull = -y / (1 + np.exp(y * (x @ w + one.bias / one.scale)))
    assert np.abs(x.T @ pull / 300 + 1e-2 * w).max() < 1e-5 and abs(pull.mean()) < 1e-5
    got = {r["index"]: r["predicted"] for r in score(df, one, "m", EN).collect()}
    margin = x @ w + one.bias / one.scale
    assert all((got[i] == EN.positive) == (margin[i] >= 0) for i in range(300) if abs(margin[i]) > 1e-6)


def test_logistic_needs_both_classes(spark):
    df = spark.createDataFrame([("a", EN.positive), (None, EN.positive)], "input string, output string")
    with pytest.raises(ValueError):
        logistic.fit_logistic(df, EN, bits=4)


# --- large weights ---------------------------------------------------------------


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    blocks = bloom.blocks_for(5000)
    table = bloom.build(keys, F.col("k"), blocks)
    asked = spark.range(20_000).select("id", F.concat(F.lit("k"), F.col("id")).alias("k"))
    hit = {r["id"] for r in bloom.maybe_in(asked, F.col("k"), table, blocks, "hit").filter("hit").collect()}
    assert set(range(5000)) <= hit and len(hit) < 5000 + 0.03 * 15_000
    assert bloom.blocks_for(1) == 1 and bloom.blocks_for(10**12) * bloom.BLOCK == bloom.MOST_BITS
    assert bloom.maybe_in(asked, F.lit(None).cast("string"), table, blocks, "hit").count() == 20_000


def test_large_weights_score_alike_and_shuffle_few_pairs(spark):
    recs = B.records(spark, SF)
    w = fit_token_weights(recs, EN, min_df=2, min_weight=0.7)
    large = replace(w, n_bytes=None)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "..."), (-3, "...")], "doc_id long, input string")
    rows = recs.select("doc_id", "input").unionByName(odd)
    scores = lambda m: sorted(map(tuple, m.scores(rows, "doc_id", "input").collect()))
    assert scores(w) == scores(large)
    marked = rows.withColumn("__row", F.monotonically_increasing_id())
    kept = large.weighted_pairs(marked, "input", ["__row"]).count() - rows.count()
    tokens = {r["token"] for r in w.table(spark).collect()}
    pairs = marked.select(F.explode(F.array_distinct(w.tokens(F.col("input")))).alias("token"))
    exact, every = pairs.filter(F.col("token").isin(*tokens)).count(), pairs.count()
    assert exact <= kept <= exact + 0.05 * every and kept < 0.8 * every


# --- failure isolation -----------------------------------------------------------


def _fragile():
    def answers(texts):
        if any("poison" in t for t in texts):
            raise ValueError("cannot read this")
        return [t.upper() for t in texts]

    return answers


def test_isolated_calls_halve_down_to_the_bad_texts():
    calls = []

    def model(texts):
        calls.append(len(texts))
        return _fragile()(texts)

    texts = [f"t{i}" for i in range(64)]
    texts[17] = "poison"
    out = isolated(model, texts)
    assert [a for a, _, _ in out] == [None if t == "poison" else t.upper() for t in texts]
    assert [w for _, _, w in out if w] == ["ValueError: cannot read this"] and out[17][2]
    assert len(calls) <= 1 + 2 * 6
    assert isolated(model, []) == []
    short = isolated(lambda ts: [1], ["a", "b"])
    assert [a for a, _, _ in short] == [1, 1]


def test_one_bad_text_does_not_fail_the_job(spark):
    rows = [(i, "poison" if i % 40 == 3 else f"positive {i}", EN.positive) for i in range(200)]
    df = spark.createDataFrame(rows, "row_idx bigint, input string, output string").repartition(3)
    p = score(df, PandasScorer(_fragile, batched=True, isolate=True, call_rows=32), "m", EN).collect()
    bad = {r["index"]: r["error"] for r in p if r["error"] is not None}
    assert set(bad) == {i for i in range(200) if i % 40 == 3} and set(bad.values()) == {"ValueError: cannot read this"}
    assert all(r["predicted"] is None and not r["correct"] and r["raw_output"] == "" for r in p if r["error"])
    assert all(r["raw_output"].startswith("POSITIVE") for r in p if not r["error"])
    with pytest.raises(Exception, match="cannot read this"):
        score(df, PandasScorer(_fragile, batched=True), "m", EN).collect()
    with pytest.raises(Exception, match="the model failed on"):
        score(df.coalesce(1), PandasScorer(_fragile, batched=True, isolate=True, most_errors=3), "m", EN).collect()


def test_answers_meet_their_rows_by_number(spark):
    recs = B.records(spark, SF).filter(F.col("split") == "train")
    w = fit_token_weights(recs, EN, min_df=2, min_weight=0.5)
    rows = spark.createDataFrame([(1, "worthless moron", EN.negative), (1, "lovely", EN.positive), (1, "lovely", EN.positive)], "row_idx bigint, input string, output string")
    got = score(rows, w, "tuned", EN).collect()
    assert sorted(r["input"] for r in got) == ["lovely", "lovely", "worthless moron"]
