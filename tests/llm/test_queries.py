"""Registered queries and the pipeline on the smallest tables."""

import os
import random

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from labelwise.llm import simhash
from labelwise.llm.queries import QUERIES, SQL
from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    res = duck.execute(SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"op8_benchmark_decontamination", "op10_license_scans"}))
def test_every_document_answers(spark, duck, name):
    ids = {r[0] for r in QUERIES[name](spark, SF).select("doc_id").collect()}
    assert ids == {r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall()}


def test_leaks_are_the_copied_items(spark, duck):
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_benchmark_decontamination"](spark, SF).collect()}
    whole = set(duck.execute("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)").fetchall())
    assert whole <= got


def test_pipeline_stages(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns
        before, after = ({tuple(r) for r in x.collect()} for x in (now, out))
        assert after <= before
        seen[name] = {r[0] for r in before} - {r[0] for r in after}
        now = spark.createDataFrame(sorted(after), docs.schema)
    good = {r[0] for r in duck.execute("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND len(string_split(text, ' ')) > 60").fetchall()}
    assert len(good & seen["quality_rules"]) <= 0.05 * len(good)
    assert len(good & seen["language_id"]) <= 0.02 * len(good)
    # what is left has neither linked fingerprints nor whole items
    assert simhash.near_duplicates(now).select("component_id").distinct().count() == now.count()
    items = [r[0] for r in duck.execute("SELECT text FROM benchmark").fetchall()]
    assert not any(i in r["text"] for r in now.collect() for i in items)
    packed = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in now.collect()}


def test_pipeline_on_empty_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for frame in (docs.limit(0), odd):
        now = frame
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        assert now.count() >= 0


def test_language_stage_rejects_texts_of_no_learned_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    first = {}
    for r in rows:
        if len(r[1] or "") > 400:
            first.setdefault(r[2], r[1])
    strange = [
        " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(80)),
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "все люди рождаются свободными и равными в своем достоинстве и правах",
        "def f(x):\n    return {k: v for k, v in x.items() if v is not None}\n" * 3,
        "12345 !!",
        "",
        None,
    ]
    mixed = [first["fr"] + " " + first["de"], first["en"] + "\n" + first["es"]]
    added = [(10**9 + i, t, None, "s", 0) for i, t in enumerate(strange + mixed)]
    frame = spark.createDataFrame(rows + added, docs.schema)
    left = {r[0] for r in corpus_pipeline.language_id(spark, frame, SF).select("doc_id").collect()}
    assert {i for i in left if i >= 10**9} == {10**9 + len(strange) + k for k in range(len(mixed))}
    words = {r[0] for r in rows if len(r[1] or "") > 400}
    assert len(words - left) <= 0.01 * len(words)
    unlabelled = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(["12 34", "", None, "a word"])], docs.schema)
    assert [r[0] for r in corpus_pipeline.language_id(spark, unlabelled, SF).collect()] == [3]
