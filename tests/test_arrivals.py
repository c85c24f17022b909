"""Arrivals of the streams over stored tables, built from rows of the test."""

import glob

import duckdb
import pytest

import __spark_entry__ as E
from labelwise.session import local_path, shared_dir


@pytest.fixture()
def large(spark, tmp_dir):
    """A table that six tasks read, with repeats, empty and null texts."""
    texts = [None if i % 97 == 0 else " \n" if i % 89 == 0 else f"text {i % 700} of {'many ' * (i % 7)}words" for i in range(2000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for part in range(6):
        docs.filter(f"doc_id DIV 350 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_dir}/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2, i // 3 % 2) for i in range(2000)], "doc_id long, quality int, toxic int")
    labels.coalesce(1).write.parquet(f"{tmp_dir}/labels.parquet")
    return tmp_dir


@pytest.mark.parametrize("name, folder, files", [("stream_late_rows", "late-rows", 18), ("stream_prepare_stateful", "stateful-rows", 7)])
def test_arrivals_are_written_by_several_tasks(spark, large, name, folder, files):
    base = local_path(shared_dir(spark))
    seen = set(glob.glob(f"{base}/{folder}-*"))
    df = E.queries()[name](spark, large)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{large}/{t}.parquet/*.parquet')")
    want = con.execute(E.oracle_sql()[name]).fetchall()
    assert len(want) > 500
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    (new,) = set(glob.glob(f"{base}/{folder}-*")) - seen
    assert len(glob.glob(f"{new}/*.parquet")) >= files


def test_settings_come_back_after_the_runs(spark):
    from labelwise.streaming.prepare import one_batch_a_run

    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    with pytest.raises(KeyError), one_batch_a_run(spark):
        assert spark.conf.get(name) == "false"
        raise KeyError
    assert spark.conf.get(name) == before
