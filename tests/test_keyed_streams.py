"""Streams with keyed state, label streams, late rows, the request log, and
what streams leave behind."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from labelwise.operators import chat
from labelwise.sources.files import names_in, numbers_in, remove
from labelwise.spec import ENGLISH_REVIEWS as EN
from labelwise.streaming.metrics import latest, start_metrics
from labelwise.streaming.prepare import prepared, start_prepare, trigger
from labelwise.streaming.requests import RequestLog, append_requests
from labelwise.streaming.stateful import labelled_stream, start_prepare_stateful

ROWS = "split string, doc_id long, text string, label string, at timestamp"


def _at(second):
    return dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=second)


def _add(spark, folder, rows, schema=ROWS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def _run(spark, folder, out, ck, delay="60 seconds"):
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)
    start_prepare_stateful(stream, EN, "doc_id", "at", delay, out, ck).awaitTermination()


def test_each_record_once_whatever_the_order(spark, tmp_dir):
    folder, out, ck = (f"{tmp_dir}/{n}" for n in ("in", "out", "ck"))
    _add(spark, folder, [("train", 9, " same ", "pos", _at(0)), ("train", 5, "other", "neg", _at(1))])
    _add(spark, folder, [("train", 3, "same", "pos", _at(30)), ("test", 4, "same", "pos", _at(31)), ("train", 6, "same", "neg", _at(2))])
    _run(spark, folder, out, ck)
    # nothing may come out before the watermark has passed
    assert names_in(spark, out) == ["_spark_metadata"] or spark.read.schema("doc_id long").parquet(out).count() == 0
    _add(spark, folder, [("train", 2, "same", "pos", _at(50)), ("train", 99, "closing", "pos", _at(100_000))])
    _run(spark, folder, out, ck)  # a restart from the checkpoint
    got = sorted((r["split"], r["doc_id"], r["input"], r["output"]) for r in spark.read.parquet(out).collect())
    assert got == sorted(
        [("train", 2, "same", EN.positive), ("train", 5, "other", EN.negative), ("train", 6, "same", EN.negative), ("test", 4, "same", EN.positive)]
    )
    # older than the watermark: dropped; newer and long after the first: a record of its own
    _add(spark, folder, [("train", 1, "same", "pos", _at(55)), ("train", 8, "same", "pos", _at(99_990))])
    _add(spark, folder, [("train", 100, "closing again", "pos", _at(300_000))])
    _run(spark, folder, out, ck)
    ids = sorted(r["doc_id"] for r in spark.read.parquet(out).collect())
    assert ids == [2, 4, 5, 6, 8, 99]


def test_labels_join_inside_the_delay_only(spark, tmp_dir):
    texts, labels, out, ck = (f"{tmp_dir}/{n}" for n in ("texts", "labels", "out", "ck"))
    t_schema, l_schema = "doc_id long, text string, text_at timestamp", "doc_id long, label string, label_at timestamp"
    _add(spark, texts, [(1, "in time", _at(0)), (2, "late label", _at(0)), (3, "no label", _at(0)), (4, "at the limit", _at(0))], t_schema)
    _add(spark, labels, [(1, "pos", _at(10)), (4, "neg", _at(60)), (7, "pos", _at(5))], l_schema)
    sink = {}

    def run():
        here = spark.readStream.schema(t_schema).option("maxFilesPerTrigger", 1).parquet(texts)
        there = spark.readStream.schema(l_schema).option("maxFilesPerTrigger", 1).parquet(labels)
        joined = labelled_stream(here, there, "doc_id", "text_at", "label_at", "60 seconds", how="left_outer")
        trigger(joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck), True).start().awaitTermination()
        sink["rows"] = {(r["doc_id"], r["label"]) for r in spark.read.parquet(out).collect()}

    run()
    assert sink["rows"] == {(1, "pos"), (4, "neg")}
    _add(spark, labels, [(2, "pos", _at(61)), (99, "pos", _at(100_000))], l_schema)
    _add(spark, texts, [(99, "closing", _at(100_000))], t_schema)
    run()
    assert sink["rows"] == {(1, "pos"), (4, "neg"), (2, None), (3, None), (99, "pos")}


def test_request_log_is_replayed_from_its_offsets(spark, tmp_dir):
    spark.dataSource.register(RequestLog)
    folder, out, ck = (f"{tmp_dir}/{n}" for n in ("log", "out", "ck"))
    make = lambda ids: spark.createDataFrame([(i, f"text {i}", None) for i in ids], "request_id bigint, text string, mode string")

    def run(checkpoint=ck, to=out):
        stream = spark.readStream.format("request_log").load(folder)
        trigger(stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint), True).start().awaitTermination()
        return sorted(r["request_id"] for r in spark.read.parquet(to).collect())

    assert append_requests(make(range(5)).repartition(3), folder) == 1
    assert run() == list(range(5))
    assert append_requests(make(range(5, 9)), folder) == 2
    os.makedirs(f"{folder}/batch=4")  # a writer still at work: no _SUCCESS yet
    assert append_requests(make([9]), folder) == 3
    assert run() == list(range(10)) and run() == list(range(10))
    assert run(f"{tmp_dir}/ck2", f"{tmp_dir}/out2") == list(range(10))


def test_metrics_keep_their_last_versions(spark, tmp_dir):
    schema = "mode string, index bigint, expected string, predicted string, latency_sec double, correct boolean, valid_format boolean"
    folder, out, ck = (f"{tmp_dir}/{n}" for n in ("in", "out", "ck"))
    for i in range(5):
        _add(spark, folder, [("m", i, EN.positive, EN.positive, 0.1, True, True)], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    start_metrics(stream, EN, out, ck, keep=2).awaitTermination()
    assert len(numbers_in(spark, out, "batch_id")) == 2
    assert [r["total"] for r in latest(spark, out).collect()] == [5]
    remove(spark, out)
    assert names_in(spark, out) == []


def test_prepare_forgets_old_logs(spark, tmp_dir):
    folder, out, ck = (f"{tmp_dir}/{n}" for n in ("in", "out", "ck"))
    schema = "split string, doc_id long, text string, label string"
    for i in range(9):
        _add(spark, folder, [("train", 100 - i, f"text {i % 3}", "pos")], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    first, second = start_prepare(stream, EN, "doc_id", out, ck, compact_every=1)
    first.awaitTermination()
    second.awaitTermination()
    bases, logs = numbers_in(spark, f"{out}/bases", "upto"), numbers_in(spark, f"{out}/firsts", "batch_id")
    assert len(bases) <= 3 and min(logs) > bases[0] - 1
    assert sorted(r["doc_id"] for r in prepared(spark, out, "doc_id").collect()) == [92, 93, 94]


def test_null_messages_count_as_empty(spark):
    conv = spark.createDataFrame([(1, 0, None, "hi"), (1, 1, "user", None), (1, 2, "user", "x")], "conv_id long, turn long, role string, text string")
    text = "".join(r["segment"] for r in chat.conversation_segments(conv).orderBy("turn").collect())
    assert [r["prompt_chars"] for r in chat.conversation_summary(conv).collect()] == [len(text)]
    assert chat.conversation_segments(conv).filter("segment IS NULL").count() == 0


@pytest.mark.parametrize("name", ["none", "absent/deeper"])
def test_names_of_absent_folders(spark, tmp_dir, name):
    assert names_in(spark, f"{tmp_dir}/{name}") == [] and numbers_in(spark, f"{tmp_dir}/{name}", "n") == []
