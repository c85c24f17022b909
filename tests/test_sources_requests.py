import json
import os

import pytest
from pyspark.sql import functions as F

from labelwise.sources import registry as R
from labelwise.sources.readers import read_first, read_jsonl, read_optional
from labelwise.sources.sinks import json_document, publish, write_predictions, write_records
from labelwise.streaming.serve import validate_requests


def _write(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_jsonl_skips_blank_lines_and_limits(spark, tmp_dir):
    p = os.path.join(tmp_dir, "a.jsonl")
    _write(p, ['{"input": "a", "output": "x"}', "   ", "", "\t", "\u3000\u2003", '{"input": "b", "output": "y"}', '{"input": "c", "output": "z"}'])
    df = read_jsonl(spark, p, "input string, output string")
    assert [(r.row_idx, r.input) for r in df.orderBy("row_idx").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert [r.input for r in read_jsonl(spark, p, "input string, output string", limit=2).orderBy("row_idx").collect()] == ["a", "b"]


def test_jsonl_broken_line_fails(spark, tmp_dir):
    p = os.path.join(tmp_dir, "b.jsonl")
    _write(p, ['{"input": "a"}', '{"input": '])
    with pytest.raises(Exception):
        read_jsonl(spark, p, "input string").collect()


def test_prediction_sink_keeps_null(spark, tmp_dir):
    rows = [("base", 0, "t", "正面", "?", None, 0.5)]
    df = spark.createDataFrame(rows, "mode string, index bigint, input string, expected string, raw_output string, predicted string, latency_sec double")
    out = os.path.join(tmp_dir, "preds")
    write_predictions(df, out)
    text = [r.value for r in spark.read.text(out).collect()]
    assert len(text) == 1 and '"predicted":null' in text[0] and "正面" in text[0]
    assert set(json.loads(text[0])) == {"index", "input", "expected", "raw_output", "predicted", "latency_sec"}


def test_record_sink_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([("train", 1, "评论", "正面")], "split string, row_idx bigint, input string, output string")
    out = os.path.join(tmp_dir, "recs")
    write_records(df, out)
    back = read_jsonl(spark, out, "row_idx bigint, input string, output string", key="row_idx").collect()
    assert [(r.split, r.row_idx, r.input, r.output) for r in back] == [("train", 1, "评论", "正面")]


def test_read_first_falls_back_and_reports(spark, tmp_dir):
    good = os.path.join(tmp_dir, "good")
    spark.range(3).write.parquet(good)
    assert read_first(spark, [os.path.join(tmp_dir, "missing"), good]).count() == 3
    with pytest.raises(RuntimeError, match="missing"):
        read_first(spark, [os.path.join(tmp_dir, "missing")])
    with pytest.raises(RuntimeError):
        read_first(spark, [good], explicit=os.path.join(tmp_dir, "missing"))


def test_optional_table_and_publish(spark, tmp_dir):
    assert read_optional(spark, os.path.join(tmp_dir, "none"), "a int").count() == 0
    src = os.path.join(tmp_dir, "src")
    spark.range(4).write.parquet(src)
    assert publish(spark, src, os.path.join(tmp_dir, "dst")).count() == 4
    with pytest.raises(FileNotFoundError):
        publish(spark, os.path.join(tmp_dir, "nope"), os.path.join(tmp_dir, "dst2"))


def test_registry_upsert(spark, tmp_dir):
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    old = R.entries(names(["a", "b"]), F.concat(F.col("name"), F.lit(".jsonl")))
    new = R.entries(names(["b", "c"]), F.concat(F.col("name"), F.lit("_v2.jsonl")))
    got = {r.name: r.file_name for r in R.upsert(old, new).collect()}
    assert got == {"a": "a.jsonl", "b": "b_v2.jsonl", "c": "c_v2.jsonl"}
    missing = R.read_registry(spark, os.path.join(tmp_dir, "no-registry"))
    assert {r.name for r in R.upsert(missing, new).collect()} == {"b", "c"}
    recs = spark.createDataFrame([("i", "t", "o")], "instruction string, input string, output string")
    assert R.mapped_columns(recs).columns == ["prompt", "query", "response"]


def test_json_document(spark):
    df = spark.createDataFrame([("train", 2), ("test", 1)], "split string, records bigint")
    assert json.loads(json_document(df, key="split").first().json) == {"test": {"records": 1}, "train": {"records": 2}}


@pytest.mark.parametrize(
    "text,mode,accepted,resolved",
    [
        ("", None, False, "tuned"),
        (" ", None, True, "tuned"),
        ("x" * 2000, "base", True, "base"),
        ("x" * 2001, "base", False, "base"),
        ("ok", "x", False, "x"),
        ("ok", None, True, "tuned"),
    ],
)
def test_request_validation(spark, text, mode, accepted, resolved):
    df = spark.createDataFrame([(1, text, mode)], "request_id bigint, text string, mode string")
    r = validate_requests(df).first()
    assert r.accepted == accepted and r.mode == resolved
    assert (r.reason is None) == accepted


def test_registries_are_updated_one_by_one(spark, tmp_dir):
    entry = lambda n, f: R.entries(spark.createDataFrame([(n,)], "name string"), F.lit(f))
    a, b, a2, b2, c2 = (os.path.join(tmp_dir, x) for x in ("a", "b", "a2", "b2", "c2"))
    R.write_registry(entry("mine", "m"), a)
    R.write_registry(entry("theirs", "t"), b)
    R.upsert_all(entry("new", "n"), {a: a2, b: b2, os.path.join(tmp_dir, "absent"): c2})
    names = lambda p: {r.name for r in R.read_registry(spark, p).collect()}
    assert names(a2) == {"mine", "new"} and names(b2) == {"theirs", "new"} and names(c2) == {"new"}


def test_publish_keeps_partition_folders(spark, tmp_dir):
    src, dst = os.path.join(tmp_dir, "parts"), os.path.join(tmp_dir, "published")
    spark.createDataFrame([("a", 1), ("b", 2)], "split string, x int").write.partitionBy("split").parquet(src)
    assert sorted(map(tuple, publish(spark, src, dst).select("split", "x").collect())) == [("a", 1), ("b", 2)]
    assert sorted(x for x in os.listdir(dst) if "=" in x) == ["split=a", "split=b"]


def test_wrong_shape_is_skipped_and_other_errors_raise(spark, tmp_dir):
    wrong, right = os.path.join(tmp_dir, "wrong"), os.path.join(tmp_dir, "right")
    spark.range(2).write.parquet(wrong)
    spark.createDataFrame([("x",)], "text string").write.parquet(right)
    assert read_first(spark, [wrong, right], require=[("text", "review")]).columns == ["text"]
    with pytest.raises(RuntimeError, match="no column of text/review"):
        read_first(spark, [wrong], require=[("text", "review")])
    with pytest.raises(Exception, match="no_such_format"):
        read_first(spark, [right], fmt="no_such_format")


def test_jsonl_positions_across_files(spark, tmp_dir):
    d = os.path.join(tmp_dir, "multi")
    os.makedirs(d)
    _write(os.path.join(d, "part-b.jsonl"), [json.dumps({"v": f"b{i}"}) for i in range(300)])
    _write(os.path.join(d, "part-a.jsonl"), [json.dumps({"v": f"a{i}"}) for i in range(5)] + ["", "  "])
    got = [(r.row_idx, r.v) for r in read_jsonl(spark, d, "v string").orderBy("row_idx").collect()]
    want = [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(300)]
    assert got == list(enumerate(want))
    assert [r.v for r in read_jsonl(spark, d, "v string", limit=7).orderBy("row_idx").collect()] == want[:7]


def test_keyed_jsonl_limit_keeps_smallest_keys(spark, tmp_dir):
    p = os.path.join(tmp_dir, "keyed.jsonl")
    _write(p, [json.dumps({"k": k, "v": f"x{k}"}) for k in (9, 3, 7, 1, 5)] + ["  "])
    got = sorted(r.k for r in read_jsonl(spark, p, "k bigint, v string", key="k", limit=3).collect())
    assert got == [1, 3, 5]
