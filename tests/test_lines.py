"""Lines with positions: byte ranges, line ends, limits, changed settings."""

import bz2
import gzip
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from labelwise.operators.ranks import sums_before
from labelwise.sources import lines as L
from labelwise.sources.readers import read_jsonl


def test_every_line_is_owned_by_one_range():
    rng = random.Random(3)
    for _ in range(300):
        text = b"".join(rng.choice([b"a", b"bb", b"\n", b"\r", b"\r\n", b"", b"long " * 9]) for _ in range(rng.randrange(60)))
        width = rng.randrange(1, 12)
        got = []
        for start in range(0, max(len(text), 1), width):
            stream = io.BytesIO(text)
            stream.seek(max(start - 1, 0))
            got += L.lines_between(stream, start, min(start + width, len(text)))
        assert got == text.splitlines()


def test_short_reads_do_not_cut_lines(monkeypatch):
    monkeypatch.setattr(L, "_READ", 3)
    text = b"one line\r\ntwo\r\rfour is a longer line\n\nsix"
    assert list(L.lines_between(io.BytesIO(text), 0, len(text))) == text.splitlines()


@pytest.mark.parametrize("line,blank", [(b"", True), (b" \t", True), ("　 ".encode(), True), (b"\x1c\x1f", True), (b"x", False), ("é".encode(), False), (b"\xff", False)])
def test_blank(line, blank):
    assert L.is_blank(line) == blank


def _numbered(spark, path, **options):
    return [(r.row_idx, r.value) for r in L.numbered_lines(spark, path, **options).orderBy("row_idx").collect()]


def test_positions_with_tiny_ranges_and_partition_folders(spark, tmp_dir):
    rng, want = random.Random(5), []
    for day in (1, 2):
        folder = os.path.join(tmp_dir, "t", f"day={day}")
        os.makedirs(folder)
        for k in range(2):
            rows = [f"{day} {k} {i} " + "x" * rng.randrange(40) for i in range(rng.randrange(30))]
            with open(os.path.join(folder, f"part {k}.txt"), "w", newline="") as f:
                f.write("".join(r + rng.choice(["\n", "\r\n", "\n\n", "\n  \n"]) for r in rows))
            want += [(day, r) for r in rows]
    path = os.path.join(tmp_dir, "t")
    for width in (25, 1 << 20):
        got = L.numbered_lines(spark, path, range_bytes=width).orderBy("row_idx").collect()
        assert [(r.row_idx, r.day, r.value) for r in got] == [(i, d, v) for i, (d, v) in enumerate(want)]
        for limit in (17, len(want) + 5):
            assert _numbered(spark, path, range_bytes=width, limit=limit) == [(i, v) for i, (_, v) in enumerate(want)][:limit]


def test_settings_changed_between_building_and_running(spark, tmp_dir):
    path = os.path.join(tmp_dir, "many.jsonl")
    with open(path, "w") as f:
        f.writelines(json.dumps({"v": i}) + "\n" for i in range(40_000))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        frame = read_jsonl(spark, path, "v bigint")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert [(r.row_idx, r.v) for r in frame.orderBy("row_idx").collect()] == [(i, i) for i in range(40_000)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_limit_opens_the_first_ranges_only(spark, tmp_dir):
    for name in "abcdefgh":
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.writelines(f"{name}{i}\n" for i in range(10))
    frame = L.numbered_lines(spark, tmp_dir, limit=7)
    for name in "bcdefgh":
        os.remove(os.path.join(tmp_dir, name))
    assert [r.value for r in frame.orderBy("row_idx").collect()] == [f"a{i}" for i in range(7)]


def test_a_changed_file_is_reported(spark, tmp_dir):
    path = os.path.join(tmp_dir, "grows.txt")
    with open(path, "w") as f:
        f.write("a\nb\nc\n")
    frame = L.numbered_lines(spark, path)
    with open(path, "w") as f:
        f.write("a\n\n\n\n")
    with pytest.raises(Exception, match="changed while it was read"):
        frame.collect()


def test_compressed_files_are_whole_ranges(spark, tmp_dir):
    rows = [f"row {i}" for i in range(1000)]
    data = ("\n".join(rows) + "\n").encode()
    with open(os.path.join(tmp_dir, "a.gz"), "wb") as f:
        f.write(gzip.compress(data[: len(data) // 2]))
    with open(os.path.join(tmp_dir, "b.bz2"), "wb") as f:
        f.write(bz2.compress(data[len(data) // 2 :]))
    halves = [x for half in (data[: len(data) // 2], data[len(data) // 2 :]) for x in half.splitlines() if x]
    assert [v.encode() for _, v in _numbered(spark, tmp_dir, range_bytes=64)] == halves


def test_empty_files_and_folders_of_blank_lines(spark, tmp_dir):
    open(os.path.join(tmp_dir, "none"), "w").close()
    assert _numbered(spark, tmp_dir) == []
    with open(os.path.join(tmp_dir, "blank"), "w") as f:
        f.write("\n \n\t\n")
    assert _numbered(spark, tmp_dir) == [] and _numbered(spark, tmp_dir, limit=3) == []


def test_sums_before_in_groups(spark):
    rows = spark.range(1000).select(F.col("id").alias("p"), (F.col("id") % 7).alias("v"))
    for fan in (4, 100, 5000):
        got = {r.p: r.s for r in sums_before(rows, "p", "v", "s", fan).collect()}
        assert got == {p: sum(i % 7 for i in range(p)) for p in range(1000)}


def test_stores_that_only_spark_opens_give_the_same_positions(spark, tmp_dir, monkeypatch):
    for name in ("b", "a"):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.writelines(f"{name}{i}\n\n" for i in range(500))
    want = _numbered(spark, tmp_dir)
    monkeypatch.setattr(L, "opens_in_python", lambda path: False)
    assert _numbered(spark, tmp_dir) == want
    assert _numbered(spark, tmp_dir, limit=505) == want[:505]
    assert not L.opens_in_python("nosuchstore://x/y")
