"""A Python tokeniser hands back a batch's tokens part by part."""

import pandas as pd
from pyspark.sql import functions as F

from labelwise.operators import encode as enc
from labelwise.operators.workers import PART_CHARS, text_parts


def _split():
    return str.split


def test_parts_are_whole_steps_of_bounded_size():
    texts = ["ab", None, "abcd", "", "abcdef", 7, "a"]
    for step in (1, 2, 3, 9):
        for most in (1, 4, 100):
            parts = list(text_parts(texts, step, most))
            assert [t for p in parts for t in texts[p]] == texts
            assert all((p.stop - p.start) % step == 0 for p in parts[:-1])
    assert list(text_parts([])) == []
    long = ["x" * (PART_CHARS // 3)] * 10
    assert [p.stop - p.start for p in text_parts(long)] == [4, 4, 2]


def test_tokens_of_a_batch_leave_in_parts():
    texts = pd.Series(["a b " * (PART_CHARS // 8)] * 6 + [None, ""])
    parts = list(enc.pandas_tokenizer(_split).func(iter([texts, texts[:0], texts[6:]])))
    assert [len(p) for p in parts] == [2, 2, 2, 2, 2]
    assert parts[0][0][:3] == ["a", "b", "a"] and parts[-1].tolist() == [None, []]


def test_parts_of_large_batches_meet_their_rows(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 50 != 7, F.repeat(F.concat(F.col("id").cast("string"), F.lit(" w ")), 1500)).alias("prompt")).coalesce(1)
    tok = enc.pandas_tokenizer(_split)
    got = df.select("id", F.size(tok("prompt")).alias("n"), F.element_at(tok("prompt"), 1).alias("first")).collect()
    assert len(got) == 300
    assert all((r["first"] is None) if r["id"] % 50 == 7 else (r["n"], r["first"]) == (3000, str(r["id"])) for r in got)
