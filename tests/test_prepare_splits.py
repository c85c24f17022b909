import pytest
from pyspark.sql import functions as F

from labelwise.operators.prepare import detect_column, dedup_first, quarantined, records_from_pair, split_stats, to_records
from labelwise.operators.splits import canonical_splits, head_limit, holdout_split, seeded_cap
from labelwise.operators import splits as S
from labelwise.spec import CHINESE_REVIEWS as CN

P, N = CN.positive, CN.negative


def test_detect_column_candidate_order(spark):
    df = spark.createDataFrame([(1, "a", "b")], "row_idx int, review string, text string")
    assert detect_column(df, ("text", "review"), "text") == "text"
    with pytest.raises(KeyError, match="no label column"):
        detect_column(df, ("label", "labels"), "label")


def test_empty_text_dropped_before_label_check(spark):
    df = spark.createDataFrame([(0, "  ", "junk"), (1, "ok", "pos")], "row_idx bigint, text string, label string")
    rows = to_records(df, CN, split_col=None).collect()
    assert [(r.row_idx, r.input, r.output) for r in rows] == [(1, "ok", P)]
    assert rows[0].instruction == CN.instruction


def test_bad_label_raises_or_is_quarantined(spark):
    df = spark.createDataFrame([(0, "x", "junk"), (1, "y", "1")], "row_idx bigint, text string, label string")
    with pytest.raises(Exception, match="no class for the label"):
        to_records(df, CN, split_col=None).collect()
    assert [r.row_idx for r in to_records(df, CN, split_col=None, strict=False).collect()] == [1]
    assert [r.row_idx for r in quarantined(df, CN).collect()] == [0]


def test_dedup_first_wins_per_split(spark):
    rows = [
        ("train", 0, "a", "pos"),
        ("train", 1, "a", "pos"),
        ("train", 2, "a", "neg"),
        ("train", 3, " a ", "pos"),
        ("test", 0, "b", "pos"),
        ("test", 1, "c", "pos"),
        (None, 0, "a", "pos"),
    ]
    df = spark.createDataFrame(rows, "split string, row_idx bigint, text string, label string")
    got = sorted((r.split or "", r.row_idx, r.input, r.output) for r in to_records(df, CN).collect())
    assert got == [("", 0, "a", P), ("test", 0, "b", P), ("test", 1, "c", P), ("train", 0, "a", P), ("train", 2, "a", N)]


def test_dedup_is_partition_invariant(spark):
    rows = [("train", i, f"t{i % 7}", "pos" if i % 3 else "neg") for i in range(200)]
    df = spark.createDataFrame(rows, "split string, row_idx bigint, input string, output string")
    one = sorted(r.row_idx for r in dedup_first(df.coalesce(1), "row_idx").collect())
    many = sorted(r.row_idx for r in dedup_first(df.repartition(8), "row_idx").collect())
    assert one == many and len(one) == 14


def test_split_stats_counts_and_absent_splits(spark):
    df = spark.createDataFrame([("train", 0, "i", "a", P), ("train", 1, "i", "b", N)], "split string, row_idx bigint, instruction string, input string, output string")
    got = {r.split: (r.records, r.positive, r.negative) for r in split_stats(df, CN).collect()}
    assert got == {"train": (2, 1, 1), "valid": (0, 0, 0), "test": (0, 0, 0)}


def _frame(spark, splits, n=300):
    rows = [(s, i) for s in splits for i in range(n)]
    return spark.createDataFrame([(s, i + 1000 * k) for k, (s, i) in enumerate(rows)], "split string, row_idx bigint")


def test_l1_three_named_splits(spark):
    out = canonical_splits(_frame(spark, ["train", "validation", "test"], 5), "row_idx")
    assert sorted({r.split for r in out.collect()}) == ["test", "train", "valid"]
    out = canonical_splits(_frame(spark, ["train", "valid", "test", "extra"], 5), "row_idx")
    assert sorted({r.split for r in out.collect()}) == ["test", "train", "valid"]


def test_l1_train_test_carves_valid(spark):
    out = canonical_splits(_frame(spark, ["train", "test"]), "row_idx").groupBy("split").count().collect()
    c = {r.split: r["count"] for r in out}
    assert c["test"] == 300 and c["train"] + c["valid"] == 300 and 10 <= c["valid"] <= 60
    out = canonical_splits(_frame(spark, ["train", "test"], 905), "row_idx", exact=True).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"train": 814, "valid": 91, "test": 905}


def test_l1_train_only_and_errors(spark):
    out = canonical_splits(_frame(spark, ["train"], 2000), "row_idx").groupBy("split").count().collect()
    c = {r.split: r["count"] for r in out}
    assert sum(c.values()) == 2000 and 1500 < c["train"] < 1700 and 120 < c["valid"] < 280
    # {train, validation} without test: the validation rows are dropped only on request
    with pytest.raises(ValueError, match="strict"):
        canonical_splits(_frame(spark, ["train", "validation"], 100), "row_idx")
    assert canonical_splits(_frame(spark, ["train", "validation"], 100), "row_idx", strict=True).count() == 100
    with pytest.raises(KeyError):
        canonical_splits(_frame(spark, ["test"], 3), "row_idx")


def test_holdout_is_stable_and_disjoint(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_idx")
    a = holdout_split(df.repartition(7), "row_idx", 42, {"train": 0.8, "valid": 0.1, "test": 0.1})
    b = holdout_split(df.coalesce(1), "row_idx", 42, {"train": 0.8, "valid": 0.1, "test": 0.1})
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.count() == 5000


def test_seeded_cap(spark):
    df = spark.createDataFrame([("train", i) for i in range(5)], "split string, row_idx bigint")
    assert seeded_cap(df, {"train": 0}, "row_idx").count() == 5
    assert seeded_cap(df, {"train": 5}, "row_idx").count() == 5
    a = sorted(r.row_idx for r in seeded_cap(df.repartition(3), {"train": 2}, "row_idx").collect())
    b = sorted(r.row_idx for r in seeded_cap(df.coalesce(1), {"train": 2}, "row_idx").collect())
    assert a == b and len(a) == 2


def test_seeded_cap_equals_sorting_by_hash(spark):
    df = spark.range(3000).select(F.lit("train").alias("split"), F.col("id").alias("row_idx"))
    got = sorted(r.row_idx for r in seeded_cap(df, {"train": 1234}, "row_idx").collect())
    order = [r.row_idx for r in df.orderBy(S.hash_order("row_idx", 42), "row_idx").collect()]
    assert got == sorted(order[:1234])


def test_limits_keep_null_splits_and_take_any_key_type(spark):
    df = spark.createDataFrame([(None, "z")] * 2 + [("train", f"k{i:02}") for i in range(20)], "split string, row_idx string")
    for cut in (head_limit, seeded_cap):
        rows = cut(df, {"train": 7}, "row_idx").collect()
        assert sum(r.split is None for r in rows) == 2 and sum(r.split == "train" for r in rows) == 7
    assert sorted(r.row_idx for r in head_limit(df, {"train": 3}, "row_idx").collect() if r.split) == ["k00", "k01", "k02"]


def test_small_shares_are_not_rounded_away(spark):
    df = spark.range(200_000).withColumnRenamed("id", "row_idx")
    n = holdout_split(df, "row_idx", 42, {"tiny": 0.0004, "rest": 0.9996}).filter("split = 'tiny'").count()
    assert 40 <= n <= 130
    with pytest.raises(ValueError, match="sum to 1"):
        holdout_split(df, "row_idx", 42, {"a": 0.5, "b": 0.4})


def test_empty_split_without_columns(spark):
    out = to_records(spark.createDataFrame([], "row_idx bigint, other string"), CN)
    assert out.columns == ["split", "row_idx", "instruction", "input", "output"] and out.count() == 0


def test_head_limit(spark):
    df = spark.createDataFrame([("train", i) for i in range(10)] + [("test", 100 + i) for i in range(3)], "split string, row_idx bigint")
    got = sorted(r.row_idx for r in head_limit(df.repartition(4), {"train": 3, "test": 0}, "row_idx").collect())
    assert got == [0, 1, 2, 100, 101, 102]


def test_exact_holdout_sizes_and_ranks(spark):
    from labelwise.operators.splits import exact_holdout_split, exact_sizes_80_10_10, hash_order

    n = 5003
    df = spark.range(n).withColumnRenamed("id", "row_idx")
    out = exact_holdout_split(df.repartition(5), "row_idx", 42)
    got = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert got == dict(exact_sizes_80_10_10(n)) and sum(got.values()) == n
    # brute force: rank by (md5, key) on the driver
    rows = df.select("row_idx", hash_order("row_idx", 42).alias("h")).collect()
    order = [r.row_idx for r in sorted(rows, key=lambda r: (r.h, r.row_idx))]
    sizes = exact_sizes_80_10_10(n)
    want, pos = {}, 0
    for name, c in sizes:
        for k in order[pos : pos + c]:
            want[k] = name
        pos += c
    assert {r.row_idx: r.split for r in out.collect()} == want


def test_null_text_as_none(spark):
    df = spark.createDataFrame([(0, None, "1"), (1, "x", "0")], "row_idx bigint, text string, label string")
    assert to_records(df, CN, split_col=None).count() == 1
    got = sorted((r.row_idx, r.input) for r in to_records(df, CN, split_col=None, null_text_as_none=True).collect())
    assert got == [(0, "None"), (1, "x")]


def test_first_by_key_is_exact(spark):
    df = spark.range(20000).select(F.lit("train").alias("split"), ((F.col("id") * 7919) % 20011).alias("row_idx"))
    want = sorted(r.row_idx for r in df.collect())[:12345]
    got = sorted(r.row_idx for r in head_limit(df.repartition(6), {"train": 12345}, "row_idx").collect())
    assert got == want


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_TEXTS = st.sampled_from(["a", " a", "a ", "　a", "b", "a b", "", "  ", "\tb\n", "c"])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(_TEXTS, st.integers(0, 1), st.sampled_from(["train", "valid", "test"])), min_size=1, max_size=30))
def test_two_table_prepare_equals_one_table(spark, rows):
    texts = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "row_idx bigint, text string")
    labels = spark.createDataFrame([(i, y, s) for i, (_, y, s) in enumerate(rows)], "row_idx bigint, label int, split string")
    one = to_records(texts.join(labels, "row_idx"), CN, key="row_idx")
    two = records_from_pair(texts, labels, CN, key="row_idx")
    cols = ["split", "row_idx", "input", "output"]
    assert sorted(map(tuple, one.select(*cols).collect())) == sorted(map(tuple, two.select(*cols).collect()))
    # brute force: first wins per (split, stripped text, label)
    seen, want = set(), []
    for i, (t, y, s) in enumerate(rows):
        x = t.strip()
        if x and (s, x, y) not in seen:
            seen.add((s, x, y))
            want.append((s, i, x, CN.positive if y == 1 else CN.negative))
    assert sorted(want) == sorted(map(tuple, two.select(*cols).collect()))
