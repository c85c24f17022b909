import pytest
from pyspark.sql import functions as F

from labelwise.functions.labels import extract_label, is_correct, is_valid_format, normalize_label
from labelwise.functions.text import WHITESPACE, pct, py_strip, seconds, snippet, space_tokens, word_tokens
from labelwise.spec import CHINESE_REVIEWS as CN


def col(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {dtype}")


def test_whitespace_set_is_python_isspace():
    assert sorted(WHITESPACE) == sorted(chr(c) for c in range(0x110000) if chr(c).isspace())


def test_strip_matches_python(spark):
    vals = ["　好 \t", " a b ", "\n", " x ", "\x1cq\x1f", "mid dle"]
    got = [r.s for r in col(spark, vals).select(py_strip("x").alias("s")).collect()]
    assert got == [v.strip() for v in vals]


def test_snippet_replaces_newline_then_cuts(spark):
    text = "abcde\n" + "x" * 124
    got = col(spark, [text]).select(snippet("x", 120).alias("s")).first().s
    assert got == text.replace("\n", " ")[:120]
    assert len(got) == 120 and got[5] == " "


def test_percent_and_seconds(spark):
    r = col(spark, [0.6895674300], "double").select(pct("x").alias("p"), seconds("x").alias("s")).first()
    assert r.p == "68.96%" and r.s == "0.69s"


def test_tokens(spark):
    r = col(spark, ["Hello, WORLD! ça-va 42"]).select(word_tokens("x").alias("w"), space_tokens("x").alias("s")).first()
    assert r.w == ["hello", "world", "ça", "va"]
    assert r.s == ["Hello,", "WORLD!", "ça-va", "42"]


def test_space_tokens_match_python_split(spark):
    """The JVM whitespace class splits exactly where ``str.split()`` does,
    over every code point of the BMP (no whitespace exists above it)."""
    text = "a".join(chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000)
    got = col(spark, [text]).select(space_tokens("x").alias("s")).first().s
    assert got == text.split()


POSITIVE, NEGATIVE = CN.positive, CN.negative


@pytest.mark.parametrize(
    "raw,expected",
    [
        (" Positive ", POSITIVE),
        ("POS", POSITIVE),
        ("1", POSITIVE),
        ("好评", POSITIVE),
        ("neg", NEGATIVE),
        ("0", NEGATIVE),
        ("差评", NEGATIVE),
    ],
)
def test_normalize_string_labels(spark, raw, expected):
    df = col(spark, [raw])
    assert df.select(normalize_label(df, "x", CN).alias("o")).first().o == expected


def test_normalize_int_and_bool(spark):
    df = col(spark, [1, 0], "int")
    assert [r.o for r in df.select(normalize_label(df, "x", CN).alias("o")).collect()] == [POSITIVE, NEGATIVE]
    df = col(spark, [True, False], "boolean")
    assert [r.o for r in df.select(normalize_label(df, "x", CN).alias("o")).collect()] == [POSITIVE, NEGATIVE]


def test_normalize_with_class_dictionary(spark):
    df = col(spark, [1, 0], "int")
    got = df.select(normalize_label(df, "x", CN, class_names={0: "negative", 1: "positive"}).alias("o")).collect()
    assert [r.o for r in got] == [POSITIVE, NEGATIVE]
    # a dictionary can invert the plain 0/1 rule
    got = df.select(normalize_label(df, "x", CN, class_names={0: "positive", 1: "negative"}).alias("o")).collect()
    assert [r.o for r in got] == [NEGATIVE, POSITIVE]


@pytest.mark.parametrize(
    "values,dtype",
    [([2], "int"), ([1.0], "double"), (["true"], "string"), (["good"], "string"), ([None], "string"), ([None], "int")],
)
def test_normalize_rejects(spark, values, dtype):
    df = col(spark, values, dtype)
    with pytest.raises(Exception, match="no class for the label"):
        df.select(normalize_label(df, "x", CN).alias("o")).collect()
    assert df.select(normalize_label(df, "x", CN, strict=False).alias("o")).first().o is None


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("正面", POSITIVE),
        ("负面，但有正面", NEGATIVE),
        ("答案：正面", POSITIVE),
        ("积极", POSITIVE),
        ("不是正面，是负面", None),
        ("消极", NEGATIVE),
        ("不知道", None),
        ("", None),
        ("不是正面", POSITIVE),
        ("  正面\n", POSITIVE),
    ],
)
def test_extract_label(spark, raw, expected):
    assert col(spark, [raw]).select(extract_label("x", CN).alias("p")).first().p == expected


def test_flags_treat_null_as_false(spark):
    df = spark.createDataFrame([(POSITIVE, POSITIVE), (None, POSITIVE), (NEGATIVE, POSITIVE)], "p string, e string")
    got = df.select(is_correct("p", "e").alias("c"), is_valid_format("p", CN).alias("v")).collect()
    assert [(r.c, r.v) for r in got] == [(True, True), (False, False), (False, True)]


def test_fixed_matches_python_rounding(spark):
    import random

    from labelwise.functions.text import fixed

    rnd = random.Random(7)
    vals = [0.105, 0.115, 0.125, 0.135, 0.145, 2.675, 1.005, 0.0, 0.5, 1.5, 2.5, 0.995, 0.994999, 123.455, 1e-9]
    vals += [rnd.random() * 10 ** rnd.randint(-3, 4) for _ in range(3000)]
    vals += [n / 10000 for n in range(0, 5000, 7)]  # latency stand-ins
    vals += [-0.105, -2.5, -0.0, -0.001]
    vals += [0.999, 9.995, 99.999, 2.0**45 + 0.0078125, 4.6e13 + 0.125, 2.0**52 + 1, 9.2e18, -7e17, 1e20]
    vals += [float("nan"), float("inf"), float("-inf")]
    vals += [rnd.random() * 10 ** rnd.randint(5, 17) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.s for r in df.select(fixed("x", 2).alias("s")).collect()]
    assert got == [f"{v:.2f}" for v in vals]
    whole = [r.s for r in df.select(fixed("x", 0).alias("s")).collect()]
    assert whole == [f"{v:.0f}" for v in vals]
    exact = [v for v in vals if not abs(v) > 9e16]  # times 100 below 2^63
    got_pct = [r.s for r in df.filter("isnan(x) or abs(x) <= 9e16").select(pct("x").alias("s")).collect()]
    assert got_pct == [f"{v:.2%}" for v in exact]
