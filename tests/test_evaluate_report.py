import pytest
from pyspark.sql import functions as F

from labelwise.functions.labels import is_correct, is_valid_format
from labelwise.operators import evaluate as ev
from labelwise.operators import report as rep
from labelwise.spec import CHINESE_REVIEWS as CN

P, N = CN.positive, CN.negative
SCHEMA = "mode string, index bigint, input string, expected string, raw_output string, predicted string, latency_sec double"


def preds(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("correct", is_correct("predicted", "expected")).withColumn(
        "valid_format", is_valid_format("predicted", CN)
    )


def test_small_metrics_case(spark):
    df = preds(spark, [("m", 0, "a", P, P, P, 0.1), ("m", 1, "b", P, "?", None, 0.2), ("m", 2, "c", N, P, P, 0.3)])
    m = ev.metrics(df, CN).first()
    assert m.total == 3 and m.accuracy == pytest.approx(1 / 3) and m.format_valid_rate == pytest.approx(2 / 3)
    assert m.macro_f1 == pytest.approx(0.25) and m.avg_latency_sec == pytest.approx(0.2)
    pl = {r.label: r for r in ev.per_label(df, CN).collect()}
    assert (pl[P].precision, pl[P].recall, pl[P].f1) == pytest.approx((0.5, 0.5, 0.5))
    assert (pl[N].precision, pl[N].recall, pl[N].f1) == (0.0, 0.0, 0.0)
    c = ev.confusion(df, CN).first()
    assert (c.pos_as_pos, c.pos_as_neg, c.pos_invalid, c.neg_as_neg, c.neg_as_pos, c.neg_invalid) == (1, 0, 1, 0, 1, 0)


def test_empty_predictions_give_no_metrics(spark):
    assert ev.metrics(preds(spark, []), CN).count() == 0


GOLDEN = {  # published confusion counts: pos->pos, pos->neg, pos invalid, neg->neg, neg->pos, neg invalid
    "base": (249, 351, 0, 564, 15, 0),
    "tuned": (552, 48, 0, 535, 44, 0),
}


def test_golden_metrics(spark):
    rows, i = [], 0
    for mode, (pp, pn, pi, nn, np_, ni) in GOLDEN.items():
        for exp, pred, k in ((P, P, pp), (P, N, pn), (P, None, pi), (N, N, nn), (N, P, np_), (N, None, ni)):
            for _ in range(k):
                rows.append((mode, i, "t", exp, pred or "", pred, 0.0))
                i += 1
    m = {r.mode: r for r in ev.metrics(preds(spark, rows), CN).collect()}
    assert m["base"].total == 1179 and m["tuned"].total == 1179
    assert m["base"].accuracy == pytest.approx(0.6895674300, abs=1e-10)
    assert m["base"].macro_f1 == pytest.approx(0.6657044846, abs=1e-10)
    assert m["tuned"].accuracy == pytest.approx(0.9219677693, abs=1e-10)
    assert m["tuned"].macro_f1 == pytest.approx(0.9219515424, abs=1e-10)
    assert m["base"].format_valid_rate == 1.0
    d = ev.mode_deltas(ev.metrics(preds(spark, rows), CN), "base", "tuned").first()
    assert d.accuracy_pp == pytest.approx(23.2400, abs=1e-4) and d.macro_f1_pp == pytest.approx(25.6247, abs=1e-4)
    lines = rep.report_lines(
        ev.metrics(preds(spark, rows), CN), ev.confusion(preds(spark, rows), CN), rep.error_cases(preds(spark, rows), CN), ["base", "tuned"], CN
    )
    text = [r.line for r in lines.orderBy("section", "mode_ord", "line_no").collect()]
    assert "| base | 68.96% | 66.57% | 100.00% | 0.00s |" in text
    assert "| tuned | 92.20% | 92.20% | 100.00% | 0.00s |" in text
    assert "- `pos_as_neg`: 351" in text


def test_deltas_need_both_modes(spark):
    m = ev.metrics(preds(spark, [("base", 0, "a", P, P, P, 0.0)]), CN)
    assert ev.mode_deltas(m, "base", "tuned").count() == 0


def test_side_by_side_outcomes(spark):
    rows = [
        ("base", 0, "a", P, P, P, 0.0), ("tuned", 0, "a", P, P, P, 0.0),
        ("base", 1, "b", P, N, N, 0.0), ("tuned", 1, "b", P, P, P, 0.0),
        ("base", 2, "c", N, N, N, 0.0), ("tuned", 2, "c", N, P, P, 0.0),
        ("base", 3, "d", N, P, P, 0.0), ("tuned", 3, "d", N, "", None, 0.0),
    ]
    got = {r["index"]: r.outcome for r in ev.side_by_side(preds(spark, rows), "base", "tuned").collect()}
    assert got == {0: "both", 1: "fixed", 2: "broken", 3: "neither"}


def test_error_cases_first_k_and_placeholder(spark):
    rows = [("m", i, "x" * 5 + "\n" + "y" * 124, P, N, N, 0.0) for i in range(10, 0, -1)]
    rows.append(("ok", 0, "a", P, P, P, 0.0))
    df = preds(spark, rows)
    e = rep.error_cases(df.repartition(4), CN).orderBy("rank").collect()
    assert [r["index"] for r in e] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert len(e[0].snippet) == 120 and e[0].snippet[5] == " "
    c = ev.counts(df, CN)
    lines = rep.report_lines(ev.metrics_from_counts(c), c, rep.error_cases(df, CN), ["m", "ok"], CN)
    ok_lines = [r.line for r in lines.filter((F.col("section") == 5) & (F.col("mode_ord") == 1)).orderBy("line_no").collect()]
    assert ok_lines == ["### ok", rep.NO_FAILURES, ""]
