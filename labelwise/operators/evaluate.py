"""Quality metrics over predictions (P17-P18 flags come from ``score``;
A2-A8 aggregates, J2 deltas, J3 side-by-side).

All metrics derive from one pass of conditional sums grouped by mode
(map-side partial aggregation, one tiny row per mode after the shuffle);
precision / recall / F1 / macro-F1 are arithmetic on that row.  Every 0/0
is 0.0, invalid predictions stay in the denominator, labels without
support still count in the macro average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import TaskSpec

# The cells' names.
CONFUSION_COLUMNS = ("pos_as_pos", "pos_as_neg", "pos_invalid", "neg_as_neg", "neg_as_pos", "neg_invalid")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _ratio(F.lit(2.0) * p * r, p + r)


def counts(preds: DataFrame, spec: TaskSpec) -> DataFrame:
    """One row per mode: totals and the six confusion cells (one pass)."""
    pos, neg = F.lit(spec.positive), F.lit(spec.negative)
    e, p = F.col("expected"), F.col("predicted")
    cnt = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return preds.groupBy("mode").agg(
        F.count(F.lit(1)).alias("total"),
        cnt(F.col("correct")).alias("n_correct"),
        cnt(F.col("valid_format")).alias("n_valid"),
        F.sum("latency_sec").alias("latency_sum"),
        cnt((e == pos) & (p == pos)).alias("pos_as_pos"),
        cnt((e == pos) & (p == neg)).alias("pos_as_neg"),
        cnt((e == pos) & p.isNull()).alias("pos_invalid"),
        cnt((e == neg) & (p == neg)).alias("neg_as_neg"),
        cnt((e == neg) & (p == pos)).alias("neg_as_pos"),
        cnt((e == neg) & p.isNull()).alias("neg_invalid"),
        # one-vs-rest cells that do not follow from the six above when an
        # expected value is outside the label set
        cnt((e != pos) & (p == pos)).alias("fp_pos"),
        cnt((e != neg) & (p == neg)).alias("fp_neg"),
        cnt((e == pos) & ~F.coalesce(p == pos, F.lit(False))).alias("fn_pos"),
        cnt((e == neg) & ~F.coalesce(p == neg, F.lit(False))).alias("fn_neg"),
    )


def _label_scores(c: DataFrame) -> DataFrame:
    out = c
    for side, tp in (("pos", "pos_as_pos"), ("neg", "neg_as_neg")):
        out = (
            out.withColumn(f"{side}_precision", _ratio(F.col(tp), F.col(tp) + F.col(f"fp_{side}")))
            .withColumn(f"{side}_recall", _ratio(F.col(tp), F.col(tp) + F.col(f"fn_{side}")))
            .withColumn(f"{side}_f1", _f1(F.col(f"{side}_precision"), F.col(f"{side}_recall")))
        )
    return out


def metrics_from_counts(c: DataFrame) -> DataFrame:
    s = _label_scores(c)
    return s.select(
        "mode",
        "total",
        _ratio(F.col("n_correct"), F.col("total")).alias("accuracy"),
        ((F.col("pos_f1") + F.col("neg_f1")) / F.lit(2.0)).alias("macro_f1"),
        _ratio(F.col("n_valid"), F.col("total")).alias("format_valid_rate"),
        _ratio(F.col("latency_sum"), F.col("total")).alias("avg_latency_sec"),
    )


def metrics(preds: DataFrame, spec: TaskSpec) -> DataFrame:
    """``mode, total, accuracy, macro_f1, format_valid_rate,
    avg_latency_sec``; no predictions -> no rows."""
    return metrics_from_counts(counts(preds, spec))


def per_label_from_counts(c: DataFrame, spec: TaskSpec) -> DataFrame:
    s = _label_scores(c)
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.lit(i).alias("label_ord"),
                F.col(f"{side}_precision").alias("precision"),
                F.col(f"{side}_recall").alias("recall"),
                F.col(f"{side}_f1").alias("f1"),
            )
            for i, (side, label) in enumerate((("pos", spec.positive), ("neg", spec.negative)))
        ]
    )
    return s.select("mode", F.inline(rows))


def per_label(preds: DataFrame, spec: TaskSpec) -> DataFrame:
    """A5: ``mode, label, label_ord, precision, recall, f1`` (fixed label list)."""
    return per_label_from_counts(counts(preds, spec), spec)


def confusion(preds: DataFrame, spec: TaskSpec) -> DataFrame:
    """The six cells, zeros included."""
    return counts(preds, spec).select("mode", *CONFUSION_COLUMNS)


def mode_deltas(metric_rows: DataFrame, base: str, tuned: str) -> DataFrame:
    """Tuned - base in percentage points; no row unless both exist."""
    pick = lambda col, m: F.max(F.when(F.col("mode") == m, F.col(col)))
    return (
        metric_rows.agg(
            ((pick("accuracy", tuned) - pick("accuracy", base)) * F.lit(100.0)).alias("accuracy_pp"),
            ((pick("macro_f1", tuned) - pick("macro_f1", base)) * F.lit(100.0)).alias("macro_f1_pp"),
        )
        .filter(F.col("accuracy_pp").isNotNull())
    )


def side_by_side(preds: DataFrame, base: str, tuned: str) -> DataFrame:
    """Each input under both modes; outcome fixed / broken / both / neither.

    Equi-join on ``index``; both sides come from the same prediction table
    so, partitioned by ``index``, the join needs one shuffle of small columns.
    """
    cols = ["index", "expected", "predicted", "correct"]
    b = preds.filter(F.col("mode") == base).select(*cols)
    t = preds.filter(F.col("mode") == tuned).select(
        "index", F.col("predicted").alias("t_predicted"), F.col("correct").alias("t_correct")
    )
    j = b.join(t, "index")
    outcome = (
        F.when(F.col("correct") & F.col("t_correct"), F.lit("both"))
        .when(~F.col("correct") & F.col("t_correct"), F.lit("fixed"))
        .when(F.col("correct") & ~F.col("t_correct"), F.lit("broken"))
        .otherwise(F.lit("neither"))
    )
    return j.select(
        "index",
        "expected",
        F.col("predicted").alias("base"),
        F.col("t_predicted").alias("tuned"),
        outcome.alias("outcome"),
    )
