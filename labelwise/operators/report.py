"""Example errors and the Markdown report (L6, P19-P21, R1, S6 layout).

The report is a small line table ``(section, mode_ord, line_no, line)``
built from the per-mode metrics (one row per mode) and at most ``k``
failures per mode; ordering happens only on that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_text, pct, seconds, snippet
from ..spec import TaskSpec
from .evaluate import CONFUSION_COLUMNS


def error_cases(
    preds: DataFrame, spec: TaskSpec, k: int | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """L6 + P19: the first ``k`` failures (by index) of each mode.

    ``row_number() <= k`` over ``partition by mode`` is planned with a
    per-task group limit before the shuffle (WindowGroupLimit), so a mode
    holding most of the rows still ships only k rows per task.  When the
    predictions carry no text, ``texts`` ``(index, input)`` supplies it: the
    at most k x modes failures are broadcast (a proven bound) and the text
    table is only scanned, never shuffled.
    """
    k = spec.failures_per_mode if k is None else k
    w = Window.partitionBy("mode").orderBy("index")
    fails = preds.filter(~F.col("correct"))
    top = fails.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if "input" not in top.columns:
        if texts is None:
            raise ValueError("predictions without input need `texts` (index, input)")
        top = texts.select("index", "input").join(F.broadcast(top), "index")
    return (
        top
        .select(
            "mode",
            F.col("rank").cast("int").alias("rank"),
            "index",
            "expected",
            "predicted",
            snippet("raw_output", spec.snippet_chars).alias("raw_snippet"),
            snippet("input", spec.snippet_chars).alias("snippet"),
        )
    )


def display(preds: DataFrame, spec: TaskSpec) -> DataFrame:
    """Predictions as the comparison view shows them."""
    return preds.select(
        "mode",
        "index",
        or_text("predicted", spec.undetermined_text).alias("label_text"),
        or_text("raw_output", spec.no_output_text).alias("raw_text"),
        seconds("latency_sec").alias("latency_text"),
    )


# Report wording (ours); layout: title, summary table, confusion lists,
# failure examples, each section in mode order.
TITLE = "# Evaluation report"
TASK_LINE = "Task: binary text classification; a valid answer is `{pos}` or `{neg}`."
# The table heading and its rule.
TABLE_HEAD = ("| mode | Accuracy | Macro F1 | Format Valid | Avg Latency |", "| --- | ---: | ---: | ---: | ---: |")
CONFUSION_TITLE = "## Confusion counts"
FAILURES_TITLE = "## Example errors"
NO_FAILURES = "- no errors."


def report_lines(
    metric_rows: DataFrame,
    confusion_rows: DataFrame,
    errors: DataFrame,
    modes: Sequence[str],
    spec: TaskSpec,
) -> DataFrame:
    """``(section, mode_ord, line_no, line)``; sort by all three to read."""
    spark = metric_rows.sparkSession
    order = spark.createDataFrame([(m, i) for i, m in enumerate(modes)], "mode string, mode_ord int")
    L = lambda sec, mo, no, text: (sec, mo, no, text)
    fixed = [
        L(0, -1, 0, TITLE),
        L(0, -1, 1, ""),
        L(0, -1, 2, TASK_LINE.format(pos=spec.positive, neg=spec.negative)),
        L(0, -1, 3, ""),
        L(0, -1, 4, TABLE_HEAD[0]),
        L(0, -1, 5, TABLE_HEAD[1]),
        L(2, -1, 0, ""),
        L(2, -1, 1, CONFUSION_TITLE),
        L(2, -1, 2, ""),
        L(4, -1, 0, FAILURES_TITLE),
        L(4, -1, 1, ""),
    ]
    schema = "section int, mode_ord int, line_no int, line string"
    parts = [spark.createDataFrame(fixed, schema)]
    m = metric_rows.join(order, "mode")
    parts.append(
        m.select(
            F.lit(1).alias("section"),
            "mode_ord",
            F.lit(0).alias("line_no"),
            F.concat_ws(
                " | ",
                F.concat(F.lit("| "), F.col("mode")),
                pct("accuracy"),
                pct("macro_f1"),
                pct("format_valid_rate"),
                F.concat(seconds("avg_latency_sec"), F.lit(" |")),
            ).alias("line"),
        )
    )
    c = confusion_rows.join(order, "mode")
    cells = F.array(
        *[F.struct(F.lit(i + 1).alias("n"), F.lit(name).alias("k"), F.col(name).alias("v")) for i, name in enumerate(CONFUSION_COLUMNS)]
    )
    parts.append(c.select(F.lit(3).alias("section"), "mode_ord", F.lit(0).alias("line_no"), F.concat(F.lit("### "), F.col("mode")).alias("line")))
    parts.append(
        c.select("mode_ord", F.inline(cells)).select(
            F.lit(3).alias("section"),
            "mode_ord",
            F.col("n").alias("line_no"),
            F.format_string("- `%s`: %d", F.col("k"), F.col("v")).alias("line"),
        )
    )
    parts.append(c.select(F.lit(3).alias("section"), "mode_ord", F.lit(len(CONFUSION_COLUMNS) + 1).alias("line_no"), F.lit("").alias("line")))
    # failures: header, up to k lines or a placeholder, blank line
    parts.append(order.select(F.lit(5).alias("section"), "mode_ord", F.lit(0).alias("line_no"), F.concat(F.lit("### "), F.col("mode")).alias("line")))
    e = errors.join(order, "mode")
    parts.append(
        e.select(
            F.lit(5).alias("section"),
            "mode_ord",
            F.col("rank").alias("line_no"),
            F.format_string(
                "- expected `%s`, predicted `%s`, output: %s; text: %s",
                F.col("expected"),
                F.coalesce(F.col("predicted"), F.lit("None")),
                F.col("raw_snippet"),
                F.col("snippet"),
            ).alias("line"),
        )
    )
    has_errors = errors.select("mode").distinct()
    parts.append(
        order.join(has_errors, "mode", "left_anti").select(
            F.lit(5).alias("section"), "mode_ord", F.lit(1).alias("line_no"), F.lit(NO_FAILURES).alias("line")
        )
    )
    parts.append(order.select(F.lit(5).alias("section"), "mode_ord", F.lit(max(spec.failures_per_mode, 1) + 1).alias("line_no"), F.lit("").alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("section").cast("int"), F.col("mode_ord").cast("int"), F.col("line_no").cast("int"), "line")
