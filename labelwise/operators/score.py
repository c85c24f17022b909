"""Scoring records with a scorer.

A scorer adds ``raw_output`` (the model's text answer) and optionally
``latency_sec`` to a frame.  Three kinds:

* Column scorers (``LexiconScorer``): a pure expression, fused into the
  scan's codegen stage.
* Relational scorers (``TokenWeights`` in ``fit.py``): joins + grouping.
* External models (``PandasScorer``): ``mapInPandas`` over Arrow batches,
  the model built once per Python worker and reused across batches and
  tasks; each row's latency is the model call only.  A worker answers and
  hands back a batch in small parts, so it never holds a second one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import extract_label, is_correct, is_valid_format
from ..functions.text import py_strip, word_tokens
from ..session import scratch_path
from ..spec import TaskSpec
from .workers import built_once, new_id, text_parts

PREDICTION_COLUMNS = ("mode", "index", "input", "expected", "raw_output", "predicted", "latency_sec")


class LexiconScorer:
    """M3: untuned baseline — a word-list rule as a Column expression.

    A text containing a negative word and no positive word answers
    ``spec.negative``; the reverse answers ``spec.positive``; otherwise
    ``default``.
    """

    def __init__(
        self,
        spec: TaskSpec,
        negative_words: Sequence[str],
        positive_words: Sequence[str] = (),
        default: str | None = None,
    ):
        self.spec = spec
        self.negative_words = tuple(negative_words)
        self.positive_words = tuple(positive_words)
        self.default = default if default is not None else spec.positive

    @staticmethod
    def _hit(tokens: Column, words: Sequence[str]) -> Column:
        if not words:
            return F.lit(False)
        return F.coalesce(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words])), F.lit(False))

    def answer(self, text: Column) -> Column:
        toks = word_tokens(text)
        neg = self._hit(toks, self.negative_words)
        pos = self._hit(toks, self.positive_words)
        s = self.spec
        return F.when(neg & ~pos, F.lit(s.negative)).when(pos & ~neg, F.lit(s.positive)).otherwise(F.lit(self.default))

    def apply(self, df: DataFrame, key: str, text_col: str) -> DataFrame:
        return df.withColumn("raw_output", self.answer(F.col(text_col)))


class PandasScorer:
    """Plug in any Python model.

    ``factory()`` is called once per Python worker process and scorer and
    must return ``fn(text) -> str`` or, with ``batched``, ``fn(texts) ->
    answers`` over up to ``call_rows`` texts (an Arrow batch if not given;
    each row then gets an equal share of the call's time).  Call ``check()``
    on the driver first to fail fast (e.g. a missing model artefact) before
    any task starts.

    With ``isolate`` a text on which the model raises does not fail the job:
    a failing call is repeated on its two halves until the text stands alone;
    that row gets no answer and the reason in ``error`` (null for the others).
    One bad text among n costs about 2 log2(n) further calls.  Where more than
    ``most_errors`` texts of a task fail, the model is broken rather than the
    texts, and the task raises.
    """

    def __init__(
        self,
        factory: Callable[[], Callable],
        check: Callable[[], None] | None = None,
        batched: bool = False,
        isolate: bool = False,
        call_rows: int | None = None,
        most_errors: int | None = None,
    ):
        self.factory = factory
        self.check = check
        self.batched = batched
        self.isolate = isolate
        self.call_rows = call_rows
        self.most_errors = most_errors
        self.ident = new_id()

    def apply(self, df: DataFrame, key: str, text_col: str) -> DataFrame:
        if self.check is not None:
            self.check()
        factory, ident, batched, isolate = self.factory, self.ident, self.batched, self.isolate
        call_rows, most_errors = self.call_rows, self.most_errors
        added = [T.StructField("raw_output", T.StringType()), T.StructField("latency_sec", T.DoubleType())]
        if isolate:
            added.append(T.StructField("error", T.StringType()))
        schema = T.StructType(df.schema.fields + added)

        def run(batches: Iterator):
            fn = built_once(ident, factory)
            calls = (lambda texts: fn(texts)) if batched else (lambda texts: [fn(t) for t in texts])
            failed = 0
            for pdf in batches:
                size = (call_rows or max(len(pdf), 1)) if batched else 1
                for rows in text_parts(pdf[text_col], size):
                    part, answers = pdf.iloc[rows], []
                    texts = list(part[text_col])
                    for at in range(0, len(texts), size):
                        call = texts[at : at + size]
                        answers += isolated(calls, call) if isolate else timed(calls, call)
                    failed += sum(why is not None for _, _, why in answers)
                    if most_errors is not None and failed > most_errors:
                        raise RuntimeError(f"the model failed on {failed} texts of one task, the last: {[w for _, _, w in answers if w][-1]}")
                    new = {
                        "raw_output": [None if why else "" if a is None else str(a).strip() for a, _, why in answers],
                        "latency_sec": [sec for _, sec, _ in answers],
                    }
                    yield part.assign(**new, **({"error": [why for _, _, why in answers]} if isolate else {}))

        return df.mapInPandas(run, schema)


def timed(calls: Callable[[list], Sequence], texts: list) -> list[tuple]:
    """(answer, seconds, None) of every text from one call."""
    began = time.perf_counter()
    answers = list(calls(texts))
    if len(answers) != len(texts):
        raise ValueError(f"{len(answers)} answers for {len(texts)} texts")
    return [(a, (time.perf_counter() - began) / len(texts), None) for a in answers]


def isolated(calls: Callable[[list], Sequence], texts: list) -> list[tuple]:
    """(answer, seconds, reason) of every text: a call that raises is made
    again for each half, down to single texts."""
    done, open_ = [], [texts] if texts else []
    while open_:
        part = open_.pop()
        try:
            done += timed(calls, part)
        except Exception as exc:  # noqa: BLE001 - whatever a model raises
            if len(part) == 1:
                done.append((None, 0.0, f"{type(exc).__name__}: {exc}"[:500]))
            else:
                half = len(part) // 2
                open_ += [part[half:], part[:half]]
    return done


def score(
    df: DataFrame,
    scorer,
    mode: str,
    spec: TaskSpec,
    key: str = "row_idx",
    text_col: str = "input",
    expected_col: str = "output",
    latency: Column | None = None,
    keep_input: bool = True,
) -> DataFrame:
    """M1: records -> predictions (D9) plus ``correct`` / ``valid_format``.

    ``latency`` fills ``latency_sec`` for scorers that do not time rows
    (default 0.0).  Every input row gets one prediction, also when keys
    repeat.  Relational scorers return rows without the text; with
    ``keep_input`` the rows are numbered and written once, and the answers meet
    them by that number; without it the predictions omit ``input`` — metrics
    never need it, and ``report.error_cases`` fetches it for its few rows only.
    A scorer's ``error`` column (why a row has no answer) stays.
    """
    cols = [key, text_col, expected_col]
    if latency is not None:
        df = df.withColumn("__latency", latency.cast("double"))
        cols.append("__latency")
    # only what the predictions need rides through the scorer (its shuffle
    # or Arrow transfer); other record columns are not carried
    df = df.select(*dict.fromkeys(cols))
    if keep_input and getattr(scorer, "relational", False):
        path = scratch_path(df.sparkSession, "scored-rows")
        df.withColumn("__scored_row", F.monotonically_increasing_id()).write.parquet(path)
        rows = df.sparkSession.read.parquet(path)
        answers = scorer.apply(rows.select("__scored_row", text_col), "__scored_row", text_col)
        scored = rows.join(answers, "__scored_row").drop("__scored_row")
    else:
        scored = scorer.apply(df, key, text_col)
    if "latency_sec" not in scored.columns:
        scored = scored.withColumn("latency_sec", F.col("__latency") if latency is not None else F.lit(0.0))
    raw = py_strip(F.coalesce(F.col("raw_output"), F.lit("")))
    text = [F.col(text_col).alias("input")] if keep_input else []
    why = ["error"] if "error" in scored.columns and "error" not in df.columns else []
    pred = scored.select(
        F.lit(mode).alias("mode"),
        F.col(key).cast("bigint").alias("index"),
        *text,
        F.col(expected_col).alias("expected"),
        raw.alias("raw_output"),
        F.col("latency_sec").cast("double").alias("latency_sec"),
        *why,
    ).withColumn("predicted", extract_label("raw_output", spec))
    return pred.select(
        *[c for c in PREDICTION_COLUMNS if c in pred.columns],
        *why,
        is_correct("predicted", "expected").alias("correct"),
        is_valid_format("predicted", spec).alias("valid_format"),
    )


def run_modes(
    df: DataFrame,
    scorers: dict,
    modes: str | Sequence[str],
    spec: TaskSpec,
    **kw,
) -> DataFrame:
    """Score under each mode and stack the results (keyed by mode).

    ``modes`` is a list or comma string; blanks are dropped, a repeated mode
    counts once, an unknown mode fails before any work starts.
    """
    names = parse_modes(modes)
    unknown = [m for m in names if m not in scorers]
    if unknown:
        raise ValueError(f"no scorer for {unknown}; there are {sorted(scorers)}")
    out = None
    for m in names:
        p = score(df, scorers[m], m, spec, **kw)
        out = p if out is None else out.unionByName(p)
    return out


def parse_modes(modes: str | Sequence[str]) -> list[str]:
    items = modes.split(",") if isinstance(modes, str) else list(modes)
    seen: list[str] = []
    for m in (x.strip() for x in items):
        if m and m not in seen:
            seen.append(m)
    return seen
