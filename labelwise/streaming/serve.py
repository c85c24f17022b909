"""Online scoring as Structured Streaming.

Requests ``(request_id, text, mode)`` arrive on any streaming source.
Each micro-batch is validated (length 1..2000 checked *before* the strip,
mode in the served set, absent mode -> default), accepted requests are
stripped and scored by their mode's scorer, rejects go to a dead-letter
table with the reasons.  ``foreachBatch`` gives every micro-batch the full
batch API (the relational scorer joins and groups); each batch writes to
its own ``batch_id=N`` folder with overwrite, so a retried batch replaces
its own output (idempotent, exactly-once on the files).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import extract_label
from ..functions.text import py_strip
from ..spec import TaskSpec

# Request rules (fixed values): text length bounds, served modes, default.
MIN_TEXT = 1
MAX_TEXT = 2000
SERVE_MODES = ("base", "tuned")
DEFAULT_MODE = "tuned"


def validate_requests(
    req: DataFrame,
    modes: Sequence[str] = SERVE_MODES,
    default: str = DEFAULT_MODE,
    min_len: int = MIN_TEXT,
    max_len: int = MAX_TEXT,
) -> DataFrame:
    """Adds resolved ``mode``, ``accepted`` and ``reason`` (all
    failing rules, '; '-joined; null when accepted)."""
    n = F.length(F.col("text"))
    mode = F.coalesce(F.col("mode"), F.lit(default))
    reasons = F.array(
        F.when(F.col("text").isNull(), F.lit("text missing")),
        F.when(n < min_len, F.lit(f"text shorter than {min_len}")),
        F.when(n > max_len, F.lit(f"text longer than {max_len}")),
        F.when(~mode.isin(*modes), F.concat(F.lit("unknown mode "), mode)),
    )
    reason = F.concat_ws("; ", F.filter(reasons, lambda r: r.isNotNull()))
    return req.withColumn("mode", mode).withColumn("reason", F.nullif(reason, F.lit(""))).withColumn(
        "accepted", F.col("reason").isNull()
    )


def respond(accepted: DataFrame, scorers: dict, spec: TaskSpec, key: str = "request_id", latency: Column | None = None) -> DataFrame:
    """Score each accepted request with its mode's scorer:
    ``(request_id, mode, label, raw_output, latency_sec)``."""
    base = accepted.withColumn("text", py_strip("text"))
    out = None
    for m, scorer in scorers.items():
        part = scorer.apply(base.filter(F.col("mode") == m), key, "text")
        if "latency_sec" not in part.columns:
            part = part.withColumn("latency_sec", (latency if latency is not None else F.lit(0.0)).cast("double"))
        part = part.select(
            F.col(key),
            F.col("mode"),
            extract_label(py_strip("raw_output"), spec).alias("label"),
            py_strip("raw_output").alias("raw_output"),
            F.col("latency_sec").cast("double").alias("latency_sec"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def serve_batch(batch: DataFrame, scorers: dict, spec: TaskSpec, key: str = "request_id", latency: Column | None = None):
    """One micro-batch -> (responses, rejects); also the batch twin of X1/X2."""
    v = validate_requests(batch, modes=tuple(scorers))
    rejects = v.filter(~F.col("accepted")).select(key, "mode", "reason")
    return respond(v.filter(F.col("accepted")), scorers, spec, key, latency), rejects


def start_serving(
    requests: DataFrame,
    scorers: dict,
    spec: TaskSpec,
    out_dir: str,
    dead_dir: str,
    checkpoint: str,
    key: str = "request_id",
    latency: Column | None = None,
    available_now: bool = True,
):
    """X1 + X2 as one streaming query; returns the ``StreamingQuery``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            ok, bad = serve_batch(batch, scorers, spec, key, latency)
            ok.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
            bad.write.mode("overwrite").parquet(f"{dead_dir}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    w = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
