"""Running quality metrics over a stream of labelled predictions.

The streaming aggregate is exactly ``evaluate.counts``: conditional sums
grouped by mode, so the state is one row per mode whatever the volume.
Each trigger writes the (tiny) complete result as a version of its own
(``batch_id=N``); ``latest`` reads the newest one, so a reader never meets a
half-replaced table, and a retried trigger replaces its own version only.
The last ``KEEP`` versions stay; older ones go with the next trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.evaluate import counts
from ..sources.files import names_in, numbers_in, remove
from ..spec import TaskSpec

KEEP = 10


def running_counts(stream_preds: DataFrame, spec: TaskSpec) -> DataFrame:
    return counts(stream_preds, spec)


def start_metrics(
    stream_preds: DataFrame, spec: TaskSpec, out_dir: str, checkpoint: str, available_now: bool = True, keep: int = KEEP
):
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
        for old in numbers_in(batch.sparkSession, out_dir, "batch_id"):
            if old <= batch_id - keep:
                remove(batch.sparkSession, f"{out_dir}/batch_id={old}")

    w = (
        running_counts(stream_preds, spec)
        .writeStream.outputMode("complete")
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def latest(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest complete result (folder names alone tell which)."""
    done = [n for n in numbers_in(spark, out_dir, "batch_id") if "_SUCCESS" in names_in(spark, f"{out_dir}/batch_id={n}")]
    return spark.read.parquet(f"{out_dir}/batch_id={max(done)}")
