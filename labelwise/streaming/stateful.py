"""Streaming prepare with keyed state (X4): every record is written once.

``start_prepare_stateful`` keeps, for every (split, label, text digest,
length), the smallest-keyed row seen so far in a value state, and a timer that
fires ``delay`` after the event time of the first.  When the watermark reaches
it, the row is written and its state removed.  So the sink gets each prepared
record once, with the smallest key among the equal rows whose event times lie
within ``delay`` of the first, in whatever order they arrived; nothing is
staged, logged or joined again, and the state holds the records of the last
``delay`` and no others.  Rows older than the watermark are dropped.  A retried
micro-batch starts from the same state and offsets, and the file sink commits
it once.

``labelled_stream`` joins texts with labels that arrive as a stream of their
own, so no micro-batch reads a label table again.  Both sides are kept for
``delay`` and then forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.prepare import to_records
from ..spec import TaskSpec
from .prepare import GROUP, rocksdb_state, trigger

_MILLIS = "__millis"


class FirstRecord(StatefulProcessor):
    """One group of equal records: the row with the smallest key waits until
    its timer fires."""

    def __init__(self, fields: T.StructType, key: str, hold_millis: int):
        self.fields, self.key, self.hold = fields, key, hold_millis

    def init(self, handle) -> None:
        self.handle = handle
        self.least = handle.getValueState("least", self.fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        least = dict(zip(self.fields.names, self.least.get(), strict=True)) if self.least.exists() else None
        waiting, first = least is not None, None
        for row in rows:
            if row[_MILLIS] <= watermark:
                continue  # late
            first = row[_MILLIS] if first is None else min(first, row[_MILLIS])
            if least is None or row[self.key] < least[self.key]:
                least = {name: row[name] for name in self.fields.names}
        if first is not None:
            self.least.update(tuple(least[name] for name in self.fields.names))
            if not waiting:
                self.handle.registerTimer(first + self.hold)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        row = self.least.get()
        self.least.clear()
        yield Row(*self.fields.names)(*row)

    def close(self) -> None:
        pass


def _millis(spark, delay: str) -> int:
    return int(spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {delay})").first()[0])


def start_prepare_stateful(
    rows: DataFrame,
    spec: TaskSpec,
    key: str,
    event_time: str,
    delay: str,
    out_dir: str,
    checkpoint: str,
    class_names: dict[int, str] | None = None,
    keep=(),
    available_now: bool = True,
):
    """P2-P5 + L5 on a stream; appends ``split, key, instruction, input,
    output`` and ``keep`` to ``out_dir``.  ``delay`` is an interval such as
    ``10 minutes``."""
    spark = rows.sparkSession
    kept = tuple(dict.fromkeys((*keep, event_time)))
    recs = to_records(rows, spec, key=key, class_names=class_names, keep=kept, dedup=False)
    fields = T.StructType([f for f in recs.schema.fields if f.name != event_time or event_time in keep])
    marked = recs.withWatermark(event_time, delay).withColumns(
        {"digest": F.sha2(F.col("input"), 256), "n": F.length("input"), _MILLIS: F.unix_millis(event_time)}
    )
    once = marked.groupBy(*GROUP).transformWithState(FirstRecord(fields, key, _millis(spark, delay)), fields, "Append", "EventTime")
    writer = once.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
    with rocksdb_state(spark):
        return trigger(writer, available_now).start()


def labelled_stream(
    texts: DataFrame, labels: DataFrame, key: str, text_time: str, label_time: str, delay: str, how: str = "inner"
) -> DataFrame:
    """``texts`` with the columns of ``labels`` (both streams) whose key is the
    same and whose time lies between the text's and ``delay`` later.  With
    ``how="left_outer"`` a text without such a label comes out, once the
    watermark has passed, with nulls."""
    here = texts.withWatermark(text_time, delay)
    there = labels.withColumnRenamed(key, "__label_key").withWatermark(label_time, delay)
    at = F.col(label_time)
    match = (F.col(key) == F.col("__label_key")) & (at >= F.col(text_time)) & (at <= F.col(text_time) + F.expr(f"INTERVAL {delay}"))
    return here.join(there, match, how).drop("__label_key")
