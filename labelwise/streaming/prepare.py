"""Streaming prepare (X4): P2-P5 on arriving rows plus first-wins dedup.

Two chained queries:
* the records query cleans and labels every arriving row once and appends
  it, with its text digest and length, to a staging table.  Spark's file
  sink commits whole micro-batches to its log, so a retried batch never
  replaces files that the second query may be reading;
* the dedup query streams the staging table's slim columns (split, label,
  digest, length, key -- parquet column pruning, the text is not read)
  into a streaming aggregate ``min(key)`` per (split, label, digest,
  length) -- fixed-width state, one row per distinct record -- and appends
  the groups it changed to a log.  ``min`` is idempotent, so a retried
  batch cannot change the result.  Every ``COMPACT_EVERY`` batches the log
  so far is reduced to a base of one row per group; readers take the newest
  finished base and the log after it.
The prepared table is then ``staging`` semi-joined, on (split, key), with the
smallest keys, which equals the batch ``to_records`` result for any arrival
order.  The source (and any join that labels it) is read once per
micro-batch.

The dedup state grows with the distinct records, so it is kept in RocksDB
(off-heap, spilled to local disk, changelog checkpoints to the shared
folder) unless the session already names a state store provider.  Where
duplicates arrive within a known delay, ``start_prepare_within`` bounds the
state by a watermark instead: the first to arrive wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prepare import to_records
from ..sources.files import numbers_in, remove
from ..sources.readers import read_optional
from ..spec import TaskSpec

COMPACT_EVERY = 50
GROUP = ("split", "output", "digest", "n")

_DEFAULT_PROVIDER = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB_CONF = {
    _PROVIDER_KEY: ROCKSDB_PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """``conf`` for queries started inside.  A query copies the session's
    settings when it starts; the caller's own come back after."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store for queries started inside, unless a provider
    other than the in-memory default is configured."""
    ours = spark.conf.get(_PROVIDER_KEY, None) in (None, _DEFAULT_PROVIDER)
    with _settings(spark, _ROCKSDB_CONF if ours else {}):
        yield


@contextmanager
def one_batch_a_run(spark: SparkSession) -> Iterator[None]:
    """Queries started inside add no batch without rows when they run out of
    input, so over several runs from one checkpoint the watermark moves as in
    one run: from a batch with rows to the next."""
    with _settings(spark, {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        yield


def trigger(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")


def _marked(records: DataFrame) -> DataFrame:
    return records.withColumns({"__digest": F.sha2(F.col("input"), 256), "__n": F.length("input")})


def _least(log: DataFrame, key: str) -> DataFrame:
    return log.groupBy(*GROUP).agg(F.min(key).alias(key))


def _firsts(spark: SparkSession, out_dir: str, key: str) -> DataFrame:
    """The smallest key of every group logged so far.  A base counts once a
    later batch has begun to log, so it is never a half-written one."""
    log = spark.read.parquet(f"{out_dir}/firsts")
    fields = [f for f in log.schema.fields if f.name != "batch_id"]
    bases = read_optional(spark, f"{out_dir}/bases", T.StructType(fields).add("upto", "long"))
    newest = log.agg(F.max("batch_id")).first()[0]
    base = bases.filter(F.col("upto") < newest).agg(F.max("upto")).first()[0] if newest is not None else None
    if base is None:
        return _least(log, key)
    names = [f.name for f in fields]
    return _least(
        bases.filter(F.col("upto") == base).select(*names).unionByName(log.filter(F.col("batch_id") > base).select(*names)), key
    )


def _forget(spark: SparkSession, out_dir: str) -> None:
    """Remove the bases before the last three, and the log that the oldest of
    these has taken in."""
    bases = numbers_in(spark, f"{out_dir}/bases", "upto")
    for old in bases[:-3]:
        remove(spark, f"{out_dir}/bases/upto={old}")
    if len(bases) >= 3:
        for batch_id in numbers_in(spark, f"{out_dir}/firsts", "batch_id"):
            if batch_id <= bases[-3]:
                remove(spark, f"{out_dir}/firsts/batch_id={batch_id}")


def start_prepare(
    rows: DataFrame,
    spec: TaskSpec,
    key: str,
    out_dir: str,
    checkpoint: str,
    class_names: dict[int, str] | None = None,
    keep=(),
    available_now: bool = True,
    compact_every: int = COMPACT_EVERY,
):
    spark = rows.sparkSession
    recs = _marked(to_records(rows, spec, key=key, class_names=class_names, keep=keep, dedup=False))
    staging = f"{out_dir}/staging"

    def log(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/firsts/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            _firsts(batch.sparkSession, out_dir, key).write.mode("overwrite").parquet(f"{out_dir}/bases/upto={batch_id}")
            _forget(batch.sparkSession, out_dir)

    # starting the sink makes its folder, which the second query reads
    to_staging = recs.writeStream.format("parquet").option("path", staging).option("checkpointLocation", f"{checkpoint}/staging")
    q1 = trigger(to_staging, available_now).start()
    if available_now:
        q1.awaitTermination()  # the dedup pass then sees every staged row
    staged = spark.readStream.schema(recs.schema).parquet(staging)
    firsts = staged.groupBy(
        "split", "output", F.col("__digest").alias("digest"), F.col("__n").alias("n")
    ).agg(F.min(key).alias(key))
    to_log = firsts.writeStream.outputMode("update").foreachBatch(log).option("checkpointLocation", f"{checkpoint}/firsts")
    with rocksdb_state(spark):
        q2 = trigger(to_log, available_now).start()
    return q1, q2


def prepared(spark: SparkSession, out_dir: str, key: str) -> DataFrame:
    """The prepared records produced so far.  A row is named by (split, key):
    keys may be numbered anew in each split."""
    staging = spark.read.parquet(f"{out_dir}/staging").drop("__digest", "__n")
    firsts = _firsts(spark, out_dir, key).select(F.col("split").alias("__s"), F.col(key).alias("__k"))
    same = F.col("split").eqNullSafe(F.col("__s")) & (F.col(key) == F.col("__k"))
    return staging.join(firsts, same, "left_semi")


def start_prepare_within(
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
    """X4 with bounded state: of equal records whose ``event_time`` (a
    timestamp column) lies within ``delay`` of each other, the first to arrive
    is appended to ``out_dir``; rows later than the watermark (which starts at
    1970-01-01) are dropped.  A
    repeat further away is dropped too until its group's state has expired."""
    kept = tuple(dict.fromkeys((*keep, event_time)))
    recs = _marked(to_records(rows, spec, key=key, class_names=class_names, keep=kept, dedup=False))
    once = recs.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["split", "output", "__digest", "__n"])
    to_files = once.drop("__digest", "__n").writeStream.format("parquet").option("path", out_dir).option(
        "checkpointLocation", checkpoint
    )
    with rocksdb_state(rows.sparkSession):
        return trigger(to_files, available_now).start()
