"""Writers: records (S3), predictions (S4), JSON documents (S5), report
text (S6), dataset publishing (S7)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import CONFUSION_COLUMNS, metrics_from_counts, per_label_from_counts
from ..spec import TaskSpec

from .readers import is_absent
from .versions import Version, VersionedTable


def partition_folders(df: DataFrame) -> list[str]:
    """Columns that the paths of a frame's files spell out, in path order."""
    first = next(iter(df.inputFiles()), "")
    found = re.findall(r"/([^/=]+)=[^/]*(?=/)", first)
    return [c for c in found if c in df.columns]


def write_records(df: DataFrame, path: str, fmt: str = "json", partition_by: str | None = "split") -> None:
    """S3: one JSON object per line (non-ASCII kept literal), target
    replaced; parquet is the main format for downstream Spark jobs."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "json":
        w.option("ignoreNullFields", "false").json(path)
    else:
        w.format(fmt).save(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    """The stored prediction fields, ``"predicted": null`` kept,
    one directory per mode."""
    cols = ["mode", "index", "input", "expected", "raw_output", "predicted", "latency_sec"]
    preds.select(*cols).write.mode("overwrite").partitionBy("mode").option("ignoreNullFields", "false").json(path)


def json_document(df: DataFrame, key: str | None = None) -> DataFrame:
    """A small frame (one row per split / mode) as one JSON document:
    ``{key_value: {col: value, ...}, ...}`` or a JSON array without key."""
    body = F.struct(*[F.col(c) for c in df.columns if c != key])
    if key is None:
        return df.agg(F.to_json(F.collect_list(body), {"ignoreNullFields": "false"}).alias("json"))
    return df.agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), body)))), {"ignoreNullFields": "false"}).alias(
            "json"
        )
    )


def _pretty(value) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false", "pretty": "true"}).alias("json")


def stats_document(stats: DataFrame, instruction: str) -> DataFrame:
    """S5 for a prepare run: the instruction and, per split, its counts."""
    body = F.struct(*[F.col(c) for c in stats.columns if c != "split"])
    splits = F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", body))))
    return stats.agg(splits.alias("splits")).select(_pretty(F.struct(F.lit(instruction).alias("instruction"), "splits")))


def metrics_document(c: DataFrame, spec: TaskSpec) -> DataFrame:
    """S5 for an evaluation run: per mode the scalar metrics with nested
    ``per_label`` and ``confusion``, from the one-row-per-mode counts."""
    labels = (
        per_label_from_counts(c, spec)
        .groupBy("mode")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.struct("precision", "recall", "f1"))))).alias("per_label"))
    )
    rows = metrics_from_counts(c).join(c.select("mode", F.struct(*CONFUSION_COLUMNS).alias("confusion")), "mode").join(labels, "mode")
    body = F.struct(*[F.col(x) for x in rows.columns if x != "mode"])
    by_mode = lambda a, b: F.when(a["mode"] < b["mode"], F.lit(-1)).otherwise(F.lit(1))
    return rows.agg(_pretty(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", body.alias("body"))), by_mode))).alias("json"))


def write_json_document(df: DataFrame, path: str, key: str | None = None) -> None:
    """S5 for metrics/stats-sized frames only (bounded: a few rows)."""
    json_document(df, key).coalesce(1).write.mode("overwrite").text(path)


def write_report(lines: DataFrame, path: str) -> None:
    """The ordered line table as one text file (report-sized input)."""
    lines.orderBy("section", "mode_ord", "line_no").select("line").coalesce(1).write.mode("overwrite").text(path)


def publish(spark, source: str, target: str, fmt: str = "parquet", partition_by: Sequence[str] | None = None) -> DataFrame:
    """The source must exist; the target is fully replaced and keeps the
    source's partition folders (those in its paths, or ``partition_by``)."""
    df, folders = _to_publish(spark, source, fmt, partition_by)
    df.write.mode("overwrite").format(fmt).partitionBy(*folders).save(target)
    return spark.read.format(fmt).load(target)


def publish_version(
    spark, source: str, target: VersionedTable, fmt: str = "parquet", partition_by: Sequence[str] | None = None
) -> Version:
    """S7 into a versioned target: whoever reads it meanwhile goes on with the
    version before."""
    df, folders = _to_publish(spark, source, fmt, partition_by)
    return target.replace(df, partition_by=tuple(folders))


def _to_publish(spark, source: str, fmt: str, partition_by: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    try:
        df = spark.read.format(fmt).load(source)
    except AnalysisException as exc:
        if not is_absent(exc):
            raise
        raise FileNotFoundError(f"nothing to publish at {source}") from exc
    return df, list(partition_by) if partition_by is not None else partition_folders(df)
