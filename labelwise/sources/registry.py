"""Dataset registry (S8) and logical column mapping.

A registry row: ``name string, file_name string, columns map<string,string>``
where ``columns`` maps a logical role (prompt, query, response) to a
physical column of the dataset.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .readers import read_optional
from .versions import Version, VersionedTable

REGISTRY_SCHEMA = "name string, file_name string, columns map<string,string>"
# Default role mapping for instruction records (fixed values).
DEFAULT_COLUMNS = {"prompt": "instruction", "query": "input", "response": "output"}


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A missing registry is an empty registry."""
    return read_optional(spark, path, REGISTRY_SCHEMA)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Shallow per-name replace; other names kept."""
    return old.join(new.select("name"), "name", "left_anti").unionByName(new)


def write_registry(df: DataFrame, path: str) -> None:
    """Write a registry version to a path nobody reads in the same job (write
    a new version, then point readers at it); never overwrite the input of
    the upsert."""
    df.write.mode("overwrite").parquet(path)


def upsert_all(new: DataFrame, targets: Mapping[str, str]) -> None:
    """S8 for several registries (e.g. the project's and the consumer's):
    each is read, upserted and written by itself, so entries of one never
    appear in, or vanish from, another.  ``targets`` maps the current version
    of a registry (may be absent) to the path of its next version.  ``new``
    is computed once."""
    spark = new.sparkSession
    path = scratch_path(spark, "registry-entries")
    write_registry(new, path)
    fresh = read_registry(spark, path)
    for current, following in targets.items():
        write_registry(upsert(read_registry(spark, current), fresh), following)


def upsert_version(table: VersionedTable, new: DataFrame) -> Version:
    """S8 on a versioned registry: readers see the old or the new one, and of
    two writers at a time neither loses an entry.  ``new`` is computed once."""
    path = scratch_path(table.spark, "registry-entries")
    write_registry(new, path)
    fresh = read_registry(table.spark, path)
    return table.update(lambda old: upsert(old, fresh), REGISTRY_SCHEMA)


def entries(names: DataFrame, file_name, columns: dict[str, str] = DEFAULT_COLUMNS) -> DataFrame:
    """Registry rows for a frame of names; ``file_name`` is a Column."""
    cmap = F.create_map(*[F.lit(x) for kv in sorted(columns.items()) for x in kv])
    return names.select(F.col("name"), file_name.alias("file_name"), cmap.alias("columns"))


def mapped_columns(df: DataFrame, columns: dict[str, str] = DEFAULT_COLUMNS) -> DataFrame:
    """Logical columns from physical ones, as the registry says."""
    return df.select(*[F.col(src).alias(role) for role, src in columns.items()])
