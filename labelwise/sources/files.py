"""Small helpers on the store that Spark writes to (any Hadoop file system)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in ``path`` (none if it is absent)."""
    fs, at = _open(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def numbers_in(spark: SparkSession, path: str, label: str) -> list[int]:
    """The numbers of the folders ``label=<number>`` in ``path``."""
    return sorted(int(n.split("=", 1)[1]) for n in names_in(spark, path) if n.startswith(f"{label}="))


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _open(spark, path)
    fs.delete(at, True)
