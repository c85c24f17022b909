"""Session helpers: a local session for tests/bench and the shared folder
used to cut lineage (written tables, ``checkpoint()``)."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every plan in this package assumes.  AQE re-plans joins and
# coalesces shuffle partitions at runtime; skew-join splits hot partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "labelwise") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this is set by the deployment and must be on shared
    storage.  Only a ``local`` session (tests, bench) may leave it unset and
    gets a temporary folder; on a cluster that folder would be a different
    one on every machine, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="labelwise-ckpt-")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir() or current
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared folder.  It belongs to the
    innermost ``scratch_scope``, if any."""
    base = shared_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Owner of scratch tables: at its end, every folder that ``scratch_path``
    handed out inside is removed.

        with scratch_scope(spark):
            pack(docs).write.parquet(target)

    Results are lazy and read scratch tables, so write what you keep before
    the scope ends.  Scopes nest; they belong to one driver thread.
    """
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.pop()
        for path in paths:
            _remove_folder(path)


def _remove_folder(path: str) -> None:
    from pyarrow import fs

    scheme = "://" in path or path.startswith("file:")
    plain = f"file://{local_path(path)}" if not scheme or path.startswith("file:") else path
    system, inner = fs.FileSystem.from_uri(plain)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        system.delete_dir(inner)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme (for local-only helpers in tests)."""
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)
