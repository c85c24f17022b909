"""Readers: first-available source (S1), JSON Lines (S2), optional tables
(S9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip
from .lines import numbered_lines

# Spark's error conditions for "there is nothing at this path".
_ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def is_absent(exc: AnalysisException) -> bool:
    condition = exc.getCondition() or ""
    return any(condition.startswith(c) for c in _ABSENT)


def read_first(
    spark: SparkSession,
    candidates: Sequence[str],
    fmt: str = "parquet",
    explicit: str | None = None,
    schema: T.StructType | str | None = None,
    require: Sequence[Sequence[str]] = (),
    **options,
) -> DataFrame:
    """The table at the first candidate path that exists and has the
    wanted shape; ``explicit`` is the only candidate if given.

    ``require``: groups of column names, of each of which the table needs at
    least one.  Only an absent path or a wrong shape moves on to the next
    candidate; any other error is raised at once.  If none fits, the error
    names the reason for each path.  Corrupt data inside a file fails at the
    first action (Spark reads lazily).
    """
    refused: dict[str, str] = {}
    for path in (explicit,) if explicit else candidates:
        source = spark.read.format(fmt).options(**options)
        try:
            table = (source.schema(schema) if schema is not None else source).load(path)
        except AnalysisException as exc:
            if not is_absent(exc):
                raise
            refused[path] = "nothing there"
            continue
        lacking = [group for group in require if not set(group) & set(table.columns)]
        if not lacking:
            return table
        refused[path] = "no column of " + ", ".join("/".join(g) for g in lacking)
    raise RuntimeError("no usable source; " + "; ".join(f"{p} ({why})" for p, why in refused.items()))


def read_jsonl(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    limit: int = 0,
    key: str | None = None,
) -> DataFrame:
    """S2 (+ L4): JSON Lines with a fixed schema.

    Lines of white space only (Unicode) are skipped and do not count toward
    ``limit``; a malformed line raises (FAILFAST).  With ``key`` (a field of
    every record, as our sinks write it) ``limit`` keeps the ``limit``
    smallest keys.  Without it the records get ``row_idx``: the 0-based
    position of the line among the non-blank lines of all files in path
    order.

    Positions come from fixed byte ranges (``lines.py``), so they hold under
    any session setting; a limit opens the first ranges and few more.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    record = F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")
    if key is None:
        numbered = numbered_lines(spark, path, limit)
        extra = [c for c in numbered.columns if c not in ("row_idx", "value")]
        return numbered.select("row_idx", record, *extra).select("row_idx", "r.*", *extra)
    lines = spark.read.text(path)
    extra = [c for c in lines.columns if c != "value"]  # partition columns
    parsed = lines.filter(F.length(py_strip(F.col("value"))) > 0).select(record, *extra).select("r.*", *extra)
    from ..operators.splits import first_by_key

    return first_by_key(parsed, key, limit) if limit > 0 else parsed


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """The table at ``path``, or an empty frame of ``schema`` when it is
    absent (absence is not an error; anything else is)."""
    try:
        return spark.read.format(fmt).schema(schema).load(path)
    except AnalysisException as exc:
        if not is_absent(exc):
            raise
        return spark.createDataFrame([], schema)
