"""Text lines with their positions, by byte ranges of their own.

The files are cut into fixed byte ranges once, and the ranges are written as a
table.  A range owns the lines that start in it, so whoever reads a range meets
the same lines: counting and reading cannot disagree, whatever the session's
file splits, cores or settings are when either runs.

* Ranges are ranked by (path, start) and every task takes a bounded run of
  them; a line's position is its number in its range plus the lines of all
  earlier ranges.  Only these counts are summed, never lines.
* With a limit, ranges are counted from the first on, four times as many each
  time, until they hold enough; the others are not opened.
* A reader that meets another number of lines than was counted raises: the
  files changed meanwhile.
* Compressed files are one range each.  Files in a store that Python cannot
  open are read once by Spark, and the numbered lines are written.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip
from ..operators.ranks import global_positions, sums_before
from ..session import scratch_path

RANGE_BYTES = 32 << 20
RANGES_PER_TASK = 8
_READ = 1 << 20
_BATCH = 4 << 20
_COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".deflate", ".snappy")
_LISTED = ("path", "modificationTime", "length", "content")


def python_file(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark spells it, and the path there."""
    if path.startswith("file:") or path.startswith("/"):
        plain = path.removeprefix("file:")
        return pafs.LocalFileSystem(), "/" + plain.lstrip("/")
    scheme, _, rest = path.partition("://")
    host, _, inner = rest.partition("/")
    known = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    system, base = pafs.FileSystem.from_uri(f"{known}://{host}/")
    return system, f"{base.rstrip('/')}/{inner}"


def opens_in_python(path: str) -> bool:
    try:
        python_file(path)
    except (pa.ArrowException, OSError, NotImplementedError):
        return False
    return True


def lines_between(stream, start: int, stop: int) -> Iterator[bytes]:
    """The lines (ended by ``\\n``, ``\\r`` or ``\\r\\n``, without it) that
    start at byte ``start`` or later and before ``stop``.

    ``stream`` stands at byte ``max(start - 1, 0)``: a line starts at
    ``start`` exactly if the byte before it ends one.
    """
    at, skip = max(start - 1, 0), start > 0
    held, want = b"", _READ
    while True:
        block = stream.read(want)
        pieces = (held + block).splitlines(keepends=True)
        # the last piece may go on, and a last \r may be half of \r\n
        held = pieces.pop() if block and pieces and not pieces[-1].endswith(b"\n") else b""
        want = _READ if pieces else 2 * want
        for piece in pieces:
            first, at = at, at + len(piece)
            if skip:
                skip = False
            elif first >= stop:
                return
            else:
                yield piece.rstrip(b"\r\n")
        if not block or at >= stop:
            return


def is_blank(line: bytes) -> bool:
    """White space only, as ``str.strip`` sees it."""
    bare = line.strip()
    return not bare or (not 0x21 <= bare[0] <= 0x7E and not bare.decode("utf-8", "replace").strip())


def range_lines(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The non-blank lines that a range owns."""
    system, inner = python_file(path)
    if path.endswith(_COMPRESSED):
        source, stop = system.open_input_stream(inner, compression="detect"), 1 << 62
    else:
        source = system.open_input_file(inner)
        source.seek(max(start - 1, 0))
    with source as stream:
        for line in lines_between(stream, start, stop):
            if not is_blank(line):
                yield line


def ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``pos, path, start, stop`` and the paths' partition columns: the fixed
    ranges of all files, in path order, written once."""
    files = spark.read.format("binaryFile").load(path)
    extra = [c for c in files.columns if c not in _LISTED]
    whole = F.lower("path").rlike(r"\.(" + "|".join(c[1:] for c in _COMPRESSED) + ")$")
    last = F.when(whole, F.lit(0)).otherwise(F.floor((F.col("length") - 1) / F.lit(range_bytes))).cast("long")
    cut = (
        files.filter("length > 0")
        .select("path", "length", whole.alias("whole"), *extra, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
        .select(
            "path",
            (F.col("i") * range_bytes).alias("start"),
            F.when(F.col("whole"), F.col("length")).otherwise(F.least("length", (F.col("i") + 1) * range_bytes)).alias("stop"),
            *extra,
        )
    )
    return _written(global_positions(cut, ["path", "start"]), "line-ranges")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dealt(cut: DataFrame, n: int) -> DataFrame:
    """Ranges in tasks of ``RANGES_PER_TASK`` or fewer, however small the rows
    that name them (a numbered layout is not merged)."""
    tasks = max(1, -(-n // RANGES_PER_TASK), min(n, cut.sparkSession.sparkContext.defaultParallelism))
    return cut.repartitionByRange(tasks, "pos")


def _counted(cut: DataFrame, n: int) -> DataFrame:
    """``pos, n``: the non-blank lines of every range."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            found = [sum(1 for _ in range_lines(r["path"], r["start"], r["stop"])) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["pos", "n"])

    return _written(_dealt(cut.select("pos", "path", "start", "stop"), n).mapInArrow(run, "pos long, n long"), "line-counts")


def numbered_lines(spark: SparkSession, path: str, limit: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``row_idx, value`` and partition columns of the non-blank lines; with a
    ``limit`` the first so many."""
    files = spark.read.format("binaryFile").load(path)
    extra = [c for c in files.columns if c not in _LISTED]
    one = files.select("path").first()
    if one is not None and not opens_in_python(one[0]):
        return _numbered_by_spark(spark, path, extra, limit)
    cut = ranges(spark, path, range_bytes)
    n, some = cut.count(), 1
    counts = _counted(cut.filter(F.col("pos") < some), min(some, n)) if limit > 0 else _counted(cut, n)
    while limit > 0 and some < n and (counts.agg(F.sum("n")).first()[0] or 0) < limit:
        more = cut.filter((F.col("pos") >= some) & (F.col("pos") < 4 * some))
        counts, some = counts.unionByName(_counted(more, min(4 * some, n) - some)), 4 * some
    placed = sums_before(counts, "pos", "n", "first").filter(F.col("n") > 0)
    if limit > 0:
        placed = placed.filter(F.col("first") < limit)
    placed = _written(cut.join(placed, "pos"), "line-offsets")
    schema = T.StructType().add("row_idx", "long").add("value", "string")
    schema = T.StructType(schema.fields + [placed.schema[c] for c in extra])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, r in enumerate(b.select(["path", "start", "stop", "first", "n"]).to_pylist()):
                wanted = min(r["n"], limit - r["first"]) if limit > 0 else r["n"]
                lines = range_lines(r["path"], r["start"], r["stop"])
                found = 0
                for values in _batches(lines, wanted):
                    ids = pa.array(range(r["first"] + found, r["first"] + found + len(values)), pa.int64())
                    found += len(values)
                    same = pa.array([i] * len(values), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(values, pa.string()), *[b.column(c).take(same) for c in extra]], names=["row_idx", "value", *extra]
                    )
                if found < wanted or (wanted == r["n"] and next(lines, None) is not None):
                    raise RuntimeError(f"{r['path']} changed while it was read: not {r['n']} lines from byte {r['start']} any more")

    slim = placed.select("pos", "path", "start", "stop", "first", "n", *extra)
    return _dealt(slim, placed.count()).mapInArrow(run, schema)


def _batches(lines: Iterator[bytes], most: int) -> Iterator[list[str]]:
    """The first ``most`` lines, as text, in lists of about ``_BATCH`` bytes."""
    values, held = [], 0
    for line in islice(lines, most):
        values.append(line.decode("utf-8", "replace"))
        held += len(line)
        if held >= _BATCH:
            yield values
            values, held = [], 0
    if values:
        yield values


def _numbered_by_spark(spark: SparkSession, path: str, extra: list[str], limit: int) -> DataFrame:
    """The same by Spark's own line reader, for stores that only it opens: one
    pass writes every line with its file, block and order in the block."""
    lines: DataFrame = spark.read.text(path)
    blank: Column = F.length(py_strip(F.col("value"))) == 0
    tagged = lines.filter(~blank).select(
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
        "value",
        *extra,
    )
    ranked = global_positions(_written(tagged, "tagged-lines"), ["__file", "__block", "__id"])
    kept = ranked if limit <= 0 else ranked.filter(F.col("pos") < limit)
    return kept.select(F.col("pos").alias("row_idx"), "value", *extra)
