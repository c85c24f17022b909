"""Best-fit sequence packing by exact complements.

Which pieces share a sequence depends only on how many pieces there are of
each length, and lengths are at most ``CAPACITY``.  So the corpus is reduced
to one count per length, the packing is planned on those counts, and the plan
is dealt out to the pieces by their rank within their length.

Plan: the sums of one, two and three available lengths are indexed; from the
longest length down, the gap a piece leaves is looked up there, and a
combination that fills it exactly is consumed as often as the counts allow.
What has no exact complement is packed best-fit, longest first.

Scale: texts are encoded once and never shuffled; only narrow piece rows
(ids, lengths, checksum) move.  The plan's size depends on the capacity, not
on the corpus.  A piece's rank is its rank within its own task plus the count
of that length in earlier tasks, so a length that a third of all pieces share
is ranked by all tasks, not by one.  A task's pieces meet its ``capacity``
counts in one row by a shuffle join on the task: nothing that grows with the
tasks is broadcast.

Defined results: a null or empty text is one piece that holds only the end
token; texts over the capacity are cut so that only the first piece is
shorter; repeated rows and ids are pieces of their own; an empty table packs
into nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .tokens import default_tokenizer, id_bytes

CAPACITY = 1024
END = 2


class SumIndex:
    """Which available lengths sum to a gap: singles by their length, pairs by
    their sum, triples by their longest part and the pair that is left.

    Counts only fall, so a pair of which a length has run out never comes back:
    each sum's list of pairs is entered at the first that may still serve.
    """

    def __init__(self, left: list[int]):
        self.left = left
        lengths = [x for x in range(1, len(left)) if left[x] > 0]
        self.lengths = lengths[::-1]
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for a in self.lengths:  # longest part first
            for b in lengths:
                if b > a or a + b >= len(left):
                    break
                self.pairs.setdefault(a + b, []).append((a, b))
        self.entry = dict.fromkeys(self.pairs, 0)

    def has(self, used: tuple[int, ...]) -> bool:
        return all(self.left[x] >= used.count(x) for x in used)

    def pair(self, total: int, beside: tuple[int, ...], longest: int) -> tuple[int, int] | None:
        """The pair with the longest part, at most ``longest``, that is
        available beside what is taken already."""
        found, left = self.pairs.get(total, ()), self.left
        at, n = self.entry.get(total, 0), len(found)
        while at < n and not (left[found[at][0]] and left[found[at][1]]):
            at += 1
        self.entry[total] = at
        if at < n and found[at][0] > longest:
            at = bisect_left(found, -longest, at, key=lambda p: -p[0])
        for a, b in islice(found, at, None):
            if left[a] and left[b] and self.has((*beside, a, b)):
                return a, b
        return None

    def filling(self, gap: int, beside: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """A single, else a pair, else a triple of lengths that sum to ``gap``,
        longest part first."""
        if gap <= 0:
            return None
        if self.has((*beside, gap)):
            return (gap,)
        pair = self.pair(gap, beside, gap)
        if pair:
            return pair
        for a in self.lengths:
            if 3 * a < gap:
                break
            if a < gap - 1 and self.left[a] and self.has((*beside, a)):
                pair = self.pair(gap - a, (*beside, a), a)
                if pair:
                    return (a, *pair)
        return None


def exact_combination(gap: int, left: Sequence[int]) -> tuple[int, ...] | None:
    """Up to three of the available lengths that sum to ``gap``: a single, else
    a pair, else a triple, longest part first."""
    return SumIndex(list(left)).filling(gap)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many alike) for ``counts[length]`` pieces."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] += n
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), left[capacity]))
        left[capacity] = 0
    index = SumIndex(left)
    for length in range(capacity - 1, 0, -1):
        while left[length] > 0:
            rest = index.filling(capacity - length, (length,))
            if rest is None:
                break
            used = (length, *rest)
            need = {x: used.count(x) for x in used}
            times = min(left[x] // k for x, k in need.items())
            for x, k in need.items():
                left[x] -= k * times
            out.append((used, times))
    # best fit, longest first, for whole groups of equal sequences
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity - 1, 0, -1):
        n = left[length]
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                used, times, gap = (), n, capacity
            else:
                used, times = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
            each = min(gap // length, n)
            full = min(times, n // each)
            if used and times > full:
                open_.setdefault(gap, []).append((used, times - full))
            open_.setdefault(gap - each * length, []).append((used + (length,) * each, full))
            n -= each * full
    out += [group for gap in sorted(open_) for group in open_[gap]]
    return out


class Slots:
    """Where the r-th piece of each length goes."""

    def __init__(self, groups: list[tuple[tuple[int, ...], int]]):
        used: dict[int, int] = {}
        rows, base = [], 0
        for lengths, times in groups:
            at = 0
            for x in lengths:
                rows.append(((x << 44) + used.get(x, 0), base, at))
                used[x] = used.get(x, 0) + times
                at += x
            base += times
        table = np.array(sorted(rows), np.int64).reshape(len(rows), 3)
        self.start, self.sequence, self.offset = table[:, 0], table[:, 1], table[:, 2]
        self.sequences = base

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << 44) + rank
        k = np.searchsorted(self.start, key, side="right") - 1
        return self.sequence[k] + (key - self.start[k]), self.offset[k]


def pieces(docs: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece, with the task that made it and the piece's rank
    among the task's pieces of its length."""
    tail = np.array([end], "<u4").tobytes()
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind)]).add("piece", "integer").add("start", "long").add("length", "long").add(
        "ids_crc32", "long"
    ).add("task", "long").add("rank", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        encode = id_bytes(path)
        task = TaskContext.get().partitionId()
        so_far = [0] * (capacity + 1)
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                ids = encode(t) + tail
                n = len(ids) // 4
                start, k = 0, 0
                stop = n % capacity or capacity
                while start < n:
                    size = stop - start
                    rows.append((i, k, start, size, zlib.crc32(ids[4 * start : 4 * stop]), task, so_far[size]))
                    so_far[size] += 1
                    start, stop, k = stop, stop + capacity, k + 1
            if rows:
                cols = list(zip(*rows, strict=True))
                ident = b.column(0).take(pa.array(cols[0], pa.int64())).cast(arrow.field(0).type)
                yield pa.RecordBatch.from_arrays(
                    [ident] + [pa.array(c, arrow.field(j + 1).type) for j, c in enumerate(cols[1:])], schema=arrow
                )

    return docs.select(key, text).mapInArrow(run, schema)


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = written(pieces(docs, key, text, path or default_tokenizer(), capacity, end), "pieces")
    per_task = written(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Slots(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    by_task = offsets.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("length", "earlier"))).alias("earlier"))
    ranked = cut.join(by_task.hint("merge"), "task").select(
        key, "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")[F.col("length")]).alias("rank")
    )
    schema = T.StructType(list(cut.schema.fields[:5])).add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                seq, at = slots.place(b.column(3).to_numpy(), b.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:5], pa.array(seq), pa.array(at)], names=[f.name for f in schema.fields]
                )

    return ranked.mapInArrow(run, schema)
