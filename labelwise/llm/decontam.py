"""Benchmark decontamination: BM25 over the test items, block-max WAND.

The benchmark is the index, the corpus is the query stream.  Items are cut
into segments of at most ``SEGMENT`` words; a segment's BM25 impacts are
divided by its own total, so a passage holding all its words scores 1.  Every
text is cut into overlapping passages of two segment lengths, so each segment
copied into a text lies whole in one passage.  Each passage retrieves all
segments scoring ``THRESHOLD`` or more:

* postings are cut into blocks of ``BLOCK`` segments with each term's largest
  impact there; summing those for all passages of a text at once rules out
  every (passage, block) whose upper bound stays below the threshold;
* in the blocks left, document-at-a-time WAND moves its cursors by pivots
  under the same block maxima and scores only segments that can reach it.

The bounds never fall below true scores, so nothing above the threshold is
lost.  A retrieved item counts as leaked if the text holds ``OVERLAP`` of the
5-word shingles of its question and of its answer.  An item is cut before
"answer:" (the label itself is not looked for) or after its last inner "?";
with neither, its last third stands as the answer.  In a part of fewer than
``SHORT`` words one changed word can undo most shingles; there it also counts
which share of its words, weighed by rarity, some stretch around a retrieved
passage has in order, words put in between taken off.

Scale: one pass over the corpus, no shuffle.  Document frequencies and the mean
length are counted over all items.  A benchmark over ``INDEX_BYTES`` is cut into
shards, each built by one task with these global figures (so scores do not
depend on the shards) and searched in a pass of its own; the driver holds one
shard's index at a time, to broadcast it.

Defined results: null and empty texts match nothing; items without a word
are never found; items without an answer that are shorter than a shingle must
occur whole, other items not; repeated rows
give repeated results; repeated items are found under each of their ids.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fresh_names, written

SEGMENT = 64
THRESHOLD = 0.6
OVERLAP = 0.5
SHINGLE = 5
SHORT = 3 * SHINGLE - 1  # from here on, one changed word leaves half of the shingles
BLOCK = 4
SLACK = 1e-9  # rounding allowance of the bounds
INDEX_BYTES = 16 << 20
K1, B = 1.2, 0.75

_PLAIN = bytes(
    (c + 32 if 0x41 <= c <= 0x5A else c) if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)
)


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates."""
    return text.translate(_PLAIN).split() if text else []


def shingles(words: Sequence[bytes], n: int = SHINGLE) -> set[tuple]:
    n = min(n, len(words))
    return set(zip(*[words[k:] for k in range(n)], strict=False)) if n else set()


def question_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    found = re.search(rb"(?i)\banswer\s*:", text)
    at = found.start() if found else text.rstrip().rstrip(b"?").rfind(b"?") + 1
    if at > 0:
        q, a = plain_words(text[:at]), plain_words(text[at:])
        if q and a:
            return q, a
    words = plain_words(text)
    cut = len(words) - len(words) // 3
    return (words, words) if len(words) < 2 * SHINGLE else (words[:cut], words[cut:])


def item_parts(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Question and answer without the answer's label (unless that is all)."""
    q, a = question_answer(text)
    if a[:1] == [b"answer"] and a is not q and len(a) > 1 and re.search(rb"(?i)\banswer\s*:", text):
        a = a[1:]
    return q, a


def in_order(part: Sequence[bytes], weight: Sequence[float], words: Sequence[bytes]) -> float:
    """Largest share of the part's weight that some stretch of ``words`` has
    in order; each word of the stretch beyond the part takes off a mean one."""
    total = sum(weight)
    extra = total / len(part)
    row = [0.0] * (len(words) + 1)  # least cost of a stretch that ends here
    for w, cost in zip(part, weight, strict=True):
        new = [row[0] + cost]
        for j, b in enumerate(words):
            # one word in place of another costs the word it replaces
            step = row[j] if w == b else row[j] + cost
            new.append(min(step, row[j + 1] + cost, new[j] + extra))
        row = new
    return 1 - min(row) / total


def segments(words: Sequence[bytes]) -> list[Counter]:
    """The word counts of an item's segments, all of about one length."""
    if not words:
        return []
    pieces = -(-len(words) // SEGMENT)
    size = -(-len(words) // pieces)
    return [Counter(words[k : k + size]) for k in range(0, len(words), size)]


class Index:
    """Inverted index of the items' segments with block maxima.

    ``statistics``: (number of segments, their words in all, segments with
    each term) of the whole benchmark, if the items are but a part of it.
    """

    def __init__(self, items: Iterable[tuple[object, bytes]], statistics: tuple[int, int, Mapping[bytes, int]] | None = None):
        self.items: list = []
        self.parts: list[tuple[set, set]] = []
        self.words: list[tuple[list, list]] = []
        self.owner: list[int] = []
        bags: list[Counter] = []
        for ident, text in items:
            words = plain_words(text)
            if not words:
                continue
            q, a = item_parts(text)
            self.items.append(ident)
            self.parts.append((shingles(q), shingles(a)))
            self.words.append((q, a))
            for bag in segments(words):
                self.owner.append(len(self.items) - 1)
                bags.append(bag)
        if statistics is None:
            every = Counter(t for bag in bags for t in bag)
            statistics = len(bags), sum(sum(b.values()) for b in bags), every
        n, length, frequency = statistics
        terms = sorted({t for bag in bags for t in bag})
        self.term = {t: i + 1 for i, t in enumerate(terms)}  # 0: not in the index
        self.rarity = {t: float(np.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5))) for t in terms}
        average = length / max(n, 1)
        postings: list[list] = [[] for _ in range(len(self.term) + 1)]
        for s, bag in enumerate(bags):
            norm = K1 * (1 - B + B * sum(bag.values()) / average)
            impact = {t: self.rarity[t] * c * (K1 + 1) / (c + norm) for t, c in bag.items()}
            total = sum(impact.values())
            for t, w in impact.items():
                postings[self.term[t]].append((s, float(w / total)))
        self.segments = [[s for s, _ in p] for p in postings]
        self.impacts = [[w for _, w in p] for p in postings]
        # per term: the blocks of BLOCK segments it occurs in, and its largest impact there
        at_block = [
            [(b, max(w for s, w in p if s // BLOCK == b)) for b in sorted({s // BLOCK for s, _ in p})] for p in postings
        ]
        self.n_blocks = -(-len(bags) // BLOCK)
        self.block_count = np.array([len(p) for p in at_block], np.int64)
        self.block_start = np.cumsum(self.block_count) - self.block_count
        self.block_id = np.array([b for p in at_block for b, _ in p], np.int64)
        self.block_most = np.array([w for p in at_block for _, w in p], float)
        self.ceiling = [dict(p) for p in at_block]

    def dump(self) -> bytes:
        """Everything in it, as plain data."""
        return pickle.dumps(self.__dict__, protocol=5)

    @classmethod
    def load(cls, data: bytes) -> Index:
        index = cls.__new__(cls)
        index.__dict__.update(pickle.loads(data))
        return index

    def retrieve(self, terms: Sequence[int], block: int, least: float = THRESHOLD) -> list[tuple[int, float]]:
        """All (segment, score) of ``least`` or more in a block for a
        passage's distinct terms: document-at-a-time WAND, with the terms'
        maxima in this block as bounds."""
        first, stop = block * BLOCK, (block + 1) * BLOCK
        cursors = []  # [segment, place in the postings, term, largest impact in this block]
        for t in terms:
            most = self.ceiling[t].get(block)
            if most is not None:
                place = bisect_left(self.segments[t], first)
                cursors.append([self.segments[t][place], place, t, most])
        out = []

        def forward(c: list, to: int) -> None:
            c[1] = bisect_left(self.segments[c[2]], to, c[1])
            c[0] = self.segments[c[2]][c[1]] if c[1] < len(self.segments[c[2]]) else stop

        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= least - SLACK:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            if cursors[0][0] == at:
                here = [c for c in cursors if c[0] == at]
                score = sum(self.impacts[c[2]][c[1]] for c in here)
                if score >= least - SLACK:
                    out.append((at, score))
                for c in here:
                    forward(c, at + 1)
            else:
                for c in cursors[:pivot]:
                    forward(c, at)
            cursors = [c for c in cursors if c[0] < stop]
        return out

    def passages(self, ids: np.ndarray) -> Iterator[tuple[int, list[tuple[int, float]]]]:
        """(word at which a passage starts, segments it retrieves)."""
        terms = len(self.term) + 1
        span = max(2, (1 << 21) // max(self.n_blocks, 1))  # passages at a time
        count = max(-(-len(ids) // SEGMENT) - 1, 1)
        for low in range(0, count, span):
            high = min(low + span, count)
            part = ids[low * SEGMENT : (high + 1) * SEGMENT]
            at = np.flatnonzero(part)
            piece, term = at // SEGMENT, part[at]
            # a passage is two neighbouring pieces
            key = np.unique(
                np.concatenate([(piece * terms + term)[piece < high - low], ((piece - 1) * terms + term)[piece > 0]])
            )
            passage, term = key // terms, key % terms
            n = self.block_count[term]
            place = np.arange(n.sum()) + np.repeat(self.block_start[term] - (np.cumsum(n) - n), n)
            bound = np.bincount(
                np.repeat(passage, n) * self.n_blocks + self.block_id[place],
                weights=self.block_most[place],
                minlength=(high - low) * self.n_blocks,
            )
            for cell in np.flatnonzero(bound >= THRESHOLD - SLACK).tolist():
                p, block = divmod(cell, self.n_blocks)
                a, b = np.searchsorted(passage, [p, p + 1])
                found = self.retrieve(term[a:b].tolist(), block)
                if found:
                    yield (low + p) * SEGMENT, found

    def search(self, text: bytes | None) -> list[tuple[object, float, int, float, float]]:
        """Leaked items of a text: (item id, best score, word at which that
        passage starts, question overlap, answer overlap)."""
        words = plain_words(text)
        if not words or not self.items:
            return []
        get = self.term.get
        ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        best: dict[int, tuple[float, int]] = {}
        where: dict[int, list[int]] = {}
        for at, found in self.passages(ids):
            for s, score in found:
                item = self.owner[s]
                where.setdefault(item, []).append(at)
                if item not in best or score > best[item][0] + SLACK:
                    best[item] = (score, at)
        if not best:
            return []
        have = {n: shingles_of(words, n) for n in {len(next(iter(p))) for i in best for p in self.parts[i]}}
        out = []
        for item in sorted(best):
            share = []
            q, a = self.words[item]
            for part, plain in zip(self.parts[item], (q, a), strict=True):
                seen = have[len(next(iter(part)))]
                share.append(sum(s in seen for s in part) / len(part))
                whole = q == a and len(plain) < SHINGLE
                if share[-1] < OVERLAP and len(plain) < SHORT and not whole:
                    weight = [self.rarity.get(w, 1.0) for w in plain]
                    around = _stretches(where[item], len(words))
                    share[-1] = max([share[-1], *(in_order(plain, weight, words[x:y]) for x, y in around)])
            if min(share) >= OVERLAP:
                out.append((self.items[item], *best[item], *share))
        return out


def _stretches(starts: Iterable[int], n: int) -> list[tuple[int, int]]:
    """The passages at ``starts`` and a piece on either side, joined where
    they meet."""
    out: list[tuple[int, int]] = []
    for at in sorted(set(starts)):
        a, b = max(0, at - SEGMENT), min(n, at + 3 * SEGMENT)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def shingles_of(words: Sequence[bytes], n: int) -> set[tuple]:
    return set(zip(*[words[k:] for k in range(n)], strict=False))


class Shards(Sequence):
    """The shards of a benchmark's index, a written table of one row each;
    only the one asked for is fetched."""

    def __init__(self, table: DataFrame, n: int):
        self.table, self.n = table, n

    def __len__(self) -> int:
        return self.n

    def data(self, i: int) -> bytes:
        row = self.table.filter(F.col("shard") == i).select("data").first()
        return bytes(row["data"]) if row else Index([]).dump()

    def __getitem__(self, i: int) -> Index:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return Index.load(self.data(i))


def build_indexes(items: DataFrame, key: str = "item_id", text: str = "text", limit: int = INDEX_BYTES) -> Shards:
    """The index, in as many shards (by a hash of the id and text) as keep
    each shard's text near ``limit`` bytes; built by one task a shard."""
    rows = items.filter(F.col(text).isNotNull() & (F.length(text) > 0)).select(
        F.col(key).alias("k"), F.col(text).cast("binary").alias("t")
    )
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(1, -(-int(size) // limit))
    rows = written(rows.withColumn("shard", F.pmod(F.xxhash64("k", "t"), F.lit(shards))), "leak-items")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for shard, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for bag in segments(plain_words(text)):
                    out += [(shard, t, 1, 0, 0) for t in bag]
                    out.append((shard, b"", 0, 1, sum(bag.values())))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "term", "df", "n", "length"])

    counted = written(
        rows.select("shard", "t").mapInArrow(count, "shard long, term binary, df long, n long, length long").groupBy("shard", "term").agg(
            *[F.sum(c).alias(c) for c in ("df", "n", "length")]
        ),
        "leak-terms",
    )
    n, length = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    everywhere = counted.groupBy("term").agg(F.sum("df").alias("df"))
    of_shard = counted.filter("df > 0").select("shard", "term").join(everywhere, "term")
    nothing = F.lit(None)
    parts = rows.select("shard", "k", "t", nothing.cast("binary").alias("term"), nothing.cast("long").alias("df")).unionByName(
        of_shard.select("shard", nothing.cast(rows.schema["k"].dataType).alias("k"), nothing.cast("binary").alias("t"), "term", "df")
    )

    def build(group: pa.Table) -> pa.Table:
        found, frequency = [], {}
        for r in group.select(["k", "t", "term", "df"]).to_pylist():
            if r["term"] is None:
                found.append((r["k"], r["t"]))
            else:
                frequency[r["term"]] = r["df"]
        found.sort(key=lambda x: (x[0] is None, x[0], x[1]))
        data = Index(found, (n, length, frequency)).dump()
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    built = parts.groupBy("shard").applyInArrow(build, "shard long, data binary")
    return Shards(written(built, "leak-shards"), shards)


def _searcher(shared) -> Callable[[], Index]:
    """The broadcast index, loaded once in a task."""
    return lambda: Index.load(shared.value)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    limit: int = INDEX_BYTES,
) -> DataFrame:
    """Leaked (document, item) pairs: ``key, item, score, passage_start,
    question_overlap, answer_overlap``."""
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField(item, items.schema[item].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("passage_start", T.LongType()),
            T.StructField("question_overlap", T.DoubleType()),
            T.StructField("answer_overlap", T.DoubleType()),
        ]
    )
    narrow, sc = docs.select(key, text), docs.sparkSession.sparkContext

    def one(load: Callable[[], Index]) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow, index = to_arrow_schema(schema), load()
            for b in batches:
                hits = [
                    (i, *hit)
                    for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist())
                    for hit in index.search(t)
                ]
                if hits:
                    cols = list(zip(*hits, strict=True))
                    ids = b.column(0).take(pa.array(cols[0], pa.int64()))
                    arrays = [ids.cast(arrow.field(0).type)] + [
                        pa.array(c, arrow.field(k + 1).type) for k, c in enumerate(cols[1:])
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

        return narrow.mapInArrow(run, schema)

    shards = build_indexes(items, item, item_text, limit)
    return reduce(DataFrame.unionByName, [one(_searcher(sc.broadcast(shards.data(i)))) for i in range(len(shards))])


def without_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", limit: int = INDEX_BYTES
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    shards, out = build_indexes(items, item, item_text, limit), docs
    for i in range(len(shards)):
        (flag,) = fresh_names(out, "leaked")
        load = _searcher(docs.sparkSession.sparkContext.broadcast(shards.data(i)))

        def make(load: Callable[[], Index] = load) -> Callable[[list], Sequence]:
            index = load()
            return lambda batch: [[bool(index.search(t)) for t in batch]]

        out = append_columns(out, make, text, [(flag, "boolean")]).filter(~F.col(flag)).drop(flag)
    return out
