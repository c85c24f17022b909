"""Ranked lexical search over a length-stratified index.

A document's score for an item is the sum, over the item's distinct terms, of
the term's weight times an impact that depends on the term's occurrences tf in
the document and on the document's normaliser m alone.  So documents of equal
m form a stratum; inside a stratum a term's postings are grouped by tf, and
one impact is computed for each (m, tf), not for each posting.  A stratum's
bound for an item is the sum of its terms' largest impacts there; strata are
visited from the highest bound down, until the bound falls below the score of
the last of the ``top`` documents found so far.

Scale: texts are read once, into a written table of each document's terms (of
the items' terms only, where these are at most ``VOCABULARY_BYTES`` and can be
broadcast; else of all).  Collection statistics come from all rows of it by
map-side aggregation.  Every task indexes its own documents in segments of at
most ``SEGMENT_POSTINGS`` postings, so a stratum that a third of all documents
share is searched by all tasks.  Items are asked in blocks of about
``BLOCK_TERMS`` terms.  A task returns at most ``top`` documents of each item
and segment; they are ranked first within ``FAN_IN`` tasks, then over all, so
no task meets the candidates of a whole corpus.

Integers are 64 bits throughout and all sums exact, whatever the partitions.

Defined results: a null text has no terms; an item without terms, or whose
terms no document holds, has no rows; a repeated item row is ranked anew with
its own rows; repeated documents rank each by itself; documents of equal score
rank by ascending key, null keys last; an empty table on either side gives no
rows; extra columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

TOP = 50
VOCABULARY_BYTES = 64 << 20
BLOCK_TERMS = 1 << 18
SEGMENT_POSTINGS = 1 << 20
SEGMENT_DOCS = 1 << 15
FAN_IN = 512
_ENTRY = 80  # bytes of a term in a set besides its own

# ASCII letters and digits and all other characters make up terms; A-Z become a-z
_TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order, with repeats."""
    return text.translate(_TERM_BYTES).split() if text else []


def term_counts(docs: DataFrame, key: str, text: str, vocabulary: set[bytes] | None = None) -> DataFrame:
    """``key, n_terms, terms, tfs``: all terms counted, those of the
    ``vocabulary`` (bounded by the caller; None: all) listed."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType)]).add("n_terms", "long")
    schema = schema.add("terms", T.ArrayType(T.StringType())).add("tfs", T.ArrayType(T.LongType()))
    shared = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else shared.value.__contains__
        for b in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                found = terms_of(t)
                sizes.append(len(found))
                counts = Counter(found if known is None else filter(known, found))
                terms += counts.keys()
                tfs += counts.values()
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(at, pa.array(terms, pa.binary()).cast(pa.string())),
                    pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64())),
                ],
                names=["key", "n_terms", "terms", "tfs"],
            )

    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, schema)


def term_weight(documents: int, df: Column) -> Column:
    """floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * documents + 2.0) / (F.lit(2.0) * df + F.lit(1.0)))).cast("long")


def normaliser(n_terms: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """100 - 50 + (50 n N) div L."""
    return 50 + (50 * n_terms * documents) // max(all_terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))


def _sum_at(where: np.ndarray, what: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of ``what`` by place."""
    if int(what.sum()) < 1 << 53:  # doubles hold every partial sum
        return np.bincount(where, weights=what, minlength=n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, where, what)
    return out


class Segment:
    """Some documents of a task, by stratum; postings by (term, stratum, tf)."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, terms: int):
        # doc: a document's number in key order; m: its normaliser
        strata, stratum = np.unique(m, return_inverse=True)
        self.docs, self.strata = len(m), len(strata)
        self.stratum_docs = np.bincount(stratum, minlength=self.strata)
        order = np.lexsort((tf, stratum[doc], term))
        doc, term, tf, level = doc[order], term[order], tf[order], stratum[doc][order]
        edge = lambda *cols: np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols], axis=0))))
        self.doc = doc
        if not len(doc):
            self.of_term = np.zeros(terms + 1, np.int64)
            return
        # runs of equal (term, stratum, tf): one impact each
        run = edge(term, level, tf)
        run_impact = impact(tf[run], strata[level[run]])
        self.run_of = np.repeat(np.arange(len(run)), np.diff(np.append(run, len(doc))))
        self.run_impact = run_impact
        # lists of equal (term, stratum); the last run has the largest tf
        lists = edge(term, level)
        self.start, self.size = lists, np.diff(np.append(lists, len(doc)))
        self.level = level[lists]
        self.most = run_impact[self.run_of[lists + self.size - 1]]
        self.of_term = np.searchsorted(term[lists], np.arange(terms + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers) and scores: the ``top`` best, with all that
        could tie with them, of those that score ``least`` or more."""
        first = self.of_term[terms]
        n_lists = self.of_term[terms + 1] - first
        lists, weight = _spans(first, n_lists), np.repeat(weights, n_lists)
        if not len(lists):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        level = self.level[lists]
        bounds = _sum_at(level, self.most[lists] * weight, self.strata)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] >= max(least, 1)]
        found, scored, at, wanted = [], [], 0, 2 * top
        while at < len(order) and bounds[order[at]] >= least:
            held = np.cumsum(self.stratum_docs[order[at:]])
            now = order[at : at + int(np.searchsorted(held, wanted)) + 1]
            now = now[bounds[now] >= least]
            at, wanted = at + len(now), wanted * 4
            visit = np.zeros(self.strata, bool)
            visit[now] = True
            some = visit[level]
            size = self.size[lists[some]]
            posting = _spans(self.start[lists[some]], size)
            gain = self.run_impact[self.run_of[posting]] * np.repeat(weight[some], size)
            scores = _sum_at(self.doc[posting], gain, self.docs)
            hit = np.flatnonzero(scores >= max(least, 1))
            found.append(hit)
            scored.append(scores[hit])
            everything = np.concatenate(scored)
            if len(everything) >= top:
                least = max(least, int(np.partition(everything, -top)[-top]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc, score = np.concatenate(found), np.concatenate(scored)
        best = np.lexsort((doc, -score))[:top]
        return doc[best], score[best]


def _searched(index: DataFrame, asked: list, stats: tuple[int, int], top: int, limits: tuple[int, int]) -> DataFrame:
    """``item, task, key, score`` from every task's segments; ``asked`` has
    (item, term, weight) rows of one block of items."""
    terms = sorted({t for _, t, _ in asked})
    number = {t: i for i, t in enumerate(terms)}
    asked = sorted((item, number[t], w) for item, t, w in asked)
    ids = np.array([a[0] for a in asked], np.int64)
    items, begins = np.unique(ids, return_index=True)
    block = {
        "terms": terms,
        "items": items,
        "ends": np.append(begins, len(ids)),
        "term": np.array([a[1] for a in asked], np.int64),
        "weight": np.array([a[2] for a in asked], np.int64),
    }
    shared = index.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType().add("item", "long").add("task", "long").add(index.schema["key"]).add("score", "long")
    documents, all_terms = stats
    most_postings, most_docs = limits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        known = pa.array(q["terms"], pa.string())
        best = np.zeros((len(q["items"]), top), np.int64)  # ascending; the first is the score to beat
        task = TaskContext.get().partitionId()

        def answered(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(part).combine_chunks()
            keys = rows.column("key").combine_chunks()
            in_order = pc.sort_indices(keys, null_placement="at_end").to_numpy()
            rank = np.empty(len(keys), np.int64)
            rank[in_order] = np.arange(len(keys))
            lists = rows.column("terms").combine_chunks()
            doc = np.repeat(rank, np.diff(lists.offsets.to_numpy()))
            term = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            tf = rows.column("tfs").combine_chunks().flatten().to_numpy()
            m = normaliser(rows.column("n_terms").to_numpy(), documents, all_terms)[in_order]
            ours = term >= 0
            segment = Segment(doc[ours], term[ours].astype(np.int64), tf[ours], m, len(q["terms"]))
            who, docs, scores = [], [], []
            for i in range(len(q["items"])):
                a, z = q["ends"][i], q["ends"][i + 1]
                hit, score = segment.search(q["term"][a:z], q["weight"][a:z], top, int(best[i, 0]))
                if len(hit):
                    best[i] = np.sort(np.concatenate((best[i], score)))[-top:]
                    who.append(np.full(len(hit), q["items"][i]))
                    docs.append(hit)
                    scores.append(score)
            if who:
                picked = keys.take(pa.array(in_order[np.concatenate(docs)]))
                item = np.concatenate(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item), pa.array(np.full(len(item), task)), picked, pa.array(np.concatenate(scores))],
                    names=["item", "task", "key", "score"],
                )

        part, docs, postings = [], 0, 0
        for b in batches:
            at = 0
            sizes = np.cumsum(np.diff(b.column(2).offsets.to_numpy()))
            while at < b.num_rows:
                before = int(sizes[at - 1]) if at else 0
                room = int(np.searchsorted(sizes, before + max(most_postings - postings, 1), side="right")) - at
                n = min(max(room, 1), b.num_rows - at, most_docs - docs)
                part.append(b.slice(at, n))
                at, docs, postings = at + n, docs + n, postings + int(sizes[at + n - 1]) - before
                if docs >= most_docs or postings >= most_postings:
                    yield from answered(part)
                    part, docs, postings = [], 0, 0
        if part:
            yield from answered(part)

    return index.mapInArrow(run, schema)


def _best(rows: DataFrame, top: int, *groups: str) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    vocabulary_bytes: int = VOCABULARY_BYTES,
    block_terms: int = BLOCK_TERMS,
    segment: tuple[int, int] = (SEGMENT_POSTINGS, SEGMENT_DOCS),
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``item_key, rank, key, score``: each item's ``top`` best documents with
    a score above 0, ranks from 1, equal scores by ascending key."""
    spark = docs.sparkSession
    rows = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).alias("item_key"), F.col(item_text).alias("t")), "search-items")
    own_terms = term_counts(rows, "item", "t").select(F.col("key").alias("item"), F.explode("terms").alias("term"))
    item_terms = written(own_terms, "search-item-terms")
    vocabulary = item_terms.select("term").distinct()
    size = vocabulary.agg(F.sum(F.octet_length("term") + _ENTRY)).first()[0] or 0
    known = {r["term"].encode() for r in vocabulary.collect()} if size <= vocabulary_bytes else None
    index = written(term_counts(docs, key, text, known), "search-index")
    documents, all_terms = index.agg(F.count_if(F.col("n_terms") > 0), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = item_terms.join(held, "term").withColumn("weight", term_weight(documents, F.col("df"))).filter("weight > 0")
    asked = written(weighed.select("item", "term", "weight"), "search-asked")
    blocks = max(1, -(-asked.count() // block_terms))
    of_block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = None
    for i in range(blocks):
        part = [(r["item"], r["term"], r["weight"]) for r in asked.filter(of_block == i).collect()]
        one = _searched(index, part, (documents, all_terms), top, segment)
        found = one if found is None else found.unionByName(one)
    near = _best(found.withColumn("team", F.floor(F.col("task") / F.lit(fan_in))), top, "item", "team").drop("rank")
    ranked = _best(near, top, "item").join(rows.select("item", "item_key"), "item")
    return ranked.select(F.col("item_key").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")
