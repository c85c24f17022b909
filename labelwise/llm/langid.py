"""Language identification by string kernels.

Blended-spectrum presence kernel: a text is the set of its byte n-grams of
length 1 to 3 (letters only, case folded), each hashed into one of ``DIMS``
slots; k(x, y) = |x & y| / sqrt(|x| |y|).  Nystrom landmarks, ``LANDMARKS``
texts of every language (fewer where that would be more than
``MOST_LANDMARKS`` in all), turn the kernel into as many features, on which one
ridge regression per language (targets +1 / -1) is fitted.  A batch is scored
by two matrix products: presence x landmarks, then features x languages.

Scale: the fit uses at most ``SAMPLE`` labelled texts per language (chosen by
a hash of id and text, a documented bound; repeated rows count once).  Tasks
turn them into presence bits (2 KB each) and add up the normal equations; the
landmarks, these sums and one pair of numbers per text are all that reaches
the driver.  Every text is scored whole, in one pass without a shuffle, and the
model (2 KB a landmark, independent of the data) travels in the task closure.

The best score is at least 1 / languages for any text, so it cannot tell a text
of no learned language.  ``familiar`` does: a text's n-grams have a mean log
share (of a learned language's fitted texts with that n-gram, the language that
has it most), which is held against the fitted texts of its size, each of them
measured without itself.  A text that mixes learned languages is familiar.

Defined results: of more than ``MAX_LANGUAGES`` labels those with most rows are
learned (ties by name), the others are not; null texts and texts without a
letter are ``und`` with score 0, and not familiar; so is every text if there is no labelled row to learn from; ties go to the
language first in alphabetical order; repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns, fresh_names, written

DIMS = 1 << 14
LANDMARKS = 16
MOST_LANDMARKS = 2048
SAMPLE = 400
RIDGE = 1e-2
MAX_LANGUAGES = 1000
SUMMED = 2000
LEAST_SHARE = 1e-3
LOWEST = 0.01
ROOM = 4
CHUNK = 1 << 20
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def mark(text: bytes, row: np.ndarray) -> None:
    """Set ``row[slot] = 1`` for every n-gram of the text."""
    for at in range(0, len(text), CHUNK):
        part = np.frombuffer(text, np.uint8, min(CHUNK + 3, len(text) - at), at)
        b = _FOLD[part]
        # capitals of the Latin-1 letters: C3 80..9E -> C3 A0..BE
        wide = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
        b[wide] |= 0x20
        x = b.astype(np.uint32)
        row[x] = 1
        if len(x) > 1:
            two = x[:-1] * np.uint32(257) + x[1:]
            row[(two * np.uint32(2654435761)) >> np.uint32(18)] = 1
            if len(x) > 2:
                three = two[:-1] * np.uint32(257) + x[2:]
                row[(three * np.uint32(2246822519) + np.uint32(97)) >> np.uint32(18)] = 1


def has_letter() -> Callable[[bytes], bool]:
    import regex

    ascii_letter, letter = regex.compile(rb"[A-Za-z]"), regex.compile(r"\p{L}")
    return lambda t: bool(ascii_letter.search(t)) or bool(letter.search(t.decode("utf-8", "replace")))


@dataclass(frozen=True)
class KernelModel:
    languages: tuple[str, ...]
    marks: np.ndarray  # landmarks x DIMS / 8, packed presence
    weights: np.ndarray  # (landmarks + 1) x languages
    log_share: np.ndarray | None = None  # per slot: log share of texts that have it
    usual: tuple[float, float, float, float] = (0.0, 0.0, 0.0, -np.inf)  # see ``fit_usual``

    @cached_property
    def landmarks(self) -> np.ndarray:
        """landmarks x DIMS, presence / sqrt(size)."""
        return _scaled(np.unpackbits(self.marks, axis=1)).astype(np.float32)

    def familiar(self, presence: np.ndarray) -> np.ndarray:
        """Whether each text's n-grams are those of the learned languages."""
        size = np.maximum(presence.sum(axis=1), 1)
        least_size, offset, slope, least = self.usual
        expected = offset + slope * np.log2(np.maximum(size, least_size))
        return presence @ self.log_share / size - expected >= least

    def margins(self, presence: np.ndarray) -> np.ndarray:
        size = np.maximum(presence.sum(axis=1, keepdims=True), 1)
        kernel = (presence @ self.landmarks.T) / np.sqrt(size)
        return kernel @ self.weights[:-1] + self.weights[-1]


def fit_usual(value: np.ndarray, size: np.ndarray) -> tuple[float, float, float, float]:
    """What mean log share is usual: (smallest size, offset and slope by log2
    of the size, least difference from that).  The least difference leaves
    ``ROOM`` times the room of the lowest ``LOWEST`` of the fitted texts, so a few
    mislabelled or broken ones do not set it."""
    at = np.log2(size)
    spread = at - at.mean()
    slope = float(spread @ value / max(spread @ spread, 1e-9))
    offset = float(value.mean() - slope * at.mean())
    left = value - offset - slope * at
    middle = float(np.median(left))
    least = middle - ROOM * (middle - float(np.quantile(left, LOWEST)))
    return float(size.min()), offset, slope, least


def unpacked(column: pa.Array) -> np.ndarray:
    """Presence rows (texts x DIMS) of packed bits."""
    rows = [np.frombuffer(x.as_buffer(), np.uint8) for x in column]
    return np.unpackbits(np.stack(rows), axis=1) if rows else np.zeros((0, DIMS), np.uint8)


def _scaled(presence: np.ndarray) -> np.ndarray:
    x = presence.astype(np.float64)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def _summed(parts: DataFrame) -> np.ndarray | None:
    """The sum of all tasks' vectors, one at a time."""
    total = None
    for r in parts.toLocalIterator():
        part = np.frombuffer(r["sums"], np.float64)
        total = part.copy() if total is None else total + part
    return total


def _bits() -> Callable[[list], Sequence]:
    def work(batch: list) -> Sequence:
        out = []
        for t in batch:
            row = np.zeros(DIMS, np.uint8)
            mark(t or b"", row)
            out.append(np.packbits(row).tobytes())
        return [out]

    return work


def sampled(docs: DataFrame, learn: Column, key: str, text: str, lang: str, sample: int) -> tuple[DataFrame, dict[str, int]]:
    """``lang, h, bits, place`` of at most ``sample`` texts per language, written,
    and how many each has.  ``place`` counts a language's texts by hash."""
    rows = docs.filter(learn & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h")
    )
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return rows.sparkSession.createDataFrame([], "lang string, h long, bits binary, place int"), {}
    # a little over ``sample`` rows of each language, by a threshold on the hash
    below = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 1.2 * sample / n)))])
    part = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.filter(part < F.coalesce(F.try_element_at(below, F.col("lang")), F.lit(0.0)))
    # rows that repeat an id and a text have one hash: they count once
    marked = append_columns(picked, _bits, "text", [("bits", "binary")]).select("lang", "h", "bits")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    kept = written(marked.dropDuplicates(["lang", "h"]).withColumn("place", place).filter(F.col("place") <= sample), "language-sample")
    return kept, {r["lang"]: r["count"] for r in kept.groupBy("lang").count().collect()}


def fit_languages(
    docs: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE,
    landmarks: int = LANDMARKS,
    ridge: float = RIDGE,
) -> KernelModel:
    """Fit on at most ``sample`` texts per language of the rows where
    ``learn`` holds and text and language are not null."""
    rows, n = sampled(docs, learn, key, text, lang, sample)
    names = tuple(sorted(n))
    if not names:
        return KernelModel((), np.zeros((0, DIMS // 8), np.uint8), np.zeros((1, 0), np.float32))
    each = max(1, min(landmarks, MOST_LANDMARKS // len(names)))
    chosen = sorted(rows.filter(F.col("place") <= each).collect(), key=lambda r: (r["place"], r["lang"]))
    packed = np.stack([np.frombuffer(bytes(r["bits"]), np.uint8) for r in chosen])
    marks = _scaled(np.unpackbits(packed, axis=1))
    value, vector = np.linalg.eigh(marks @ marks.T)
    good = value > max(value.max(), 0) * 1e-8
    root = vector[:, good] / np.sqrt(value[good])
    to_features = marks.T @ root
    width, group = to_features.shape[1] + 1, {name: g for g, name in enumerate(names)}
    dealt = rows.repartition(max(1, min(16, sum(n.values()) // SUMMED)), "h")

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Normal equations, and of each language the texts with each slot."""
        square, target, count = np.zeros((width, width)), np.zeros((width, len(names))), np.zeros((len(names), DIMS))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                bits = unpacked(part.column(1))
                who = np.array([group[x] for x in part.column(0).to_pylist()])
                phi = np.hstack([_scaled(bits) @ to_features, np.ones((len(bits), 1))])
                w = 1 / np.array([n[names[g]] for g in who], float)  # every language weighs the same
                y = np.where(who[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
                square += phi.T @ (phi * w[:, None])
                target += phi.T @ (y * w[:, None])
                for g in np.unique(who):
                    count[g] += bits[who == g].sum(axis=0, dtype=np.int64)
        sums = np.concatenate([square.ravel(), target.ravel(), count.ravel()])
        yield pa.RecordBatch.from_pydict({"sums": [sums.tobytes()]})

    sums = _summed(dealt.select("lang", "bits").mapInArrow(add, "sums binary"))
    square, target = sums[: width * width].reshape(width, width), sums[width * width :][: width * len(names)].reshape(width, -1)
    count = sums[width * (width + len(names)) :].reshape(len(names), DIMS)
    penalty = ridge * np.eye(width)
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(square + penalty, target)
    weights = np.vstack([root @ solved[:-1], solved[-1:]])
    total = np.array([n[name] for name in names], float)
    share = np.maximum(count / total[:, None], LEAST_SHARE)
    shared = docs.sparkSession.sparkContext.broadcast((count.astype(np.int32), share.astype(np.float32)))

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's mean log share, measured without itself, and its size."""
        count, share = shared.value
        for b in batches:
            bits, values, sizes = unpacked(b.column(1)), [], []
            for row, name in zip(bits, b.column(0).to_pylist(), strict=True):
                own, g = np.flatnonzero(row), group[name]
                size = max(len(own), 1)
                without = np.maximum((count[g, own] - 1) / max(total[g] - 1, 1), LEAST_SHARE)
                others = np.delete(share[:, own], g, axis=0).max(axis=0, initial=LEAST_SHARE)
                values.append(float(np.log(np.maximum(without, others)).sum() / size))
                sizes.append(size)
            if sizes:
                yield pa.RecordBatch.from_pydict({"value": values, "size": sizes})

    usual = dealt.select("lang", "bits").mapInArrow(alone, "value double, size long").toArrow()
    return KernelModel(
        names,
        packed,
        weights.astype(np.float32),
        np.log(share.max(axis=0)).astype(np.float32),
        fit_usual(usual.column("value").to_numpy(), usual.column("size").to_numpy()),
    )


def scorer(model: KernelModel, step: int = 128) -> Callable[[], Callable[[list], Sequence]]:
    def make():
        letter = has_letter()
        x = np.zeros((step, DIMS), np.float32)

        def work(batch: list) -> Sequence:
            lang, score = [UNKNOWN] * len(batch), [0.0] * len(batch)
            todo = [i for i, t in enumerate(batch) if t and letter(t)] if model.languages else []
            for at in range(0, len(todo), step):
                part = todo[at : at + step]
                x[: len(part)] = 0
                for k, i in enumerate(part):
                    mark(batch[i], x[k])
                f = model.margins(x[: len(part)])
                best = f.argmax(axis=1)
                for k, i in enumerate(part):
                    lang[i] = model.languages[best[k]]
                    score[i] = float(min(1.0, max(0.0, (f[k, best[k]] + 1) / 2)))
            return lang, score

        return work

    return make


def identify(docs: DataFrame, model: KernelModel, text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` plus predicted language and score; also the names they got."""
    lang, score = fresh_names(docs, "lang_pred", "score")
    return append_columns(docs, scorer(model), text, [(lang, "string"), (score, "double")]), lang, score


def familiar_texts(docs: DataFrame, model: KernelModel, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` plus whether a text has letters and the n-grams of the learned
    languages (letters alone count if none was learned); also that name."""
    (flag,) = fresh_names(docs, "familiar")

    def make(step: int = 128):
        letter = has_letter()
        x = np.zeros((step, DIMS), np.float32)

        def work(batch: list) -> Sequence:
            out = [bool(t) and letter(t) for t in batch]
            todo = [i for i, good in enumerate(out) if good] if model.languages else []
            for at in range(0, len(todo), step):
                part = todo[at : at + step]
                x[: len(part)] = 0
                for k, i in enumerate(part):
                    mark(batch[i], x[k])
                for i, good in zip(part, model.familiar(x[: len(part)]).tolist(), strict=True):
                    out[i] = good
            return [out]

        return work

    return append_columns(docs, make, text, [(flag, "boolean")]), flag
