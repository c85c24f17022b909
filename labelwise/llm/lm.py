"""Language-model scoring: a log-bilinear neural model, trained with
noise-contrastive estimation, next to an add-one unigram base score.

Vocabulary: the most frequent training words, ``WORDS`` and one more for every
``TYPES_PER_WORD`` types up to ``MOST_WORDS``, are outputs of their own (so the
parameters grow with the lexicon, to under 1 MB); every other word belongs to one of ``BUCKETS`` tail classes (a hash of
its last two bytes), and inside a class a word has its add-one share, unseen
words counting as one type.  So probabilities of the next token sum to one.

Model: the vectors of the two preceding classes, each through a matrix of its
position, add up to a predicted vector; a class scores its product with that
plus a bias.  Training contrasts each next class with noise drawn from the
unigram distribution, so it needs no normaliser; scoring normalises exactly,
by one matrix product over the distinct contexts of a batch.

Scale: words are counted within tasks first and only (word, count) rows are
shuffled.  The model learns from every training text: texts are dealt, by a
hash of id and content, to one learner for every ``LEARNER_TOKENS`` tokens; each
learns on its own texts, in the order of their hashes, from a common start, and
the parameters are averaged by tokens, in ``ROUNDS`` rounds that take
``PASSES`` passes together.  So a learner's share is bounded, and neither texts
nor scores depend on how rows lie in partitions.  (A few tens of thousands of
numbers per learner are merged in a tree of groups of ``FAN``.)  Counts of words
with at least 1 / ``SHARE`` of the tokens (so at most ``SHARE`` words, 64 bytes
each) travel to the tasks; the rarer words of each text, one row per distinct
word, are joined with their counts by a shuffle.  No frequent word is in that
join, so it has no hot key.  Words over ``LONGEST`` bytes are told apart by
their SHA-256 digest, so a long word, frequent or not, is never shuffled or kept
whole.

Defined results: a null text counts as empty and has only the end token;
without training texts every count is 0 and the model is uniform; repeated
rows are scored and counted one by one, and teach the model once; a null id is
remainder 0, so it trains.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

WORDS = 512
TYPES_PER_WORD = 16_000
MOST_WORDS = 4096
BUCKETS = 32
DIM = 16
SHARE = 1 << 19
LONGEST = 64
NOISE = 64
NOISE_RATIO = 16
BATCH = 4096
RATE = 0.05
ROUNDS = 4
PASSES = 2
LEARNER_TOKENS = 1 << 22
MOST_TASKS = 10_000
FAN = 128
END = b" "  # no word contains a space
_FLUSH = 1 << 18


def lm_words(text: bytes | None) -> list[bytes]:
    """Lower-case words; a long one as a blank (which no word contains) and
    its digest."""
    words = text.lower().split() if text else []
    if max(map(len, words), default=0) > LONGEST:
        words = [w if len(w) <= LONGEST else b" " + sha256(w).digest() for w in words]
    return words


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """``(word, c)`` over all rows, the end token included once per row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                names=["word", "c"],
            )
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                seen.update(lm_words(t))
                seen[END] += 1
                if len(seen) > _FLUSH:
                    yield flush()
        if seen:
            yield flush()

    return docs.select(text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def _bucket_column(word: Column) -> Column:
    end = F.substring(word, F.greatest(F.length(word) - 1, F.lit(1)), F.lit(2))
    return F.pmod(F.crc32(end), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Lexicon:
    """Corpus counts as far as tasks need them."""

    tokens: int  # N
    types: int  # V
    head: dict[bytes, int]  # frequent word -> place
    head_count: np.ndarray  # its count
    head_class: np.ndarray  # its class
    class_size: np.ndarray  # tokens of each class
    tail_total: np.ndarray  # per bucket: tokens + types + 1

    @property
    def classes(self) -> int:
        return len(self.class_size)


def own_words(types: int) -> int:
    """How many words are outputs of their own."""
    return min(MOST_WORDS, WORDS + types // TYPES_PER_WORD)


def lexicon(counts: DataFrame, words: int | None = None, share: int = SHARE) -> Lexicon:
    """The lexicon of ``counts(word, c)``; at most ``share`` words reach the driver."""
    word = F.col("word")
    by_bucket = counts.groupBy(_bucket_column(word).alias("b")).agg(F.sum("c").alias("s"), F.count("*").alias("k")).collect()
    size, kinds = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in by_bucket:
        size[r["b"]], kinds[r["b"]] = r["s"], r["k"]
    tokens, types = int(size.sum()), int(kinds.sum())
    frequent = counts.filter(F.col("c") * share >= tokens).select(word.alias("w"), "c").collect()
    order = sorted(((bytes(r["w"]), r["c"]) for r in frequent), key=lambda x: (-x[1], x[0]))
    words = min(own_words(types) if words is None else words, len(order))
    head_class = np.array([i if i < words else words + bucket_of(w) for i, (w, _) in enumerate(order)], np.int64)
    for w, c in order[:words]:
        size[bucket_of(w)] -= c
        kinds[bucket_of(w)] -= 1
    return Lexicon(
        tokens,
        types,
        {w: i for i, (w, _) in enumerate(order)},
        np.array([c for _, c in order], np.int64),
        head_class,
        np.concatenate([np.array([c for _, c in order[:words]], np.int64), size]),
        size + kinds + 1,
    )


ENCODED = "row long, n_tokens long, n_known long, base double, tail double, classes binary, rare array<binary>, times array<int>"


def encode(docs: DataFrame, key: str, text: str, held_out: Column, lex: Lexicon) -> DataFrame:
    """One row per text: ``key``, ``held_out``, a row number, token counts, the
    parts of both scores that the lexicon settles, the class of each token
    (16-bit) and the distinct words whose counts have to be looked up, with
    how often the text has each."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(lex))  # plain data: workers have no copy of this package
    rows = docs.select(F.col(key).alias("id"), held_out.alias("held_out"), F.col(text).alias("t"))
    schema = T.StructType([*rows.schema.fields[:2], *T._parse_datatype_string(ENCODED).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        lex = Lexicon(**shared.value)
        get, crc = lex.head.get, zlib.crc32
        words_of_own = lex.classes - BUCKETS
        log_count = np.log10(lex.head_count + 1.0)
        log_all = np.log10(lex.tokens + lex.types + 1.0)
        log_tail = np.log10(lex.tail_total.astype(float))
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            out: list[tuple] = []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                words = lm_words(t)
                words.append(END)
                place = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                known = place >= 0
                rare_at = np.flatnonzero(~known)
                rare = [words[i] for i in rare_at.tolist()]
                cls = np.empty(len(words), np.int64)
                cls[known] = lex.head_class[place[known]]
                cls[rare_at] = [words_of_own + crc(w[-2:]) % BUCKETS for w in rare]
                logs = np.zeros(len(words))
                logs[known] = log_count[place[known]]
                in_tail = cls >= words_of_own
                often = Counter(rare)
                tail = logs[in_tail].sum() - log_tail[cls[in_tail] - words_of_own].sum()
                out.append(
                    (
                        row,
                        len(words),
                        int(known.sum()),
                        float(logs.sum() - log_all * len(words)),
                        float(tail),
                        cls.astype("<u2").tobytes(),
                        list(often.keys()),
                        list(often.values()),
                    )
                )
                row += 1
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1)]
                    + [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[2:], strict=True)],
                    schema=arrow,
                )

    return rows.mapInArrow(run, schema)


@dataclass
class LogBilinear:
    """R: context vectors (one more for the start of a text); P: one matrix
    per position; Q, b: output vectors and biases."""

    R: np.ndarray
    P: np.ndarray
    Q: np.ndarray
    b: np.ndarray

    @classmethod
    def start(cls, class_size: np.ndarray, dim: int = DIM, seed: int = 42) -> LogBilinear:
        rng = np.random.default_rng(seed)
        n = len(class_size)
        b = np.log((class_size + 1.0) / (class_size.sum() + n))
        return cls(
            rng.normal(0, 0.1, (n + 1, dim)).astype(np.float32),
            np.stack([np.eye(dim), 0.5 * np.eye(dim)]).astype(np.float32),
            rng.normal(0, 0.1, (n, dim)).astype(np.float32),
            b.astype(np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.R, self.P, self.Q, self.b]

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()]).astype(np.float64)

    def unpack(self, flat: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for x in self.parts():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*out)

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.R[one] @ self.P[0] + self.R[two] @ self.P[1]

    def log_probabilities(self, one: np.ndarray, two: np.ndarray, token: np.ndarray, step: int = 512) -> np.ndarray:
        """Natural logs of the normalised probabilities of ``token`` after
        the classes ``one`` (last) and ``two`` (before it)."""
        n = len(self.R)
        context, which = np.unique(one * n + two, return_inverse=True)
        q = self.predicted(context // n, context % n)
        norm, outputs = np.empty(len(context)), np.ascontiguousarray(self.Q.T)
        for at in range(0, len(context), step):
            s = q[at : at + step] @ outputs
            s += self.b
            top = s.max()
            if top > 60:  # exp would overflow, or lose the smaller rows
                rows = s.max(axis=1)
                s -= rows[:, None]
            else:
                rows = 0.0
            np.exp(s, out=s)
            norm[at : at + step] = rows + np.log(s.sum(axis=1, dtype=np.float64))
        return np.einsum("ij,ij->i", q[which], self.Q[token]) + self.b[token] - norm[which]


def contexts(classes: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last, one before, token) for all tokens of some texts."""
    sizes = np.array([len(c) for c in classes], np.int64)
    token = np.concatenate(classes).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    one = np.concatenate([[start], token[:-1]])
    one[first] = start
    two = np.concatenate([[start], one[:-1]])
    two[first] = start
    return one, two, token


class NoiseContrast:
    """Minibatch training by noise-contrastive estimation with Adagrad steps."""

    def __init__(self, model: LogBilinear, class_size: np.ndarray, seed: int):
        self.m = model
        self.rng = np.random.default_rng(seed)
        noise = (class_size + 1.0) / (class_size.sum() + len(class_size))
        self.draw = np.cumsum(noise / noise.sum())
        self.log_noise = np.log(NOISE_RATIO * noise / noise.sum()).astype(np.float32)
        self.past = [np.full(x.shape, 0.1, np.float32) for x in model.parts()]

    @staticmethod
    def _gather(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Sums of ``rows`` by ``index`` (16-bit, so sorted by radix)."""
        order = np.argsort(index, kind="stable")
        index = index[order]
        first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        out = np.zeros((n, rows.shape[1]), np.float32)
        out[index[first]] = np.add.reduceat(rows[order], first, axis=0)
        return out

    def step(self, one: np.ndarray, two: np.ndarray, token: np.ndarray) -> None:
        m, n = self.m, len(token)
        r1, r2, out = m.R[one], m.R[two], m.Q[token]
        q = r1 @ m.P[0] + r2 @ m.P[1]
        drawn = self.draw.searchsorted(self.rng.random(NOISE)).clip(max=len(m.b) - 1).astype(np.uint16)
        # chance that a sample is data: sigmoid(score - log(k * noise))
        data = np.einsum("ij,ij->i", q, out) + m.b[token] - self.log_noise[token]
        fake = q @ m.Q[drawn].T
        fake += m.b[drawn] - self.log_noise[drawn]
        with np.errstate(over="ignore"):
            gd = 1 / (1 + np.exp(data))
            gf = np.exp(np.negative(fake, out=fake), out=fake)
        gf += 1
        gf = np.divide(np.float32(-NOISE_RATIO / NOISE), gf, out=gf)
        gq = gd[:, None] * out + gf @ m.Q[drawn]
        grad_q = self._gather(token, gd[:, None] * q, len(m.Q))
        grad_q += self._gather(drawn, gf.T @ q, len(m.Q))
        grad_b = np.bincount(token, gd, len(m.b)) + np.bincount(drawn, gf.sum(axis=0), len(m.b))
        grad_p = np.stack([r1.T @ gq, r2.T @ gq])
        grad_r = self._gather(np.concatenate([one, two]), np.concatenate([gq @ m.P[0].T, gq @ m.P[1].T]), len(m.R))
        for x, past, g in zip(m.parts(), self.past, (grad_r, grad_p, grad_q, grad_b), strict=True):
            g = (g / np.sqrt(n)).astype(np.float32)
            past += g * g
            x += RATE * g / np.sqrt(past)

    def learn(self, classes: list[np.ndarray]) -> None:
        one, two, token = (x.astype(np.uint16) for x in contexts(classes, len(self.m.R) - 1))
        order = self.rng.permutation(len(token))
        for at in range(0, len(order), BATCH):
            i = order[at : at + BATCH]
            self.step(one[i], two[i], token[i])


def _texts(column: pa.Array, most: int = 1 << 19) -> Iterator[list[np.ndarray]]:
    """Class arrays of some texts at a time, about ``most`` tokens."""
    held, n = [], 0
    for x in column:
        c = np.frombuffer(x.as_buffer(), "<u2")
        held.append(c)
        n += len(c)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


PARTIAL = "slot long, n double, sums binary"


def lessons(encoded: DataFrame, tokens: int, learner_tokens: int = LEARNER_TOKENS) -> tuple[DataFrame, int]:
    """``learner, turn, h, classes`` of the distinct training texts, written, and
    the number of learners.  It depends on ids and contents alone."""
    learners = max(1, -(-tokens // learner_tokens))
    hashed = F.xxhash64(F.col("id").cast("string"), "classes")
    rows = encoded.filter("not held_out").select(hashed.alias("h"), "classes").dropDuplicates(["h"])
    kept = rows.select(
        F.pmod("h", F.lit(learners)).alias("learner"),
        F.pmod(F.shiftrightunsigned("h", 32), F.lit(ROUNDS // PASSES)).cast("int").alias("turn"),
        "h",
        "classes",
    )
    return written(kept, "lm-lessons"), learners


def train(
    encoded: DataFrame, lex: Lexicon, rounds: int = ROUNDS, seed: int = 42, learner_tokens: int = LEARNER_TOKENS
) -> LogBilinear:
    """Learn from every distinct row of ``encoded`` that is not held out."""
    model, size = LogBilinear.start(lex.class_size, seed=seed), lex.class_size
    if not lex.tokens:
        return model
    texts, learners = lessons(encoded, lex.tokens, learner_tokens)
    for turn in range(rounds):
        now = texts.filter(F.col("turn") == turn % (ROUNDS // PASSES)).select("learner", "h", "classes")
        # the number of tasks is given: small groups are long work
        spread = now.repartition(min(learners, MOST_TASKS), "learner")
        parts = spread.groupBy("learner").applyInArrow(_learner(model.pack(), size, seed, turn), PARTIAL)
        for _ in range(2):  # one row reaches the driver per FAN * FAN learners
            parts = parts.groupBy("slot").applyInArrow(_add, PARTIAL)
        got = parts.collect()
        weight = sum(r["n"] for r in got)
        if weight:
            model = model.unpack(sum(np.frombuffer(r["sums"], np.float64) for r in got) / weight)
    return model


def _learner(flat: np.ndarray, size: np.ndarray, seed: int, turn: int) -> Callable[[pa.Table], pa.Table]:
    def learn(group: pa.Table) -> pa.Table:
        """One learner's turn: a bounded group, in a fixed order."""
        learner = group.column("learner")[0].as_py()
        nce = NoiseContrast(LogBilinear.start(size, seed=seed).unpack(flat), size, seed + 1000 * turn + learner)
        classes = group.sort_by("h").column("classes")
        for some in _texts(classes):
            nce.learn(some)
        seen = sum(len(x.as_buffer()) // 2 for x in classes)
        return pa.table({"slot": [learner // FAN], "n": [float(seen)], "sums": [(nce.m.pack() * seen).tobytes()]})

    return learn


def _add(group: pa.Table) -> pa.Table:
    sums = sum(np.frombuffer(x.as_buffer(), np.float64) for x in group.column("sums"))
    n = float(sum(group.column("n").to_pylist()))
    return pa.table({"slot": [group.column("slot")[0].as_py() // FAN], "n": [n], "sums": [sums.tobytes()]})


def score_texts(
    docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", share: int = SHARE
) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score``
    (log10) for every row, learning from the rows that are not held out.
    Words below 1 / ``share`` of the tokens are looked up by a join."""
    counts = written(count_words(docs.filter(~held_out), text), "lm-counts")
    lex = lexicon(counts, share=share)
    encoded = written(encode(docs, key, text, held_out, lex), "lm-encoded")
    model = train(encoded, lex)
    rare_counts = counts.filter(F.col("c") * share < lex.tokens)
    looked_up = (
        encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
        .select("row", F.col("x.rare").alias("word"), "x.times")
        .join(rare_counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("rare_log"),
            F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("rare_known"),
        )
    )
    narrow = encoded.drop("rare", "times")
    schema = T.StructType([f for f in narrow.schema.fields if f.name != "classes"]).add("model", "double")
    at = narrow.columns.index("classes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sums: list[float] = []
            for some in _texts(b.column(at)):
                one, two, token = contexts(some, len(model.R) - 1)
                logs = model.log_probabilities(one, two, token) / np.log(10)
                ends = np.cumsum([len(c) for c in some])
                total = np.concatenate([[0.0], np.cumsum(logs)])[ends]
                sums += np.diff(np.concatenate([[0.0], total])).tolist()
            columns = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.float64())], names=[f.name for f in schema])

    scored = narrow.mapInArrow(run, schema).join(looked_up, "row", "left")
    rare = F.coalesce("rare_log", F.lit(0.0))
    return scored.select(
        F.col("id").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare).alias("base_score"),
        (F.col("model") + F.col("tail") + rare).alias("score"),
    )
