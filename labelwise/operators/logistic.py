"""A second fitter: logistic regression on hashed token presence (M4).

A row's features are the distinct hashes of its tokens, 2 ** ``bits`` of them
at most; its margin is the sum of their weights and a bias.  The mean log loss
plus ``l2 / 2`` |w|^2 is minimised by limited-memory BFGS.

The driver holds the weights and a few vectors of that size (bounded by
``bits``, never by the data) and broadcasts the weights for every evaluation;
each task sums loss and gradient over its rows, and the tasks' sparse sums are
added up by feature, map-side first, so that one number for each feature is
what reaches the driver.  The features are computed once and written.  Rounds
end when no derivative is above ``tolerance``.

The result does not depend on the partitioning beyond the rounding of sums of
doubles.  Weights are kept as whole numbers of 1 / ``scale``, so scores do not
depend on it at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..session import scratch_path
from ..spec import TaskSpec

BITS = 16
MEMORY = 8
_LOSS, _BIAS = -2, -1


def hashed_features(text: Column, bits: int = BITS, tokens: Callable[[Column], Column] = word_tokens) -> Column:
    """Distinct features in [0, 2 ** bits): the first 32 bits of each token's
    MD5, modulo the size."""
    number = lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.array_distinct(F.transform(tokens(text), lambda t: (number(t) % F.lit(1 << bits)).cast("int")))


def feature_tokens(bits: int = BITS) -> Callable[[Column], Column]:
    """Hashed features as a tokeniser of the token-weight fit (M4)."""
    return lambda text: F.transform(hashed_features(text, bits), lambda f: f.cast("string"))


@dataclass
class LogisticModel:
    path: str  # feature, weight (bigint, in 1 / scale)
    bias: int
    scale: int
    bits: int
    spec: TaskSpec
    rounds: int = 0
    loss: float = 0.0
    steepest: float = 0.0
    relational = True

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def apply(self, df: DataFrame, key: str, text_col: str) -> DataFrame:
        """Scorer protocol: every column of ``df`` except the text, plus
        ``raw_output``.  The weights have at most 2 ** bits rows."""
        carry = [c for c in df.columns if c not in (key, text_col)]
        rows = df.withColumn("__row", F.monotonically_increasing_id())
        each = rows.select("__row", key, *carry, F.explode_outer(hashed_features(F.col(text_col), self.bits)).alias("feature"))
        joined = each.join(F.broadcast(self.table(df.sparkSession)), "feature", "left")
        margin = F.coalesce(F.sum("weight"), F.lit(0)) + F.lit(self.bias)
        answer = F.when(F.col("__margin") >= 0, F.lit(self.spec.positive)).otherwise(F.lit(self.spec.negative))
        summed = joined.groupBy("__row", key, *carry).agg(margin.alias("__margin"))
        return summed.withColumn("raw_output", answer).drop("__row", "__margin")


def _evaluated(rows: DataFrame, n: int, size: int, w: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Loss and gradient at ``w`` (the bias last)."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        gradient, loss, bias = np.zeros(size), 0.0, 0.0
        seen = np.zeros(size, bool)
        for b in batches:
            lists = b.column(0)
            feature, count = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(count)), count)
            sign = b.column(1).to_numpy()
            margin = sign * (np.bincount(row, weights=now[feature], minlength=len(count)) + now[size])
            loss += np.logaddexp(0.0, -margin).sum()
            pull = -sign / (1.0 + np.exp(np.clip(margin, -700, 700)))
            bias += pull.sum()
            gradient += np.bincount(feature, weights=pull[row], minlength=size)
            seen[feature] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(([_LOSS, _BIAS], at)), pa.int32()), pa.array(np.concatenate(([loss, bias], gradient[at])))],
            names=["at", "g"],
        )

    sums = rows.select("features", "sign").mapInArrow(run, "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).toArrow()
    shared.destroy()
    at, g = sums.column("at").to_numpy(), sums.column("g").to_numpy()
    loss, gradient = float(g[at == _LOSS].sum()), np.zeros(size + 1)
    gradient[at[at >= 0]] = g[at >= 0]
    gradient[size] = g[at == _BIAS].sum()
    gradient /= n
    gradient[:size] += l2 * w[:size]
    return loss / n + 0.5 * l2 * float(w[:size] @ w[:size]), gradient


def _direction(gradient: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton step from the last changes of weights and gradient."""
    q, used = gradient.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (s @ y)
        q -= a * y
        used.append(a)
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(past, reversed(used), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, tolerance: float, most_rounds: int):
    """Weights, loss, largest derivative and rounds of L-BFGS with step
    halving (the loss falls in every round)."""
    w = start
    loss, gradient = evaluate(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    rounds = 0
    while rounds < most_rounds and np.abs(gradient).max() > tolerance:
        step = _direction(gradient, past)
        size = 1.0 if past else 1.0 / max(1.0, float(np.abs(gradient).sum()))
        while True:
            there = w + size * step
            new_loss, new_gradient = evaluate(there)
            if new_loss <= loss + 1e-4 * size * float(gradient @ step) or size < 1e-10:
                break
            size /= 2
        s, y = there - w, new_gradient - gradient
        if float(s @ y) > 1e-12:
            past = [*past, (s, y)][-MEMORY:]
        w, loss, gradient = there, new_loss, new_gradient
        rounds += 1
    return w, loss, float(np.abs(gradient).max()), rounds


def fit_logistic(
    records: DataFrame,
    spec: TaskSpec,
    text_col: str = "input",
    label_col: str = "output",
    bits: int = BITS,
    l2: float = 1e-3,
    tolerance: float = 1e-4,
    most_rounds: int = 100,
    scale: int = 1_000_000,
) -> LogisticModel:
    """Fit on (already split / capped) training records; an action.  Rows of
    another label than the two classes do not count."""
    spark = records.sparkSession
    sign = F.when(F.col(label_col) == F.lit(spec.positive), F.lit(1.0)).when(F.col(label_col) == F.lit(spec.negative), F.lit(-1.0))
    path = scratch_path(spark, "features")
    features = F.coalesce(hashed_features(F.col(text_col), bits), F.array().cast("array<int>"))
    records.select(features.alias("features"), sign.alias("sign")).filter("sign is not null").write.parquet(path)
    rows = spark.read.parquet(path)
    n, positive = rows.agg(F.count(F.lit(1)), F.count_if(F.col("sign") > 0)).first()
    if positive in (0, n):
        raise ValueError(f"training data needs both classes (positive={positive}, negative={n - positive})")
    size = 1 << bits
    w, loss, steepest, rounds = minimise(lambda x: _evaluated(rows, n, size, x, l2), np.zeros(size + 1), tolerance, most_rounds)
    whole = np.rint(w * scale).astype(np.int64)
    at = np.flatnonzero(whole[:size])
    table = pa.table({"feature": pa.array(at, pa.int32()), "weight": pa.array(whole[at])})
    out = scratch_path(spark, "logistic-weights")
    spark.createDataFrame(table).write.parquet(out)
    return LogisticModel(out, int(whole[size]), scale, bits, spec, rounds, loss, steepest)
