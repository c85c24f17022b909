"""Distributed token-presence log-odds classifier (M4 fit, M5 score).

Fit, one pass over the training split after a class count:
  tokens -> array_distinct (presence) -> explode -> groupBy(token) with
  conditional document counts (dp, dn).  Hot tokens ("the" is in every
  document) are collapsed by map-side partial aggregation, so the shuffle
  carries at most one row per (token, task).
  weight = round(scale * ln(((dp+1)/(Np+2)) / ((dn+1)/(Nn+2)))) as bigint,
  kept where dp+dn >= min_df and |weight| >= min_weight * scale.
  Integer weights make per-document sums independent of summation order.

The fitted weights are written as a table under the shared checkpoint
folder: that cuts lineage (an executor loss later re-reads the table
instead of refitting), and its size, taken once from the written
table, decides whether scoring broadcasts it (see BROADCAST_MAX_BYTES) or
uses a shuffle join with AQE skew splitting.

Score: explode each document's distinct tokens in place, left-join the
weights, sum per document (one pass, no join back to the documents);
documents with no weighted token score the prior.  score >= 0 answers the
positive label.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom
from ..functions.text import word_tokens
from ..session import scratch_path
from ..spec import TaskSpec


# Explicit broadcast of the fitted weights only up to this many bytes of
# token text and weights (measured on the written table at fit time).  Beyond
# it the scoring join is a shuffle join on token, where AQE splits the
# partitions of hot tokens, and a Bloom filter of the weight tokens keeps out
# of the shuffle what has no weight.  The plan differs, the scores do not.
BROADCAST_MAX_BYTES = 64 << 20


@dataclass
class TokenWeights:
    path: str
    n_pos: int
    n_neg: int
    scale: int
    spec: TaskSpec
    n_bytes: int | None = None  # token text and weights of the table; None = unknown
    n_tokens: int | None = None
    tokens: Callable[[Column], Column] = word_tokens
    _bloom: tuple[int, str] | None = None
    relational = True  # scores come out of a join and a grouping, without the text

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def prior(self) -> Column:
        """round(scale * ln(Np / Nn)), evaluated (constant-folded) in the JVM."""
        return F.round(F.lit(float(self.scale)) * F.log(F.lit(float(self.n_pos)) / F.lit(float(self.n_neg)))).cast(
            "bigint"
        )

    def is_broadcast(self) -> bool:
        return self.n_bytes is not None and self.n_bytes <= BROADCAST_MAX_BYTES

    def scores(self, df: DataFrame, key: str, text_col: str, carry=()) -> DataFrame:
        """``(key, score, *carry)`` for every row of ``df``, in one pass.

        Each row's distinct tokens are exploded in place, looked up in the
        weights and summed per row.  All tokens of a row sit in the same task,
        so map-side partial aggregation already yields one row per row; the
        shuffle moves that row's small columns only (keep the text out of
        ``carry``).
        """
        # rows, not keys, are scored: a repeated key gets an answer for each row
        rows = df.withColumn("__row", F.monotonically_increasing_id())
        weights = self.table(df.sparkSession).select("token", "weight")
        if self.is_broadcast():
            toks = rows.select(
                "__row", key, *carry, F.explode_outer(F.array_distinct(self.tokens(F.col(text_col)))).alias("token")
            )
            joined = toks.join(F.broadcast(weights), "token", "left")
        else:
            joined = self.weighted_pairs(rows, text_col, ["__row", key, *carry]).join(weights, "token", "left")
        # carried columns are constant per key: grouping on them keeps the
        # aggregate a hash aggregate (first() over strings would sort)
        return joined.groupBy("__row", key, *carry).agg(
            (self.prior() + F.coalesce(F.sum("weight"), F.lit(0))).alias("score")
        ).drop("__row")

    def weighted_pairs(self, rows: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
        """``keep`` and ``token`` of the (row, token) pairs that may have a
        weight, and one mark of every row (a token of its own, so that rows
        without weighted tokens stay and marks spread over all tasks)."""
        mark = F.concat(F.lit("\0"), F.col("__row").cast("string"))
        tokens = F.array_append(F.array_distinct(self.tokens(F.coalesce(F.col(text_col), F.lit("")))), mark)
        pairs = rows.select(*keep, F.explode(tokens).alias("token"))
        blocks, table = self._filter(rows.sparkSession)
        found = bloom.maybe_in(pairs, F.col("token"), table, blocks, "__maybe")
        return found.filter(F.col("__maybe") | F.col("token").startswith("\0")).drop("__maybe")

    def _filter(self, spark: SparkSession) -> tuple[int, DataFrame]:
        """The Bloom filter of the weight tokens, built once and written."""
        if self._bloom is None:
            weights = self.table(spark)
            n = self.n_tokens if self.n_tokens is not None else weights.count()
            blocks, path = bloom.blocks_for(n), scratch_path(spark, "weight-filter")
            bloom.build(weights.select("token"), F.col("token"), blocks).write.parquet(path)
            self._bloom = (blocks, path)
        blocks, path = self._bloom
        return blocks, spark.read.parquet(path)

    def answer(self, score: Column) -> Column:
        s = self.spec
        return F.when(score >= 0, F.lit(s.positive)).otherwise(F.lit(s.negative))

    def apply(self, df: DataFrame, key: str, text_col: str) -> DataFrame:
        """Scorer protocol: every column of ``df`` except the text, plus
        ``raw_output``."""
        carry = [c for c in df.columns if c not in (key, text_col)]
        return self.scores(df, key, text_col, carry).withColumn("raw_output", self.answer(F.col("score"))).drop("score")


def token_counts(
    records: DataFrame,
    spec: TaskSpec,
    text_col: str = "input",
    label_col: str = "output",
    tokens: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """``(token, dp, dn)``: documents of each class containing the token."""
    # explode the expression in place: exploding a projected column makes the
    # optimizer add a size(tokens) > 0 filter below it, tokenising twice
    docs = records.select(
        F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token"),
        (F.col(label_col) == F.lit(spec.positive)).alias("y"),
    )
    return (
        docs.groupBy("token")
        .agg(F.count_if(F.col("y")).alias("dp"), F.count_if(~F.col("y")).alias("dn"))
    )


def fit_token_weights(
    records: DataFrame,
    spec: TaskSpec,
    text_col: str = "input",
    label_col: str = "output",
    min_df: int = 5,
    min_weight: float = 3.0,
    scale: int = 1_000_000,
    path: str | None = None,
    tokens: Callable[[Column], Column] = word_tokens,
) -> TokenWeights:
    """M4: fit on (already split / capped) training records; an action."""
    spark = records.sparkSession
    cls = records.agg(
        F.count_if(F.col(label_col) == F.lit(spec.positive)).alias("p"),
        F.count_if(F.col(label_col) == F.lit(spec.negative)).alias("n"),
    ).first()
    n_pos, n_neg = int(cls["p"]), int(cls["n"])
    if n_pos == 0 or n_neg == 0:
        raise ValueError(f"training data needs both classes (positive={n_pos}, negative={n_neg})")
    weights = weight_table(token_counts(records, spec, text_col, label_col, tokens), n_pos, n_neg, min_df, min_weight, scale)
    path = path or scratch_path(spark, "token-weights")
    weights.write.mode("overwrite").parquet(path)
    size = spark.read.parquet(path).agg(F.sum(F.octet_length("token") + F.lit(8)), F.count(F.lit(1))).first()
    return TokenWeights(
        path=path, n_pos=n_pos, n_neg=n_neg, scale=scale, spec=spec, n_bytes=int(size[0] or 0), n_tokens=size[1], tokens=tokens
    )


def weight_table(
    counts: DataFrame, n_pos: int, n_neg: int, min_df: int, min_weight: float, scale: int
) -> DataFrame:
    dp, dn = F.col("dp"), F.col("dn")
    ratio = ((dp + F.lit(1)) / F.lit(float(n_pos + 2))) / ((dn + F.lit(1)) / F.lit(float(n_neg + 2)))
    w = F.round(F.lit(float(scale)) * F.log(ratio)).cast("bigint")
    return (
        counts.filter(dp + dn >= F.lit(min_df))
        .withColumn("weight", w)
        .filter(F.abs(F.col("weight")) >= F.lit(int(round(min_weight * scale))))
    )
