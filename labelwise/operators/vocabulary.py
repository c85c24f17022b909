"""A vocabulary learned from the records: dense ids without collisions (P10,
U1).

Tokens are counted with map-side aggregation, ranked by (count, token) through
range partitions, and numbered from ``first_id`` on, the most frequent first;
the table is written once.  No task sorts, and the driver never sees, the
whole vocabulary.

Looking ids up has two forms with the same result.  A table of at most
``BROADCAST_MAX_BYTES`` is broadcast as two Arrow arrays and looked up batch
by batch (``ids``).  A larger one is joined (``encode``): the ``FREQUENT``
first tokens, which make up most of any text, by a broadcast of bounded size,
so that no hot token is shuffled; only the rarer rest by a shuffle join.

Defined results: an unknown or null token gets ``unknown``; a null list stays
null, an empty one empty; ``decode`` gives null for ids that the table lacks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .ranks import global_positions

BROADCAST_MAX_BYTES = 64 << 20
FREQUENT = 1 << 15
FREQUENT_TOKEN_BYTES = 256


@dataclass
class Vocabulary:
    path: str
    size: int
    n_bytes: int  # token text and ids
    unknown: int

    def table(self, spark: SparkSession) -> DataFrame:
        """``token, id, n``: ids are dense and follow falling counts ``n``."""
        return spark.read.parquet(self.path)

    def ids(self, spark: SparkSession) -> Callable[[Column], Column]:
        """A Column function from lists of tokens to lists of ids, for
        ``encode(..., ids=...)``; the table must be small enough to broadcast."""
        if self.n_bytes > BROADCAST_MAX_BYTES:
            raise ValueError(f"a table of {self.n_bytes} bytes is joined, not broadcast: use encode()")
        table = self.table(spark).select("token", "id").toArrow()
        shared = spark.sparkContext.broadcast((table.column("token").combine_chunks(), table.column("id").combine_chunks()))
        unknown = self.unknown

        def lookup(tokens: pa.Array) -> pa.Array:
            known, ids = shared.value
            at = pc.index_in(tokens.flatten(), value_set=known)
            found = pc.fill_null(ids.take(at), unknown)
            return pa.ListArray.from_arrays(_offsets(tokens), found, mask=tokens.is_null())

        lookup.__annotations__ = {"tokens": pa.Array, "return": pa.Array}
        return F.arrow_udf(lookup, T.ArrayType(T.IntegerType()))

    def encode(self, df: DataFrame, tokens: str, out: str = "ids", broadcast: bool | None = None) -> DataFrame:
        """``df`` plus ``out``, the ids of the list of tokens in ``tokens``.
        ``broadcast`` forces one of the two forms."""
        spark = df.sparkSession
        if broadcast if broadcast is not None else self.n_bytes <= BROADCAST_MAX_BYTES:
            return df.withColumn(out, self.ids(spark)(F.col(tokens)))
        table = self.table(spark)
        frequent = table.filter((F.octet_length("token") <= FREQUENT_TOKEN_BYTES)).filter(F.col("pos") < FREQUENT)
        return _joined(df, tokens, out, table.select("token", "id"), frequent.select("token", "id"), "token", "id", F.lit(self.unknown))

    def decode(self, df: DataFrame, ids: str, out: str = "tokens") -> DataFrame:
        """``df`` plus ``out``, the tokens of the list of ids in ``ids``."""
        table = self.table(df.sparkSession)
        frequent = table.filter((F.octet_length("token") <= FREQUENT_TOKEN_BYTES)).filter(F.col("pos") < FREQUENT)
        return _joined(df, ids, out, table.select("id", "token"), frequent.select("id", "token"), "id", "token", F.lit(None).cast("string"))


def _offsets(lists: pa.ListArray) -> pa.Array:
    """Offsets into ``lists.flatten()``, which leaves null lists out."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0)
    ends = pc.cumulative_sum(sizes).cast(pa.int32())
    return pa.concat_arrays([pa.array([0], pa.int32()), ends])


def _joined(
    df: DataFrame, lists: str, out: str, table: DataFrame, frequent: DataFrame, source: str, target: str, missing: Column
) -> DataFrame:
    """``df`` plus ``out``: every element of ``lists`` replaced by its
    ``target`` where ``table`` has it as ``source``."""
    spark = df.sparkSession
    path = scratch_path(spark, "to-look-up")
    df.withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    each = rows.select("__row", F.posexplode(lists).alias("__at", source))
    near = each.join(F.broadcast(frequent), source, "left")
    known = near.filter(F.col(target).isNotNull() | F.col(source).isNull())
    rest = near.filter(F.col(target).isNull() & F.col(source).isNotNull()).drop(target).join(table, source, "left")
    found = known.select("__row", "__at", target).unionByName(rest.select("__row", "__at", target))
    value = F.coalesce(F.col(target), missing).alias("v")
    # a struct keeps null values, which collect_list alone would leave out
    in_order = F.array_sort(F.collect_list(F.struct("__at", value)))
    made = found.groupBy("__row").agg(F.transform(in_order, lambda x: x["v"]).alias("__made"))
    empty = F.when(F.col(lists).isNotNull(), F.array().cast(made.schema["__made"].dataType))
    return rows.join(made, "__row", "left").withColumn(out, F.coalesce("__made", empty)).drop("__row", "__made")


def learn_vocabulary(
    df: DataFrame,
    tokens: Column,
    min_count: int = 1,
    size: int | None = None,
    first_id: int = 1,
    unknown: int = 0,
    path: str | None = None,
) -> Vocabulary:
    """The vocabulary of all ``tokens`` (a list per row): those that occur
    ``min_count`` times or more, at most the ``size`` most frequent (ties by
    the token), with ids from ``first_id`` on."""
    if first_id <= unknown and (size is None or unknown < first_id + size):
        raise ValueError("the id of unknown tokens lies among the others'")
    spark = df.sparkSession
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.filter(F.col("token").isNotNull() & (F.col("n") >= min_count)).withColumn("__order", -F.col("n"))
    ranked = global_positions(kept, ["__order", "token"]).drop("__order")
    if size is not None:
        ranked = ranked.filter(F.col("pos") < size)
    path = path or scratch_path(spark, "vocabulary")
    ranked.select("token", (F.col("pos") + first_id).cast("int").alias("id"), "n", "pos").write.mode("overwrite").parquet(path)
    n, n_bytes = spark.read.parquet(path).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("token") + 8), F.lit(0))).first()
    return Vocabulary(path=path, size=n, n_bytes=n_bytes, unknown=unknown)
