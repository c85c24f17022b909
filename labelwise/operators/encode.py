"""Encode prompt/target pairs into loss-masked training examples and pad
them in batches (P10-P15, L7, U1).

The built-in tokeniser splits on Unicode whitespace and maps each piece to
an id by hashing (``xxhash64 mod vocab``): no vocabulary table, no driver
state, fully JVM-side.  Other tokenisers plug in as a Column function
``str -> array<string>`` plus an id function, or as an Arrow
``pandas_udf`` (see ``pandas_tokenizer``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WHITESPACE, space_tokens
from .chat import CHATML, ChatTemplate
from .ranks import global_positions
from .splits import hash_bucket
from .workers import built_once, new_id, text_parts

Tokenizer = Callable[[Column], Column]


def hashed_ids(vocab_size: int = 1 << 20) -> Callable[[Column], Column]:
    """Token strings -> int ids in ``[1, vocab_size]`` (0 is kept free).

    Ids are hashes: of V distinct tokens about V / (2 * vocab_size) share an
    id with another one (1 in 20 for 100,000 tokens and the default size).
    Where that matters, pass ``table_ids`` or a larger size.
    """

    def ids(tokens: Column) -> Column:
        return F.transform(tokens, lambda t: (F.pmod(F.xxhash64(t), F.lit(vocab_size)) + 1).cast("int"))

    return ids


def table_ids(vocabulary: dict[str, int], unknown: int = 0) -> Callable[[Column], Column]:
    """Ids from a given vocabulary (plan-sized: a few thousand entries)."""
    entries = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv])

    def ids(tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(entries, t), F.lit(unknown)).cast("int"))

    return ids


def encode(
    df: DataFrame,
    max_length: int = 256,
    ignore_index: int = -100,
    tokenizer: Tokenizer = space_tokens,
    ids: Callable[[Column], Column] | None = None,
    keep_tokens: bool = False,
) -> DataFrame:
    """P10-P13 on a frame with ``prompt`` and ``target`` columns.

    ``prompt_ids`` = tokens(prompt) (untruncated), ``full_ids`` =
    tokens(prompt + target) cut to ``max_length`` on the right; labels are
    ``ignore_index`` over the prompt part, then the remaining full ids.
    Rows without a supervised position are dropped; the size test runs
    before any id array is built.
    """
    ids = ids or hashed_ids()
    p_tok = tokenizer(F.col("prompt"))
    full = tokenizer(F.concat("prompt", "target"))
    if tokenizer is space_tokens:
        # whitespace pieces: when the prompt ends in whitespace (a chat
        # prompt ends with its generation-prompt newline), tokens(prompt +
        # target) = tokens(prompt) ++ tokens(target) -- the long prompt is
        # not split a second time.
        ends_ws = F.substring(F.col("prompt"), -1, 1).isin(*WHITESPACE)
        full = F.when(ends_ws, F.concat(F.col("__p0"), tokenizer(F.col("target")))).otherwise(full)
    # Both token arrays come out of one (outer) generator: a filter on its
    # output cannot be pushed below it, so the P12 size test does not
    # re-run the tokeniser.
    pair = F.struct(F.col("__p0").alias("__p"), F.slice(full, 1, max_length).alias("__f"))
    staged = df.select("*", F.inline_outer(F.array(F.struct(p_tok.alias("__p0")))))
    staged = staged.select("*", F.inline_outer(F.array(pair))).drop("__p0")
    staged = staged.withColumn("n_prompt", F.size("__p")).withColumn("n_full", F.size("__f"))
    staged = staged.filter(F.col("n_full") > F.col("n_prompt"))  # P12
    n_masked = F.least("n_prompt", "n_full")
    out = (
        staged.withColumn("input_ids", ids(F.col("__f")))
        .withColumn("attention_mask", F.array_repeat(F.lit(1), F.col("n_full")))  # P13
        .withColumn(
            "labels",
            F.concat(
                F.array_repeat(F.lit(ignore_index), n_masked),
                F.slice("input_ids", n_masked + 1, F.greatest(F.col("n_full") - n_masked, F.lit(0))),
            ),
        )
        .withColumn("n_supervised", F.col("n_full") - n_masked)
    )
    if keep_tokens:
        out = out.withColumn("supervised_tokens", F.slice("__f", n_masked + 1, F.col("n_supervised")))
    return out.drop("__p", "__f")


def pad_batches(
    encoded: DataFrame,
    key: str,
    batch_size: int = 8,
    shards: int | None = None,
    seed: int = 42,
    pad_id: int | None = None,
    template: ChatTemplate = CHATML,
    ignore_index: int = -100,
    layout: str = "shards",
    numbering: str = "auto",
) -> DataFrame:
    """L7 + P14: batches of ``batch_size`` consecutive rows in ``key``
    order (a unique row key); every row is padded to its batch's longest row.

    ``layout="global"``: consecutive over the whole frame, as a single-node
    data loader would batch a file.  ``layout="shards"``: consecutive within
    ``shards`` hash shards, a number that has to be given: batches must not
    depend on a session setting;
    shards come from a keyed hash, so they are balanced whatever the keys.

    Numbering: with at least as many shards as shuffle partitions, a
    row-number window per shard is one shuffle (the batch window reuses its
    partitioning) and each task holds a few shards.  Otherwise (the global
    layout, or few shards: a shard would be too large for one task) the
    encoded rows are written once to the shared folder; positions and batch
    maxima are computed on the slim ``(key, shard, n_full)`` columns of
    that table (``global_positions``, range partitioned, no task holds a
    whole shard), and joined back on ``key`` -- the tokeniser runs once and
    the id arrays are shuffled once.  ``numbering`` forces ``"window"`` or
    ``"ranked"``; both give the same batches.
    """
    from ..session import scratch_path

    spark = encoded.sparkSession
    pad = template.pad_token_id if pad_id is None else pad_id
    to_batch = lambda pos: F.floor(pos / F.lit(batch_size)).cast("bigint")
    by_batch = Window.partitionBy("shard", "batch_id")
    if layout == "global":
        sharded, numbering = encoded.withColumn("shard", F.lit(0)), "ranked"
    elif layout == "shards":
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not shards:
            raise ValueError("layout 'shards' needs the number of shards: batches depend on it")
        sharded = encoded.withColumn("shard", hash_bucket(key, seed, shards).cast("int"))
        if numbering == "auto":
            numbering = "window" if shards >= partitions else "ranked"
    else:
        raise ValueError(f"unknown layout {layout!r}")
    if numbering == "window":
        by_shard = Window.partitionBy("shard").orderBy(key)
        out = sharded.withColumn("batch_id", to_batch(F.row_number().over(by_shard) - 1)).withColumn(
            "max_len", F.max("n_full").over(by_batch)
        )
    elif numbering == "ranked":
        path = scratch_path(spark, "encoded")
        sharded.write.mode("overwrite").parquet(path)
        stored = spark.read.parquet(path)
        ranked = global_positions(
            stored.select(key, "shard", "n_full"),
            key,
            group=None if layout == "global" else "shard",
        )
        sizes = (
            ranked.withColumn("batch_id", to_batch(F.col("pos")))
            .withColumn("max_len", F.max("n_full").over(by_batch))
            .select(key, "batch_id", "max_len")
        )
        out = stored.join(sizes, key)
    else:
        raise ValueError(f"unknown numbering {numbering!r}")
    out = out.withColumn("n_pad", F.col("max_len") - F.col("n_full"))
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("n_pad")))
    return (
        out.withColumn("input_ids", fill("input_ids", pad))
        .withColumn("attention_mask", fill("attention_mask", 0))
        .withColumn("labels", fill("labels", ignore_index))
    )


def pandas_tokenizer(factory: Callable[[], Callable[[str], list[str]]]) -> Tokenizer:
    """U1 for external tokenisers: an Arrow-batched pandas UDF.

    ``factory`` builds the tokeniser once per Python worker (cached), and
    the returned function maps one text to its token strings.  A batch's
    tokens, many times its text as Python strings, leave the worker part by
    part (``text_parts``).
    """
    import pandas as pd

    ident = new_id()

    def tok(batches):
        fn = built_once(ident, factory)
        for texts in batches:
            for rows in text_parts(texts):
                yield texts.iloc[rows].map(lambda t: None if t is None else list(fn(t)))

    tok.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(tok, T.ArrayType(T.StringType()))
