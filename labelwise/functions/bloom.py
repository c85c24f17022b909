"""Bloom filters as tables: built by aggregation, looked up by a broadcast join.

A filter is a table ``block, bits`` of blocks of 4 KB.  A key's block and its
``HASHES`` positions inside it come from its 64-bit hash, so one lookup finds
all its bits.  Everything is a built-in function; a filter never holds more
than ``MOST_BITS`` bits, which bounds the broadcast, and has no false
negatives however many keys it was built from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 15
BITS_PER_KEY = 12
MOST_BITS = 1 << 30
HASHES = 3


def blocks_for(keys: int, bits_per_key: int = BITS_PER_KEY, most_bits: int = MOST_BITS) -> int:
    """Blocks of a filter for so many keys (a power of two)."""
    bits = min(max(keys * bits_per_key, BLOCK), most_bits)
    return 1 << max(0, (bits - 1) // BLOCK).bit_length()


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(key)
    at = lambda i: F.shiftrightunsigned(h, 64 - 15 * (i + 1)).bitwiseAND(F.lit(BLOCK - 1)).cast("long")
    return F.pmod(h, F.lit(blocks)), [at(i) for i in range(HASHES)]


def build(keys: DataFrame, key: Column, blocks: int) -> DataFrame:
    """``block, bits`` of all keys; partial bitmaps are made in every task."""
    block, at = _places(key, blocks)
    return (
        keys.select(block.alias("block"), F.explode(F.array(*at)).alias("at"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("at").alias("bits"))
    )


def maybe_in(df: DataFrame, key: Column, bloom: DataFrame, blocks: int, flag: str) -> DataFrame:
    """``df`` plus ``flag``: false where the key is surely not in the filter."""
    block, at = _places(key, blocks)
    table = F.broadcast(bloom.select(F.col("block").alias("__bloom_block"), F.col("bits").alias("__bloom_bits")))
    byte = lambda p: F.conv(F.hex(F.substring("__bloom_bits", F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hits = [F.getbit(byte(p), p.bitwiseAND(F.lit(7)).cast("int")) == 1 for p in at]
    found = df.join(table, block == F.col("__bloom_block"), "left")
    return found.withColumn(flag, F.coalesce(reduce(lambda a, b: a & b, hits), F.lit(False))).drop("__bloom_block", "__bloom_bits")
