"""Exact dedup by two passes over a Bloom filter.

Texts are equal when their bytes are.  Pass one digests every text once and
counts, for every bit position of a Bloom filter, how many rows set it; the
positions that two or more rows set are the filter.  Pass two looks every row
up: a row of which a position was set by no other row has no equal and passes
straight through.  Only the others, equal rows and the filter's few false
alarms, are shuffled and grouped by digest.

The filter is made of blocks of ``BLOCK`` bits; a digest's block and its two
positions inside it come from a 64-bit hash, so one lookup finds both.  It has
``BITS_PER_ROW`` bits a row up to ``MOST_BITS`` in all (128 MB), which bounds
what is broadcast; beyond that (a hundred million rows) it fills up, lets more
rows through to the grouping and stays right.

Scale: what moves is a row's key and digest, after map-side aggregation, never
its text (``keep_one`` moves the possibly repeated rows whole, one of each
text and task).  Groups of more than rows / ``HOT_GROUPS`` rows (at least
``HOT_ROWS``) are at most ``HOT_GROUPS``; their rows meet their group by a
broadcast of these few, so that no task gathers them.

All steps are DataFrame functions on written tables.

Defined results: a null text counts as empty; a null key is smaller than any
other, and ``keep_id`` is null only where all keys of a group are; of rows
with equal text and key one is ``kept``; ``group_size`` counts rows; an empty
table gives no rows; columns besides key and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, written

BLOCK = 1 << 15
BITS_PER_ROW = 16
MOST_BITS = 1 << 30
HOT_GROUPS = 10_000
HOT_ROWS = 100


def text_digest(text: str) -> Column:
    """SHA-256 of the text's UTF-8 bytes, as bytes."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def filter_blocks(rows: int, bits_per_row: int = BITS_PER_ROW, most_bits: int = MOST_BITS) -> int:
    """How many blocks a filter for so many rows has: a power of two."""
    wanted = min(max(rows * bits_per_row, 1), most_bits)
    blocks = 1
    while blocks * BLOCK < wanted:
        blocks *= 2
    return blocks


def places(digest: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The digest's block, and its two bit positions there."""
    h = F.xxhash64(digest)
    position = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(BLOCK - 1)).cast("long")
    return F.pmod(h, F.lit(blocks)), [position(34), position(49)]


def repeated_filter(digests: DataFrame, digest: str, blocks: int) -> DataFrame:
    """Pass one: ``block, bits``, the positions that two rows or more set."""
    block, positions = places(F.col(digest), blocks)
    counted = (
        digests.select(block.alias("block"), F.explode(F.array(*positions)).alias("position"))
        .groupBy("block", "position")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.filter("n > 1").groupBy("block").agg(F.bitmap_construct_agg("position").alias("bits"))


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), position.bitwiseAND(F.lit(7)).cast("int")) == 1


def with_lookup(rows: DataFrame, digest: str, bloom: DataFrame, blocks: int, flag: str) -> DataFrame:
    """Pass two: ``rows`` plus ``flag``, false where no other row can have
    this digest.  The filter's bytes are bounded by ``MOST_BITS``."""
    block, positions = places(F.col(digest), blocks)
    own, bits = fresh_names(rows, "block", "bits")
    table = F.broadcast(bloom.select(F.col("block").alias(own + "_f"), F.col("bits").alias(bits)))
    found = rows.withColumn(own, block).join(table, F.col(own) == F.col(own + "_f"), "left")
    hit = _is_set(F.col(bits), positions[0]) & _is_set(F.col(bits), positions[1])
    return found.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(own, own + "_f", bits)


def _digests(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Key, row number and digest of every row, written, and how many there are."""
    table = written(
        docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), text_digest(text).alias("digest")),
        "digests",
    )
    return table, table.count()


def memberships(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    bits_per_row: int = BITS_PER_ROW,
    most_bits: int = MOST_BITS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``keep_id`` (the largest key among
    the equal texts), ``group_size``, ``kept`` and ``text_sha256``."""
    digests, n = _digests(docs, key, text)
    blocks = filter_blocks(n, bits_per_row, most_bits)
    bloom = written(repeated_filter(digests, "digest", blocks), "bloom")
    looked = with_lookup(digests, "digest", bloom, blocks, "again")
    alone = looked.filter(~F.col("again")).drop("again")
    again = written(looked.filter("again").drop("again"), "possibly-repeated")
    groups = written(
        again.groupBy("digest")
        .agg(F.max(F.struct("key", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("of"), "best", "n"),
        "groups",
    )
    hot = F.col("n") > max(hot_rows, -(-n // HOT_GROUPS))
    few = F.broadcast(groups.filter(hot))  # at most HOT_GROUPS rows
    same = F.col("digest") == F.col("of")
    in_hot = again.join(few, same)
    rest = again.join(F.broadcast(groups.filter(hot).select("of")), same, "left_anti")
    in_rest = rest.join(groups.filter(~hot), same, "left")
    nobody = F.lit(None).cast(groups.schema["best"].dataType)
    joined = in_hot.unionByName(in_rest).unionByName(
        alone.withColumns({"of": F.lit(None).cast("binary"), "best": nobody, "n": F.lit(None).cast("long")})
    )
    grouped = F.col("n").isNotNull()
    return joined.select(
        F.col("key").alias(key),
        F.when(grouped, F.col("best.key")).otherwise(F.col("key")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(grouped, F.col("best.row") == F.col("row")).otherwise(F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each text, that with the largest key (of
    several, that with the largest hash of all its columns).  Rows without an
    equal pass straight through."""
    digests, n = _digests(docs, key, text)
    blocks = filter_blocks(n)
    bloom = written(repeated_filter(digests, "digest", blocks), "bloom")
    digest, again = fresh_names(docs, "digest", "again")
    looked = with_lookup(docs.withColumn(digest, text_digest(text)), digest, bloom, blocks, again)
    row = F.struct(*[F.col(c) for c in docs.columns])
    hashable = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    best = F.max_by(row, F.struct(F.col(key), F.xxhash64(*hashable)))
    survivors = looked.filter(F.col(again)).groupBy(digest).agg(best.alias(again)).select(f"{again}.*")
    return looked.filter(~F.col(again)).select(*docs.columns).unionByName(survivors)
