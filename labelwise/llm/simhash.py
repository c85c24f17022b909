"""SimHash near-duplicates with pigeonring filtering.

Fingerprint: over the 3-word shingles of a text (repeats included) bit i is 1
if it is set in more than half of their XXH64 values.  Two fingerprints link
at ``BITS`` = 3 or fewer differing bits; documents are grouped by reachability.

Pigeonring filter: cut the 64 bits into a ring of 4 segments.  If two
fingerprints differ in at most 3 bits, some chain of consecutive segments
stays within its proportional budget after every step: 0 differences after
one segment, 1 after two, 2 after three, 3 after four.  So a pair must agree
in a whole segment and in one half of the next one (at most one difference
there): eight 24-bit keys per fingerprint find every pair, and the running
budget prunes candidates before the full Hamming check.

Scale: equal fingerprints are merged first, so exact copies cost one row.
Within a key, all pairs are never formed.  First every member is compared
with the key's heaviest fingerprint (linear) and those links are contracted;
then only members outside a key's largest component are paired with the rest,
and only across components.  A dense group of near copies thereby costs its
size, not its square, and no link between different components is missed.
Where more than about ``CROWD`` members are left to pair, the key is cut finer:
its other 40 bits make four marks of 10, and as a pair has at most three
differences there, it agrees in one of them.
Components come from alternating star contraction over written tables; no
fingerprint, link or component passes through the driver.

Defined results: null, empty and blank texts have fingerprint zero and link
like any other; texts of one or two words have one shingle, the whole
sequence; null ids count as larger than any id (a group of null ids only has
a null component); repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, fresh_names, written

SHINGLE = 3
BITS = 3
SEED = 42
CROWD = 256
_BLOCK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned 64-bit integer."""
    from xxhash import xxh64_intdigest as h64

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return h64(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]])
    n = len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        s, e = starts[at : at + _BLOCK].tolist(), (ends[shingle - 1 :][at : at + _BLOCK] - 1).tolist()
        h = np.fromiter((h64(joined[a:b], SEED) for a, b in zip(s, e, strict=True)), np.uint64, len(s))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int) -> Callable[[], Callable[[list], Sequence]]:
    def make():
        def work(batch: list) -> Sequence:
            return [np.array([fingerprint(t, shingle) for t in batch], np.uint64).view(np.int64)]

        return work

    return make


def with_fingerprint(docs: DataFrame, name: str, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` plus the fingerprint as a signed 64-bit column."""
    return append_columns(docs, _fingerprints(shingle), text, [(name, "long")])


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def _keys(fp: Column) -> Column:
    """Eight (start, half) keys: the whole segment at ``start`` and one half
    of the segment after it."""
    out = []
    for start in range(4):
        ring = fp if start == 0 else F.shiftrightunsigned(fp, 16 * start).bitwiseOR(F.shiftleft(fp, 64 - 16 * start))
        whole = ring.bitwiseAND(F.lit(0xFFFF))
        for half in range(2):
            part = F.shiftrightunsigned(ring, 16 + 8 * half).bitwiseAND(F.lit(0xFF))
            out.append(F.lit((2 * start + half) << 24).cast("long") + F.shiftleft(whole, 8) + part)
    return F.array(*out)


def _marks(key: Column, fp: Column) -> Column:
    """Four marks of the 40 bits that a key leaves open."""
    turn = (F.shiftright(key, 25) * 16).cast("int")
    ring = F.call_function("shiftrightunsigned", fp, turn).bitwiseOR(F.call_function("shiftleft", fp, F.lit(64) - turn))
    first_half = key.bitwiseAND(F.lit(1 << 24)) == 0
    other = F.when(first_half, F.shiftrightunsigned(ring, 24)).otherwise(F.shiftrightunsigned(ring, 16)).bitwiseAND(F.lit(0xFF))
    rest = F.shiftleft(F.shiftrightunsigned(ring, 32), 8).bitwiseOR(other)
    return F.array(
        *[(F.lit(k << 10) + F.shiftrightunsigned(rest, 10 * k).bitwiseAND(F.lit(1023))).cast("int") for k in range(4)]
    )


def _within_budget(a: str, b: str, key: str) -> Column:
    """Chain condition from the key's start, then the full Hamming check."""
    diff = F.col(a).bitwiseXOR(F.col(b))
    start = F.shiftright(F.col(key), 25)

    def chain(segments: int) -> Column:
        mask = (1 << (16 * segments)) - 1
        out = F.lit(0)
        for s in range(4):
            turned = ((mask << (16 * s)) | (mask >> (64 - 16 * s) if s else 0)) & ((1 << 64) - 1)
            signed = turned - (1 << 64) if turned >> 63 else turned
            out = F.when(start == s, F.bit_count(diff.bitwiseAND(F.lit(signed).cast("long")))).otherwise(out)
        return out

    return (chain(2) <= 1) & (chain(3) <= 2) & (F.bit_count(diff) <= BITS)


def star_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(v, c)`` for every vertex of ``edges(a, b)``: ``c`` is the smallest
    vertex it can reach.  Alternating large-star / small-star rounds, each
    written to the shared folder; the number of rounds is logarithmic."""
    state = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )

    def sign(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = sign(state)
    while last[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
            .select("x.u", F.col("x.m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        state = written(small, name)
        now = sign(state)
        if now == last:
            break
        last = now
    roots = state.select(F.col("v").alias("c")).distinct()
    return state.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(
        roots.select(F.col("c").alias("v"), "c")
    )


def link(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``(fp, c)`` for the fingerprints of ``nodes(fp, n)`` that link to
    another one; the rest are alone.  ``n`` (documents) picks the pivots;
    ``crowd`` changes the work only, not the result."""
    keyed = nodes.select("fp", "n", F.explode(_keys(F.col("fp"))).alias("key"))
    shared = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("members"), F.max(F.struct("n", "fp")).alias("top"))
        .filter("members > 1")
        .select("key", F.col("top.fp").alias("pivot"))
    )
    member = written(keyed.join(shared, "key").select("key", "fp", "pivot"), "simhash-keys")
    near = member.filter((F.col("fp") != F.col("pivot")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= BITS))
    first = written(star_components(near.select(F.col("fp").alias("a"), F.col("pivot").alias("b"))), "simhash-first")
    placed = member.join(first.withColumnRenamed("v", "fp"), "fp", "left").select(
        "key", "fp", F.coalesce("c", "fp").alias("c")
    )
    parts = placed.groupBy("key", "c").agg(F.count("*").alias("size"))
    open_keys = (
        parts.groupBy("key")
        .agg(F.count("*").alias("parts"), F.max(F.struct("size", "c")).alias("top"), F.sum("size").alias("all"))
        .filter("parts > 1")
        .select("key", F.col("top.c").alias("major"), ((F.col("all") - F.col("top.size")) * F.col("all") > crowd * crowd).alias("crowded"))
    )
    mark = F.when(F.col("crowded"), _marks(F.col("key"), F.col("fp"))).otherwise(F.array(F.lit(-1)))
    rows = written(placed.join(open_keys, "key").select("key", F.explode(mark).alias("mark"), "fp", "c", "major"), "simhash-open")
    minor = rows.filter("c <> major").select("key", "mark", F.col("fp").alias("fa"), F.col("c").alias("a"))
    rest = rows.select("key", "mark", F.col("fp").alias("fb"), F.col("c").alias("b"), "major")
    across = minor.join(rest, ["key", "mark"]).filter(
        (F.col("a") != F.col("b")) & ((F.col("b") == F.col("major")) | (F.col("fa") < F.col("fb")))
    )
    second = star_components(across.filter(_within_budget("fa", "fb", "key")).select("a", "b").distinct())
    over = second.select(F.col("v").alias("c"), F.col("c").alias("d"))
    # a fingerprint without a first-round link is its own first component
    alone = second.join(first, second.v == first.v, "left_anti").select(F.col("v").alias("fp"), "c")
    return (
        first.join(over, "c", "left")
        .select(F.col("v").alias("fp"), F.coalesce("d", "c").alias("c"))
        .unionByName(alone)
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(key, fingerprint, component_id)``, one row per row of ``docs``."""
    rows = written(with_fingerprint(docs.select(F.col(key).alias("id"), F.col(text).alias("t")), "fp", "t", shingle).drop("t"), "simhash")
    fps = written(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("low")), "simhash-fps")
    linked = written(link(fps), "simhash-links")
    named = fps.join(linked, "fp", "left").select("fp", "low", F.coalesce("c", "fp").alias("c"))
    lowest = named.groupBy("c").agg(F.min("low").alias("component_id"))
    return rows.join(named.join(lowest, "c").select("fp", "component_id"), "fp").select(
        F.col("id").alias(key), hex16(F.col("fp")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the
    smallest id (null ids last; equal ids: smallest hash of all columns; rows
    alike in all columns: any one).

    The choice is made on narrow rows (id, row hash); the wide rows meet the
    survivors by one column, so they move at most once.
    """
    (mark,) = fresh_names(docs, "mark")
    hashable = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    hashed = F.xxhash64(*hashable)
    narrow = with_fingerprint(docs.select(F.col(key).alias("id"), hashed.alias("h"), F.col(text).alias("t")), "fp", "t", shingle)
    rows = written(narrow.drop("t"), "simhash")
    fps = written(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("z"), "id", "h")).alias("low")), "simhash-fps")
    linked = written(link(fps.select("fp", "n")), "simhash-links")
    name = lambda ident, h: F.concat_ws(":", h.cast("string"), ident.cast("string"))  # noqa: E731  a null id is left out
    best = (
        fps.join(linked, "fp", "left")
        .groupBy(F.coalesce("c", "fp").alias("c"))
        .agg(F.min("low").alias("low"))
        .select(name(F.col("low.id"), F.col("low.h")).alias(mark))
    )
    chosen = docs.withColumn(mark, name(F.col(key), hashed)).join(best, mark, "left_semi")
    return chosen.dropDuplicates([mark]).select(*docs.columns)
