"""Split canonicalisation, seeded holdout, seeded caps and head limits
(L1-L4).

Randomness is a keyed hash, ``md5(seed|key)``, never ``rand()``: the
assignment of a row does not depend on partitioning, task retries or
executor loss, and it is the same in any SQL engine with ``md5``.

Exact sizes and limits all use one plan, whatever the size and the key type:
ranks are computed on the slim (split, key) columns by range partitioning
(``ranks.global_positions``) and the surviving keys are joined back to the
wide rows once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import global_positions

CANONICAL = ("train", "valid", "test")
HASH_RANGE = float(1 << 32)


def hash_order(key, seed: int) -> Column:
    """md5 of ``seed|key`` as lower-case hex (sorts like the 128-bit value)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))


def hash_number(key, seed: int) -> Column:
    """The first 32 bits of the md5 as a bigint."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("bigint")


def hash_bucket(key, seed: int, buckets: int) -> Column:
    """Stable bucket in ``[0, buckets)`` from the first 32 bits of the md5."""
    return F.pmod(hash_number(key, seed), F.lit(buckets))


def _part_below(x: Column, edges: Sequence[tuple[str, float]]) -> Column:
    """The first name whose upper edge exceeds ``x``; the last name otherwise."""
    out = F.lit(edges[-1][0])
    for name, edge in reversed(edges[:-1]):
        out = F.when(x < F.lit(edge), F.lit(name)).otherwise(out)
    return out


def holdout_split(df: DataFrame, key: str, seed: int, fractions: Mapping[str, float]) -> DataFrame:
    """L2: assign each row to one named part by keyed hash.

    ``fractions`` is an ordered mapping name -> share and must sum to 1;
    parts are disjoint and cover all rows.  The 32-bit hash is compared with
    the shares themselves, so sizes are those of independent draws for any
    share.  Narrow: no shuffle.
    """
    if not fractions or abs(sum(fractions.values()) - 1.0) > 1e-9 or min(fractions.values()) < 0:
        raise ValueError(f"shares must be non-negative and sum to 1: {dict(fractions)}")
    edges, total = [], 0.0
    for name, share in fractions.items():
        total += share
        edges.append((name, total * HASH_RANGE))
    return df.withColumn("split", _part_below(hash_number(key, seed), edges))


def exact_sizes_80_10_10(n: int) -> list[tuple[str, int]]:
    """Exact part sizes of the two-step 3-way split: hold out ceil(20 %),
    then give the test part ceil(half) of the holdout."""
    hold = math.ceil(0.2 * n)
    test = math.ceil(0.5 * hold)
    return [("train", n - hold), ("valid", hold - test), ("test", test)]


def exact_holdout_split(df: DataFrame, key: str, seed: int, sizes=None) -> DataFrame:
    """L2 with exact part sizes: rows ranked by ``(md5(seed|key), key)``;
    the first ``sizes[0]`` ranks go to the first part, and so on.  ``key``
    is unique.  ``sizes`` defaults to the two-step 80/10/10 rule.
    """
    ranked = global_positions(df.select(F.col(key).alias("__k"), hash_order(key, seed).alias("__h")), ["__h", "__k"])
    if sizes is None:
        sizes = exact_sizes_80_10_10(ranked.count())
    edges, total = [], 0
    for name, size in sizes:
        total += size
        edges.append((name, total))
    part = ranked.select("__k", _part_below(F.col("pos"), edges).alias("split"))
    return df.join(part, F.col(key).eqNullSafe(F.col("__k"))).drop("__k")


def canonical_splits(
    df: DataFrame,
    key: str,
    seed: int = 42,
    split_col: str = "split",
    names: Sequence[str] | None = None,
    exact: bool = False,
    strict: bool = False,
) -> DataFrame:
    """L1: bring any split layout to ``train`` / ``valid`` / ``test``.

    Cases, tested in order on the set of split names:
    {train, validation, test} as is (validation -> valid); {train, valid,
    test} as is; {train, test}: 10 % of train becomes valid; {train}: 80 /
    10 / 10; anything else raises.  A table without a split column counts
    as {train}.  Rows of other splits are dropped.  ``exact`` makes the
    sizes of the last two cases exact (a carved tenth is rounded up).

    A validation part without a test part would be dropped and train split
    anew; that raises unless ``strict`` asks for exactly this.
    """
    wanted = ("train", "validation", "valid", "test")
    if split_col not in df.columns:
        present = {"train"}
        df = df.withColumn(split_col, F.lit("train"))
    elif names is not None:
        present = set(names)
    else:
        found = df.agg(*[F.max(F.col(split_col) == w).alias(w) for w in wanted]).first()
        present = {w for w in wanted if found[w]}
    s = F.col(split_col)
    if {"train", "validation", "test"} <= present:
        out = df.filter(s.isin("train", "validation", "test")).withColumn(
            "split", F.when(s == "validation", F.lit("valid")).otherwise(s)
        )
    elif set(CANONICAL) <= present:
        out = df.filter(s.isin(*CANONICAL)).withColumn("split", s)
    elif {"train", "test"} <= present:
        train, test = df.filter(s == "train"), df.filter(s == "test").withColumn("split", F.lit("test"))
        if exact:
            rows = train.count()
            tenth = math.ceil(0.1 * rows)
            carved = exact_holdout_split(train.drop("split"), key, seed, [("valid", tenth), ("train", rows - tenth)])
        else:
            carved = holdout_split(train, key, seed, {"valid": 0.1, "train": 0.9})
        out = carved.select(*test.columns).unionByName(test) if split_col == "split" else carved.unionByName(test, True)
    elif "train" in present:
        if not strict and present & {"validation", "valid"}:
            raise ValueError("a validation split without a test split would be dropped; pass strict=True to allow it")
        train = df.filter(s == "train").drop(split_col)
        if exact:
            out = exact_holdout_split(train, key, seed)
        else:
            out = holdout_split(train, key, seed, {"train": 0.8, "valid": 0.1, "test": 0.1})
    else:
        raise KeyError(f"no train split among the splits found: {sorted(present)}")
    if split_col != "split" and split_col in out.columns:
        out = out.drop(split_col)
    return out


# --- L3 / L4 -----------------------------------------------------------------


def _limited(df: DataFrame, limits: Mapping[str, int], key: str, split_col: str, order: list[Column]) -> DataFrame:
    """Rows of unlimited splits (a null split included) plus, per limited
    split, the first ``limit`` rows in ``order``, ties by ``key`` (unique
    within its split)."""
    capped = {s: n for s, n in limits.items() if n > 0}
    if not capped:
        return df
    s = F.col(split_col)
    inside = F.coalesce(s.isin(*capped), F.lit(False))
    names = [f"__o{i}" for i in range(len(order))]
    slim = df.filter(inside).select(
        s.alias("__s"), F.col(key).alias("__k"), *[o.alias(n) for o, n in zip(order, names, strict=True)]
    )
    ranked = global_positions(slim, [*names, "__k"], group="__s")
    first = reduce(lambda c, x: c | x, [(F.col("__s") == k) & (F.col("pos") < n) for k, n in capped.items()])
    keep = ranked.filter(first).select("__s", "__k")
    kept = df.filter(inside).join(keep, (s == F.col("__s")) & F.col(key).eqNullSafe(F.col("__k")), "left_semi")
    return df.filter(~inside).unionByName(kept)


def seeded_cap(
    df: DataFrame,
    limits: Mapping[str, int],
    key: str,
    seed: int = 42,
    split_col: str = "split",
) -> DataFrame:
    """L3: per split, keep ``limit`` rows chosen by seeded hash order.

    ``limit <= 0`` or a split no larger than ``limit`` is left unchanged.
    The choice depends only on (seed, key), so it is the same for any
    partitioning.  The output is a set; its order is not defined.
    """
    return _limited(df, limits, key, split_col, [hash_order(key, seed)])


def first_by_key(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest ``key`` (unique, of any orderable
    type), exactly and by the same plan for every ``n``."""
    if n <= 0:
        return df.limit(0)
    keep = global_positions(df.select(F.col(key).alias("__k")), "__k").filter(F.col("pos") < n).select("__k")
    return df.join(keep, F.col(key).eqNullSafe(F.col("__k")), "left_semi")


def head_limit(df: DataFrame, limits: Mapping[str, int], key: str, split_col: str = "split") -> DataFrame:
    """L4 / M6: per split, the first ``limit`` rows in ``key`` order (0 = all)."""
    return _limited(df, limits, key, split_col, [])
