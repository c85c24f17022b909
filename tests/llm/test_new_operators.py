"""Exact dedup, Merkle manifest and ranked search against brute force: nulls,
empty and very long texts, ties and repeated rows, empty tables, extra columns
with clashing names, hot groups."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwise.llm import exactdedup, merkle, search
from labelwise.llm.common import written

ODD = [None, "", " ", "word", "Word", "x " * 40_000, "ünï ¡¿ 　 \U0001f600", "a\x00b"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- exact dedup ---------------------------------------------------------------


def dedup_rows(n=600, seed=1):
    rng = random.Random(seed)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, t) for i, t in enumerate(ODD)]
    rows += [(200 + i, f"text {rng.randrange(n)}") for i in range(n)]
    rows += [(10_000 + i, "one text that a third of all rows share") for i in range(n // 2)]
    rows += [(5, "same id, same text"), (5, "same id, same text"), (None, "no id"), (None, "no id"), (None, "word")]
    rng.shuffle(rows)
    return rows


def dedup_frame(spark, rows):
    return spark.createDataFrame([(i, t, "d", 1, "k") for i, t in rows], "doc_id long, text string, digest string, block int, kept string").repartition(7)


def brute_groups(rows):
    out = {}
    for i, t in rows:
        out.setdefault(t or "", []).append(i)
    return out


@pytest.mark.parametrize("options", [{}, {"hot_rows": 5, "most_bits": 64}])
def test_exact_dedup_against_brute_force(spark, options):
    rows = dedup_rows()
    groups = brute_groups(rows)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    got = exactdedup.memberships(dedup_frame(spark, rows), **options).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_keeps_whole_rows(spark):
    rows = dedup_rows(200, 2)
    frame = dedup_frame(spark, rows)
    got = exactdedup.keep_one(frame)
    assert got.columns == frame.columns
    have = [tuple(r) for r in got.collect()]
    want = {t: max((i for i in ids if i is not None), default=None) for t, ids in brute_groups(rows).items()}
    assert len(have) == len(want) and {(t or ""): i for i, t, *_ in have} == want
    assert {r[2:] for r in have} == {("d", 1, "k")}


def test_exact_dedup_lets_rows_without_equals_pass(spark):
    rows = written(spark.range(20_000).select("id", F.concat(F.lit("text "), F.least("id", F.lit(19_899)).cast("string")).alias("text")), "t")
    digests = rows.select("id", exactdedup.text_digest("text").alias("digest"))
    blocks = exactdedup.filter_blocks(20_000)
    bloom = written(exactdedup.repeated_filter(digests, "digest", blocks), "bloom")
    again = {r["id"] for r in exactdedup.with_lookup(digests, "digest", bloom, blocks, "again").filter("again").collect()}
    assert set(range(19_899, 20_000)) <= again  # no equal row is lost
    assert len(again) < 0.05 * 20_000  # and few others are shuffled
    assert bloom.count() <= blocks and bloom.agg(F.max(F.octet_length("bits"))).first()[0] == exactdedup.BLOCK // 8


def test_exact_dedup_runs_no_python_and_moves_no_text(spark):
    frame = dedup_frame(spark, dedup_rows(50))
    out = exactdedup.memberships(frame)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "text" not in {c for line in plan.splitlines() if "ReadSchema" in line for c in re.findall(r"(\w+):", line)}


def test_exact_dedup_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exactdedup.memberships(empty).count() == 0
    assert exactdedup.keep_one(empty).count() == 0


def test_filter_size_follows_rows_up_to_its_bound():
    assert exactdedup.filter_blocks(0) == exactdedup.filter_blocks(2048) == 1
    assert exactdedup.filter_blocks(2049) == 2
    assert exactdedup.filter_blocks(10**12) * exactdedup.BLOCK == exactdedup.MOST_BITS


# --- Merkle manifest -----------------------------------------------------------


def brute_tree(nodes, fanout):
    """Root and each node's way: (left, right) texts by level."""
    ways = [[] for _ in nodes]
    members = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, own = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a : a + fanout]
            for k in range(len(run)):
                for i in members[a + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha(*run))
            own.append([i for m in members[a : a + fanout] for i in m])
        nodes, members = up, own
    return nodes[0], ways


def brute_manifest(rows, fanout):
    groups = {}
    for key, grp, leaf in rows:
        groups.setdefault(grp, []).append(((key is not None, key or 0), leaf, key))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[1] for x in sorted(groups[g], key=lambda x: x[:2])], fanout) for g in order}
    root, crown = brute_tree([trees[g][0] for g in order], fanout)
    out = Counter()
    for g, above in zip(order, crown, strict=True):
        for (_, leaf, key), way in zip(sorted(groups[g], key=lambda x: x[:2]), trees[g][1], strict=True):
            out[("" if g is None else "=" + g, key, leaf, trees[g][0], root, tuple(way + above))] += 1
    return out


@pytest.mark.parametrize("fanout,height,most", [(2, 10, 40), (2, 2, 70), (3, 1, 50)])
def test_manifest_against_brute_force(spark, fanout, height, most):
    rng = random.Random(most)
    sizes = {None: 3, "": 1, "en": most, "é": 7, "zz": 2, "lone": 1}
    rows = [(rng.randrange(1000), g) for g, n in sizes.items() for _ in range(n)]
    rows += [(None, "en"), (None, "en"), rows[0], rows[4], rows[4]]
    frame = spark.createDataFrame(
        [(k, g, "x", 1) for k, g in rows], "doc_id long, lang string, node string, pos int"
    ).repartition(5)
    leaf = merkle.leaf_digest([F.col("doc_id"), F.col("lang")])
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = brute_manifest([(k, g, sha(text(k), text(g))) for k, g in rows], fanout)
    out = merkle.manifest(frame, "doc_id", "lang", leaf, {"extra": F.col("pos")}, fanout=fanout, height=height)
    got = out.withColumns({"fold": merkle.folded(F.col("node"), F.col("way")), "proof": merkle.proof_digest(F.col("way"))}).collect()
    have = Counter((r["grp"], r["key"], r["node"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["way"])) for r in got)
    assert have == want
    assert all(r["fold"] == r["root"] for r in got)
    assert all(r["proof"] == sha(*[x for s in r["way"] for x in s]) for r in got)


def test_manifest_shows_tampering(spark):
    out = merkle.verified_documents(spark, "/root/testdata/sf0.001").collect()
    assert {r["verified"] for r in out} == {True, False}
    for r in out:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) == (r["folded_root"] == r["root"])


def test_manifest_of_one_group_is_spread_over_tasks(spark):
    frame = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    leaves = frame.select(F.lit("=en").alias("grp"), F.col("doc_id").alias("key"), merkle.leaf_digest([F.col("doc_id")]).alias("node"))
    nodes = merkle.numbered(leaves)
    assert [r["pos"] for r in nodes.orderBy("key").select("pos").collect()] == list(range(5000))
    chunked = merkle.Stride(nodes, 2, 8).nodes.groupBy("grp", "chunk").count()
    assert chunked.count() == 20 and chunked.agg(F.max("count")).first()[0] == 256


def test_manifest_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string")
    assert merkle.manifest(empty, "doc_id", "lang", merkle.leaf_digest([F.col("doc_id")])).count() == 0


# --- ranked search -------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_search(docs, items, top):
    bags = [(i, Counter(brute_terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in items:
        scored = []
        for (i, b), n in zip(bags, sizes, strict=True):
            m = 100 - 50 + (50 * n * n_docs) // max(n_terms, 1)
            s = 0
            for t in set(brute_terms(text)) & set(b):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                s += w * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored)[:top], 1):
            out[(item, rank, i, -s)] += 1
    return out


def search_docs(seed=4, n=400):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 3, 3, 20, 90])))) for i in range(n)]
    rows += [(1000 + i, "W1, w2. quite the same text; w3") for i in range(n // 2)]
    rows += [(7, "w1 w1"), (7, "w1 w1"), (None, "w1 w2"), (None, "w5 Ünï")]
    rng.shuffle(rows)
    items = [(1, "w1 w2 w3 W3"), (2, None), (3, "nothing here holds"), (4, "quite THE same"), (4, "ünï ¡¿ x"), (5, "Ünï-x word a"), (None, "w9 w11")]
    items += [(10 + i, " ".join(rng.choice(words) for _ in range(8))) for i in range(20)]
    return rows, items


@pytest.mark.parametrize(
    "options", [{}, {"vocabulary_bytes": 0, "segment": (200, 1 << 15)}, {"block_terms": 60, "segment": (1 << 20, 3), "fan_in": 2, "top": 3}]
)
def test_search_against_brute_force(spark, options):
    rows, items = search_docs()
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, terms string, score int").repartition(6)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int").repartition(3)
    got = search.search(docs, asked, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute_search(rows, items, options.get("top", 50))


def test_search_with_text_keys(spark):
    rows, items = search_docs(9, 60)
    rows = [(f"d{i:05}", t) for i, t in rows if i is not None]
    docs = spark.createDataFrame(rows, "name string, body string")
    got = search.search(docs, spark.createDataFrame(items, "item_id long, text string"), key="name", text="body", top=5)
    bare = brute_search([(int(i[1:]), t) for i, t in rows], items, 5)
    assert Counter((r[0], r[1], int(r[2][1:]), r[3]) for r in got.collect()) == bare


def test_search_empty(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0


def test_strata_are_left_out_by_their_bound():
    """Strata whose bound stays below the last of the best are not scored."""
    m = np.repeat([60, 500, 4000], [40, 400, 4000])
    doc = np.arange(len(m))
    segment = search.Segment(doc, np.zeros(len(m), np.int64), np.where(doc % 2, 1, 3), m, 1)
    seen = []
    original = search._spans
    search._spans = lambda start, size: seen.append(int(size.sum())) or original(start, size)
    try:
        hit, score = segment.search(np.array([0]), np.array([1000]), 10, 0)
    finally:
        search._spans = original
    assert hit.tolist() == list(range(0, 20, 2)) and len(set(score.tolist())) == 1
    assert max(seen) <= 40


def test_impacts_are_computed_once_for_each_tf_of_a_stratum():
    m = np.full(1000, 77)
    doc = np.arange(1000)
    segment = search.Segment(doc, np.zeros(1000, np.int64), 1 + doc % 4, m, 1)
    assert segment.strata == 1 and len(segment.run_impact) == 4
    assert segment.most[0] == (1_000_000_000 * 4) // (4000 + 20 * 77)


# --- packing index, cuts at lone spaces --------------------------------------------


def test_sum_index_against_all_combinations():
    from itertools import combinations_with_replacement

    from labelwise.llm import packing

    rng = random.Random(6)
    for _ in range(200):
        left = [0] + [rng.choice([0, 0, 1, 2, 3]) for _ in range(rng.randint(3, 25))]
        index = packing.SumIndex(left)
        for _ in range(6):
            gap, beside = rng.randint(1, len(left) - 1), tuple(rng.sample(range(1, len(left)), rng.randint(0, 1)))
            if not index.has(beside):
                continue
            fits = [
                c[::-1]
                for k in (1, 2, 3)
                for c in combinations_with_replacement(range(1, len(left)), k)
                if sum(c) == gap and index.has((*beside, *c))
            ]
            got = index.filling(gap, beside)
            if not fits:
                assert got is None
                continue
            fewest = min(map(len, fits))
            assert got == max(c for c in fits if len(c) == fewest)
            for x in (*beside, *got):
                left[x] -= 1


def test_texts_are_cut_at_lone_spaces_only():
    import public_tokenizers

    from labelwise.llm import tokens

    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert enc.units("a b  c d \ne f") == ["a", "b  c", "d \ne", "f"]
    assert enc.units(" a b ") == [" a", "b "] and enc.units("") == [""]
    assert enc.units("a <|endoftext|> b") is None
    for text in ("x  y z\n\n w  ", "a　 b c", "it's 'll  do 12 \t34 \x1c x y"):
        units = enc.units(text)
        ids = enc.unit(units[0]) + [i for u in units[1:] for i in enc.unit(" " + u)]
        assert ids == enc.whole(text)


def test_unit_cache_is_bounded_in_bytes(monkeypatch):
    from labelwise.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 5000)
    cache = tokens.UnitCache(len)
    for i in range(500):
        assert cache[f"u{i}"] == len(f" u{i}") and cache["x" * 300] == 301
        assert (len(cache) + len(cache.aside)) * tokens._ENTRY <= 5000 + tokens._ENTRY and "x" * 300 not in cache


def test_long_words_and_whole_texts_equal_the_library():
    import public_tokenizers

    from labelwise.llm import tokens

    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", "a", "ab" * 5000, "x " * 3000, "one\n\ntwo 'll it's", "中文 and plain", "é" * 3000 + " b", "tail <|endoftext|> x"):
        assert enc.ids(text).tolist() == enc.whole(text)
