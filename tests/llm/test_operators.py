"""Operators against brute force on small tables: nulls, empty and very long
texts, ties and repeated rows, empty tables, extra clashing columns."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelwise.llm import decontam, langid, licenses, lm, packing, quality, simhash, tokens, toolcalls, warc

WORDS = "the of and river stone quiet morning little bright cloud under over walks sings early fields".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus():
    rng = random.Random(7)
    base = prose(rng, 300, [f"w{i}" for i in range(400)])
    near = base.replace(" w1", " q1", 1)
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "word"),
        (5, "two words"),
        (6, base),
        (7, base),
        (8, near),
        (8, near),
        (None, base),
        (9, prose(rng, 60) + ".\nsecond line\nsecond line\n"),
        (10, "x " * 30_000),
        (11, "Ünïcode çafé <|endoftext|> １２３ 　 wide  double space"),
        (12, "#* | " * 40),
        (13, prose(rng, 5000, [f"v{i}" for i in range(3000)])),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(i, t, "x", "y", 0) for i, t in corpus()], "doc_id long, text string, fp string, n_words string, score int"
    )


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def split_words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- quality rules -------------------------------------------------------------


def brute_counts(t):
    w = split_words(t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in (t or "").split("\n") if split_words(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in t or ""),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(hit),
    )


def test_quality_counts_and_decisions(docs):
    out, names = quality.judge(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = out.select("text", *[F.col(names[c]).alias(f"c_{c}") for c in (*quality.COUNTS[:5], "base_failed", "kept")]).collect()
    assert len(got) == len(corpus())
    for r in got:
        want = brute_counts(r["text"])
        assert tuple(r[1:6]) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["c_base_failed"] == failed
        assert not (failed and r["c_kept"])


def test_quality_em_separates_rules():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.85
    right = np.array([0.95, 0.9, 0.8, 0.97])
    votes = np.where(rng.random((4000, 4)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[rng.random((4000, 4)) < 0.2] = 0
    pattern, n = np.unique(votes, axis=0, return_counts=True)
    m = quality.estimate(pattern, n.astype(float))
    assert abs(m.clean - truth.mean()) < 0.03
    assert np.allclose(m.right_clean, right, atol=0.04)
    order = np.argsort(m.right_clean)
    assert order[0] == 2


def test_quality_empty(empty):
    out, names = quality.judge(empty)
    assert out.count() == 0
    assert quality.estimate(np.zeros((0, 3)), np.zeros(0)).clean == 0.8


# --- language model ------------------------------------------------------------


def test_lm_base_score_and_counts(spark, docs):
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    got = lm.score_texts(docs, held).collect()
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    toks = lambda t: [*(t or "").encode().lower().split(), b" "]
    c = Counter(w for i, t in corpus() if not out(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted(
        (
            (i or -1, out(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 5))
            for i, t in corpus()
        )
    )
    have = sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got)
    assert have == want
    assert all(r["score"] < 0 for r in got)


def test_lm_rare_and_long_words(spark):
    long = ["L" * 200 + "a", "L" * 200 + "b", "é" * 40]
    rows = [
        (1, " ".join(["common"] * 50 + long + ["once", "twice", "twice"])),
        (2, " ".join([long[0]] * 30 + ["common"])),
        (3, " ".join(["unseen"] * 9 + long + ["l" * 201] + ["once"] * 3)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    c = Counter(w for i, t in rows[:2] for w in [*t.encode().lower().split(), b" "])
    n, v = sum(c.values()), len(c)
    got = []
    for share in (10, lm.SHARE):
        found = lm.score_texts(df, F.col("doc_id") == 3, share=share).orderBy("doc_id").collect()
        for r, (_, t) in zip(found, rows, strict=True):
            words = [*t.encode().lower().split(), b" "]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(c[w] > 0 for w in words), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
        got.append(found)
    # the two tiers share one set of counts: tier one or two, the base score is the same
    assert [r["base_score"] for r in got[0]] == pytest.approx([r["base_score"] for r in got[1]])


def test_lm_probabilities_sum_to_one():
    size = np.array([50, 20, 10, 5, 1, 0])
    m = lm.LogBilinear.start(size, 4)
    nce = lm.NoiseContrast(m, size, 1)
    for _ in range(200):
        nce.learn([np.array([0, 1, 0, 1, 2, 3, 0, 1] * 50, "<u2")])
    n = len(size)
    for one, two in ((0, 1), (6, 6), (3, 2)):
        p = np.exp(m.log_probabilities(np.full(n, one), np.full(n, two), np.arange(n)))
        assert abs(p.sum() - 1) < 1e-5
    # after (1, 0) always comes 1
    assert m.log_probabilities(np.array([0]), np.array([1]), np.array([1]))[0] > np.log(0.4)


def test_lm_noise_samples_of_a_step():
    drawn = []
    size = np.array([50, 30, 20, 5, 1])
    nce = lm.NoiseContrast(lm.LogBilinear.start(size, 4), size, 1)
    nce.rng = type("Counted", (), {"random": lambda self, n: drawn.append(n) or np.linspace(0, 0.99, n)})()
    token = np.zeros(100, np.int64)
    nce.step(token, token, token)
    assert drawn == [64]


def test_lm_no_training_rows(docs, empty):
    assert lm.score_texts(empty, F.lit(False)).count() == 0
    rows = lm.score_texts(docs, F.lit(True)).collect()
    assert len(rows) == len(corpus())
    assert {r["train_tokens"] for r in rows} == {0} and {r["n_known"] for r in rows} == {0}


# --- tool calls ----------------------------------------------------------------

CALL = "grp long, call_id string, position long, name string, arguments string, depends_on array<string>"
RESULT = "grp long, call_id string, position long, content string"
SCHEMA = {"f": {"properties": {"x": {"type": "integer", "minimum": 0}}, "required": ["x"]}}


def test_toolcalls_links_orders_and_checks(spark):
    calls = [
        (1, "a", 0, "f", '{"x": 1}', []),
        (1, "b", 1, "f", '{"x": -1, "y": 2}', ["c"]),  # waits for a later call
        (1, "c", 5, "f", "{bad", ["a"]),
        (1, "d", 2, "f", None, ["b"]),
        (1, "a", 7, "f", '{"x": 9}', []),
        (1, None, 8, "g", '{"é": "ü"}', None),
        (2, "p", 0, "f", '{"x": 0}', ["q"]),
        (2, "q", 1, "f", '{"x": 0}', ["p"]),
        (2, "r", 2, "f", '{"x": 0}', ["q", "missing"]),
        (None, "a", 0, "f", '{"x": 3}', []),
    ]
    results = [(1, "a", 1, "ok"), (1, "a", 2, "again"), (1, "z", 3, "lost"), (1, "c", 4, "early"), (None, "a", 1, None), (1, None, 9, "n")]
    out = toolcalls.link_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), SCHEMA).collect()
    assert len(out) == 10 + 3  # two orphans, one repeated result
    by = {(r["grp"], r["call_id"], r["status"]): r for r in out}
    assert by[1, "a", "answered"]["json"] == (
        '{"arguments":{"x":1},"content":"ok","depends_on":[],"errors":[],"id":"a","name":"f","role":"call","status":"answered"}'
    )
    assert by[1, "b", "unanswered"]["errors"] == "x: too small; y: unknown"
    assert by[1, "c", "early_result"]["errors"] == "arguments: not JSON"
    assert by[1, "d", "unanswered"]["errors"] == "x: missing"
    assert by[1, None, "unanswered"]["errors"] == "name: no schema" and '"é":"ü"' in by[1, None, "unanswered"]["json"]
    for k in ((1, "a", "duplicate_call"), (1, "a", "duplicate_result"), (1, "z", "orphan_result"), (1, None, "orphan_result"), (None, "a", "answered")):
        assert k in by, k
    assert (2, "p", "cyclic") in by and (2, "q", "cyclic") in by
    assert by[2, "r", "unanswered"]["order_major"] == 2  # after the cycle, in its own place
    order = sorted((r for r in out if r["grp"] == 1 and r["call_id"] in ("a", "b", "c", "d") and r["status"] in ("answered", "early_result", "unanswered")), key=lambda r: (r["order_major"], r["order_minor"], r["position"]))
    assert [r["call_id"] for r in order] == ["a", "c", "b", "d"]


def test_toolcalls_random_orders_are_topological(spark):
    rng = random.Random(5)
    rows, deps = [], {}
    for g in range(30):
        n = rng.randint(1, 12)
        rank = list(range(n))
        rng.shuffle(rank)
        for i in range(n):
            deps[g, str(i)] = [str(j) for j in range(n) if rank[j] < rank[i] and rng.random() < 0.3]
            rows.append((g, str(i), i, "f", '{"x":1}', deps[g, str(i)]))
    out = toolcalls.link_calls(spark.createDataFrame(rows, CALL), spark.createDataFrame([], RESULT), SCHEMA).collect()
    at = {(r["grp"], r["call_id"]): (r["order_major"], r["order_minor"], r["position"]) for r in out}
    assert len(at) == len(rows) and {r["status"] for r in out} == {"unanswered"}
    assert all(at[g, d] < at[g, i] for (g, i), ds in deps.items() for d in ds)


def test_toolcalls_empty(spark):
    none = spark.createDataFrame([], CALL), spark.createDataFrame([], RESULT)
    assert toolcalls.link_calls(*none, SCHEMA).count() == 0


# --- tokens and packing ----------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_equal_library(docs, library):
    got = tokens.token_counts(docs.select("doc_id", "text", "fp"), size=8).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == sorted(
        (i or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in corpus()
    )


def test_unit_encoder_on_odd_texts(library):
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.id_bytes(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(11)
    alphabet = list("ab' .,!\n\t 　éß中9²́\x1c\x85😀") + ["'s", "'ll", " the", "<|endoftext|>", "   "]
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == want, t
    assert enc.fast is not None


def test_packing(docs, library):
    got = packing.pack(docs).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["piece"]].append((r["start"], r["length"], r["ids_crc32"]))
    want = defaultdict(list)
    for i, t in corpus():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        start, stop, k = 0, len(ids) % 1024 or 1024, 0
        while start < len(ids):
            want[i, k].append((start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
            start, stop, k = stop, stop + 1024, k + 1
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(seqs) <= math.ceil(total / 1024) + 1


def test_packing_plan_is_complete_and_tight():
    rng = random.Random(2)
    for _ in range(30):
        cap = rng.choice([10, 50, 200])
        counts = {rng.randint(1, cap): rng.randint(1, 400) for _ in range(rng.randint(1, 30))}
        groups = packing.plan(counts, cap)
        used = Counter()
        for lengths, times in groups:
            assert sum(lengths) <= cap and times > 0
            for x in lengths:
                used[x] += times
        assert used == Counter(counts)
        lower = math.ceil(sum(k * n for k, n in counts.items()) / cap)
        over_half = sum(n for k, n in counts.items() if 2 * k > cap)
        assert sum(t for _, t in groups) <= 1.35 * max(lower, over_half) + 2
    left = np.zeros(11, np.int64)
    left[[1, 2, 4]] = 1
    assert packing.exact_combination(7, left) == (4, 2, 1)
    assert packing.exact_combination(8, left) is None


def test_tokens_and_packing_empty(empty):
    assert tokens.token_counts(empty).count() == 0
    assert packing.pack(empty).count() == 0


# --- WARC ------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, other = "é" * 600, "<p>" + "x" * 2000
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, big), (7, big), (6, big), (8, other), (9, other + "!"), (None, big), (7, big), (10, "\x1f\x8b\x08 WARC/1.1\r\n" + "z" * 1500)]
    pages = spark.createDataFrame([(i, f"http://e.org/{i}\r\nX", t, "d", "r") for i, t in rows], "page_id long, url string, html string, digest string, refers_to string").repartition(3)
    want = []
    for i, t in rows:
        b = (t or "").encode()
        same = [j for j, u in rows if (u or "").encode() == b and j is not None]
        top = max(same) if len(b) >= 1000 and same else None
        revisit = top is not None and i != top
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for step in (64, 1000, warc.RANGE_BYTES):
        got = [tuple(r) for r in warc.round_trip(pages, step=step).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_warc_reader_owns_each_record_once_and_skips_damage():
    import io

    rng = random.Random(3)
    records = []
    for i in range(20):
        payload = rng.randbytes(rng.randint(0, 3000)) + (warc.MAGIC * 5 if i % 3 == 0 else b"")
        records.append(warc.gzip_member(warc.record(i, None, payload, hashlib.sha1(payload).hexdigest(), None)))
    records[5] = records[5][:20] + b"\x00" * 12 + records[5][32:]
    data = b"".join(records)
    for step in (1, 7, 500, 10**6) if len(data) < 10**5 else (500, 10**6):
        found = []
        for at in range(0, len(data), step):
            found += [warc._page_id(r.header[b"warc-record-id"]) for r in warc.read_range(io.BytesIO(data), len(data), at, min(at + step, len(data)))]
        assert found == [i for i in range(20) if i != 5]


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- language ID -------------------------------------------------------------------

LANGS = {
    "en": "the quick brown fox jumps over the lazy dog with thought and this that there where".split(),
    "de": "der schnelle braune fuchs springt über den faulen hund und nicht gewöhnlich straße".split(),
    "fr": "le renard brun rapide saute par-dessus le chien paresseux où était déjà leçon".split(),
}


def test_language_id(spark, empty):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(5, 80), LANGS[g]).upper() if i % 5 == 0 else prose(rng, rng.randint(5, 80), LANGS[g]), g, "s", 1.5) for i, g in enumerate(["en", "de", "fr"] * 60)]
    odd = [(1000, None, "en", "s", 0.0), (1001, "", "en", "s", 0.0), (1002, "123 !!", "de", "s", 0.0), (1003, "the dog" * 60_000, None, "s", 0.0), (None, "der hund", None, "s", 0.0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string, score double")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    model = langid.fit_languages(df, ~held)
    assert model.languages == ("de", "en", "fr")
    out, lang, score = langid.identify(df, model)
    got = {r["doc_id"]: (r[lang], r[score]) for r in out.collect()}
    right = [got[i][0] == g for i, _, g, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(right) > 30 and sum(right) / len(right) >= 0.97
    assert [got[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003][0] == "en" and got[None][0] == "de"
    assert all(0 <= s <= 1 for _, s in got.values())
    none = langid.fit_languages(empty, F.lit(True))
    assert {r[-2] for r in langid.identify(df, none)[0].collect()} == {"und"}


def test_language_fit_counts_repeated_rows_once(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, 20), "en") for k in range(5)] + [(9, "der die das und ist nicht " * 3, "de")]
    schema = "doc_id long, text string, lang string"
    extra = [(None, prose(rng, 30), "en"), (None, "noch ein Satz mit Worten", "de")]
    once = langid.fit_languages(spark.createDataFrame(rows + extra, schema), F.lit(True))
    often = langid.fit_languages(spark.createDataFrame(rows + extra * 300, schema).repartition(4), F.lit(True), sample=4000)
    assert once.languages == often.languages == ("de", "en")
    assert np.allclose(once.landmarks, often.landmarks) and np.allclose(once.weights, often.weights, atol=1e-4)


def test_kernel_equals_set_definition():
    a, b = "Straße am Fluß", "die Straßen"
    x = np.zeros((2, langid.DIMS), np.float32)
    langid.mark(a.encode(), x[0])
    langid.mark(b.encode(), x[1])

    def grams(t):
        import re

        f = re.sub(rb"[^a-zA-Z\x80-\xff]", b" ", t.encode()).lower()
        return {f[i : i + k] for k in (1, 2, 3) for i in range(len(f) - k + 1)}

    # hashing can only merge grams
    assert x[0].sum() <= len(grams(a)) and x[0].sum() >= 0.97 * len(grams(a))
    assert abs(x[0] @ x[1] - len(grams(a) & grams(b))) <= 2


# --- decontamination ----------------------------------------------------------------


def bm25(index_items, passage):
    """All normalised BM25 scores by definition."""
    bags = [Counter(w) for w in index_items]
    n, avg = len(bags), sum(map(len, index_items)) / len(index_items)
    df = Counter(t for b in bags for t in b)
    out = []
    for bag, w in zip(bags, index_items, strict=True):
        imp = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t, c in bag.items()}
        out.append(sum(v for t, v in imp.items() if t in passage) / sum(imp.values()))
    return out


def test_block_max_wand_retrieves_exactly():
    rng = random.Random(9)
    vocab = [f"t{i}".encode() for i in range(120)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(3, 40))] for _ in range(60)]
    index = decontam.Index([(i, b" ".join(w)) for i, w in enumerate(items)])
    words = []
    for _ in range(30):
        words += [rng.choice(vocab) for _ in range(rng.randint(0, 150))]
        words += rng.choice(items)
    ids = np.array([index.term.get(w, 0) for w in words])
    got = defaultdict(list)
    for at, found in index.passages(ids):  # one entry per block
        got[at] += found
    s = decontam.SEGMENT
    for at in range(0, max(len(words) - s, 1), s):
        score = bm25(items, set(words[at : at + 2 * s]))
        want = {k: v for k, v in enumerate(score) if v >= decontam.THRESHOLD}
        have = dict(got.get(at, []))
        assert have.keys() == want.keys()
        assert all(abs(have[k] - want[k]) < 1e-9 for k in want)


def test_leaks(spark, empty):
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(2000)]
    texts = [prose(rng, rng.randint(12, 200), vocab) for _ in range(25)]
    items = spark.createDataFrame([*enumerate(texts), (90, None), (91, ""), (92, texts[3])], "item_id long, text string")
    rows, want = [], set()
    for i in range(60):
        t = prose(rng, rng.randint(0, 400), vocab)
        if i % 3 == 0:
            k = rng.randrange(25)
            t = t + "\n" + texts[k].upper().replace(" ", ", ") + " " + prose(rng, 50, vocab)
            want |= {(i, k)} | ({(i, 92)} if k == 3 else set())
        rows.append((i, t, "x"))
    rows += [(100, None, "x"), (None, texts[0], "x"), (101, "", "x")]
    want |= {(None, 0)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaked string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()}
    assert got == want
    kept = decontam.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect() if r[0] is not None) == sorted(i for i, _, _ in rows if i is not None and i not in {a for a, _ in want})
    assert decontam.leaks(empty, items).count() == 0
    assert decontam.leaks(docs, items.limit(0)).count() == 0
    shards = decontam.build_indexes(items, limit=2000)
    assert len(shards) > 2 and sum(len(x.items) for x in shards) == 26


def test_question_and_answer_parts():
    q, a = decontam.question_answer(b"What is it? It is a stone.")
    assert q == [b"what", b"is", b"it"] and a == [b"it", b"is", b"a", b"stone"]
    q, a = decontam.question_answer(b"Name the river Answer: the Rhine")
    assert a == [b"answer", b"the", b"rhine"]
    q, a = decontam.question_answer(b" ".join(b"w%d" % i for i in range(30)))
    assert len(q) == 20 and len(a) == 10


def test_near_copies_of_short_items():
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(900)]
    fill = prose(rng, 80, vocab)
    fifteen = [f"z{i}" for i in range(15)]
    capital = b"Which town on the Seine is the capital of old Gallia? Answer: Paris"
    index = decontam.Index(
        [(0, capital), (1, " ".join(fifteen).encode()), (2, " ".join(f"s{i}" for i in range(7)).encode())]
        + [(10 + k, prose(rng, 40, vocab).encode()) for k in range(20)]
    )

    def found(text):
        return {hit[0] for hit in index.search(f"{fill} {text} {prose(rng, 300, vocab)}".encode())} & {0, 1, 2}

    question = "Which town on the Seine is the capital of old Gallia?"
    for answer in ("Answer: Paris", "A: Paris", "Paris"):
        assert found(f"{question} {answer}") == {0}
    assert found(f"{question} A: Lyon") == set()
    for k in range(15):  # any one word of the shortest form changed
        assert found(" ".join(w if i != k else "other" for i, w in enumerate(fifteen))) == {1}
    for k in range(7):
        assert found(" ".join(f"s{i}" if i != k else "other" for i in range(7))) == {2}
    assert found(" ".join(fifteen[:10])) == set()
    assert found(" ".join(reversed(fifteen))) == set()


# --- SimHash --------------------------------------------------------------------------


def brute_fp(t):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(fps):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_documents(docs, empty):
    rows = corpus()
    fps = [brute_fp(t) for _, t in rows]
    roots = brute_groups(fps)
    low = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    want = sorted((i or -1, format(f, "016x"), low.get(r)) for (i, _), f, r in zip(rows, fps, roots, strict=True))
    got = sorted((r[0] or -1, r[1], r[2]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == sorted(low.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("crowd", [simhash.CROWD, 0])
def test_simhash_links_by_brute_force(spark, crowd):
    rng = random.Random(8)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.randint(0, 12)):
            g = f
            for _ in range(rng.randint(1, 5)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
            f = g if rng.random() < 0.5 else f
    dense = rng.getrandbits(64)
    fps |= {dense ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12, 20)}
    # many strangers, and some near pairs, under one key
    shared = 0xBEEF | 0xA5 << 16
    for _ in range(60):
        f = rng.getrandbits(40) << 24 | shared
        fps |= {f, f ^ 1 << rng.randrange(24, 32) ^ 1 << rng.randrange(32, 48) ^ 1 << rng.randrange(48, 64)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s, 1 + k % 3) for k, s in enumerate(signed)], "fp long, n long")
    got = {r["fp"]: r["c"] for r in simhash.link(nodes, crowd).collect()}
    ours = defaultdict(set)
    for k, s in enumerate(signed):
        ours[got.get(s, s)].add(k)
    want = defaultdict(set)
    for k, r in enumerate(brute_groups(fps)):
        want[r].add(k)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, want.values()))


def test_star_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(500, k) for k in range(501, 560)]
    got = {r["v"]: r["c"] for r in simhash.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {v: find(v) for v in up}


# --- licenses ---------------------------------------------------------------------------


def test_license_scan(spark, empty):
    rows = [
        (1, "Intro\nLicensed under CC BY-NC 4.0.\nOutro"),
        (2, "LICENSED UNDER CC BY 4.0."),
        (3, "This work is licensed under the GNU Lesser General Public License, version 3."),
        (4, "Licensed under the Apache License, Version 2.0 (the new one)."),
        (5, "You need a driving licence to drive."),
        (6, "No such thing here."),
        (7, None),
        (8, ""),
        (9, "Released under the MIT License.\nReleased under the MIT License."),
        (9, "Released under the MIT License."),
        (10, "word " * 50_000 + "All rights reserved. " + "word " * 10),
        (11, "Licensed under the Apache License, Version 1.1."),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    out = licenses.scan(df).collect()
    sure = sorted((r["doc_id"], r["line_no"], r["license"]) for r in out if r["confirmed"])
    assert sure == [
        (1, 1, "CC-BY-NC-4.0"),
        (2, 0, "CC-BY-4.0"),
        (3, 0, "LGPL-3.0"),
        (4, 0, "Apache-2.0"),
        (9, 0, "MIT"),
        (9, 0, "MIT"),
        (9, 1, "MIT"),
        (10, 0, "all-rights-reserved"),
    ]
    assert all(r["reduction"] > 0 for r in out)
    assert licenses.scan(empty).count() == 0


def test_licenses_of_a_block_all_come_out():
    def sure(text):
        return sorted((k, n) for k, n, _, _, good in licenses.Scanner().text(text.encode()) if good)

    rng = random.Random(2)
    two = "Text under CC. Licensed under CC BY 4.0. Code: Released under the MIT License."
    assert sure(two) == [(0, "CC-BY-4.0"), (0, "MIT")]
    # one long text without line ends, notices far apart, template words around them
    many = WORDS + "license version public general work terms under licensed released source".split()
    notices = list(licenses.TEMPLATES.items())
    for _ in range(5):
        text = " ".join(prose(rng, 400, many) + ". " + t for _, t in notices)
        assert sure(text) == sorted((0, n) for n, _ in notices)
    assert sure("Intro\nLicensed under the Apache License,\nVersion 2.0\n\nend") == [(1, "Apache-2.0")]
    assert sure("Licensed under the Apache License,\n\nVersion 1.1") == []
    # a long line with a notice keeps the unconfirmed rows of its other stretches
    far = "Released under the MIT License. " + prose(rng, 3000) + " Licensed under the Apache License, Version 1.1. " + prose(rng, 900)
    got = [(n, good) for _, n, _, _, good in licenses.Scanner().text(far.encode())]
    assert got == [("MIT", True), ("Apache-2.0", False)]


def test_license_headers_full_texts_and_tags():
    def sure(text):
        return sorted((k, n) for k, n, _, _, good in licenses.Scanner().text(text.encode()) if good)

    mit = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
    assert sure(mit) == [(4, "MIT")]
    gnu = """ # This {} is free software; you can redistribute it and/or modify
 # it under the terms of the GNU {}General Public License as published by
 # the Free Software Foundation, either version {} of the License, or
 # (at your option) any later version."""
    assert sure(gnu.format("program", "", 3)) == [(0, "GPL-3.0")]
    assert sure(gnu.format("program", "", 2)) == [(0, "GPL-2.0")]
    assert sure(gnu.format("library", "Lesser ", 3)) == [(0, "LGPL-3.0")]
    assert sure(gnu.format("program", "Affero ", 3)) == [(0, "AGPL-3.0")]
    assert sure(gnu.format("library", "Lesser ", 2.1)) == []
    assert sure("x\n// SPDX-License-Identifier: (MIT OR Apache-2.0)\n") == [(1, "Apache-2.0"), (1, "MIT")]
    assert sure("SPDX-License-Identifier: GPL-2.0-or-later") == [(0, "GPL-2.0")]
    assert sure("SPDX-License-Identifier: MIT-0") == []
    cc = "This work is licensed under a Creative Commons\nAttribution{} 4.0 International License."
    assert sure(cc.format("-NonCommercial")) == [(0, "CC-BY-NC-4.0")]
    assert sure(cc.format("")) == [(0, "CC-BY-4.0")]


def test_wording_differences():
    w = licenses.wording
    t = w("Licensed under CC BY-NC 4.0.")
    assert licenses.differences(w("text Licensed under CC BY-NC 4.0 more"), t) == (0, 0)
    assert licenses.differences(w("Licensed under CC BY 4.0"), t)[1] == 1
    assert licenses.differences(w("Licensed under the CC BY-NC 4.0"), t) == (1, 0)
    assert json.loads(toolcalls.canonical({"b": 1, "a": "é"})) == {"a": "é", "b": 1}
