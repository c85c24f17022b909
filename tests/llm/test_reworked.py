"""Faults once found in the earlier operators, and what they do now."""

import json
import math
import os
import random
import subprocess
import sys
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwise.llm import decontam, langid, licenses, lm, toolcalls, warc
from labelwise.llm.common import id_remainder, written

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# --- language model ----------------------------------------------------------------


def lm_docs(spark, n=240):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "unheard of words only"), (5, rows[5][1]), (None, "w1 w2"), (n + 3, "L" * 300)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def scores(df):
    held = id_remainder("doc_id", 7) == 2
    return {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score_texts(df, held).collect()}


def test_lm_score_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEARNER_TOKENS", 1500)
    monkeypatch.setattr(lm.train, "__defaults__", (*lm.train.__defaults__[:-1], 1500))
    df = lm_docs(spark)
    one, eight = scores(df.coalesce(1)), scores(df.repartition(8))
    assert one.keys() == eight.keys()
    assert max(abs(one[k] - eight[k]) for k in one) < 1e-6


def test_lm_score_is_the_sum_of_normalised_probabilities(spark):
    df, held = lm_docs(spark), id_remainder("doc_id", 7) == 2
    counts = written(lm.count_words(df.filter(~held), "text"), "t")
    lex = lm.lexicon(counts, words=20)
    model = lm.train(written(lm.encode(df, "doc_id", "text", held, lex), "t"), lex)
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    own = lex.classes - lm.BUCKETS
    original = lm.own_words
    lm.own_words = lambda types: 20
    try:
        got = lm.score_texts(df, held).collect()
    finally:
        lm.own_words = original
    text = {(r["doc_id"], r["text"]): r for r in df.collect()}
    by_id = {i: t for i, t in text}
    classes = np.arange(lex.classes)
    checked = 0
    for r in got:
        words = [*lm.lm_words((by_id[r["doc_id"]] or "").encode()), lm.END]
        total, one, two = 0.0, lex.classes, lex.classes
        for w in words:
            place = lex.head.get(w)
            k = int(lex.head_class[place]) if place is not None else own + lm.bucket_of(w)
            q = model.R[one].astype(float) @ model.P[0] + model.R[two].astype(float) @ model.P[1]
            logits = model.Q[classes].astype(float) @ q + model.b
            total += (logits[k] - logits.max() - math.log(np.exp(logits - logits.max()).sum())) / math.log(10)
            if k >= own:  # a word of the tail has its add-one share there
                total += math.log10((c.get(w, 0) + 1) / lex.tail_total[k - own])
            one, two = k, one
        assert abs(total - r["score"]) < 1e-3 * max(1, len(words))
        checked += 1
    assert checked == df.count()


def test_lm_words_grow_with_the_lexicon_under_a_bound():
    assert lm.own_words(0) == lm.WORDS < lm.own_words(10**6) < lm.own_words(10**9) == lm.MOST_WORDS
    assert lm.MOST_WORDS + lm.BUCKETS < 1 << 16


def test_operators_run_where_the_package_is_not_installed():
    """Started elsewhere and without a search path for the workers."""
    code = f"""
import sys; sys.path.insert(0, {REPO!r})
from labelwise.session import local_session
spark = local_session(2, 4)
import __spark_entry__ as E
for name in ("op2_lm_scoring", "op8_benchmark_decontamination", "op7_language_id", "encode_vocabulary"):
    print(name, E.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as away:
        done = subprocess.run([sys.executable, "-c", code], cwd=away, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "op2_lm_scoring 200" in done.stdout


# --- tool calls --------------------------------------------------------------------


RULE = {"t": {"properties": {"a": {"minimum": 1, "min_length": 2, "choices": ["xx", 1]}}, "additional": True}}


@pytest.mark.parametrize(
    "arguments,errors",
    [
        ('{"a":"\\ud800"}', ["arguments: not Unicode"]),
        ('{"b":1e400}', ["arguments: number out of range"]),
        ('{"b":1,"b":2}', ["arguments: repeated name"]),
        ('{"c":{"b":1,"b":2}}', ["arguments: repeated name"]),
        ('{"b":NaN}', ["arguments: not JSON"]),
        ("[" * 100_000, ["arguments: not JSON"]),
        ('{"b":' + "9" * 5000 + "}", ["arguments: not JSON"]),
        ("[1]", ["arguments: not an object"]),
        ('{"a":"xx"}', ["a: not a number"]),
        ('{"a":1}', ["a: without a length"]),
        ('{"a":true}', ["a: not a number", "a: without a length", "a: not a choice"]),
        ('{"a":null}', ["a: not a number", "a: without a length", "a: not a choice"]),
        ('{"a":{"k":[]}}', ["a: not a number", "a: too short", "a: not a choice"]),
        ('{"a":0}', ["a: too small", "a: without a length", "a: not a choice"]),
    ],
)
def test_no_argument_makes_a_call_fail(arguments, errors):
    got, text = toolcalls.message(RULE, "i", "t", arguments, None, "answered", None)
    assert got == errors
    assert json.loads(text)["errors"] == errors and text.encode()


def test_schemas_are_checked_at_once(spark):
    for bad in ({"type": "text"}, {"minimun": 1}):
        with pytest.raises(ValueError):
            toolcalls.check_schemas({"t": {"properties": {"a": bad}}})


def test_other_turns_have_a_row(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "tool", "x"), (1, 3, None, None)], "conv_id long, turn long, role string, text string"
    )
    calls, results = toolcalls.calls_of_turns(turns)
    out = {r["position"]: r for r in toolcalls.link_calls(calls, results, toolcalls.TURN_SCHEMAS, toolcalls.other_turns(turns)).collect()}
    assert {p: r["status"] for p, r in out.items()} == {0: "answered", 2: "other_turn", 3: "other_turn"}
    assert json.loads(out[2]["json"]) == {"content": "x", "id": "1:2", "role": "tool", "status": "other_turn"}
    assert json.loads(out[3]["json"])["role"] is None and out[3]["name"] is None


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n, names = 200, []
    original = toolcalls.written
    monkeypatch.setattr(toolcalls, "written", lambda df, name: names.append(name) or original(df, name))
    calls = spark.createDataFrame(
        [("g", f"c{i}", i, "t", None, [f"c{i + 1}"] if i + 1 < n else []) for i in range(n)],
        "grp string, call_id string, position long, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([], "grp string, call_id string, position long, content string")
    out = toolcalls.link_calls(calls, results, {"t": {}}).collect()
    order = sorted(out, key=lambda r: (r["order_major"], r["order_minor"], r["position"]))
    assert [r["call_id"] for r in order] == [f"c{i}" for i in reversed(range(n))]
    assert len(names) < 45  # a few for each doubling, not one for each call


# --- WARC --------------------------------------------------------------------------


def pages_frame(spark, n=60):
    rng = random.Random(1)
    return spark.createDataFrame([(i, f"u{i}", rng.randbytes(rng.randrange(3000)).hex()) for i in range(n)], "page_id long, url string, html string")


def test_ranges_are_read_by_many_tasks(spark):
    from labelwise.session import scratch_path

    made = warc.write_archives(pages_frame(spark).coalesce(2), scratch_path(spark, "w"))
    cut = written(warc.ranges(made, 1000).select("path", "length", "start", "end"), "r")
    n = cut.count()
    assert n > 40
    spread = warc.dealt(cut)
    assert spread.rdd.getNumPartitions() >= n // warc.RANGES_PER_TASK
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= n // warc.RANGES_PER_TASK // 2 and max(sizes) <= 4 * warc.RANGES_PER_TASK
    assert warc.read_archives(made, 1000).count() == 60


def test_damaged_and_short_archives_are_reported(spark):
    from labelwise.session import local_path, scratch_path

    made = warc.write_archives(pages_frame(spark).coalesce(1), scratch_path(spark, "w"))
    row = made.collect()[0]
    path = local_path(row["path"])
    with open(path, "rb") as f:
        data = f.read()
    starts = [r.start for r in warc.read_range(open(path, "rb"), len(data), 0, len(data))]
    for damage in (data[:-40], data[: starts[30] + 900] + b"\x00" * 40 + data[starts[30] + 940 :], data[: starts[30]] + b"\x00" * 16 + data[starts[30] + 16 :]):
        with open(path, "wb") as f:
            f.write(damage)
        with pytest.raises(Exception, match="damaged or cut off|of 60 records"):
            warc.read_archives(made).collect()
        assert 50 < warc.read_archives(made, strict=False).count() < 60


# --- language ID -------------------------------------------------------------------


def test_seventy_languages_are_told_apart(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{g:02}": ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(40)] for g in range(70)}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(30)), g) for i, g in enumerate(list(words) * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    held = id_remainder("doc_id", 3) == 1
    model = langid.fit_languages(df, ~held)
    assert len(model.languages) == 70 and len(model.marks) <= langid.MOST_LANDMARKS
    out, lang, _ = langid.identify(df.filter(held), model)
    right = Counter()
    for r in out.collect():
        right[r["lang"], r[lang] == r["lang"]] += 1
    last = [f"l{g:02}" for g in range(64, 70)]
    assert sum(n for (_, good), n in right.items() if good) >= 0.97 * sum(right.values())
    assert sum(right[g, True] for g in last) >= 0.95 * sum(right[g, True] + right[g, False] for g in last)


def test_many_labels_do_not_raise(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    rng = random.Random(3)
    rows = [(i, "the dog and the fox " * 3, "en") for i in range(9)] + [(20 + i, "der hund und der fuchs " * 3, "de") for i in range(8)]
    rows += [(50 + i, f"noise {rng.random()}", f"dirty{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(df, F.lit(True))
    assert model.languages == ("de", "en")


# --- decontamination ---------------------------------------------------------------


def test_shards_find_and_score_as_one_index_does(spark):
    rng = random.Random(5)
    vocab = [f"v{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(12, 90))) for _ in range(40)]
    items = spark.createDataFrame([*enumerate(texts), (50, texts[1]), (51, None), (None, texts[2])], "item_id long, text string")
    rows = []
    for i in range(60):
        t = " ".join(rng.choice(vocab) for _ in range(200))
        if i % 2:
            words = rng.choice(texts).split()
            words[rng.randrange(len(words))] = "changed"
            t += " " + " ".join(words)
        rows.append((i, t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r["doc_id"], r["item_id"] is None, r["item_id"] or 0)
    one = sorted(decontam.leaks(docs, items).collect(), key=key)
    many = sorted(decontam.leaks(docs, items, limit=900).collect(), key=key)
    assert len(decontam.build_indexes(items, limit=900)) > 5 and len(one) >= 25
    assert [tuple(r)[:2] for r in one] == [tuple(r)[:2] for r in many]
    assert all(abs(a["score"] - b["score"]) < 1e-12 and a["question_overlap"] == b["question_overlap"] for a, b in zip(one, many, strict=True))
    kept = lambda limit: sorted(r[0] for r in decontam.without_leaks(docs, items, limit=limit).collect())
    assert kept(900) == kept(decontam.INDEX_BYTES) == sorted(set(range(60)) - {r["doc_id"] for r in one})


# --- licenses ----------------------------------------------------------------------


def sure(text):
    return sorted((k, n) for k, n, _, _, good in licenses.Scanner().text(text.encode()) if good)


@pytest.mark.parametrize(
    "text,names",
    [
        ("This software is NOT released under the MIT License.", []),
        ("It is no longer licensed under CC BY 4.0.", []),
        ("Never released under the MIT License", []),
        ("This is not\nreleased under the MIT License.", []),
        ("Released, but not under the MIT License.", []),
        ("It does not matter. Released under the MIT License.", ["MIT"]),
        ("No warranty\nReleased under the MIT License.", ["MIT"]),
        ("Not for sale; licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("SPDX-License-Identifier: BSD-2-Clause", ["BSD-2-Clause"]),
    ],
)
def test_denied_notices_are_not_confirmed(text, names):
    assert [n for _, n in sure(text)] == names


def test_bsd_texts_are_told_apart_by_their_conditions():
    first = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.

2. Redistributions in binary form must reproduce the above copyright notice.
"""
    third = """
3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software.
"""
    assert sure(first) == [(0, "BSD-2-Clause")] and sure(first + third) == [(0, "BSD-3-Clause")]
    assert sure(first + "\n" + first + third) == [(0, "BSD-2-Clause"), (first.count("\n") + 1, "BSD-3-Clause")]
    assert sure(licenses.TEMPLATES["BSD-3-Clause"]) == [(0, "BSD-3-Clause")]


def test_no_confirmed_notice_is_lost_by_its_rank():
    """The wordings that compression hands to the exact check hold all that an
    exact check of every wording confirms."""
    rng = random.Random(9)
    scanner = licenses.Scanner()
    filler = "license licensed under the work general public version terms of this released copyright notice any use software".split()
    for w in scanner.wordings:
        for _ in range(12):
            words = w.text.decode().split()
            for _ in range(rng.randrange(w.allowed + 1)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(filler))
            around = [" ".join(rng.choice(filler + [f"x{rng.randrange(500)}"]) for _ in range(rng.choice([0, 5, 60, 400]))) for _ in range(2)]
            text = f"{around[0]} {' '.join(words)} {around[1]}".encode()
            have = Counter(licenses.wording(text.decode()))
            ranked = scanner.ranked(text, have)
            for other in scanner.wordings:
                if any(True for _ in other.places(licenses.wording(text.decode()), have)):
                    assert other in ranked, (other.text, text[:300])


def test_ranks_follow_the_reductions():
    scanner = licenses.Scanner()
    text = b"Licensed under the Apache License, Version 2.0. Released under the MIT License."
    have = Counter(licenses.wording(text.decode()))
    ranked = scanner.ranked(text, have)
    gains = [scanner.reduction(text, w.text) for w in ranked]
    assert gains == sorted(gains, reverse=True) and {w.license for w in ranked} >= {"MIT", "Apache-2.0"}
    assert all(g > 0 for g in gains)


# --- quality rules -----------------------------------------------------------------


def test_counts_are_decided_on_as_whole_rows_are(spark):
    from labelwise.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    names = ("n_words", "n_repeat_words", "base_failed", "kept")
    show = lambda out, n: sorted(tuple(r) for r in out.select("doc_id", *[n[x] for x in names]).collect())
    once = quality.judge_counts(docs)
    assert "text" not in once[0].columns and show(*once) == show(*quality.judge(docs))
