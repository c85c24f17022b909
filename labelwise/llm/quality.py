"""Quality rules: weak supervision over rule votes.

Each rule looks at counts of one text and votes "clean" (+1), "junk" (-1) or
abstains (0).  Nothing is labelled: expectation-maximisation over the vote
patterns of all documents estimates the share of clean documents and, per
rule, how often its vote is right on clean and on junk documents.  The
posterior probability of "clean" then decides, instead of "all rules must
pass".

Scale: a vote pattern is one of 3^rules codes, so the corpus is reduced to
at most 19,683 counts (partial aggregation, no text is shuffled) and the
estimation runs on those counts.  Counting and deciding each read the text
once; no row is joined back.

Defined results: a null or empty text has no words, fails the base check and
has all counts 0; repeated rows are counted and judged one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, fresh_names, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

_SYMBOLS = b"#*$%&|<>"
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_CONT = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B))
_PUNCT = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_letters",
    "n_punct",
    "n_bare",
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows of ``window`` words that occur at least
    twice.  Windows are compared by a rolling 64-bit hash first and then by
    their words, so the count is exact."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    roll = np.zeros(n, np.uint64)
    for k in range(window):
        roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.sort(roll)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(roll, twice))
    seen: dict[tuple, int] = {}
    for i in at.tolist():
        w = tuple(words[i : i + window])
        seen[w] = seen.get(w, 0) + 1
    cover = np.zeros(len(words) + 1, np.int64)
    for i in at.tolist():
        if seen[tuple(words[i : i + window])] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text (UTF-8)."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else ([text] if words else [])
    size = len(text)
    ascii_letters = size - len(text.translate(None, _LETTERS))
    unpunctuated = text.translate(None, _PUNCT)
    wide = size - len(text.translate(None, bytes(range(0xC0, 0x100))))  # lead bytes of wider characters
    return (
        len(words),
        len(text.translate(None, _SPACE + _CONT)),
        size - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        size - len(text.translate(None, _UPPER)),
        ascii_letters + wide,
        size - len(unpunctuated),
        len(words) - len(unpunctuated.split()),
    )


def count_columns() -> callable:
    def work(batch: list) -> Sequence:
        return np.array([counts(t) for t in batch], np.int64).reshape(len(batch), len(COUNTS)).T

    return work


@dataclass(frozen=True)
class Rule:
    """A ratio of two counts: clean within [low, high], junk outside
    [junk_low, junk_high], else no vote; no vote below ``least`` of the
    denominator."""

    name: str
    over: str
    under: str
    low: float
    high: float
    junk_low: float
    junk_high: float
    least: int = 1

    def vote(self, col) -> Column:
        x = col(self.over) / F.greatest(col(self.under), F.lit(1))
        return (
            F.when(col(self.under) < self.least, F.lit(0))
            .when((x >= self.low) & (x <= self.high), F.lit(1))
            .when((x < self.junk_low) | (x > self.junk_high), F.lit(-1))
            .otherwise(F.lit(0))
        )


ONE = "one"
INF = float("inf")
RULES = (
    Rule("length", "n_words", ONE, 50, INF, MIN_WORDS, INF),
    Rule("word_length", "word_chars", "n_words", 3.0, 9.0, 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.02, 0.0, 0.2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.0, 0.0, 0.3, 3),
    Rule("repeated_words", "n_repeat_words", "n_words", 0.0, 0.05, 0.0, 0.2),
    Rule("capitals", "n_upper", "n_letters", 0.0, 0.15, 0.0, 0.5),
    Rule("punctuation", "n_punct", "word_chars", 0.0, 0.06, 0.0, 0.10),
    Rule("bare_symbols", "n_bare", "n_words", 0.0, 0.05, 0.0, 0.2),
    Rule("letters", "n_letters", "word_chars", 0.85, INF, 0.7, INF),
)


@dataclass(frozen=True)
class VoteModel:
    """Share of clean documents and, per rule, the chance that its vote is
    right on clean documents and on junk."""

    clean: float
    right_clean: tuple[float, ...]
    right_junk: tuple[float, ...]

    def log_odds(self, votes: Sequence[Column]) -> Column:
        out = F.lit(float(np.log(self.clean / (1 - self.clean))))
        for v, c, j in zip(votes, self.right_clean, self.right_junk, strict=True):
            out = out + F.when(v == 1, F.lit(float(np.log(c / (1 - j))))).when(
                v == -1, F.lit(float(np.log((1 - c) / j)))
            ).otherwise(F.lit(0.0))
        return out


def estimate(votes: np.ndarray, weight: np.ndarray, rounds: int = 200, tol: float = 1e-9) -> VoteModel:
    """Expectation-maximisation over vote patterns.

    ``votes``: patterns x rules in {-1, 0, 1}; ``weight``: documents with
    that pattern.  Abstentions carry no evidence.  The start says that rules
    are mostly right and most documents clean, which fixes which of the two
    classes is called clean; a weak Beta prior keeps every chance inside
    (0, 1).  No documents: the start itself.
    """
    rules = votes.shape[1]
    clean, right_clean, right_junk = 0.8, np.full(rules, 0.9), np.full(rules, 0.6)
    plus, minus = (votes == 1).astype(float), (votes == -1).astype(float)
    total = weight.sum()
    for _ in range(rounds if total else 0):
        lc = np.log(clean) + plus @ np.log(right_clean) + minus @ np.log1p(-right_clean)
        lj = np.log1p(-clean) + plus @ np.log1p(-right_junk) + minus @ np.log(right_junk)
        p = 1 / (1 + np.exp(np.clip(lj - lc, -500, 500)))
        a, b = weight * p, weight * (1 - p)
        new = np.clip((a.sum() + 8) / (total + 10), 1e-6, 1 - 1e-6)
        right_clean = (a @ plus + 9) / (a @ (plus + minus) + 10)
        right_junk = (b @ minus + 6) / (b @ (plus + minus) + 10)
        done = abs(new - clean) < tol
        clean = new
        if done:
            break
    return VoteModel(float(clean), tuple(map(float, right_clean)), tuple(map(float, right_junk)))


def _votes(names: dict[str, str], rules: Sequence[Rule]) -> list[Column]:
    def col(name: str) -> Column:
        return F.lit(1) if name == ONE else F.col(names[name])

    return [r.vote(col) for r in rules]


def fit_votes(counted: DataFrame, names: dict[str, str], rules: Sequence[Rule] = RULES) -> VoteModel:
    """The vote model of all rows: at most 3^rules pattern counts reach the driver."""
    code = F.lit(0)
    for v in _votes(names, rules):
        code = code * 3 + (v + 1)
    found = counted.select(code.alias("code")).groupBy("code").count().collect()
    votes = np.zeros((len(found), len(rules)), int)
    for i, row in enumerate(found):
        c = row["code"]
        for k in reversed(range(len(rules))):
            c, digit = divmod(c, 3)
            votes[i, k] = digit - 1
    return estimate(votes, np.array([r["count"] for r in found], float))


def _decided(
    counted: DataFrame, names: dict[str, str], model: VoteModel, rules: Sequence[Rule], least: float
) -> DataFrame:
    failed = (F.col(names["n_words"]) < MIN_WORDS) | (
        F.col(names["n_repeat_words"]) * 100 > F.col(names["n_words"]) * MAX_REPEAT_PERCENT
    )
    odds = model.log_odds(_votes(names, rules))
    out = counted.withColumn(names["base_failed"], failed).withColumn(
        names["clean_probability"], F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    )
    return out.withColumn(names["kept"], ~F.col(names["base_failed"]) & (F.col(names["clean_probability"]) >= least))


def _named(docs: DataFrame) -> tuple[dict[str, str], list[tuple[str, str]]]:
    extra = ("base_failed", "clean_probability", "kept")
    names = dict(zip((*COUNTS, *extra), fresh_names(docs, *COUNTS, *extra), strict=True))
    return names, [(names[c], "long") for c in COUNTS]


def judge(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, least: float = 0.5
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` plus its counts, ``base_failed``, ``clean_probability`` and
    ``kept``; also the (clash-free) names those columns got.

    ``kept``: the base check passes and the posterior is at least ``least``.
    The texts are counted twice, once to fit and once to decide, and never
    shuffled or written.
    """
    names, fields = _named(docs)
    model = fit_votes(append_columns(docs.select(text), count_columns, text, fields), names, rules)
    return _decided(append_columns(docs, count_columns, text, fields), names, model, rules, least), names


def judge_counts(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, least: float = 0.5
) -> tuple[DataFrame, dict[str, str]]:
    """``judge`` without the text: the texts are counted once, and the fit and
    the decisions read the written counts."""
    names, fields = _named(docs)
    counted = written(append_columns(docs, count_columns, text, fields).drop(text), "quality-counts")
    return _decided(counted, names, fit_votes(counted, names, rules), rules, least), names
