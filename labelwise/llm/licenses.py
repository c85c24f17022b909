"""License scan by conditional compression.

The candidate blocks are overlapping windows (``REACHES``) around the words
that name licensing, in paragraphs (neighbouring lines with a word or sign).
Each is compressed with zstandard alone, and with every wording as raw
dictionary: the short notices, the standard headers and telling passages of the
full texts.  The wordings that shrink a window, ranked by how much, go to the
exact check, all of them: a wording is confirmed where its words are found,
across line ends too, with at most so many insertions or deletions as its
length allows (``DIFFERENCES``, or a tenth of its words), never in a word that
tells licenses apart (versions and variant names), and not where the sentence
denies it ("is not released under ...").  A notice of at most that many changed
words always shrinks its window, so none is lost by the ranking.  SPDX tags are
read as they stand.  Every license confirmed on a line gives a row.

A line that names licensing and has no part in a confirmed notice is given
with the short notice that shrinks it most, unconfirmed.

Scale: one pass over whole texts, no shuffle; lines without a trigger word
cost one search.  A wording is tried only where the paragraph has its words
but for the allowed number.  Templates are a bounded parameter.

Defined results: null and empty texts give no row; ``line_no`` is the line on
which a notice begins; a license confirmed more than once on a line gives one
row there, repeated lines and rows theirs; of the wordings of a license that
begin on a line the one with fewest differences counts, then the one that
shrinks its lines most (``reduction`` of a confirmed notice can be 0 or less);
an SPDX expression gives a row per license it names, unknown ones none.  The
sentence that all BSD texts share stands for BSD-3-Clause, but where the
conditions follow it without a third one ("Neither the name ...") for
BSD-2-Clause.  Ties of unconfirmed lines go to the name first in order.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DIFFERENCES = 2
BLOCK = 4000
REACHES = (96, 640)
LEVEL = 3

# The usual short notices of public licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the {1} as published by "
    "the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
)
_GNU_ONLY = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the {1}, version {2}, as published by "
    "the Free Software Foundation."
)
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."


def _gnu(name: str, version: str, dated: str) -> list[str]:
    return [f.format("This program", name, version) for f in (_GNU, _GNU_ONLY)] + [f"{name} Version {version}, {dated}"]


# Standard headers, and passages that only the full text has.
LONG = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": ["Apache License Version 2.0, January 2004"],
    "GPL-2.0": _gnu("GNU General Public License", "2", "June 1991"),
    "GPL-3.0": _gnu("GNU General Public License", "3", "29 June 2007"),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "3", "29 June 2007"),
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3", "19 November 2007"),
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0 1. Definitions",
    ],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal"],
    "CC-BY-4.0": [_CC.format("Attribution")],
    "CC-BY-SA-4.0": [_CC.format("Attribution-ShareAlike")],
    "CC-BY-NC-4.0": [_CC.format("Attribution-NonCommercial")],
    "CC-BY-ND-4.0": [_CC.format("Attribution-NoDerivatives")],
    "CC-BY-NC-SA-4.0": [_CC.format("Attribution-NonCommercial-ShareAlike")],
}
SPDX = re.compile(rb"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]*)")
TRIGGER = re.compile(rb"(?i)licen[sc]e|rights reserved|public domain|redistribut|copyright|creative commons")
# words that may never differ: they tell one license from another
_TELLING = re.compile(
    r"[0-9.]*[0-9][0-9.]*|mit|apache|gnu|general|lesser|affero|mozilla|bsd|cc|cc0|by|nc|sa|nd|domain|reserved"
    r"|attribution|noncommercial|commercial|sharealike|share|alike|noderivatives|noderivs|derivatives"
)
# what denies a notice, and what may stand between it and the notice
_DENIES = frozenset("not no never neither nor cannot without isn aren wasn weren".split())
_BETWEEN = frozenset(
    "longer yet currently t is are be been being was it this available distributed released licensed covered under by the a any".split()
)
_SENTENCE_ENDS = re.compile(r"[.!?;:]|\n[\s#*/%-]*[A-Z]")
_BSD_CONDITIONS = re.compile(rb"(?i)permitted\W+provided\W+that\W+the\W+following\W+conditions")
_BSD_THIRD = re.compile(rb"(?i)neither\W+the\W+names?")
_MARGIN = b" \t\r*#/;%-"  # what a blank line of a comment has
_WORD = re.compile(r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*")


def wording(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def differences(block: list[str], template: list[str]) -> tuple[int, int]:
    """Fewest word insertions and deletions that turn some stretch of the
    block into the template, and whether a telling word is among them."""
    heavy = 1000

    def cost(w: str) -> int:
        return heavy + 1 if _TELLING.fullmatch(w) else 1

    # edit distance with a free start and end in the block
    row = [0] * (len(block) + 1)
    for w in template:
        new = [row[0] + cost(w)]
        for j, b in enumerate(block):
            best = min(row[j + 1] + cost(w), new[j] + cost(b))
            if w == b:
                best = min(best, row[j])
            new.append(best)
        row = new
    least = min(row)
    return least % heavy, int(least >= heavy)


_HEAVY = 1000


def _cost(word: str) -> int:
    return _HEAVY + 1 if _TELLING.fullmatch(word) else 1


def _ends(block: np.ndarray, cost: np.ndarray, template: list[int], template_cost: list[int]) -> np.ndarray:
    """``differences`` for the stretches that end before each place of the
    block: telling ones count ``_HEAVY`` more."""
    ahead = np.concatenate([[0], np.cumsum(cost)])
    row = np.zeros(len(block) + 1, np.int64)
    for w, c in zip(template, template_cost, strict=True):
        new = row + c
        new[1:] = np.where(block == w, np.minimum(new[1:], row[:-1]), new[1:])
        row = np.minimum.accumulate(new - ahead) + ahead
    return row


class Wording:
    def __init__(self, license: str, text: str, allowed: int):
        self.license, self.text = license, text.encode()
        self.words = wording(text)
        self.allowed = max(allowed, len(self.words) // 10)
        self.need = Counter(self.words)
        self.telling = [w for w in self.need if _TELLING.fullmatch(w)]
        self.cost = [_cost(w) for w in self.words]

    def possible(self, have: Counter) -> bool:
        """May words with these counts hold the notice at all?"""
        if not self.words or any(have[w] < self.need[w] for w in self.telling):
            return False
        return sum(max(0, n - have[w]) for w, n in self.need.items()) <= self.allowed

    def denied(self, text: str, words: list[str], spans: list[tuple[int, int]], first: int, end: int) -> bool:
        """Does the sentence deny the notice in words ``first`` .. ``end``?"""
        here = Counter(words[first:end])
        if any(here[w] > self.need[w] for w in _DENIES & here.keys()):
            return True
        for k in range(first - 1, max(-1, first - 7), -1):
            if words[k] in _DENIES:
                return not _SENTENCE_ENDS.search(text, spans[k][1], spans[first][0])
            if words[k] not in _BETWEEN:
                return False
        return False

    def places(self, words: list[str], have: Counter) -> Iterator[tuple[int, int, int]]:
        """(first word, word after the last, differences) of each notice."""
        if not self.possible(have):
            return
        number = {w: i for i, w in enumerate(self.need)}
        block = np.array([number.get(w, -1) for w in words], np.int64)
        cost = np.array([_cost(w) for w in words], np.int64)
        template = [number[w] for w in self.words]
        row = _ends(block, cost, template, self.cost)
        good = np.flatnonzero(row <= self.allowed)
        # of ends near each other, the best is the notice's
        near = max(self.allowed, len(template) // 2)
        free = np.ones(len(row), bool)
        for end in good[np.argsort(row[good], kind="stable")].tolist():
            if not free[end]:
                continue
            free[max(0, end - near) : end + near + 1] = False
            low = max(0, end - len(template) - self.allowed)
            back = _ends(block[low:end][::-1], cost[low:end][::-1], template[::-1], self.cost[::-1])
            yield end - int(back.argmin()), end, int(row[end])


class Scanner:
    def __init__(self, templates: Mapping[str, str] = TEMPLATES, allowed: int = DIFFERENCES):
        import zstandard as zstd

        def compressor(text: bytes):
            known = zstd.ZstdCompressionDict(text, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            return zstd.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, dict_data=known)

        self.plain = zstd.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.names = sorted(templates)
        self.short = {n: Wording(n, templates[n], allowed) for n in self.names}
        self.wordings = [*self.short.values()]
        self.wordings += [Wording(n, t, allowed) for n in self.names if n in TEMPLATES for t in LONG.get(n, ())]
        self.spdx = {n.lower(): n for n in self.names if n in TEMPLATES and n != "all-rights-reserved"}
        if "BSD-3-Clause" in self.names:
            self.spdx["bsd-2-clause"] = "BSD-2-Clause"
        self.compressors = {t: compressor(t) for t in {w.text for w in self.wordings}}
        self.compressor = compressor

    def reduction(self, block: bytes, text: bytes) -> float:
        known = self.compressors.get(text) or self.compressor(text)
        return 1 - len(known.compress(block)) / len(self.plain.compress(block))

    def ranked(self, text: bytes, have: Counter) -> list[Wording]:
        """The wordings that shrink a window around a trigger word, the one
        that shrinks some window most first."""
        possible = [w for w in self.wordings if w.possible(have)]
        best: dict[int, float] = {}
        for window in windows(text) if possible else ():
            plain = len(self.plain.compress(window))
            for i, w in enumerate(possible):
                gain = 1 - len(self.compressors[w.text].compress(window)) / plain
                if gain > 0:
                    best[i] = max(best.get(i, 0.0), gain)
        return [possible[i] for i in sorted(best, key=lambda i: (-best[i], i))]

    def line(self, block: bytes) -> tuple[str, float, int, bool] | None:
        """The short notice that shrinks a block most, if any does: (name,
        size reduction, wording differences, unconfirmed)."""
        ranked = sorted((-self.reduction(block, w.text), n) for n, w in self.short.items())
        if not ranked or ranked[0][0] >= 0:
            return None
        gain, name = ranked[0]
        return name, -gain, differences(wording(block.decode("utf-8", "replace")), self.short[name].words)[0], False

    def notices(self, lines: list[bytes]) -> Iterator[tuple[int, int, str, float, int]]:
        """(first line, last line, license, size reduction, differences) of
        the confirmed notices of a paragraph, one per first line and license."""
        whole = b"\n".join(lines)
        text = whole.decode("utf-8", "replace")
        found_words = list(_WORD.finditer(whole.lower().decode("utf-8", "replace")))  # A-Z only: places stay
        words = [m.group() for m in found_words]
        spans = [m.span() for m in found_words]
        ends = [i for i, c in enumerate(text) if c == "\n"]
        line_of = [bisect_left(ends, a) for a, _ in spans]
        have = Counter(words)
        best: dict[tuple[int, str], tuple] = {}

        def add(first: int, last: int, name: str, text: bytes, block: bytes, n: int) -> None:
            gain = self.reduction(block, text)
            found = (first, last, name, gain, n)
            old = best.get((first, name))
            if old is None or (n, -gain) < (old[4], -old[3]):
                if old is not None:
                    found = (first, max(last, old[1]), name, gain, n)
                best[first, name] = found
            elif last > old[1]:
                best[first, name] = (first, last, *old[2:])

        for w in self.ranked(whole, have):
            for a, b, n in w.places(words, have):
                if w.denied(text, words, spans, a, b):
                    continue
                first, last = line_of[a], line_of[b - 1]
                block = b"\n".join(lines[first : last + 1])
                if len(block) > BLOCK:  # a long line: the notice itself
                    block = " ".join(words[a:b]).encode()
                add(first, last, w.license, w.text, block, n)
        for k, line in enumerate(lines):
            for m in SPDX.finditer(line):
                for ident in re.findall(rb"[A-Za-z0-9.+-]+", m.group(1)):
                    plain = re.sub(r"(-only|-or-later|\+)$", "", ident.decode().lower())
                    if plain in self.spdx:
                        add(k, k, self.spdx[plain], b"SPDX-License-Identifier: " + self.spdx[plain].encode(), m.group(0), 0)
        yield from sorted(best.values(), key=lambda x: x[:3])

    def text(self, text: bytes | None) -> Iterator[tuple[int, str, float, int, bool]]:
        if not text or not TRIGGER.search(text):
            return
        lines = text.split(b"\n")
        yield from _told_apart(self._rows(lines), lines)

    def _rows(self, lines: list[bytes]) -> Iterator[tuple[int, str, float, int, bool]]:
        start = 0
        while start < len(lines):
            stop = start
            while stop < len(lines) and lines[stop].strip(_MARGIN):
                stop += 1
            part = lines[start:stop]
            if any(TRIGGER.search(line) for line in part):
                out = []
                taken = set()
                for first, last, *found in self.notices(part):
                    out.append((start + first, *found, True))
                    taken.update(range(first, last + 1))
                for k, line in enumerate(part):
                    for block in _around(line):
                        # of a long line, the stretches without a notice are left
                        if k in taken and (len(line) <= BLOCK or any(self.notices([block]))):
                            continue
                        found = self.line(block)
                        if found:
                            out.append((start + k, *found))
                yield from sorted(out, key=lambda x: x[0])
            start = max(stop, start + 1)


def windows(text: bytes) -> Iterator[bytes]:
    """Overlapping stretches around the trigger words, narrow and wide ones;
    triggers near the middle of a stretch share it."""
    triggers = [(m.start(), m.end()) for m in TRIGGER.finditer(text)]
    for reach in REACHES:
        last = -reach
        for a, b in triggers:
            if a - last > reach // 2:
                yield text[max(0, a - reach) : b + reach]
                last = a
                if len(text) <= reach:
                    break


def _told_apart(rows: Iterable[tuple], lines: list[bytes]) -> Iterator[tuple]:
    """``rows`` with the BSD sentences named by the conditions after them."""
    rows = list(rows)
    starts = [r[0] for r in rows if r[1] == "BSD-3-Clause" and r[4]]
    for r in rows:
        if r[1] == "BSD-3-Clause" and r[4]:
            after = b"\n".join(lines[r[0] : min([x for x in starts if x > r[0]], default=len(lines))])
            if _BSD_CONDITIONS.search(after[:BLOCK]) and not _BSD_THIRD.search(after):
                r = (r[0], "BSD-2-Clause", *r[2:])
        yield r


def _around(line: bytes) -> Iterator[bytes]:
    """The line, or for very long lines the stretches around its trigger
    words (overlapping ones joined, cut at blanks)."""
    if len(line) <= BLOCK:
        if TRIGGER.search(line):
            yield line
        return
    start = end = -1
    for m in TRIGGER.finditer(line):
        a, b = max(0, m.start() - BLOCK // 8), min(len(line), m.end() + BLOCK // 8)
        if start >= 0 and a <= end and b - start <= BLOCK:
            end = b
            continue
        if start >= 0:
            yield line[start:end]
        start, end = a, b
    if start >= 0:
        yield line[start:end]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """``key, line_no, license, reduction, n_differences, confirmed``: one
    row per confirmed notice, and one per other candidate block that some short
    notice shrinks."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)]).add("line_no", "long").add(
        "license", "string"
    ).add("reduction", "double").add("n_differences", "integer").add("confirmed", "boolean")
    chosen = dict(templates)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        scanner = Scanner(chosen)
        for b in batches:
            hits = [(i, *h) for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist()) for h in scanner.text(t)]
            if hits:
                cols = list(zip(*hits, strict=True))
                ident = b.column(0).take(pa.array(cols[0], pa.int64())).cast(arrow.field(0).type)
                yield pa.RecordBatch.from_arrays(
                    [ident] + [pa.array(c, arrow.field(j + 1).type) for j, c in enumerate(cols[1:])], schema=arrow
                )

    return docs.select(key, text).mapInArrow(run, schema)
