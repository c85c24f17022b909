"""Token counts by a map-side two-tier lookup.

A text is cut into pre-token units (a word with the space before it and its
punctuation) at every space that stands alone between two other characters
than white space.  The tokeniser never joins characters across such a cut, so
a text's tokens are its units' tokens in order.  Tier one is a broadcast hash
table from the ``TABLE`` most frequent units of the corpus to their token
counts; tier two is a cache of at most ``CACHE_BYTES`` in every task, which
encodes each missing unit once.  No unit is shuffled to be encoded.  A Python
worker builds the encoder once and keeps it from task to task.

The frequent units come from all documents: every task counts its own units
and reports those that make up more than 1 / ``SHARE`` of them, so what is
merged is bounded per task; the table only saves work and never changes a
count.

Texts that contain a special token's string are encoded whole by the tokeniser
itself.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated
rows are counted one by one; ids are passed through, null or not.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.workers import built_once
from .common import append_columns

TABLE = 1 << 16
SHARE = 50_000
CACHE_BYTES = 96 << 20
LIMIT = 1024
_LONG_UNIT = 200
_COUNTED = 1 << 20
_ENTRY = 170  # bytes of a cache entry besides the unit's text

# a space between two other characters than white space
_ALONE = re.compile(r"(?<=\S) (?=\S)")
# ASCII and Latin letters: white-space and letter classes of all engines agree here
_PLAIN = re.compile(r"[\n\x21-\x7e¡-ɏ]+")
_PLAIN_TEXT = re.compile(r"[ \n\x21-\x7e¡-ɏ]+")
# the rank encoder takes quadratic time over very long words
_LONG_WORD = 1000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def is_tidy(text: str) -> bool:
    """Plain Latin text in which every space stands alone."""
    if not text or text[0] in " \n" or text[-1] in " \n" or not _PLAIN_TEXT.fullmatch(text):
        return False
    return not ("  " in text or " \n" in text or "\n " in text)


def has_long_word(text: str) -> bool:
    """Some ``_LONG_WORD`` characters in a row without a blank, at a multiple of
    that place (so any word of twice that length)."""
    return any(
        text.find(" ", k, k + _LONG_WORD) < 0 and text.find("\n", k, k + _LONG_WORD) < 0
        for k in range(0, len(text) - _LONG_WORD + 1, _LONG_WORD)
    )


class Encoder:
    """Exact ids of one byte-level BPE file.

    ``whole`` is the file's own library.  ``unit`` encodes the short pieces
    between spaces with the same merges through the faster rank encoder
    where the two agree by construction (plain Latin text) and with the
    library elsewhere.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = None
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer"):
            import public_tokenizers

            letters = _byte_letters()
            ranks = {
                bytes(letters[ch] for ch in token): i
                for token, i in spec["model"]["vocab"].items()
                if token not in self.special
            }
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def unit(self, piece: str) -> list[int]:
        if self.fast is not None and _PLAIN.fullmatch(piece.lstrip(" ")) and not has_long_word(piece):
            return self.fast.encode_ordinary(piece)
        return self.whole(piece)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, as little-endian 32-bit integers: plain
        texts with lone spaces in one call of the rank encoder."""
        if self.fast is not None and not any(s in text for s in self.special):
            if is_tidy(text) and not has_long_word(text):
                return np.array(self.fast.encode_ordinary(text), "<u4")
            units = self.units(text)
            found = self.unit(units[0]) + [i for u in units[1:] for i in self.unit(" " + u)]
            return np.array(found, "<u4")
        return np.array(self.whole(text), "<u4")

    def units(self, text: str) -> list[str] | None:
        """The text cut at its lone spaces, which belong to what follows them
        and are left out; None if it has to be encoded whole."""
        if self.fast is None or any(s in text for s in self.special):
            return None
        return text.split(" ") if is_tidy(text) else _ALONE.split(text)


def _byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies use for each byte:
    printable Latin-1 characters stand for themselves, the other bytes, in
    order, for the characters from U+0100 on."""
    out, extra = {}, 0
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class UnitCache(dict):
    """Unit -> value, made on a miss.  When half of ``CACHE_BYTES`` is held, the
    units are set aside, and those asked for again come back; those set aside
    before go.  Long units are not kept."""

    def __init__(self, make: Callable[[str], object], first: dict | None = None):
        super().__init__()
        self.make, self.first, self.aside, self.held = make, first or {}, {}, 0

    def __missing__(self, unit: str):
        found = self.first.get(unit)
        if found is not None:
            return found
        value = self.aside.get(unit)
        if value is None:
            value = self.make(" " + unit)
        if len(unit) <= _LONG_UNIT:
            self.held += _ENTRY + 4 * len(unit)
            if 2 * self.held > CACHE_BYTES:
                self.aside = dict(self)
                self.clear()
                self.held = 0
            self[unit] = value
        return value


def worker_encoder(path: str) -> Encoder:
    """The encoder of a file, built once in a Python worker."""
    return built_once(f"encoder {path}", lambda: Encoder(path))


def frequent_units(docs: DataFrame, text: str = "text", size: int = TABLE, share: int = SHARE) -> list[str]:
    """The ``size`` most frequent units, from every task's own counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        total = 0
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    units = t.split(" ")[1:]
                    total += len(units)
                    if max(map(len, units), default=0) > _LONG_UNIT:
                        units = [u for u in units if len(u) <= _LONG_UNIT]
                    seen.update(units)
            if len(seen) > _COUNTED:  # keep memory bounded: forget what is rare so far
                seen = Counter({u: n for u, n in seen.items() if n > max(1, total // share)})
        kept = [(u, n) for u, n in seen.items() if n > max(1, total // share) and u]
        if kept:
            yield pa.RecordBatch.from_arrays(
                [pa.array([u for u, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())],
                names=["unit", "n"],
            )

    found = docs.select(text).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return [r["unit"] for r in found.orderBy(F.desc("n"), "unit").limit(size).collect()]


def token_counts(
    docs: DataFrame, text: str = "text", names: Sequence[str] = ("n_bytes", "n_tokens"), path: str | None = None, size: int = TABLE
) -> DataFrame:
    """``docs`` plus UTF-8 bytes and token count of each whole text."""
    path = path or default_tokenizer()
    units = frequent_units(docs, text, size)
    encoder = Encoder(path)
    table = {u: len(encoder.unit(" " + u)) for u in units if u and encoder.units(u) == [u]}
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make() -> Callable[[list], Sequence]:
        enc = worker_encoder(path)
        cache = UnitCache(lambda u: len(enc.unit(u)), shared.value)

        def count(t: bytes | None) -> int:
            if not t:
                return 0
            s = t.decode("utf-8")
            units = enc.units(s)
            if units is None:
                return len(enc.whole(s))
            return len(enc.unit(units[0])) + sum(map(cache.__getitem__, units[1:]))

        def work(batch: list) -> Sequence:
            return [len(t) if t else 0 for t in batch], [count(t) for t in batch]

        return work

    return append_columns(docs, make, text, [(names[0], "long"), (names[1], "long")])


def id_bytes(path: str) -> Callable[[bytes | None], bytes]:
    """A function from a text to its ids as little-endian 32-bit integers."""
    enc = worker_encoder(path)
    return lambda t: enc.ids(t.decode("utf-8")).tobytes() if t else b""
