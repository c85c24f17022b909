"""Objects that a Python worker builds once and keeps from task to task, and
the parts in which it works through a batch."""

from __future__ import annotations

import sys
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

# A worker keeps this many models or tokenisers; the least recently used goes.
KEPT = 4
# A worker holds what it makes of about this many characters at a time.
PART_CHARS = 1 << 18


def new_id() -> str:
    """A name for one scorer or tokeniser instance, made on the driver and
    shipped with its tasks: two instances never share what a worker built,
    whatever function made them."""
    return uuid.uuid4().hex


def built_once(ident: str, factory: Callable):
    kept = sys.__dict__.setdefault("_labelwise_built", OrderedDict())
    if ident in kept:
        kept.move_to_end(ident)
    else:
        kept[ident] = factory()
        while len(kept) > KEPT:
            kept.popitem(last=False)
    return kept[ident]


def text_parts(texts: Sequence, step: int = 1, most: int = PART_CHARS) -> Iterator[slice]:
    """Consecutive slices of ``texts``, each of whole steps of ``step`` texts
    (the last step may be shorter) and closed once it has ``most`` characters,
    so that a part's size depends neither on the batch nor on the table.  Other
    values than strings count as one character."""
    begin = chars = 0
    for i, t in enumerate(texts, 1):
        chars += len(t) if isinstance(t, str) else 1
        if chars >= most and i % step == 0:
            yield slice(begin, i)
            begin, chars = i, 0
    if begin < len(texts):
        yield slice(begin, len(texts))
