"""Scalar text functions (JVM-side Column expressions, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points Python's ``str.isspace`` accepts: Spark's plain
# ``trim`` only removes U+0020, so every strip goes through this set.
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    )
)
# Same set as a regex character class body; valid in Java regex and RE2.
WHITESPACE_CLASS = (
    r"\t-\r\x{1C}- \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# The same set for the JVM's regex engine, written as one property test
# plus the four code points ``Character.isWhitespace`` leaves out: a run of
# 12 ranges makes ``split`` test every character a dozen times (about 2.7x
# slower on review text).
JVM_WHITESPACE_RUN = r"[\p{javaWhitespace}\x{85}\x{A0}\x{2007}\x{202F}]+"
# Word tokens: maximal runs of Unicode letters.
NON_LETTER = r"[^\p{L}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Unicode-aware strip of both ends (Python ``str.strip``)."""
    return F.btrim(_c(x), F.lit(WHITESPACE))


def snippet(x, n: int = 120) -> Column:
    """Newlines become spaces, then the first ``n`` code points."""
    return F.substring(F.replace(_c(x), F.lit("\n"), F.lit(" ")), 1, n)


def fixed(x, digits: int = 2) -> Column:
    """``x`` with ``digits`` decimals, rounded like Python's ``f"{x:.2f}"``.

    Python rounds the exact binary value of the double (ties to even);
    Java's ``%.2f`` rounds its shortest decimal string half-up, so e.g.
    0.105 (really 0.10499...) gives "0.11" there and "0.10" in Python.
    Here: with f the fraction of x (exact), p = fl(f * 10^d) and the exact
    product f * 5^d = p5 + e (Dekker's error-free product; 10^d = 2^d * 5^d
    and scaling by 2^d is exact).  The fraction of p decides the rounding
    unless it is exactly one half, where the sign of e decides, and a true tie
    goes to the even integer.  Exact for |x| < 2^63; above, whose doubles
    are whole numbers, digits after the 17th are zeros.  NaN and infinity
    read ``nan``, ``inf`` and ``-inf``.
    """
    v = _c(x).cast("double")
    unit = F.floor(F.abs(v))
    a = F.abs(v) - unit.cast("double")
    five = float(5**digits)
    two = float(2**digits)
    big = F.lit(134217729.0)  # 2^27 + 1, Dekker's split constant
    c = big * a
    hi = c - (c - a)
    lo = a - hi
    p5 = F.lit(five) * a
    err = (F.lit(five) * hi - p5) + F.lit(five) * lo
    p = p5 * F.lit(two)
    k0 = F.floor(p)
    frac = p - k0
    odd = F.pmod(unit, F.lit(2)) if digits == 0 else F.lit(0)  # 10^d is even for d > 0
    up = (
        F.when(frac > 0.5, F.lit(1))
        .when(frac < 0.5, F.lit(0))
        .when(err > 0, F.lit(1))
        .when(err < 0, F.lit(0))
        .otherwise(F.pmod(k0 + odd, F.lit(2)).cast("int"))
    )
    k = (k0 + up).cast("bigint")
    scale = 10**digits
    whole = (unit + (k >= scale).cast("bigint")).cast("string")
    if digits == 0:
        body = whole
    else:
        body = F.concat(whole, F.lit("."), F.lpad(F.pmod(k, F.lit(scale)).cast("string"), digits, "0"))
    # the double's own text carries the sign, including -0.0 (as in Python)
    sign = F.when(F.startswith(v.cast("string"), F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    body = F.when(F.abs(v) >= 2.0**63, F.format_string(f"%.{digits}f", F.abs(v))).otherwise(body)
    body = F.when(F.abs(v) == float("inf"), F.lit("inf")).otherwise(body)
    return (
        F.when(v.isNull(), F.lit(None).cast("string")).when(F.isnan(v), F.lit("nan")).otherwise(F.concat(sign, body))
    )


def pct(x) -> Column:
    """P20: ``0.6896 -> '68.96%'`` (Python's ``.2%``: x * 100, then fixed)."""
    return F.concat(fixed(_c(x).cast("double") * F.lit(100.0), 2), F.lit("%"))


def seconds(x) -> Column:
    """P20: ``0.071 -> '0.07s'``."""
    return F.concat(fixed(x, 2), F.lit("s"))


def or_text(x, fallback: str) -> Column:
    """Null or empty text is shown as ``fallback``."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(fallback))


def word_tokens(x) -> Column:
    """Lower-cased letter runs of a text (empty pieces removed)."""
    # array_remove is code-generated; a filter lambda would be interpreted
    return F.array_remove(F.split(F.lower(_c(x)), NON_LETTER), "")


def space_tokens(x) -> Column:
    """Whitespace-delimited pieces (the built-in tokeniser for encoding)."""
    return F.array_remove(F.split(_c(x), JVM_WHITESPACE_RUN), "")
