"""Native column expressions over whole texts, shared by operators without Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space that parts words: space and the bytes 9 to 13.
BLANK = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
_TRIM = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The words of a text, in order; none for a blank text."""
    inner = F.trim(text, F.lit(_TRIM))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK + "+"))


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def runs(tokens: Column, k: int, whole: bool) -> Column:
    """64-bit hashes of all runs of ``k`` tokens; with ``whole``, a shorter sequence is one run."""
    n = F.size(tokens)
    full = let(tokens, lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (k - 1)), lambda i: F.xxhash64(F.slice(t, i, k))))
    short = F.when(n > 0, F.array(F.xxhash64(tokens, n))).otherwise(F.array().cast("array<bigint>")) if whole else F.array().cast("array<bigint>")
    return F.when(n >= k, full).otherwise(short)
