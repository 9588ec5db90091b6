"""Column helpers with Python string semantics, built from Spark functions.

Python ``str.strip()``/``split()`` use Unicode whitespace; Spark's ``trim``
strips only spaces unless given the characters, so these helpers name them
(those of ``\\s`` in a Java regex with ``(?U)``) or use such a regex.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The characters of ``(?U)\s``.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: remove leading/trailing whitespace."""
    return F.btrim(col(c), F.lit(SPACES))


def py_lstrip(c) -> Column:
    return F.ltrim(col(c), F.lit(SPACES))


def py_words(c) -> Column:
    """``str.split()``: whitespace-separated words (empty text -> [])."""
    s = py_strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"(?U)\s+"))


def count_occurrences(text, sub: str) -> Column:
    """Non-overlapping occurrences of a literal substring (``str.count``)."""
    t = col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(sub), F.lit("")))) / F.lit(len(sub))).cast("int")


def find(text, sub, start: Column | int = 0) -> Column:
    """``str.find(sub, start)`` with 0-based positions; -1 when absent."""
    t = col(text)
    sub_c = sub if isinstance(sub, Column) else F.lit(sub)
    pos1 = (start if isinstance(start, Column) else F.lit(start)) + 1
    tail = F.substr(t, pos1)
    hit = F.instr(tail, sub_c)
    return F.when(hit > 0, hit + pos1 - 2).otherwise(F.lit(-1))
