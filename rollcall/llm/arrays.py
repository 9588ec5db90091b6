"""Vectorised text kernels over Arrow buffers (used inside Spark tasks).

Texts stay UTF-8 bytes. A *words* object holds, for a batch of documents, the
byte range, the document and the 64-bit hash of every word; window and shingle
hashes are Rabin-Karp differences of prefix sums modulo 2**64, finished by a
bijective mixer.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
MASK = (1 << 64) - 1
BASE, BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
STEP, STEP_INV = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random word for every byte value or code point.
CODE = mix(np.arange(1, 0x110001, dtype=U) * U(BASE))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: As SPACE, and ASCII punctuation separates words too.
PUNCT = SPACE.copy()
PUNCT[[c for c in range(128) if not chr(c).isalnum()]] = True

#: A-Z in lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of lower-cased text outside terms: terms are digits, a-z and all that is not ASCII.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, U)
        p[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(p)
    return have[:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.large_string())
    a = a.cast(pa.large_string()).fill_null("")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = a.buffers()
    o = np.frombuffer(off, np.int64)[a.offset:a.offset + len(a) + 1]
    b = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def pieces(column, n: int = 256):
    """(first row, slice) of every n rows: bounds the working arrays."""
    for i in range(0, len(column), n):
        yield i, column.slice(i, n)


def code_points(column, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of a string column; null counts as empty."""
    if lower:
        column = pc.utf8_lower(column)
    b, off = utf8(column)
    points = np.frombuffer(b.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    lead = np.append(0, np.cumsum((b & 0xC0) != 0x80))
    return points, lead[off]


@functools.cache
def not_letter() -> np.ndarray:
    """By code point: it is no letter."""
    return ~np.array([chr(c).isalpha() for c in range(0x110000)])


@functools.cache
def not_word() -> np.ndarray:
    """By code point: it is neither letter nor digit."""
    return ~np.array([chr(c).isalnum() for c in range(0x110000)])


def ngrams(points: np.ndarray, start: np.ndarray, end: np.ndarray, sizes, bits: int, affixes=()):
    """Hashed features of words: (word index, bucket) pairs. Character n-grams
    of the word between two marks, its prefixes and suffixes of the lengths in
    ``affixes``, and the word itself."""
    n, length = len(start), end - start
    base = np.append(0, np.cumsum(length + 2))
    inner = np.arange(length.sum())
    word = np.repeat(np.arange(n), length)
    skip = np.append(0, np.cumsum(length))[:-1]
    flat = np.full(base[-1], 0x10FFFF, np.uint32)  # the mark
    flat[inner + 2 * word + 1] = points[inner - skip[word] + start[word]]
    own = np.repeat(np.arange(n), length + 2)
    c, shift = CODE[flat], U(64 - bits)
    words, buckets = [], []

    def add(w, h, kind):
        words.append(w)
        buckets.append((mix(h + U(kind * 0x1000003)) >> shift).astype(np.int64))

    h = c
    for k in range(2, max([*sizes, *(a + 1 for a in affixes), 1]) + 1):
        h = h[:-1] + c[k - 1:] * powers(STEP, k)[k - 1]
        if k in sizes:
            ok = own[:len(h)] == own[k - 1:]
            add(own[:len(h)][ok], h[ok], k)
        if k - 1 in affixes:
            has = np.flatnonzero(length >= k - 1)
            add(has, h[base[has]], 100 + k)
            add(has, h[base[has + 1] - k], 200 + k)
    add(np.arange(n), substring_hash(points, start, end), 1)
    return np.concatenate(words), np.concatenate(buckets)


def chunks(offsets: np.ndarray, size: int = 1 << 20, docs: int | None = None):
    """Document ranges (lo, hi) of about ``size`` bytes, and of at most ``docs``
    documents; at least one document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1), lo + (docs or n))
        yield lo, hi
        lo = hi


class Words:
    """Words of documents lo..hi: ``start``/``end`` bytes (in ``data``), ``doc``
    (0-based within the range), ``hash``, and ``first``: where each document's
    words begin (length n_docs + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, hashes: bool = True):
        self.data, n = data, len(offsets) - 1
        inside = ~space[data]
        s, e = inside.copy(), inside.copy()
        s[1:] &= ~inside[:-1]
        e[:-1] &= ~inside[1:]
        if len(data):
            b = offsets[:-1][offsets[:-1] < offsets[1:]]
            s[b] = inside[b]
            b = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            e[b] = inside[b]
        self.start, self.end = np.flatnonzero(s), np.flatnonzero(e) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)
        if hashes:
            self.hash = substring_hash(data, self.start, self.end)

    def runs(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of k words within one document.
        ``short``: a document of 1 to k-1 words has one run of all its words."""
        n = len(self.start)
        ok = np.arange(n) + k <= np.repeat(self.first[1:], self.count)
        at = np.flatnonzero(ok)
        prefix = np.zeros(n + 1, U)
        np.cumsum(self.hash * powers(STEP, n), out=prefix[1:])
        length = np.full(len(at), k)
        if short:
            few = np.flatnonzero((self.count > 0) & (self.count < k))
            at = np.concatenate([at, self.first[few]])
            length = np.concatenate([length, self.count[few]])
            order = np.argsort(at, kind="stable")
            at, length = at[order], length[order]
        h = (prefix[at + length] - prefix[at]) * powers(STEP_INV, n)[at] if n else np.zeros(0, U)
        return at, mix(h + length.astype(U))


def substring_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: polynomial, position-free, mixed."""
    n = len(data)
    prefix = np.zeros(n + 1, U)
    np.cumsum(CODE[data] * powers(BASE, n), out=prefix[1:])
    h = (prefix[end] - prefix[start]) * powers(BASE_INV, n + 1)[start]
    return mix(h ^ (end - start).astype(U))
