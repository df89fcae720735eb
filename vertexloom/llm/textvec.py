"""Word and shingle hashes of whole Arrow columns of text, vectorised over the bytes.

Every word gets a 64-bit hash (a polynomial over its bytes, mixed with its length), every run of k
words a hash of its words' hashes. Texts are taken in pieces of about PIECE bytes, whole texts each,
and a longer text is hashed block by block: the working memory is some 60 bytes for each byte of a
piece, and beyond that 20 to 30 for each word of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64

#: Byte classes: what ends a word. ASCII white space only, or every ASCII byte but letters and digits.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = (np.ones(1, _U), np.ones(1, _U))


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept up to twice a piece."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(max(n, 2 * PIECE + 2), base, _U)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= 2 * PIECE + 2:
        _powers = made[0], made[1]
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads all bits; bijective."""
    x = x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows, about PIECE bytes at a time; null is empty. Bytes aren't copied."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1] or bytes(8), kind)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, int(at[i]) + PIECE, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1].astype(np.int64) - int(at[i])
        i = j


def _words(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    inside = ~ends[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    inner = offsets[1:-1]
    after[inner[inner > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _grow(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum((_LOWER[data].astype(_U) + _U(1)) * power[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    h = mix(h ^ mix((end - start).astype(_U)))
    return h, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) and the offsets of each text's words among them."""
    n = len(data)
    if not n:
        return np.empty(0, _U), np.zeros(len(offsets), np.int64)
    if n <= 2 * PIECE or len(offsets) != 2:
        return _words(data, offsets, ends)
    # one long text: blocks that end where a word ends
    out, lo = [], 0
    while lo < n:
        hi = min(lo + PIECE, n)
        while hi < n and not ends[data[hi]]:
            step = np.flatnonzero(ends[data[hi : hi + 4096]])
            hi = hi + int(step[0]) if len(step) else min(hi + 4096, n)
        out.append(_words(data[lo:hi], np.array([0, hi - lo]), ends)[0])
        lo = hi
    h = np.concatenate(out)
    return h, np.array([0, len(h)])


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words in each text, and their offsets. ``short``: a text with fewer words is one run."""
    n = len(hashes)
    count = np.diff(offsets)
    runs = np.maximum(count - k + 1, (count > 0).astype(np.int64) if short else 0)
    out = np.concatenate([[0], np.cumsum(runs)])
    if not out[-1]:
        return np.empty(0, _U), out
    first = np.repeat(offsets[:-1] - out[:-1], runs) + np.arange(out[-1])
    last = np.repeat(offsets[1:], runs)
    padded = np.concatenate([hashes, np.zeros(k, _U)])
    h = np.zeros(len(first), _U)
    for i in range(k):
        w = padded[first + i]
        if short:
            w = np.where(first + i < last, w, _U(0))
        h = h * _U(0xD6E8FEB86659FD93) + w
        h ^= h >> _U(29)
    return mix(h), out


def shingle_sets(texts: pa.Array, k: int, ends: np.ndarray = SPACES, short: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every row."""
    for row, data, at in pieces(texts):
        h, wat = words(data, at, ends)
        s, sat = shingles(h, wat, k, short)
        for i in range(len(at) - 1):
            yield row + i, np.unique(s[sat[i] : sat[i + 1]])
