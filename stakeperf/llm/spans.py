"""Words, word hashes and word-sequence hashes of whole texts, as numpy arrays.

Texts are handled as UTF-8 bytes.  Every separator used here is an ASCII byte,
and no ASCII byte occurs inside a longer UTF-8 sequence, so cutting bytes cuts
characters.  Words are never built as Python objects here.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_M1, _M2, _LEN = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9E3779B97F4A7C15)
#: Odd, so powers have inverses modulo 2**64.
BASES = (0xD1342543DE82EF95, 0xA0761D6478BD642F)

#: Space and U+0009 to U+000D.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

#: Everything but ASCII letters and the bytes of longer characters.
NON_LETTERS = np.ones(256, bool)
NON_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without linear structure."""
    h = h ^ (h >> U(33))
    h *= _M1
    h ^= h >> U(29)
    h *= _M2
    h ^= h >> U(32)
    return h


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS):
    """(start, length, document) of every word; ``data`` has 8 bytes of padding."""
    n = len(data) - 8
    solid = ~separators[data[:n]]
    edge = np.zeros(n + 1, bool)
    edge[offsets[:-1]] = True
    edge[n] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end[:-1] &= ~solid[1:] | edge[1:n]
    s = np.flatnonzero(start)
    length = np.flatnonzero(end) + 1 - s
    return s, length, np.searchsorted(offsets, s, "right") - 1


def word_hash(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word, eight bytes at a time; equal bytes hash equal.

    The first eight bytes are mixed before the length comes in, so words of
    different lengths don't cancel out.  Hashes of different seeds are independent
    from the bytes on."""
    eight = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    first = U(seed * BASES[1] % 2**64)
    h = mix(mix((eight[start] & _KEEP[np.minimum(length, 8)]) ^ first) + length.astype(np.uint64) * _LEN)
    rest = np.flatnonzero(length > 8)
    at = 8
    while len(rest) and at < _LONG:
        left = length[rest] - at
        h[rest] = mix(h[rest] * U(BASES[0]) ^ mix((eight[start[rest] + at] & _KEEP[np.minimum(left, 8)]) + first))
        rest = rest[left > 8]
        at += 8
    for i in rest:  # words beyond 64 bytes
        h[i] = U(xxhash.xxh3_64_intdigest(data[start[i]:start[i] + length[i]].tobytes(), seed))
    return h


def same_bytes(data: np.ndarray, start: np.ndarray, other: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``length`` bytes of ``data`` from ``start`` equal those of ``other`` from ``at``."""
    x = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    y = np.ndarray((len(other) - 7,), "<u8", other.data, strides=(1,))
    out = (x[start] ^ y[at]) & _KEEP[np.minimum(length, 8)] == 0
    rest = np.flatnonzero(out & (length > 8))
    done = 8
    while len(rest):
        left = length[rest] - done
        good = (x[start[rest] + done] ^ y[at[rest] + done]) & _KEEP[np.minimum(left, 8)] == 0
        out[rest[~good]] = False
        rest = rest[good & (left > 8)]
        done += 8
    return out


def word_ids(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, first place of each number): equal numbers for equal
    bytes only.  Words of equal hash are compared; a collision takes another seed."""
    seed = 0
    while True:
        _, first, number = np.unique(word_hash(data, start, length, seed), return_index=True, return_inverse=True)
        lead = first[number]
        if (length == length[lead]).all() and same_bytes(data, start, data, start[lead], length).all():
            return number, first
        seed += 1


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(k):
        factor = factor * BASES[0] % 2**64
        out += h[j:j + n] * U(factor)
    return mix(out)


_POWERS: dict = {}


def _powers(base: int, n: int):
    """Powers of ``base`` and of its inverse modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        have = _POWERS[base] = tuple(both)
    return have[0][:n], have[1][:n]


def window_hash(h: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of every window of ``width`` consecutive word hashes in one pass:
    differences of prefix sums of a polynomial modulo 2**64."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(base, len(h))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
    return mix((prefix[width:] - prefix[:-width]) * down[:n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + c)`` for every pair."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)
