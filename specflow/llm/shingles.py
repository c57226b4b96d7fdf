"""Word shingles of whole texts as 64-bit hashes, vectorized over Arrow batches.

Words are runs of anything but ASCII white space, A-Z lower-cased.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from .common import string_bytes

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: All ASCII but letters and digits.
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_VALUE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers that a worker keeps (20 MB); more are made for one slice of texts only.
_KEPT = 5 << 18


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.full(n, _R), np.full(n, _R_INV)
    a[0] = b[0] = 1
    return np.multiply.accumulate(a), np.multiply.accumulate(b)


def word_hashes(col: pa.Array, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, offsets of the texts in them).  ``between``
    marks the bytes that are not part of words."""
    off, raw = string_bytes(col)
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    power, back = _powers(_KEPT) if n <= _KEPT else _powers.__wrapped__(n)
    total = np.zeros(n + 1, np.uint64)
    np.multiply(_VALUE[raw], power[:n], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    space = between[raw]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.r_[True, space[:-1]] | cut[:-1]
    after = np.r_[space[1:], True] | cut[1:]
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    h = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, off).astype(np.int64)


def shingle_hashes(words: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, offsets of the texts in them).  A text of fewer than
    ``size`` words has its whole sequence as one, a text without words none."""
    n = np.diff(off)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out = np.r_[0, np.cumsum(count)]
    at = np.arange(out[-1]) + np.repeat(off[:-1] - out[:-1], count)
    length = np.repeat(np.minimum(n, size), count)
    h = length.astype(np.uint64)
    padded = np.r_[words, np.zeros(size, np.uint64)]
    for k in range(size):
        h = mix(h + np.where(k < length, padded[at + k], np.uint64(0)))
    return h, out
