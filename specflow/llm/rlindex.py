"""A run-length compressed Burrows-Wheeler index of a collection of byte strings.

The strings end with their own terminators, which sort before all bytes and by
string number, so the transform is one permutation of the whole collection.
Kept are its runs (start, character, place of the first of them after
the last-to-first mapping), a text position sampled at each run's end, and the starts of the
intervals of suffixes that agree in their first ``length`` bytes (run-length again:
repetitive strings have few of either).  The suffix array itself is dropped.
"""

from __future__ import annotations

import numpy as np

_PACK = 7  # symbols of nine bits in a sort key


def packed(sym: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next seven symbols of each position, up to its terminator."""
    n = len(sym)
    key = np.zeros(n, np.uint64)
    padded = np.r_[sym, np.zeros(_PACK, sym.dtype)].astype(np.uint64)
    for k in range(_PACK):
        key = (key << np.uint64(9)) | np.where(k <= left, padded[k:k + n], np.uint64(0))
    return key


def suffix_ranks(key: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Place of each suffix in the order described above, by prefix doubling.
    ``left`` counts the symbols before each position's terminator."""
    n = len(key)
    closed = left < _PACK  # the terminator is in the key: the string's number decides
    order = np.argsort(key, kind="stable")
    name, shut = key[order], closed[order]
    new = np.r_[True, (name[1:] != name[:-1]) | shut[1:]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # first place of the group
    size = np.diff(np.r_[np.flatnonzero(new), n])
    todo = order[np.repeat(size > 1, size)]
    step = _PACK
    while len(todo):
        # suffixes that still share a place: by the place of what follows them
        pair = rank[todo] * n + rank[todo + step]
        by = np.argsort(pair)
        sub, pair = todo[by], pair[by]
        new = np.r_[True, pair[1:] != pair[:-1]]
        group = pair // n
        first = np.r_[True, group[1:] != group[:-1]]
        at = np.arange(len(sub))
        rank[sub] = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        size = np.diff(np.r_[np.flatnonzero(new), len(sub)])
        todo = sub[np.repeat(size > 1, size)]
        step *= 2
    return rank


class RunLengthIndex:
    """Built from strings that lie one after another in ``raw`` with offsets ``off``."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, length: int):
        m, n = len(off) - 1, len(raw) + len(off) - 1
        size = np.diff(off)
        stop = off[1:] + np.arange(m)  # the terminators
        sym = np.zeros(n, np.int16)
        body = np.ones(n, bool)
        body[stop] = False
        sym[body] = raw.astype(np.int16) + 1
        left = np.repeat(stop, size + 1) - np.arange(n)
        key = packed(sym, left)
        rank = suffix_ranks(key, left)
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
        # the symbol before each suffix; a string's first suffix has its own terminator before it
        start = off[:-1] + np.arange(m)
        before = np.r_[0, sym[:-1]]
        before[start] = 0
        bwt = before[sa]
        head = np.flatnonzero(np.r_[True, (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)])
        self.start, self.char = head, bwt[head]
        runs = np.diff(np.r_[head, n])
        by = np.argsort(self.char, kind="stable")
        self.first = np.empty(len(head), np.int64)
        self.first[by] = np.r_[0, np.cumsum(runs[by])][:-1]  # where the run's first symbol goes
        self.sample = sa[np.r_[head[1:], n] - 1]
        self.entry = rank[stop]  # the suffix of the terminator alone
        self.size, self.length = size, length
        # intervals of ``length`` equal bytes: neighbours' common prefixes, from fixed-length names
        self.interval = np.flatnonzero(~self._agree(key, sa, left, length))

    @staticmethod
    def _agree(key: np.ndarray, sa: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
        """Does a suffix share its first ``length`` bytes with the one before it in the order?"""
        same = np.zeros(len(sa), bool)
        enough = left[sa] >= length
        live = np.flatnonzero(enough[1:] & enough[:-1]) + 1
        for k in [*range(0, length - _PACK, _PACK), length - _PACK] if length >= _PACK else []:
            live = live[key[sa[live] + k] == key[sa[live - 1] + k]]
        if length < _PACK:
            cut = np.uint64(9 * (_PACK - length))
            live = live[key[sa[live]] >> cut == key[sa[live - 1]] >> cut]
        same[live] = True
        return same

    def before(self, q: np.ndarray) -> np.ndarray:
        """Places of the suffixes one symbol longer (last-to-first mapping by runs)."""
        r = np.searchsorted(self.start, q, "right") - 1
        return self.first[r] + (q - self.start[r])

    def intervals(self):
        """Streams all strings from their ends, side by side: yields (distance from the end,
        numbers of the strings that are as long, interval of their suffix there)."""
        q = self.entry.copy()
        who = np.arange(len(q))
        for t in range(1, int(self.size.max(initial=0)) + 1):
            keep = self.size[who] >= t
            who = who[keep]
            q = self.before(q[keep])
            if t >= self.length:
                yield t, who, np.searchsorted(self.interval, q, "right") - 1


def repeats(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place, interval) of every run of ``length`` bytes in the strings: the
    intervals are equal where the bytes are."""
    index = RunLengthIndex(raw, off, length)
    rows, place, found = [], [], []
    for t, who, interval in index.intervals():
        rows.append(who)
        place.append(index.size[who] - t)
        found.append(interval)
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(place), np.concatenate(found)
