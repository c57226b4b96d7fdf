"""Packing of token runs into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import byte_slices, id_text, large
from .tokens import encode

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0..k-1) of each item, by the largest differencing method.

    Every item starts as a partition (size, 0, ..., 0).  The two partitions
    with the largest spread are merged, the largest sums of one with the
    smallest of the other, until one is left."""
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, np.int64)
    parent = np.arange(n)  # items joined in one window so far; the root stands for them

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # sums in descending order, and an item of each window (-1: empty)
    state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = n

    def expand(t: int) -> tuple[np.ndarray, np.ndarray]:
        if t < n:
            s, m = np.zeros(k, np.int64), np.full(k, -1, np.int64)
            s[0], m[0] = sizes[t], t
            return s, m
        return state.pop(t)

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (sa, ma), (sb, mb) = expand(a), expand(b)
        sb, mb = sb[::-1], mb[::-1]
        s = sa + sb
        both = np.flatnonzero((ma >= 0) & (mb >= 0))
        for i in both:
            parent[root(int(mb[i]))] = root(int(ma[i]))
        m = np.where(ma >= 0, ma, mb)
        order = np.argsort(-s, kind="stable")
        s, m = s[order], m[order]
        state[tick] = (s - s[-1], m)
        heapq.heappush(heap, (-int(s[0] - s[-1]), tick))
        tick += 1
    _, m = expand(heap[0][1])
    window = {root(int(x)): w for w, x in enumerate(m) if x >= 0}
    return np.array([window[root(i)] for i in range(n)], np.int64)


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Near-equal windows of at most ``capacity``; their count rises until all fit."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        win = differencing(sizes, k)
        if np.bincount(win, weights=sizes, minlength=k).max(initial=0) <= capacity:
            return win
        k += 1


def packing(docs: DataFrame, vocab: str, end_id: int = 1, capacity: int = 2048, windows: int = 128,
            piece: int = 512, slack: int = 8) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task works through its own rows in order: a document's ids and
    ``end_id`` fill sequences of their own while ``capacity`` or more are left; the
    rest is cut into pieces of at most ``piece`` ids.  Pieces wait until they
    make ``windows`` full sequences but for ``slack`` ids each (the last piece is cut there), then
    differencing deals them out.  What a task has left at its end makes full
    windows in the same way, and its last ids are cut into sequences whose
    lengths are powers of two, which need no padding.  Nothing is shuffled or
    collected, and a task holds one group at a time.

    A null or empty text is a document of ``end_id`` alone.  Null doc_ids and
    repeated rows are packed like any other; an empty table gives no rows.
    Sequence ids are unique over all tasks.
    """
    def run(batches):
        seq = TaskContext.get().partitionId() << 36
        pool: list[tuple] = []  # doc_id, start, ids, doc_tokens
        held = 0
        goal = windows * (capacity - slack)

        def rows_of(items, win):
            nonlocal seq
            used: dict[int, int] = {}
            rows = []
            for (d, at, ids, total), w in zip(items, win.tolist()):
                rows.append((d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, seq + w, used.get(w, 0)))
                used[w] = used.get(w, 0) + len(ids)
            seq += int(win.max(initial=-1)) + 1
            return rows

        def take(n):
            """The first ``n`` ids of the pool as pieces; the piece there is cut."""
            nonlocal pool, held
            got, i = 0, 0
            while i < len(pool) and got + len(pool[i][2]) <= n:
                got += len(pool[i][2])
                i += 1
            out, pool = pool[:i], pool[i:]
            if got < n:
                d, at, ids, total = pool[0]
                out.append((d, at, ids[:n - got], total))
                pool[0] = (d, at + n - got, ids[n - got:], total)
            held -= n
            return out

        def pack_some(n):
            items = take(n)
            return rows_of(items, pack(np.array([len(x[2]) for x in items], np.int64), capacity))

        def batch(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[
                "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in byte_slices(batches):
            rows = []
            flat, off = encode(vocab, large(b.column("text")), end_id)
            for d, lo, hi in zip(b.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                at, n = 0, hi - lo
                while n - at >= capacity:
                    rows += rows_of([(d, at, flat[lo + at:lo + at + capacity], n)], np.zeros(1, np.int64))
                    at += capacity
                while at < n:
                    m = min(piece, n - at)
                    pool.append((d, at, flat[lo + at:lo + at + m], n))
                    held += m
                    at += m
                while held >= goal:
                    rows += pack_some(goal)
            if rows:
                yield batch(rows)
        rows = []
        if held >= capacity:
            rows += pack_some(held // capacity * (capacity - slack))
        for bit in range(held.bit_length() - 1, -1, -1):
            if held >> bit & 1:
                for lo in range(0, 1 << bit, capacity):
                    items = take(min(1 << bit, capacity))
                    rows += rows_of(items, np.zeros(len(items), np.int64))
        if rows:
            yield batch(rows)

    return id_text(docs).mapInArrow(run, SCHEMA)
