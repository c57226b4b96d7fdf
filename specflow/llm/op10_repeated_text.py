"""Removal of long repeated byte strings, exact over the whole corpus, by run-length
compressed Burrows-Wheeler indexes of the places that may repeat.

Every string of ``length`` bytes has one *anchor*: the position of its smallest hash of 24 bytes.
Equal strings have equal anchors at equal places, so strings meet by the hash of
their anchor.  Step 1 shuffles a row for each anchor with a fingerprint of all
strings that it stands for (its context).  Of equal contexts all but the first
are repeats as a whole.  Step 2 fetches the bytes of the first of each context
only where an anchor has several, indexes them (rlindex) and streams them through the
index: strings that reach the same interval are equal, and the later ones repeats.
Step 3 cuts the marked bytes out.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, id_text, large, materialize, string_bytes
from .rlindex import repeats
from .shingles import _powers, mix

GRAM = 24
_PIECE = 4 << 20
_BITS = 24  # positions in a piece and the bytes behind it
_MASK = np.uint64((1 << _BITS) - 1)


@functools.lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _prefix(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and factors: the hash of raw[a:b] is (sums[b] - sums[a]) * back[a]."""
    n = len(raw)
    power, back = _powers(1 << max(1, n).bit_length())
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_values()[raw] * power[:n], out=total[1:])
    return total, back


def _runs(raw: np.ndarray, off: np.ndarray, length: int):
    """(text, anchor, first and last string start, anchor hash, context hash) for each
    anchor of texts that lie one after another in ``raw``."""
    n, width = len(raw), length - GRAM + 1
    if n < length:
        return None
    total, back = _prefix(raw)
    gram = mix((total[GRAM:] - total[:-GRAM]) * back[:n - GRAM + 1])
    low = (gram & ~_MASK) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while span * 2 <= width:  # smallest over 2, 4, ... positions, then over all of a string's
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    starts = off[:-1]
    count = np.maximum(0, np.diff(off) - length + 1)
    text = np.repeat(np.arange(len(starts)), count)
    at = np.arange(len(text)) + np.repeat(starts - np.r_[0, np.cumsum(count)][:-1], count)
    if not len(at):
        return None
    p = (low[at] & _MASK).astype(np.int64)
    first = np.r_[True, (p[1:] != p[:-1]) | (text[1:] != text[:-1])]
    lo = np.flatnonzero(first)
    hi = np.r_[lo[1:], len(at)] - 1
    p, s1, s2, text = p[lo], at[lo], at[hi], text[lo]
    shape = ((p - s1) * 128 + (p - s2)).astype(np.uint64)
    context = mix(mix((total[s2 + length] - total[s1]) * back[s1]) + shape)
    return text, p, s1, s2, gram[p], context


def _pieces(off: np.ndarray):
    """Runs of texts of about _PIECE bytes, and parts of longer texts: (first text,
    last text + 1, first byte, end byte of string starts)."""
    i = 0
    while i < len(off) - 1:
        if off[i + 1] - off[i] > _PIECE:
            for lo in range(int(off[i]), int(off[i + 1]), _PIECE):
                yield i, i + 1, lo, min(lo + _PIECE, int(off[i + 1]))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(off, off[i] + _PIECE, "right")) - 1)
        yield i, j, int(off[i]), int(off[j])
        i = j


def anchors(col: pa.Array, length: int):
    """Arrays (text, anchor in text, start before it, last start before it, anchor hash, context hash)."""
    off, raw = string_bytes(col)
    found = []
    for i, j, lo, hi in _pieces(off):
        whole = j - i > 1 or hi - lo == off[j] - off[i]
        end = hi if whole else min(int(off[i + 1]), hi + length - 1)  # strings that start in the part
        own = off[i:j + 1] - lo if whole else np.array([0, end - lo])
        got = _runs(raw[lo:end], own, length)
        if got:
            t, p, s1, s2, h, c = got
            found.append((t + i, p + lo - off[t + i], p - s1, p - s2, h, c))
    if not found:
        return None
    return [np.concatenate(x) for x in zip(*found)]


def _pack(p: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    return (p << 14) | (d1 << 7) | d2


def _unpack(pk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = pk >> 14
    return p, p - ((pk >> 7) & 127), p - (pk & 127)


def _batch(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names.split())


def _after_lead(h: np.ndarray, c: np.ndarray, d: np.ndarray, pk: np.ndarray):
    """For rows sorted by (h, c, doc_id, pk): the first row of each context, and whether a
    row comes after it (in a larger doc_id, or at a later place of the same one)."""
    at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    lead = np.repeat(at, np.diff(np.r_[at, len(h)]))
    return at, (d > d[lead]) | ((d == d[lead]) & (pk >> 14 > pk[lead] >> 14))


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """A row for each anchor.  Of equal contexts in one batch only the first has its
    comparison still to come: the others are repeats (done) and are dealt by their place, so an
    anchor that very many documents share is no large group."""
    def run(batches):
        for b in byte_slices(batches):
            got = anchors(large(b.column("text")), length)
            if got:
                t, p, d1, d2, h, c = got
                ids, th = b.column("doc_id").to_numpy()[t], b.column("th").to_numpy()[t]
                h, c, pk = h.view(np.int64), c.view(np.int64), _pack(p, d1, d2)
                order = np.lexsort((pk, ids, c, h))
                h, c, ids, th, pk = (x[order] for x in (h, c, ids, th, pk))
                _, done = _after_lead(h, c, ids, pk)
                route = np.where(done, mix((ids * 31 + pk).view(np.uint64)).view(np.int64), h)
                yield _batch("route done h c doc_id th pk", route, done, h, c, ids, th, pk)

    return docs.mapInArrow(run, "route long, done boolean, h long, c long, doc_id long, th int, pk long")


_ROW = ("h", "c", "doc_id", "th", "pk")


def _shared(rows: DataFrame, length: int) -> DataFrame:
    """From anchor rows: kind 0, repeats (begin, end); kind 1, the first of each
    context of an anchor that has several (h, pk), for the comparison of their strings."""
    def run(batches):
        wait = None  # the first of each context of the group that may go on
        for b in batches:
            done = b.column("done").to_numpy(zero_copy_only=False)
            cols = {k: b.column(k).to_numpy() for k in _ROW}
            if done.any():
                h, _, d, th, pk = (cols[k][done] for k in _ROW)
                _, s1, s2 = _unpack(pk)
                yield _batch("kind doc_id th a b h", np.zeros(len(h), np.int32), d, th, s1, s2 + length, h)
            if not done.all():
                yield from settle(wait, [cols[k][~done] for k in _ROW], False)
                wait = state.pop()
        if wait is not None:
            yield from settle(wait, [x[:0] for x in wait], True)

    state: list = []

    def settle(wait, new, last):
        old = len(wait[0]) if wait is not None else 0
        h, c, d, th, pk = [np.r_[w, n] for w, n in zip(wait, new)] if old else new
        fresh = np.arange(len(h)) >= old
        order = np.lexsort((pk, d, c, h))
        h, c, d, th, pk, fresh = (x[order] for x in (h, c, d, th, pk, fresh))
        at, after = _after_lead(h, c, d, pk)
        head = np.zeros(len(h), bool)
        head[at] = True
        _, s1, s2 = _unpack(pk)
        rep = fresh & after
        yield _batch("kind doc_id th a b h", np.zeros(rep.sum(), np.int32), d[rep], th[rep], s1[rep], s2[rep] + length, h[rep])
        group = np.cumsum(np.r_[True, h[at][1:] != h[at][:-1]]) - 1
        several = np.bincount(group)[group] > 1
        # of equal places in rows that share an id each is a first one
        tie = ~head & ~after & fresh
        if not last:
            end = group == group[-1]
            state.append([x[at[end]] for x in (h, c, d, th, pk)])
            several &= ~end
        send = np.r_[at[several], np.flatnonzero(tie)]
        yield _batch("kind doc_id th a b h", np.ones(len(send), np.int32), d[send], th[send], pk[send], pk[send], h[send])

    return rows.repartition("route").sortWithinPartitions("done", "h", "doc_id", "pk").mapInArrow(
        run, "kind int, doc_id long, th int, a long, b long, h long")


def _contexts(docs: DataFrame, want: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted contexts: h, doc_id, th, pk, data."""
    lists = want.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "pk")).alias("want"))
    if want.limit(2_000_001).count() <= 2_000_000:  # 16 bytes each; more go through a shuffle
        lists = F.broadcast(lists)

    def run(batches):
        for b in batches:
            rows = []
            for d, th, text, ws in zip(*(b.column(k).to_pylist() for k in ("doc_id", "th", "text", "want"))):
                raw = text.encode("utf-8", "surrogatepass")
                for w in ws:
                    p, s1, s2 = _unpack(np.int64(w["pk"]))
                    rows.append((w["h"], d, th, w["pk"], raw[s1:s2 + length]))
            if rows:
                h, d, th, pk, data = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(th, pa.int32()),
                                                  pa.array(pk, pa.int64()), pa.array(data, pa.binary())], names=["h", "doc_id", "th", "pk", "data"])

    return (docs.join(lists, ["doc_id", "th"]).mapInArrow(run, "h long, doc_id long, th int, pk long, data binary"))


def _strings(rows: pa.RecordBatch):
    """Offsets and bytes of the contexts."""
    data = rows.column("data").cast(pa.large_binary())
    off = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1 + data.offset)[data.offset:]
    raw = np.frombuffer(data.buffers()[2], np.uint8, int(off[-1]))[off[0]:]
    return off - off[0], raw


def _marks(rows: pa.RecordBatch, row: np.ndarray, start: np.ndarray, length: int):
    """Runs of repeated strings as (begin, end), one batch."""
    if not len(row):
        return
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]
    lo = np.flatnonzero(new)
    hi = np.r_[lo[1:], len(row)] - 1
    d, th = rows.column("doc_id").to_numpy(), rows.column("th").to_numpy()
    yield _batch("doc_id th a b", d[row[lo]], th[row[lo]], start[lo], start[hi] + length)


def _later(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Is there an equal key in a smaller doc_id, or at an earlier start of the same one?
    Also the places of the first of each key."""
    order = np.lexsort((start, doc, key))
    k = key[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    lead = order[np.repeat(first, np.diff(np.r_[first, len(k)]))]
    later = np.zeros(len(key), bool)
    later[order] = (doc[order] > doc[lead]) | ((doc[order] == doc[lead]) & (start[order] > start[lead]))
    return later, order[first]


def _by_index(rows: pa.RecordBatch, length: int):
    """Whole groups: their strings' intervals in a run-length index of the contexts."""
    off, raw = _strings(rows)
    row, place, interval = repeats(raw, off, length)
    start = _unpack(rows.column("pk").to_numpy())[1][row] + place
    later, _ = _later(interval, rows.column("doc_id").to_numpy()[row], start)
    yield from _marks(rows, row[later], start[later], length)


def _by_hash(rows: pa.RecordBatch, seen, length: int):
    """A part of one large group: its strings' 64-bit hashes beside those of the first of
    each string so far (key, doc_id, start).  Yields batches, then the new ``seen``."""
    off, raw = _strings(rows)
    n = np.diff(off) - length + 1
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n)
    total, back = _prefix(raw)
    at = off[:-1][row] + place
    key = mix((total[at + length] - total[at]) * back[at])
    doc, start = rows.column("doc_id").to_numpy()[row], _unpack(rows.column("pk").to_numpy())[1][row] + place
    key, doc, start = (np.r_[x, y] for x, y in zip(seen, (key, doc, start)))
    row = np.r_[np.full(len(seen[0]), -1), row]
    later, first = _later(key, doc, start)
    hit = later & (row >= 0)
    yield from _marks(rows, row[hit], start[hit], length)
    yield key[first], doc[first], start[first]


def _compare(contexts: DataFrame, length: int, index_bytes: int = 1 << 20, group_bytes: int = 8 << 20) -> DataFrame:
    """Repeats (begin, end) among the strings of contexts that share an anchor.

    Groups come whole into run-length indexes of about ``index_bytes``; a group of over
    ``group_bytes`` streams past the hashes of its different strings instead."""
    names = ["h", "doc_id", "th", "pk", "data"]

    def run(batches):
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        wait, held = [], 0  # batches that no index holds yet; the last group may go on
        hot, seen = None, none
        for b in batches:
            b = b.select(names)
            if b.num_rows == 0:
                continue
            if hot is not None:  # the large group's next rows
                more = int(np.searchsorted(b.column("h").to_numpy(), hot, "right"))
                if more:
                    *out, seen = _by_hash(b.slice(0, more), seen, length)
                    yield from out
                if more == b.num_rows:
                    continue
                b, hot, seen = b.slice(more), None, none
            wait.append(b)
            held += b.nbytes
            if held < index_bytes:
                continue
            rows = pa.concat_batches(wait)
            h = rows.column("h").to_numpy()
            last = int(np.searchsorted(h, h[-1]))
            if last:
                yield from _by_index(rows.slice(0, last), length)
            rows = rows.slice(last)
            wait, held = [rows], sum(len(x) for x in rows.column("data").to_pylist())
            if held > group_bytes:
                hot, wait, held = int(h[-1]), [], 0
                *out, seen = _by_hash(rows, none, length)
                yield from out
        if wait:
            yield from _by_index(pa.concat_batches(wait), length)

    return contexts.repartition("h").sortWithinPartitions("h", "doc_id", "pk").mapInArrow(run, "doc_id long, th int, a long, b long")


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, th, spans): the maximal repeated byte ranges of each document that has
    any, as pairs of little-endian 64-bit numbers.  ``docs`` has doc_id, th and text."""
    if not GRAM <= length <= GRAM + 127:
        raise ValueError(f"length must be between {GRAM} and {GRAM + 127}")
    shared = materialize(_shared(_anchor_rows(docs, length), length), "repeat-anchors")
    want = shared.filter("kind = 1").select("doc_id", "th", "h", F.col("a").alias("pk"))
    found = shared.filter("kind = 0").select("doc_id", "th", "a", "b").unionByName(_compare(_contexts(docs, want, length), length))
    lists = found.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("marks"))

    def merge(batches):
        for b in batches:
            out = []
            for marks in b.column("marks").to_pylist():
                a, e = (np.array([m[k] for m in marks], np.int64) for k in "ab")
                top = np.maximum.accumulate(e)
                new = np.r_[True, a[1:] > top[:-1]]
                end = np.r_[top[:-1][new[1:]], top[-1:]]
                out.append(np.stack([a[new], end], axis=1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(out, pa.binary())], names=["doc_id", "th", "spans"])

    return materialize(lists.mapInArrow(merge, "doc_id long, th int, spans binary"), "repeat-spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (the other bytes),
    kept_sha256.

    Removed is each byte covered by a ``length``-byte string that starts earlier, too:
    in a smaller doc_id or at an earlier place of the same one; all strings are those of the
    input, in UTF-8, and lie within one text.  ``kept`` may end inside a character.
    A null or empty text has no bytes.  Null doc_ids count as the smallest id.  Rows
    with the same id count as one document whose texts begin at the same place, so
    equal rows are treated alike.  Other columns are ignored; an empty table gives an empty result.
    Contexts are told apart by 64-bit hashes within groups of equal 64-bit anchors; so
    are strings in groups too large for an index.
    """
    docs = id_text(docs, id_col, text_col)
    known = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.hash("text").alias("th"), "text", F.col("doc_id").alias("own_id"))
    spans = repeated_spans(known.select("doc_id", "th", "text"), length)
    size = spans.agg(F.count(F.lit(1)), F.sum(F.octet_length("spans"))).first()
    if size[0] <= 1_000_000 and (size[1] or 0) <= 32 << 20:  # more go through a shuffle
        spans = F.broadcast(spans)

    def cut(batches):
        for b in batches:
            n, gone, many, kept, sha = [], [], [], [], []
            for text, sp in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                s = np.frombuffer(sp or b"", "<i8").reshape(-1, 2)
                ends = np.r_[0, s[:, 1]]
                left = b"".join(raw[x:y] for x, y in zip(ends.tolist(), [*s[:, 0].tolist(), len(raw)]))
                n.append(len(raw))
                gone.append(len(raw) - len(left))
                many.append(len(s))
                kept.append(left)
                sha.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("own_id"), *(pa.array(x, pa.int64()) for x in (n, gone, many)), pa.array(kept, pa.binary()), pa.array(sha)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return known.join(spans, ["doc_id", "th"], "left").select("own_id", "text", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
