"""Similarity join on word shingles by parity sketches.

Tokens are XORed into a wide sketch of words, one word for each part of the hash range:
two sets differ in at most as many words as their symmetric difference has
tokens.  For sets of a and b shingles a Jaccard similarity of t or more allows a difference of
(1 - t) / (1 + t) * (a + b), so among that many words and one more, taken in an order that is
the same for all sets, one is equal.  Equal words join the sets of a size
band; a dense bit sketch bounds the difference of a pair from below, and the shingle sets
decide.  Equal sets are one class from the start.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import byte_slices, id_text, large, materialize, may_be_among
from .graph import components
from .shingles import mix, shingle_hashes, word_hashes

#: Similarity 75/100, and shingles of five words.
NUM, DEN, SIZE = 75, 100, 5
#: Counters of the frequency sketch (for the order of words only), and most bits of a dense sketch.
COUNTERS, SEGMENT, BITS = 1 << 20, 1 << 16, 1024
#: Sets above ``BITS`` shingles also have a wide sketch of about a bit for each, up to so many.
WIDEST = 1 << 20
#: Sets below this size have a word for each shingle.
SMALL = 64
#: Partners that one task compares with a set, and ends of pairs up to which the list of them is broadcast (24 bytes each).
STAR, WIDE = 512, 500_000
#: Sets that share a word and are listed as pairs; more of them stay a group.
FEW = 8
#: Text bytes of a step, pairs of a group that wait at a time (32 bytes each), and shingles that leave at a time.
_SLICE, PAIRS, SENT = 1 << 20, 1 << 18, 1 << 20


def most_difference(a: int, b: int) -> int:
    return (DEN - NUM) * (a + b) // (DEN + NUM)


def _sets(batches, *cols):
    """(position in slice, batch, sorted distinct shingle hashes) of each text."""
    for b in byte_slices(batches, limit=_SLICE):
        h, off = shingle_hashes(*word_hashes(large(b.column("text"))), SIZE)
        yield b, [np.unique(h[lo:hi]) for lo, hi in zip(off[:-1], off[1:])]


def _set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _dense(s: np.ndarray) -> bytes:
    """Parities of the shingles by their low bits; small sets take fewer of them."""
    bits = BITS // 4 if len(s) < 128 else BITS // 2 if len(s) < 512 else BITS
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _wide(s: np.ndarray) -> bytes | None:
    """Parities as those of ``_dense``, with at least a bit for each shingle of a set that fills a dense sketch."""
    if len(s) <= BITS:
        return None
    bits = min(WIDEST, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _wide_distance(x: bytes, y: bytes) -> int:
    """Hamming distance at the smaller size: a lower bound of the sets' difference."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


class _Sketches:
    """Dense sketches of many sets, each also folded to the smaller sizes: halves XORed, which
    leaves parities and so the bound."""

    def __init__(self, data: list[bytes]):
        self.words = np.fromiter(map(len, data), np.int64, len(data)) // 8
        full = BITS // 64
        at = np.zeros((len(data), full), np.uint64)
        for w in (full // 4, full // 2, full):
            rows = np.flatnonzero(self.words == w)
            if len(rows):
                at[rows, :w] = np.frombuffer(b"".join(data[i] for i in rows), np.uint64).reshape(len(rows), w)
        self.folded = {full: at}
        for w in (full // 2, full // 4):
            big = self.folded[2 * w]
            self.folded[w] = np.where((self.words > w)[:, None], big[:, :w] ^ big[:, w:], big[:, :w])

    def __getitem__(self, rows) -> "_Sketches":
        got = object.__new__(_Sketches)
        got.words, got.folded = self.words[rows], {w: f[rows] for w, f in self.folded.items()}
        return got

    def join(self, other: "_Sketches") -> "_Sketches":
        got = object.__new__(_Sketches)
        got.words, got.folded = np.r_[self.words, other.words], {w: np.concatenate([f, other.folded[w]]) for w, f in self.folded.items()}
        return got

    def distance(self, u: np.ndarray, other: "_Sketches", v: np.ndarray) -> np.ndarray:
        """Hamming distances at the smaller size of each pair: lower bounds of the sets' difference."""
        size, out = np.minimum(self.words[u], other.words[v]), np.zeros(len(u), np.int64)
        for w, f in self.folded.items():
            at = np.flatnonzero(size == w)
            if len(at):
                out[at] = np.bitwise_count(f[u[at]] ^ other.folded[w][v[at]]).sum(axis=1)
        return out


def _profile(docs: DataFrame) -> DataFrame:
    """A row per document (kind 0) and the task's shingle counts in segments (kind 1)."""
    def run(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        for b, sets in _sets(batches):
            for s in sets:
                counts[(s >> np.uint64(44)).astype(np.int64)] += 1
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(n), pa.int32()), b.column("doc_id"), pa.array(n, pa.int64()),
                 pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([_dense(s) for s in sets], pa.binary()),
                 pa.array([_wide(s) for s in sets], pa.binary())],
                names=["kind", "doc_id", "n", "sid", "data", "wide"])
        k = COUNTERS // SEGMENT
        data = [zlib.compress(counts[i * SEGMENT:(i + 1) * SEGMENT].tobytes(), 1) for i in range(k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([1] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int64()), pa.nulls(k, pa.int64()),
             pa.array(data, pa.binary()), pa.nulls(k, pa.binary())], names=["kind", "doc_id", "n", "sid", "data", "wide"])

    return materialize(docs.mapInArrow(run, "kind int, doc_id long, n long, sid long, data binary, wide binary"), "jaccard-profile")


def _classes(profile: DataFrame) -> np.ndarray:
    """Binary magnitude of each counter over all tasks; one byte a counter reaches the driver."""
    def merge(batches):
        at, total, done = None, None, []
        for b in batches:
            for seg, data in zip(b.column("n").to_pylist(), b.column("data").to_pylist()):
                if seg != at:
                    if at is not None:
                        done.append((at, total))
                    at, total = seg, np.zeros(SEGMENT, np.uint64)
                total += np.frombuffer(zlib.decompress(data), np.uint32)
        done += [(at, total)] if at is not None else []
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in done], pa.int64()),
                 pa.array([np.log2(t + np.uint64(1)).astype(np.uint8).tobytes() for _, t in done], pa.binary())], names=["n", "data"])

    rows = (profile.filter("kind = 1").select("n", "data").repartition("n").sortWithinPartitions("n")
            .mapInArrow(merge, "n long, data binary").toArrow().to_pylist())
    out = np.zeros(COUNTERS, np.uint8)
    for r in rows:
        out[r["n"] * SEGMENT:(r["n"] + 1) * SEGMENT] = np.frombuffer(r["data"], np.uint8)
    return out


def signatures(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Join keys of one set (sorted distinct hashes).

    Bands hold sizes of 4**k to 4**(k + 1) - 1; a set also enters the next band if a
    partner may be there.  Order of words: rare shingles first, then words of many
    shingles, then their value.  ``most_difference`` + 1 words are kept."""
    n = len(s)
    k = (n.bit_length() - 1) // 2
    top = 4 ** (k + 1)
    partner = n * DEN // NUM
    bands = [(k, min(partner, top - 1))] + ([(k + 1, partner)] if partner >= top else [])
    cls = classes[(s >> np.uint64(44)).astype(np.int64)]
    value = mix(s)
    out = []
    for band, largest in bands:
        keep = most_difference(n, largest) + 1
        if 4 ** (band + 1) <= 4 * SMALL:
            word, freq, many = value, cls, np.ones(n, np.int64)
        else:
            part = ((s >> np.uint64(32)) * np.uint64(4 ** (band + 1))) >> np.uint64(32)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            word = np.bitwise_xor.reduceat(value, first) ^ mix(part[first])
            freq = np.minimum.reduceat(cls, first)
            many = np.diff(np.r_[first, n])
        if keep < len(word):
            word = word[np.lexsort((word, -many, freq))[:keep]]
        out.append(mix(word + np.uint64(band + 1)))
    return np.concatenate(out)


def _members(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """(sig, sid, lead): the sets that share a word with another set, and the smallest of them.

    Up to ``FEW`` sets of a word are listed as pairs, with a null sig: sid and each smaller set as
    lead.  Most words are shared by two sets, and the same two share many."""
    seen = docs.sparkSession.sparkContext.broadcast(classes)

    def emit(batches):
        done = set()
        for b, sets in _sets(batches):
            sig, sid = [], []
            for d, s in zip(b.column("doc_id").to_pylist(), sets):
                if len(s) and d is not None and (i := _set_id(s)) not in done:
                    done.add(i)
                    sig.append(signatures(s, seen.value))
                    sid.append(np.full(len(sig[-1]), i, np.int64))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(sid))], names=["sig", "sid"])

    def listed(sig, sid):
        """Rows of whole groups."""
        if not len(sig):
            return
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        count = np.diff(np.r_[start, len(sig)])
        size, leads = np.repeat(count, count), np.repeat(sid[start], count)
        many = size > FEW
        yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (sig, sid, leads)], names=["sig", "sid", "lead"])
        at = [np.flatnonzero((sig[d:] == sig[:-d]) & ~many[d:]) for d in range(1, FEW)]
        x, y = np.concatenate(at), np.concatenate([i + d for d, i in enumerate(at, 1)])
        pairs = pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array(sid[y]), pa.array(sid[x])], names=["sig", "sid", "lead"])
        yield from pa.Table.from_batches([pairs]).to_batches(max_chunksize=1 << 16)

    def shared(batches):
        """Rows come sorted; the last group of a batch waits for the next one, but a group known to be large goes out as it comes."""
        sig = sid = none = np.zeros(0, np.int64)
        at = lead = last = None  # the large group that may go on, its smallest and its last set
        for b in batches:
            if not b.num_rows:
                continue
            sig, sid = np.r_[sig, b.column("sig").to_numpy()], np.r_[sid, b.column("sid").to_numpy()]
            new = np.r_[True, (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])]
            sig, sid = sig[new], sid[new]
            if at is not None:
                k = int(np.searchsorted(sig, at, "right"))
                more = sid[:k][sid[:k] != last]
                if len(more):
                    last = more[-1]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(more), at), more, np.full(len(more), lead))], names=["sig", "sid", "lead"])
                sig, sid = sig[k:], sid[k:]
                if not len(sig):
                    continue
                at = None
            k = int(np.searchsorted(sig, sig[-1]))
            yield from listed(sig[:k], sid[:k])
            sig, sid = sig[k:], sid[k:]
            if len(sid) > FEW:
                yield from listed(sig, sid)
                at, lead, last = sig[0], sid[0], sid[-1]
                sig = sid = none
        yield from listed(sig, sid)

    rows = docs.mapInArrow(emit, "sig long, sid long").repartition("sig").sortWithinPartitions("sig", "sid")
    return materialize(rows.mapInArrow(shared, "sig long, sid long, lead long"), "jaccard-members")


def _allowed(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, ham, close) of the pairs whose sizes and dense sketches (in a distance of ham) leave a link
    possible: whether their wide sketches do so too, which large sets need as their dense ones are full."""
    side = lambda k: facts.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("data").alias(f"d_{k}"), F.col("wide").alias(f"w_{k}"))

    def close(batches):
        for t in batches:
            if not t.num_rows:
                continue
            n, m = (t.column(f"n_{k}").to_numpy() for k in "ab")
            x, y = (_Sketches(t.column(f"d_{k}").to_pylist()) for k in "ab")
            each, most = np.arange(t.num_rows), (DEN - NUM) * (n + m) // (DEN + NUM)
            ham = x.distance(each, y, each)
            ok = np.flatnonzero((DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)) & (ham <= most))
            t = t.take(pa.array(ok))
            v, w = (t.column(f"w_{k}").to_pylist() for k in "ab")
            near = [p is None or q is None or _wide_distance(p, q) <= d for p, q, d in zip(v, w, most[ok].tolist())]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(ham[ok]), pa.array(near, pa.bool_())], names=["a", "b", "ham", "close"])

    return materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(close, "a long, b long, ham long, close boolean"), "jaccard-close")


def _tested(pairs: DataFrame, docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, linked) of the pairs that the dense sketches allow; shingles of those alone move that the wide ones allow too."""
    close = _allowed(pairs, facts)
    return _verify(close.filter("close").select("a", "b"), docs, facts).unionByName(close.filter("not close").select("a", "b", F.col("close").alias("linked")))


def _verify(pairs: DataFrame, docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, linked) for the pairs (a, b) of set ids.

    Each b travels once, to its a: a task holds one a's shingles and streams its partners past
    them.  An a of many partners is sent to several tasks, ``STAR`` partners each."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    ends = pairs.join(many, "a").select(F.col("b").alias("sid"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("k")).unionByName(
        many.select(F.col("a").alias("sid"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("k")))
    to = ends.groupBy("sid").agg(F.collect_list(F.struct("a", "part", "k")).alias("to"))
    to = materialize(facts.select("sid", F.col("rep").alias("doc_id")).join(to, "sid"), "jaccard-ends")
    if to.select(F.coalesce(F.sum(F.size("to")), F.lit(0))).first()[0] <= WIDE:
        to = F.broadcast(to)
    else:
        docs = docs.filter(may_be_among(F.col("doc_id"), to.select("doc_id")))
    meet = "a long, part int, k int, sid long, items array<long>"

    def send(batches):
        for b, sets in _sets(batches):
            # a repeated doc_id may bring another text: only the set itself counts
            out = [(t, i, s.view(np.int64)) for i, to, s in zip(b.column("sid").to_pylist(), b.column("to").to_pylist(), sets)
                   if len(s) and _set_id(s) == i for t in to]
            size = np.cumsum([len(s) for *_, s in out])
            cuts = np.flatnonzero(np.diff(size // SENT)) + 1 if out else []
            for lo, hi in itertools.pairwise([0, *cuts, len(out)]):
                if part := out[lo:hi]:
                    off = np.r_[0, np.cumsum([len(s) for *_, s in part])].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t["a"] for t, *_ in part], pa.int64()), pa.array([t["part"] for t, *_ in part], pa.int32()), pa.array([t["k"] for t, *_ in part], pa.int32()),
                         pa.array([i for _, i, _ in part], pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([s for *_, s in part])))],
                        names=["a", "part", "k", "sid", "items"])

    def compare(batches):
        at = held = last = None
        for t in batches:
            off, items = t.column("items").offsets.to_numpy(), t.column("items").values.to_numpy()
            out = []
            for i, (a, part, k, sid) in enumerate(zip(*(t.column(c).to_pylist() for c in ("a", "part", "k", "sid")))):
                mine = items[off[i]:off[i + 1]].view(np.uint64)
                if k == 0:
                    at, held, last = (a, part), mine.copy(), None
                elif at == (a, part) and sid != last:
                    spot = np.searchsorted(held, mine)
                    same = int((held[np.minimum(spot, len(held) - 1)] == mine).sum())
                    out.append((a, sid, DEN * same >= NUM * (len(held) + len(mine) - same)))
                    last = sid
            kinds = (pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kinds[j]) for j in range(3)], names=["a", "b", "linked"])

    rows = docs.join(to, "doc_id").select("sid", "to", "text").mapInArrow(send, meet)
    return materialize(rows.repartition("a", "part").sortWithinPartitions("a", "part", "k", "sid").mapInArrow(compare, "a long, b long, linked boolean"), "jaccard-verified")


def _merge(label: DataFrame | None, verified: DataFrame) -> DataFrame:
    """(sid, comp) after the links among ``verified``: components of the components
    so far, so an edge counts in one round only."""
    links = verified.filter("linked").select("a", "b")
    if label is None:
        return components(links).withColumnRenamed("node", "sid")
    at = lambda k: label.select(F.col("sid").alias(k), F.col("comp").alias(f"{k}_comp"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    root = components(ends.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")))
    nodes = links.select(F.col("a").alias("sid")).union(links.select("b")).distinct().join(label, "sid", "left_anti")
    known = label.unionByName(nodes.withColumn("comp", F.col("sid")))
    up = root.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    return materialize(known.join(up, "comp", "left").select("sid", F.coalesce("root", "comp").alias("comp")), "jaccard-labels")


def _apart(pairs: DataFrame, label: DataFrame, nearest: bool) -> DataFrame:
    """The pairs (a, b, ham) of different components; with ``nearest`` only each set's closest."""
    at = lambda k: label.select(F.col("sid").alias(k), F.col("comp").alias(f"{k}_comp"))
    pairs = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").filter(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")).select("a", "b", "ham")
    if not nearest:
        return pairs
    ends = pairs.select(F.col("a").alias("sid"), F.struct("ham", "a", "b").alias("x")).unionByName(pairs.select(F.col("b").alias("sid"), F.struct("ham", "a", "b").alias("x")))
    return ends.groupBy("sid").agg(F.min("x").alias("x")).select("x.a", "x.b", "x.ham").distinct()


def _closest(cell: np.ndarray, a: np.ndarray, b: np.ndarray, ham: np.ndarray) -> list[np.ndarray]:
    """The pairs that are the closest of one of their ends in their cell."""
    ends, at = np.r_[a, b], np.tile(np.arange(len(a)), 2)
    order = np.lexsort((b[at], a[at], ham[at], ends, cell[at]))
    best = np.r_[True, (ends[order][1:] != ends[order][:-1]) | (cell[at][order][1:] != cell[at][order][:-1])]
    keep = np.unique(at[order][best])
    return [x[keep] for x in (cell, a, b, ham)]


def _near_pairs(sig, i, j, own, sid, comp, n, data: _Sketches, nearest: bool):
    """Batches (a, b, ham) of all pairs of a run of whole cells, by the distance of their rows: the rows that
    still have a partner so far on are compared at once.  About ``PAIRS`` pairs wait at a time: with ``nearest``
    only the closest of each set's go on waiting, without they leave."""
    new = np.r_[True, (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
    first = np.flatnonzero(new)
    cell = np.cumsum(new)
    end = np.repeat(np.r_[first[1:], len(sig)], np.diff(np.r_[first, len(sig)]))
    x, d, out, held, most = np.arange(len(sig)), 0, [], 0, PAIRS

    def batch(a, b, ham):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, ham)], names=["a", "b", "ham"])

    while True:
        d += 1
        x = x[x + d < end[x]]
        if not len(x):
            break
        y = x + d
        ok = (comp[x] != comp[y]) & (DEN * np.minimum(n[x], n[y]) >= NUM * np.maximum(n[x], n[y])) & ((i[x] == j[x]) | (own[x] != own[y]))
        p, q = x[ok], y[ok]
        for lo in range(0, len(p), 1 << 16):
            u, v = p[lo:lo + (1 << 16)], q[lo:lo + (1 << 16)]
            ham = data.distance(u, data, v)
            near = ham <= (DEN - NUM) * (n[u] + n[v]) // (DEN + NUM)
            u, v = u[near], v[near]
            out.append([cell[u], np.minimum(sid[u], sid[v]), np.maximum(sid[u], sid[v]), ham[near]])
            held += len(u)
        if held >= most:
            found = [np.concatenate(c) for c in zip(*out)]
            if nearest:
                out = [_closest(*found)]
                held = len(out[0][0])
                most = PAIRS + held
            else:
                yield batch(*found[1:])
                out, held = [], 0
    if out:
        found = [np.concatenate(c) for c in zip(*out)]
        if len(found[0]):
            yield batch(*(_closest(*found) if nearest else found)[1:])


def _candidates(members: DataFrame, facts: DataFrame, label: DataFrame, nearest: bool, cell: int = 2048) -> DataFrame:
    """Pairs (a, b, ham) of different components within the groups of more than ``FEW`` sets that share a word, as far as
    size and dense sketch allow; with ``nearest`` only each set's closest in a cell.

    Groups with one component are done.  Larger groups than ``cell`` are cut into
    blocks, and each pair of blocks is a cell."""
    m = members.select("sig", "sid").join(label, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    g = m.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi")
    m = m.join(g.select("sig", F.ceil(F.col("m") / cell).cast("int").alias("nb")), "sig").join(facts, "sid")
    own = F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int")
    m = m.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    m = m.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "comp", "n", "data")

    def run(batches):
        """Whole cells of each batch; the last cell waits for the next one."""
        held = None
        for t in batches:
            if not t.num_rows:
                continue
            rows = [t.column(c).to_numpy() for c in ("sig", "i", "j", "own", "sid", "comp", "n")]
            rows.append(_Sketches(t.column("data").to_pylist()))
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held[:-1], rows[:-1])] + [held[-1].join(rows[-1])]
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
            cut = len(last) - int(last.sum())
            held = [r[cut:] for r in rows]
            if cut:
                yield from _near_pairs(*(r[:cut] for r in rows), nearest)
        if held is not None:
            yield from _near_pairs(*held, nearest)

    return (m.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "sid")
            .mapInArrow(run, "a long, b long, ham long").distinct())


def _joined(docs: DataFrame, nearest_rounds: int) -> DataFrame:
    """(doc_id, sid, n, component_id) of every row of (doc_id, text)."""
    profile = _profile(docs)
    rows = profile.filter("kind = 0")
    facts = rows.filter("sid is not null and doc_id is not null").groupBy("sid").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("data").alias("data"), F.first("wide").alias("wide"))
    facts = materialize(facts, "jaccard-classes")
    members = _members(docs, _classes(profile))
    first = members.filter("lead <> sid").groupBy("sid").agg(F.min("lead").alias("lead"))
    tested = _tested(first.select(F.col("lead").alias("a"), F.col("sid").alias("b")), docs, facts)
    label = _merge(None, tested)
    listed = members.filter("sig is null").select(F.col("lead").alias("a"), F.col("sid").alias("b")).distinct()
    listed = _allowed(listed, facts).filter("close").select("a", "b", "ham")
    members = members.filter("sig is not null")
    # first each set's closest candidates, which merge most components; then all that are left
    for nearest in [True] * nearest_rounds + [False]:
        found = _candidates(members, facts.select("sid", "n", "data"), label, nearest).unionByName(_apart(listed, label, nearest)).distinct()
        found = materialize(found, "jaccard-pairs")
        if found.isEmpty():
            break
        new = _tested(found.select("a", "b").join(tested.select("a", "b"), ["a", "b"], "left_anti"), docs, facts)
        label = _merge(label, new)
        tested = tested.union(new)
        if nearest:  # a set without a closest candidate, tested before or not, has none at all, and components only grow
            ends = found.select(F.col("a").alias("sid")).union(found.select("b")).distinct()
            members = members.join(ends, "sid", "left_semi").select("sig", "sid")
    reps = facts.select("sid", "rep").join(label, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = reps.groupBy("comp").agg(F.min("rep").alias("component_id"))
    ids = materialize(reps.join(least, "comp").select("sid", "component_id"), "jaccard-components")
    return rows.join(ids, "sid", "left").select(
        "doc_id", "sid", "n", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nearest_rounds: int = 1) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    A document's set is that of its five-word shingles (a shorter text: its whole
    word sequence).  Two documents link when 100 * intersection >= 75 * union;
    component_id is the smallest doc_id reachable by links, itself included.

    A null or empty text, or one without words, has an empty set and links with nothing.  A
    row with a null doc_id makes no links; it gets the component of its equal sets, else
    null.  Repeated rows have equal sets.  An empty table gives an empty result; other columns
    are ignored.  Set ids are 64-bit hashes of the sets.
    """
    got = _joined(id_text(docs, id_col, text_col), nearest_rounds)
    return got.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest doc_id of each component only, all columns kept.

    Rows without words or without an id make no links and stay.  Rows that share an id are
    told apart by their sets: each goes or stays with its own set's component, and of rows with the
    same id and the same set one stays."""
    got = _joined(id_text(docs, id_col, text_col), 1).filter("doc_id is not null")
    got = materialize(got.groupBy("doc_id", "sid").agg(F.count(F.lit(1)).alias("m"), F.min("component_id").alias("component_id")), "jaccard-rows")
    shared = got.groupBy("doc_id").agg(F.sum("m").alias("m")).filter("m > 1").select(F.col("doc_id").alias("_shared"))
    lost = got.filter("sid is not null and component_id < doc_id").select(F.col("doc_id").alias("_lost"), F.col("sid").alias("_lost_sid"))
    key = F.col(id_col).cast("long")
    if shared.isEmpty():  # texts that stay don't move, but for the few that the filter suspects
        suspect = may_be_among(key, lost.select("_lost"))
        return docs.filter(~suspect).unionByName(docs.filter(suspect).join(lost, key == F.col("_lost"), "left_anti"))
    own, rank = "_sid", "_rank"
    while own in docs.columns or rank in docs.columns:
        own, rank = own + "_", rank + "_"
    alone = docs.join(shared, key == F.col("_shared"), "left_anti").join(lost, key == F.col("_lost"), "left_anti")

    def ids(batches):
        for b in batches:
            text = b.column(text_col).cast(pa.string()).fill_null("")
            sets = [s for _, part in _sets([pa.RecordBatch.from_arrays([text], names=["text"])]) for s in part]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64())], names=[*b.schema.names, own])

    together = docs.join(shared, key == F.col("_shared"), "left_semi").mapInArrow(ids, StructType([*docs.schema.fields, StructField(own, LongType())]))
    together = together.join(lost, (key == F.col("_lost")) & (F.col(own) == F.col("_lost_sid")), "left_anti")
    first = F.row_number().over(Window.partitionBy(id_col, own).orderBy(F.lit(1)))
    return alone.unionByName(together.withColumn(rank, F.when(F.col(own).isNull(), 1).otherwise(first)).filter(F.col(rank) == 1).drop(own, rank))
