"""Benchmark decontamination: a BM25 index of the test items, queried with every
training passage.

An item's score for a passage is the sum of the BM25 weights of its terms that the passage holds; it
is retrieved if that is at least a share of the item's score for itself.  Items stand in blocks.
As in block-max WAND, a passage first meets the blocks' largest weights: where even their sum
(with all that common terms could add) stays below the threshold, none of the block's items is scored.
Common terms stay without postings only in blocks whose items they cannot retrieve on their own.
The bound of a passage is that of its two cells, so words are looked up once.
Retrieved items count only if the passage also holds enough of their question and of their answer.
Items of a few words are looked for apart from the index, as exact sequences of words.
"""

from __future__ import annotations

import re
from functools import partial
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, id_text, large
from .shingles import MARKS, mix, word_hashes

SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
K1, B = 1.2, 0.75
_SLICE = 1 << 20
#: Block hits that are summed at a time (60 bytes each), most sums that are kept as one array, and rows that leave at a time.
_HITS, _SUMS, _ROWS = 1 << 19, 1 << 21, 1 << 16
#: Words of a part of which one may differ: it is in 3 of 8 three-word runs.
_PART = 10


def _words(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words: runs of anything but ASCII marks and white space."""
    return word_hashes(large(pc.utf8_lower(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))), MARKS)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last sentence, or the second half of
    the words of a text with one sentence."""
    cut = [m.end() for m in re.finditer(r"[.?!]\s+|\n+", text.strip())]
    if cut:
        return text.strip()[:cut[-1]], text.strip()[cut[-1]:]
    w = text.split()
    return " ".join(w[:len(w) // 2]), " ".join(w[len(w) // 2:])


def _parts(words: np.ndarray, n_question: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The runs of question and answer, and their length in words.  One word changed, dropped or
    put in anywhere leaves 0.6 of a part's runs: a part under ``_PART`` words takes words of the
    other, and an item that hasn't enough for both is one part, with shorter runs if need be."""
    n = len(words)
    if n >= 2 * _PART:
        cut = min(max(n_question, _PART), n - _PART)
        return (_grams(words[:cut]), _grams(words[cut:])), 3
    size = 3 if n >= _PART else 2 if n >= 6 else 1
    g = _grams(words, size)
    return (g, g), size


def _grams(words: np.ndarray, size: int = 3) -> np.ndarray:
    """Hashes of runs of three words, or of all words if there are fewer."""
    size = min(size, len(words))
    if size == 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        h = mix(h + words[k:len(words) - size + 1 + k])
    return h


class Sequences:
    """Short items, each found where a text holds all its words in a row."""

    def __init__(self, ids: list[int], texts: list[str]):
        words, off = _words(texts)
        by_size: dict[int, dict[int, list[int]]] = {}
        for i, lo, hi in zip(ids, off[:-1], off[1:]):
            if hi > lo:  # an item without words is held by no text
                by_size.setdefault(int(hi - lo), {}).setdefault(int(_grams(words[lo:hi], int(hi - lo))[0]), []).append(i)
        self.sizes = {n: (np.array(sorted(x), np.uint64), [x[k] for k in sorted(x)]) for n, x in by_size.items()}

    def find(self, col: pa.Array) -> list[tuple]:
        """As ``Index.find``: the first place of each item in each text, with full score and overlaps."""
        h, off = _words(col)
        text = np.repeat(np.arange(len(off) - 1), np.diff(off))
        found = []
        for n, (keys, items) in self.sizes.items():
            if len(h) < n:
                continue
            g = _grams(h, n)
            k = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            at = np.flatnonzero((keys[k] == g) & (text[:len(g)] == text[n - 1:]))
            _, one = np.unique(text[at] * len(keys) + k[at], return_index=True)  # the first of equals
            for i in at[one]:
                found += [(int(text[i]), item, 1.0, 1.0, 1.0, int(i - off[text[i]])) for item in items[k[i]]]
        return found


class Index:
    """The inverted index of one shard of items, with block maxima.  ``ids`` are the names under
    which texts are found."""

    def __init__(self, ids: list[int], texts: list[str], share: float, block: int, common: float):
        words, off = _words(texts)
        n = np.diff(off)
        order = np.argsort(n, kind="stable")  # items of like length share a block
        self.ids = np.array(ids, np.int64)[order]
        runs = [words[off[i]:off[i + 1]] for i in order]
        self.longest = int(n.max(initial=1))
        tf = [np.unique(r, return_counts=True) for r in runs]
        self.vocab, df = np.unique(np.concatenate([t for t, _ in tf]) if tf else np.zeros(0, np.uint64), return_counts=True)
        idf = np.log1p((len(tf) - df + 0.5) / (df + 0.5))
        mean = max(1.0, float(n.mean())) if len(n) else 1.0
        self.terms = [np.searchsorted(self.vocab, t) for t, _ in tf]
        w = [idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(r) / mean)) for t, (_, c), r in zip(self.terms, tf, runs)]
        self.weights = [x / x.sum() for x in w]  # relative to the item's own score
        self.share, self.block = share, block
        blocks = -(-len(tf) // block)
        rare = df <= max(1, common * len(tf))
        # what common terms add at most, and each rare term's largest weight in each of its blocks
        self.rest = np.array([max(float(x[~rare[t]].sum()) for x, t in zip(self.weights[b * block:(b + 1) * block], self.terms[b * block:(b + 1) * block]))
                              for b in range(blocks)])
        t = np.concatenate(self.terms) if tf else np.zeros(0, np.int64)
        b = np.repeat(np.arange(len(tf)) // block, [len(x) for x in self.terms])
        x = np.concatenate(self.weights) if tf else np.zeros(0)
        keep = rare[t]
        for k in np.flatnonzero(self.rest >= share - 1e-9):
            self._post_common(int(k), slice(*np.searchsorted(b, [k, k + 1])), t, x, keep, df)
        key, at = np.unique(t[keep] * blocks + b[keep], return_inverse=True)
        self.most = np.zeros(len(key))
        np.maximum.at(self.most, at, x[keep])
        self.post_block = key % max(blocks, 1)
        self.post = np.searchsorted(key // max(blocks, 1), np.arange(len(self.vocab) + 1))
        self.blocks = blocks
        asked = np.diff(_words([split_item(texts[i])[0] for i in order])[1]) if len(order) else []
        parts = [_parts(r, int(q)) for r, q in zip(runs, asked)]
        self.grams, self.sizes = [g for g, _ in parts], [size for _, size in parts]

    def _post_common(self, b: int, at: slice, t: np.ndarray, x: np.ndarray, keep: np.ndarray, df: np.ndarray) -> None:
        """Postings for the rarest of block ``b``'s common terms, until the rest of them
        adds at most half the threshold: no item is then retrieved without a hit."""
        terms, weights, posted = t[at], x[at], keep[at]
        item = np.repeat(np.arange(len(self.terms[b * self.block:(b + 1) * self.block])),
                         [len(v) for v in self.terms[b * self.block:(b + 1) * self.block]])
        common = np.unique(terms[~posted])
        common = common[np.argsort(df[common], kind="stable")]
        place = np.zeros(len(df), np.int64)
        place[common] = np.arange(len(common))
        sums = np.zeros((item[-1] + 1, len(common)))
        sums[item[~posted], place[terms[~posted]]] = weights[~posted]
        left = (sums.sum(axis=1)[:, None] - np.cumsum(sums, axis=1)).max(axis=0)
        n = int(np.argmax(left <= self.share / 2)) + 1
        posted |= np.isin(terms, common[:n])  # a view of keep
        self.rest[b] = max(0.0, float(left[n - 1]))

    def find(self, col: pa.Array) -> list[tuple]:
        """(text, item, score, question overlap, answer overlap, first word) of all
        retrieved pairs of passages and items that hold question and answer."""
        h, off = _words(col)
        if not len(h) or not self.blocks:
            return []
        step = self.longest
        term = np.searchsorted(self.vocab, h)
        term[self.vocab[np.minimum(term, len(self.vocab) - 1)] != h] = -1
        n = np.diff(off)
        cells = -(-n // step)
        first = np.r_[0, np.cumsum(cells)]
        text = np.repeat(np.arange(len(n)), n)
        cell = first[text] + (np.arange(len(h)) - off[text]) // step
        hit = np.flatnonzero(term >= 0)
        hits = np.unique(cell[hit] * len(self.vocab) + term[hit])  # a term counts once a cell
        hits = hits // len(self.vocab), hits % len(self.vocab)
        owner = np.repeat(np.arange(len(n)), cells)
        count = np.bincount(hits[0], weights=self.post[hits[1] + 1] - self.post[hits[1]], minlength=len(owner))
        part = (np.cumsum(count) - count) // _HITS
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(owner)]
        found = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            c, b = self._live(hits, first, owner, int(lo), int(hi))
            found += self._score(h, off, term, first, owner, c, b)
        return found

    def _live(self, hits: tuple, first: np.ndarray, owner: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(first cell, block) of the passages from cells ``lo`` to ``hi`` that may reach the threshold."""
        s = slice(*np.searchsorted(hits[0], [lo, hi + 1]))  # the last passage ends in cell hi
        cell, term = hits[0][s] - lo, hits[1][s]
        count = self.post[term + 1] - self.post[term]
        at = np.arange(count.sum()) + np.repeat(self.post[term] - np.r_[0, np.cumsum(count)][:-1], count)
        key = np.repeat(cell, count) * self.blocks + self.post_block[at]
        total = (hi + 1 - lo) * self.blocks
        if total <= _SUMS:
            bound = np.bincount(key, weights=self.most[at], minlength=total)
            own = np.flatnonzero(bound)
            value = bound[own]
        else:
            own, back = np.unique(key, return_inverse=True)
            value = np.bincount(back, weights=self.most[at])
        # a passage is a cell and the next one of the same text
        c = own // self.blocks + lo
        has_next = c + 1 < first[owner[c] + 1]
        has_prev = c > first[owner[c]]
        # passages that begin with a text's last cell are held by the passage before, if there is one
        begins, ends = (c < hi) & (has_next | ~has_prev), has_prev & (c > lo)
        pk, back = np.unique(np.concatenate([own[begins], own[ends] - self.blocks]), return_inverse=True)
        pv = np.bincount(back, weights=np.concatenate([value[begins], value[ends]]), minlength=len(pk))
        pk = pk[pv + self.rest[pk % self.blocks] >= self.share - 1e-9]
        return pk // self.blocks + lo, pk % self.blocks

    def _score(self, h: np.ndarray, off: np.ndarray, term: np.ndarray, first: np.ndarray, owner: np.ndarray,
               c: np.ndarray, b: np.ndarray) -> list[tuple]:
        """The retrieved items of the blocks ``b`` for the passages from the cells ``c``."""
        step = self.longest
        found, cache = [], (-1, None, None, None)
        for i in range(len(c)):
            d = int(owner[c[i]])
            lo = int(off[d] + (c[i] - first[d]) * step)
            hi = min(lo + 2 * step, int(off[d + 1]))
            if cache[0] != lo:
                inside = np.zeros(len(self.vocab) + 1, bool)
                inside[term[lo:hi]] = True
                inside[-1] = False
                cache = (lo, inside, None, None)
            for k in range(int(b[i]) * self.block, min(len(self.ids), (int(b[i]) + 1) * self.block)):
                score = float(self.weights[k][cache[1][self.terms[k]]].sum())
                if score >= self.share - 1e-9:
                    if cache[2] is None:
                        cache = (*cache[:2], [np.unique(_run_grams(h[lo:hi], s)) for s in (1, 2, 3)], None)
                    q, a = (_overlap(g, self.sizes[k], cache[2]) for g in self.grams[k])
                    found.append((d, int(self.ids[k]), score, q, a, lo - int(off[d])))
        return found


def _run_grams(words: np.ndarray, size: int) -> np.ndarray:
    return _grams(words, size) if len(words) >= size else np.zeros(0, np.uint64)


def _overlap(grams: np.ndarray, size: int, held: list[np.ndarray]) -> float:
    """Share of a part's word runs that the passage holds; 1 for a part without words."""
    return float(np.isin(grams, held[size - 1]).mean()) if len(grams) else 1.0


def shards(items: DataFrame, shard_bytes: int, min_words: int, share: float, block: int, common: float):
    """Indexes over parts of the items of about ``shard_bytes`` text bytes each, one at a time,
    each with the sequences of the part's short items and the ids of its texts: equal texts are indexed once."""
    d = id_text(items, "item_id", "text").filter("doc_id is not null")
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // shard_bytes))
    for i in range(n):
        part = d.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == i)
        rows = part.groupBy("text").agg(F.sort_array(F.collect_set("doc_id")).alias("ids")).orderBy("text").toArrow()  # bounded by shard_bytes
        ids, texts = rows["ids"].to_pylist(), rows["text"].to_pylist()
        if ids:
            long = np.diff(_words(texts)[1]) >= min_words
            yield [kind([int(k) for k in rows], [texts[k] for k in rows]) for kind, rows in (
                (partial(Index, share=share, block=block, common=common), np.flatnonzero(long)), (Sequences, np.flatnonzero(~long)))], ids


def _pairs(indexes: list, col: pa.Array, overlap: float) -> dict[tuple[int, int], tuple]:
    """The best passage of each (text, item text) that holds question and answer."""
    best: dict[tuple[int, int], tuple] = {}
    for d, item, score, q, a, at in chain.from_iterable(x.find(col) for x in indexes):
        if q >= overlap and a >= overlap:
            new = (q + a, score, -at, q, a)
            if new > best.get((d, item), (-1.0,)):
                best[d, item] = new
    return best


def _by_id(best: dict[tuple[int, int], tuple], ids: list[list[int]]):
    """(text, item id, best passage): one for each id, which may have several texts."""
    for d, found in groupby(sorted(best), key=lambda x: x[0]):
        own: dict[int, tuple] = {}
        for _, k in found:
            for item in ids[k]:
                own[item] = max(best[d, k], own.get(item, (-1.0,)))
        for item, x in own.items():
            yield d, item, x


def contaminated(docs: DataFrame, items: DataFrame, share: float = 0.6, overlap: float = 0.6, min_words: int = 8,
                 block: int = 8, common: float = 0.1, shard_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of ``docs`` and item that it holds: doc_id, item_id, score (1:
    all of the item's terms), question_overlap, answer_overlap, first_word of the passage.

    Passages are twice as long as the longest item and overlap by half, so every run of an
    item's length lies in one of them; all passages of whole texts are queries.  Overlaps
    are shares of a part's three-word runs; the answer is the last sentence, moved so that both parts have
    ten words, and items under twenty words are one part, whose overlap counts for both.  Items with fewer than ``min_words`` words are found as
    exact sequences of words (score and overlaps 1, first_word is that of the sequence).  Items without
    words, with null text or id are not looked for; ids with equal texts are all found.  Each repeated row is searched; rows with null text give
    nothing; a null doc_id stays null; other columns are ignored; empty tables give no rows.
    The index is broadcast in shards of about ``shard_bytes`` of items; idf values are those of a shard.
    """
    spark = docs.sparkSession
    d = id_text(docs)
    out = None
    for shard in shards(items, shard_bytes, min_words, share, block, common):
        held = spark.sparkContext.broadcast(shard)

        def run(batches, held=held):
            for b in byte_slices(batches, limit=_SLICE):
                indexes, names = held.value
                ids = b.column("doc_id").to_pylist()
                found = _by_id(_pairs(indexes, b.column("text"), overlap), names)
                while rows := [(ids[d], item, s, q, a, -at) for d, item, (_, s, at, q, a) in islice(found, _ROWS)]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64()])],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        got = d.mapInArrow(run, SCHEMA)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", share: float = 0.6, overlap: float = 0.6,
                  min_words: int = 8, block: int = 8, common: float = 0.1, shard_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; no shuffle."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for shard in shards(items, shard_bytes, min_words, share, block, common):
        held = spark.sparkContext.broadcast(shard)

        def run(batches, held=held):
            for b in batches:
                plain = pa.RecordBatch.from_arrays(
                    [pc.fill_null(b.column(at), ""), pa.array(np.arange(b.num_rows))], names=["text", "row"])
                keep = np.ones(b.num_rows, bool)
                for s in byte_slices([plain], limit=_SLICE):
                    row = s.column("row").to_numpy()
                    for d, _ in _pairs(held.value[0], s.column("text"), overlap):
                        keep[row[d]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
