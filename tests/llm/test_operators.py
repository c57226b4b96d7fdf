"""Every operator against brute force on rows with the awkward cases, and on empty tables."""

import base64
import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import edge_rows, prose  # tests/ is on the path

P = pytest.importorskip("public_tokenizers")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WS = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in WS.split(text or "") if w]


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def library_ids(name, end=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids + ([] if end is None else [end]) for _, x in edge_rows()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ------------------------------------------------------------------ 1
def test_license_scan(docs, no_docs):
    from specflow.llm.op1_license_scan import BASE, license_scan, rules

    assert len(rules()) > 200
    want = []
    for d, t in edge_rows():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
        at = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        want.append((d, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    got = license_scan(docs)
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[12]["labels"] == "GPL-3.0" and by[12]["score"] == 1.0 and by[1]["labels"] == "" and by[1]["score"] == 0.0
    assert by[11]["labels"] == "CC-BY-NC-4.0,MIT,cc-by-nc,mit"  # base labels stay beside the longer detections
    assert license_scan(no_docs).count() == 0


def test_contained_detections_go(spark):
    from specflow.llm.op1_license_scan import license_scan

    d = spark.createDataFrame([(1, "Licensed under the GNU Affero General Public License v3 today")], "doc_id long, text string")
    hits = license_scan(d).first()["detections"]
    assert [h["label"] for h in hits] == ["AGPL-3.0"] and (hits[0]["s"], hits[0]["e"]) == (0, 55)


# ------------------------------------------------------------------ 2, 5, 9
def test_token_counts(docs, no_docs):
    from specflow.llm.op2_token_counts import token_counts

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        want = [(d, len((t or "").encode()), len(i), len(i) > 100) for (d, t), i in zip(edge_rows(), library_ids(name))]
        got = token_counts(docs, P.path(name), limit=100, slice_bytes=2000)
        assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts(no_docs, P.path("word_bpe_49k.json")).count() == 0


def test_every_code_point_beside_marks():
    """Each code point before and after ASCII marks, alone and behind a letter, keeps the library's ids."""
    import pyarrow as pa

    from specflow.llm import tokens

    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    groups = [f"{c}! !{c} a{c}.) " for c in points]
    texts = ["".join(groups[i:i + 50]) for i in range(0, len(groups), 50)] + ["DİKKATLİ, İyi. Gİ!", "क़! ড়. ਖ਼! ଡ଼!"]
    texts += [f"x{c}{m}y {m}{c}{m}" for c in "İक़éßΣ" for m in tokens._TAIL]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        want = [e.ids for e in tokens.tokenizer(P.path(name)).encode_batch(texts, add_special_tokens=False)]
        ids, off = tokens.encode(P.path(name), pa.array(texts, pa.large_string()))
        wrong = [t for t, lo, hi, w in zip(texts, off[:-1], off[1:], want) if ids[lo:hi].tolist() != w]
        assert not wrong, (name, len(wrong), wrong[0])


def test_new_chunks_share_a_text(monkeypatch):
    """Thousands of new chunks of a byte-level file take few texts of the library, and keep its ids."""
    import pyarrow as pa

    from specflow.llm import tokens

    path, handed = P.path("byte_bpe_50k.json"), []
    t = tokens.tokenizer(path)

    class Counting:
        def __getattr__(self, name):
            return getattr(t, name)

        def encode_batch_fast(self, texts, **more):
            handed.append(len(texts))
            return t.encode_batch_fast(texts, **more)

    words = [f"shared{i:x}é{i % 7}" if i % 3 else f"(joint{i:x}" for i in range(6000)] + ["it's", "<|endoftext|>x", "²", "日本語1", "_a", "a_"]
    texts = [" ".join(words[i:i + 40]) for i in range(0, len(words), 40)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for size in (tokens._byte_lengths(path), np.ones(1 << 17, np.int64)):  # ids that don't meet the chunks' ends: each chunk apart
        tokens._cache(path)[:] = {}, {}
        handed.clear()
        monkeypatch.setattr(tokens, "tokenizer", lambda _: Counting())
        monkeypatch.setattr(tokens, "_byte_lengths", lambda _, size=size: size)
        ids, off = tokens.encode(path, pa.array(texts, pa.large_string()))
        assert [ids[lo:hi].tolist() for lo, hi in zip(off[:-1], off[1:])] == want
        assert (sum(handed) > 6000) == (size[0] == 1 and size.min() == 1 == size.max())
    tokens._cache(path)[:] = {}, {}


def test_chunks_keep_the_ids():
    import random

    import pyarrow as pa
    from specflow.llm import tokens

    r = random.Random(4)
    alphabet = [*"ab A.,'!<|> \n\t  é́ñ1２\x00", " ", " ", "'s", "<|endoftext|>", "≠", "日"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        want = [e.ids for e in tokens.tokenizer(P.path(name)).encode_batch(texts, add_special_tokens=False)]
        ids, off = tokens.encode(P.path(name), pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want


def test_capitals_keep_the_ids():
    """Special strings in other cases are plain text; capitals are composed before they are lower-cased."""
    import random

    import pyarrow as pa
    from specflow.llm import tokens

    r = random.Random(5)
    parts = ["<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext|>", "<|StartOfText|>", "<|startoftext|>", "<|", "|>", "ENDOFTEXT", "Word", "T\u0308", "W\u030a", "I\u0307",
             "J\u030c", "\u00c9", "A\u0301", "K", " ", "  ", "\n", "!", ".", "'S", "7"]
    texts = ["<|ENDOFTEXT|>", "a <|EndOfText|> b"] + ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        want = [e.ids for e in tokens.tokenizer(P.path(name)).encode_batch(texts, add_special_tokens=False)]
        col = pa.array(texts, pa.large_string())
        ids, off = tokens.encode(P.path(name), col)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want
        assert tokens.count_tokens(P.path(name), col).tolist() == [len(w) for w in want]
    assert len(want[0]) > 1


def test_rans_archive(spark, docs, no_docs, tmp_path):
    from specflow.llm.op5_rans_archive import read_archive, token_archive, write_archive

    known = sorted(((d, i) for (d, _), i in zip(edge_rows(), library_ids("byte_bpe_50k.json", 0))), key=lambda x: (x[0] is not None, x[0]))
    want, at = [], 0
    for d, ids in known:
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    path = str(tmp_path / "a")
    write_archive(docs, P.path("byte_bpe_50k.json"), path, block_ids=700, lanes=4, checkpoint_steps=16, partitions=3)
    got = rows_of(read_archive(spark, path), "doc_id", "start", "n_tokens", "ids_crc32")
    nulls = lambda rows: Counter(r[2:] for r in rows if r[0] is None)  # noqa: E731  null ids come first, in order of their texts
    assert [r for r in got if r[0] is not None] == sorted((r for r in want if r[0] is not None), key=repr) and nulls(got) == nulls(want)
    assert token_archive(no_docs, P.path("byte_bpe_50k.json")).count() == 0
    blocks = spark.read.parquet(f"{path}/blocks")
    bad = str(tmp_path / "b")
    blocks.withColumn("crc", F.col("crc") + 1).write.parquet(f"{bad}/blocks")
    for t in ("table", "parts"):
        spark.read.parquet(f"{path}/{t}").write.parquet(f"{bad}/{t}")
    with pytest.raises(Exception, match="checksum"):
        read_archive(spark, bad).collect()


def test_rans_round_trip():
    from specflow.llm.op5_rans_archive import quantize, rans_decode, rans_encode

    r = np.random.default_rng(1)
    runs = [np.minimum(r.zipf(1.3, n), 4999).astype(np.uint32) for n in (0, 1, 31, 32, 33, 5000, 20000)]
    freq = quantize(np.bincount(np.concatenate(runs), minlength=5000), 16)
    assert freq.sum() == 1 << 16
    coded = rans_encode(runs, freq, 8, 64, 16)
    back = rans_decode([(s, w, len(x)) for (s, w), x in zip(coded, runs)], freq, 64, 16)
    assert all(np.array_equal(a, b) for a, b in zip(runs, back))
    states, word = coded[-1]  # a piece decodes alone, from its checkpoint
    part = rans_decode([(states[3:4], word, 8 * 64)], freq, 64, 16)[0]
    assert np.array_equal(part, runs[-1][3 * 512:4 * 512])


def test_packing(docs, no_docs):
    from specflow.llm.op9_packing import packing

    ids = defaultdict(list)
    for (d, _), i in zip(edge_rows(), library_ids("word_bpe_49k.json", 1)):
        ids[d].append(i)
    got = packing(docs, P.path("word_bpe_49k.json"), capacity=256, windows=4, piece=64).collect()
    assert sum(r["length"] for r in got) == sum(len(i) for x in ids.values() for i in x)
    for r in got:
        assert any(len(i) == r["doc_tokens"] and crc(i[r["start"]:r["start"] + r["length"]]) == r["ids_crc32"] for i in ids[r["doc_id"]])
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert 0 < at <= 256
    for d in {r["doc_id"] for r in got if len(ids[r["doc_id"]]) == 1}:
        runs = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == d)
        assert [s for s, _ in runs] == np.r_[0, np.cumsum([n for _, n in runs])][:-1].tolist()
        assert sum(n for _, n in runs) == len(ids[d][0])
    assert packing(no_docs, P.path("word_bpe_49k.json")).count() == 0


def test_differencing_balances():
    from specflow.llm.op9_packing import pack

    r = np.random.default_rng(2)
    sizes = r.integers(1, 513, 700)
    win = pack(sizes, 2048)
    loads = np.bincount(win, weights=sizes)
    assert len(win) == 700 and loads.max() <= 2048 and loads.max() - loads.min() < 80
    assert pack(np.array([3, 3, 3]), 4).tolist() == [0, 1, 2] or len(set(pack(np.array([3, 3, 3]), 4))) == 3  # the count rose to three
    assert len(pack(np.zeros(0, np.int64), 5)) == 0


# ------------------------------------------------------------------ 3
def components(rows):
    sets = []
    for d, t in rows:
        w = words((t or "").translate(ASCII_LOWER))
        sets.append((d, {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [i for i, (d, s) in enumerate(sets) if s and d is not None]
    for a in known:
        for b in known:
            if a < b and 100 * len(sets[a][1] & sets[b][1]) >= 75 * len(sets[a][1] | sets[b][1]):
                x, y = sorted((root(a), root(b)), key=lambda i: sets[i][0])
                parent[y] = x
    out = []
    for i, (d, s) in enumerate(sets):
        same = next((j for j in known if sets[j][1] == s), None) if d is None else i
        out.append((d, len(s), (d if not s else None) if same is None else sets[root(same)][0] if s else d))
    return out


def test_jaccard_join(spark, docs, no_docs):
    from specflow.llm.op3_jaccard_join import jaccard_join, one_of_each

    assert rows_of(jaccard_join(docs), "doc_id", "n_shingles", "component_id") == sorted(components(edge_rows()), key=repr)
    assert jaccard_join(no_docs).count() == 0
    left = one_of_each(docs)
    assert left.columns == docs.columns
    ids = Counter(r["doc_id"] for r in left.collect())
    assert 4 in ids and not {5, 6, 7, 9} & set(ids) and ids[13] == 1 and ids[1] == ids[2] == 1


def test_rows_that_share_an_id(spark):
    """A unique text stays though another row of its id goes; equal rows count once."""
    from specflow.llm.op3_jaccard_join import one_of_each

    a, b = prose(21, 50), prose(22, 50)
    rows = [(1, a, 1), (2, a, 2), (2, b, 3), (2, b + " ", 4), (3, None, 5), (3, None, 6), (3, b, 7), (None, a, 8)]
    for sid in ("_sid", "other"):
        left = one_of_each(spark.createDataFrame(rows, f"doc_id long, text string, {sid} int"))
        got = sorted(((r["doc_id"], r["text"] and r["text"].strip()) for r in left.filter("doc_id is not null").collect()), key=repr)
        assert left.columns == ["doc_id", "text", sid] and left.count() == 5
        assert got == sorted([(1, a), (2, b), (3, None), (3, None)], key=repr)


def test_jaccard_group_of_near_copies(spark, monkeypatch):
    """A few hundred near copies around the threshold, a shared passage, chains."""
    import random

    from specflow.llm.op3_jaccard_join import jaccard_join

    r = random.Random(9)
    base = prose(11, 150).split(" ")
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(300 + i, 60) + " " + prose(12, 80) + " " + prose(500 + i, 60)) for i in range(60)]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), nearest_rounds=1)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(components(rows), key=repr)
    import specflow.llm.op3_jaccard_join as op

    monkeypatch.setattr(op, "STAR", 7)
    monkeypatch.setattr(op, "WIDE", 0)
    assert sorted(got.collect()) == sorted(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())


def test_pairs_of_a_large_group_wait_in_part(monkeypatch):
    """The pairs of a group of near copies are those of brute force however few wait, and memory doesn't grow with all of them."""
    import tracemalloc

    import specflow.llm.op3_jaccard_join as op

    r = np.random.default_rng(8)

    def cells(*sizes):
        n = sum(sizes)
        bits = np.repeat(r.integers(0, 2, (1, 512)), n, axis=0) ^ (r.random((n, 512)) < r.choice([0.01, 0.15], (n, 1)))
        sid, comp = r.permutation(5 * n)[:n] - 2 * n, r.integers(0, max(2, n // 2), n)
        sig, zero = np.repeat(np.arange(len(sizes)), sizes), np.zeros(n, np.int64)
        return sig, zero, zero, zero, sid, comp, r.integers(250, 350, n), op._Sketches([np.packbits(x).tobytes() for x in bits])

    def brute(sig, i, j, own, sid, comp, n, data, nearest):
        found, each = set(), np.arange(len(sig))
        for x in each:
            for y, ham in zip(each, data.distance(np.full(len(sig), x), data, each).tolist()):
                if x < y and sig[x] == sig[y] and comp[x] != comp[y] and 100 * min(n[x], n[y]) >= 75 * max(n[x], n[y]) and ham <= op.most_difference(int(n[x]), int(n[y])):
                    found.add((int(sig[x]), ham, *sorted((int(sid[x]), int(sid[y])))))
        if nearest:
            best = {}
            for f in found:
                for end in f[2:]:
                    best[f[0], end] = min(best.get((f[0], end), f), f)
            found = set(best.values())
        return sorted((a, b, ham) for _, ham, a, b in found)

    made = cells(40, 1, 70, 2, 25)
    for most in (1, 300, 1 << 18):
        monkeypatch.setattr(op, "PAIRS", most)
        for nearest in (True, False):
            got = [tuple(x.values()) for b in op._near_pairs(*made, nearest) for x in b.to_pylist()]
            assert sorted(got) == brute(*made, nearest) and len(got) > 60
    made = cells(2048)
    for nearest in (True, False):
        tracemalloc.start()
        try:
            rows = sum(b.num_rows for b in op._near_pairs(*made, nearest))
            assert tracemalloc.get_traced_memory()[1] < 64e6 and rows >= 1000
        finally:
            tracemalloc.stop()


def test_shingles_of_large_sets_stay(spark, monkeypatch):
    """Large texts that share a passage only are told apart by their sketches, so their shingles don't move."""
    import specflow.llm.op3_jaccard_join as op

    r = np.random.default_rng(5)
    for n, m, same in [(1100, 1500, 1000), (3000, 3500, 2900), (9000, 8200, 8000)]:  # a lower bound at any sizes
        x = r.integers(0, 1 << 63, n + m - same, dtype=np.uint64)
        a, b = np.unique(x[:n]), np.unique(x[n - same:])
        assert 0 < op._wide_distance(op._wide(a), op._wide(b)) <= n + m - 2 * same
    moved, verify = [], op._verify

    def seen(pairs, *rest):
        moved.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(op, "_verify", seen)
    passage, near = prose(12, 300), prose(640, 3000)
    rows = [(i, prose(600 + i, 1400) + " " + passage + " " + prose(620 + i, 1400)) for i in range(12)]
    rows += [(50, near), (51, near + " once more"), (52, prose(641, 2) + " " + near)]
    got = op.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(components(rows), key=repr)
    assert 2 <= sum(moved) <= 3


def test_words_of_few_sets_become_pairs(spark, monkeypatch):
    """Up to FEW sets that share a word are listed as pairs, which become few; more stay a group. Batches may cut groups."""
    import specflow.llm.op3_jaccard_join as op

    rows = [(10 * i + j, prose(700 + i, 40) + " " + prose(720 + 10 * i + j, 8 + 3 * j)) for i in range(4) for j in range(4)]
    rows += [(100 + i, prose(760, 12) + " " + prose(770 + i, 5)) for i in range(9)]
    at = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    classes = np.zeros(op.COUNTERS, np.uint8)
    groups = defaultdict(set)
    for _, sets in op._sets(at.toArrow().to_batches()):
        for s in sets:
            for sig in op.signatures(s, classes).view(np.int64).tolist():
                groups[sig].add(op._set_id(s))
    for few, batch in ((8, 10000), (2, 7), (100, 1)):
        monkeypatch.setattr(op, "FEW", few)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = op._members(at, classes).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((r["sig"], r["sid"], r["lead"]) for r in got if r["sig"] is not None) == sorted((k, x, min(g)) for k, g in groups.items() if len(g) > few for x in g)
        pairs = {(x, y) for g in groups.values() if len(g) <= few for x in g for y in g if x < y}
        assert {(r["lead"], r["sid"]) for r in got if r["sig"] is None} == pairs and 0 < len(pairs) < len(got)


def test_texts_that_stay_do_not_move(spark):
    """Only rows whose id a filter of the lost ids suspects meet those by a join."""
    from specflow.llm.common import may_be_among
    from specflow.llm.op3_jaccard_join import one_of_each

    ids = spark.range(-3000, 3000).union(spark.sql("SELECT CAST(NULL AS long)"))
    keys = ids.filter("id % 10 = 0 OR id IS NULL")
    passed = ids.filter(may_be_among(F.col("id"), keys))
    assert keys.join(passed, "id", "left_anti").filter("id IS NOT NULL").isEmpty() and passed.count() < 600 + 5400 / 20
    assert ids.filter(may_be_among(F.col("id"), keys.limit(0))).isEmpty()
    rows = [(i, prose(800 + i % 30, 40), i) for i in range(40)] + [(None, prose(800, 40), 50)]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftAnti[\s\S]*hit\(", plan) and "Union" in plan
    assert sorted(r["n"] for r in got.collect()) == [*range(30), 50]


# ------------------------------------------------------------------ 4
def test_warc(spark):
    from specflow.llm.op4_warc import parse_records, read_records, warc_round_trip, write_archive

    rows = [(3, "http://a", "x"), (1, "http://b", "x"), (2, None, "x"), (7, "u\r\nv", ""), (8, "u", None), (9, "w", "é\r\n\r\nWARC/1.1\r\n" * 500),
            (9, "w", "é\r\n\r\nWARC/1.1\r\n" * 500), (None, "n", "x"), (None, "n", "alone"), (-4, "m", "neg"), (5, "m", "neg")]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, first_id int").repartition(3)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in rows:
        b, lead = (h or "").encode(), first.get(h or "")
        again = lead is not None and p != lead
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", lead if again else None))
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    got = warc_round_trip(pages)
    assert rows_of(got, *cols) == sorted(want, key=repr)
    assert {bytes(r["payload"]) for r in got.collect() if r["payload"] is not None} == {(h or "").encode() for _, _, h in rows}
    assert warc_round_trip(pages.limit(0)).count() == 0
    small = [r["record_type"] for r in warc_round_trip(pages, min_bytes=10**6).collect()]
    assert set(small) == {"response"}
    import tempfile

    path = tempfile.mkdtemp()
    write_archive(pages, f"{path}/a")
    assert parse_records(read_records(spark, f"{path}/a")).count() == len(rows)
    rec = [bytes(r["record"]) for r in read_records(spark, f"{path}/a").collect()]
    assert all(x.startswith(b"WARC/1.1\r\nWARC-Type: re") and x.endswith(b"\r\n\r\n") for x in rec)
    spark.read.parquet(f"{path}/a/records").write.parquet(f"{path}/b/records")
    spark.read.parquet(f"{path}/a/payloads").withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{path}/b/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        read_records(spark, f"{path}/b").collect()


# ------------------------------------------------------------------ 6
def test_line_dedup(docs, no_docs):
    from specflow.llm.op6_line_dedup import line_dedup

    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(ASCII_LOWER)
    where = defaultdict(list)
    for d, t in edge_rows():
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                where[k].append(d)
    keep = {k: max((d for d in ds if d is not None), default=None) for k, ds in where.items() if len(ds) >= 5}
    want = []
    for d, t in edge_rows():
        lines = (t or "").split("\n")
        left = [x for x in lines if (m := keep.get(key(x))) is None or (d is not None and d >= m)]
        want.append((d, "\n".join(left), len(lines), len(lines) - len(left)))
    got = line_dedup(docs)
    assert sum(x[3] for x in want) == 6 and got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert rows_of(got, "doc_id", "text", "n_lines", "n_dropped") == sorted(want, key=repr)
    full = line_dedup(docs, bits=1 << 20, min_docs=2)  # a small filter only suspects more
    assert full.count() == len(want)
    assert line_dedup(no_docs).count() == 0


# ------------------------------------------------------------------ 7
def test_text_statistics_and_quality(spark, docs, no_docs):
    from specflow.llm.op7_mcd_quality import keep_good, quality_rules

    want = []
    for d, t in edge_rows():
        w, text = words(t), t or ""
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if words(x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover),
                     len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality_rules(docs, prefix="q_", least_group=5)
    assert rows_of(got, "doc_id", *[f"q_{c}" for c in cols]) == sorted(want, key=repr)
    assert got.filter("q_base_failed and q_kept").count() == 0
    assert quality_rules(no_docs, prefix="q_").count() == 0
    with pytest.raises(ValueError):
        quality_rules(docs.withColumn("q_x", F.lit(1)), prefix="q_")
    assert keep_good(docs.withColumn("q_x", F.lit(1))).columns == [*docs.columns, "q_x"]


def test_robust_outliers(spark):
    """A fifth of a group is junk; the estimate isn't drawn to it, and prose stays."""
    from specflow.llm.op7_mcd_quality import keep_good

    good = [(i, prose(i, 60 + i % 50), "en", "a") for i in range(120)]
    bad = [(500 + i, " ".join(w + "%%%" for w in prose(1000 + i, 70).split()), "en", "a") for i in range(25)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    left = {r["doc_id"] for r in keep_good(d).collect()}
    assert left == set(range(120))


def test_covariance_determinant_is_the_inner_covariance(spark):
    """On a group with far points the estimate equals numpy's for the rows that it settles on."""
    from specflow.llm import op7_mcd_quality as m

    r = np.random.default_rng(3)
    x = np.round(np.r_[np.abs(r.normal(1, 0.2, (300, 6))), np.abs(r.normal(9, 0.1, (60, 6)))] / m.UNIT) * m.UNIT
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], ", ".join(["q_key string", *[f"q_{f} double" for f in m.FEATURES]]))
    est = m.covariance_determinant(rows, "q_").first()
    mu = np.array([est[f"mu_{i}"] for i in range(6)])
    assert np.abs(mu - 1).max() < 0.1
    low = np.array([[est[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(6)] for i in range(6)])
    d2 = (np.linalg.solve(low, (x - mu).T) ** 2).sum(0)
    edge = np.ceil(np.percentile(np.ceil(16 * np.log2(d2)), 75))
    inner = x[np.ceil(16 * np.log2(d2)) <= edge]
    cov = m.CONSISTENCY * np.cov(inner.T, bias=True) + np.diag(np.array(list(m.FEATURES.values())) ** 2)
    assert abs(np.linalg.slogdet(cov)[1] - est["log_det"]) < 0.05


# ------------------------------------------------------------------ 8
def test_decontamination(spark, docs, no_docs):
    from specflow.llm.op8_decontamination import contaminated, decontaminate

    items = [(1, prose(2001, 12) + ". " + prose(2002, 9)), (2, prose(2003, 25)), (3, None), (4, "too short"), (None, prose(2003, 25)),
             (5, prose(2005, 60) + "\n" + prose(2006, 20)), (5, prose(2007, 14))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    plant = lambda s, x: f"{prose(s, 200)}\n{x}\n{prose(s + 1, 77)}"
    rows = [(100, plant(3000, items[0][1])), (101, plant(3010, items[1][1].upper().replace(" ", "  "))), (102, items[5][1]), (103, prose(3020, 500)),
            (104, plant(3030, prose(2001, 12))), (105, plant(3040, items[6][1] + " " + items[1][1])), (None, plant(3050, items[1][1])), (106, None)]
    d = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, item_id string").repartition(2)
    pairs = {(100, 1), (101, 2), (102, 5), (105, 5), (105, 2), (None, 2)}
    for shard in (1 << 20, 300):  # one shard, and several
        assert {(r["doc_id"], r["item_id"]) for r in contaminated(d, bench, shard_bytes=shard).collect()} == pairs
        left = decontaminate(d, bench, shard_bytes=shard)
        assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {103, 104, 106}
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(no_docs, bench).count() == 0
    assert decontaminate(docs, bench).count() == docs.count()


def test_block_bounds_lose_nothing():
    """Retrieved pairs equal scoring every item for every passage."""
    import pyarrow as pa
    from specflow.llm.op8_decontamination import Index, _words

    texts = [prose(s, 20 + s % 30) for s in range(40)]
    docs = [prose(900 + i, 150) + " " + " ".join(texts[i % 40].split()[: 8 + i % 40]) + " " + prose(950 + i, 30) for i in range(30)]
    index = Index(list(range(40)), texts, 0.5, 4, 0.2)
    got = {(d, item, at) for d, item, _, _, _, at in index.find(pa.array(docs, pa.large_string()))}
    h, off = _words(docs)
    want = set()
    for d in range(len(docs)):
        n = int(off[d + 1] - off[d])
        last = max(1, -(-n // index.longest) - 1)
        for c in range(last):
            lo = c * index.longest
            held = set(h[off[d] + lo:off[d] + min(n, lo + 2 * index.longest)].tolist())
            for k, t in enumerate(index.terms):
                if sum(w for w, x in zip(index.weights[k], index.vocab[t].tolist()) if x in held) >= 0.5:
                    want.add((d, int(index.ids[k]), lo))
    assert got == want and want


def test_decontamination_with_a_large_group_of_items(spark):
    """A third of the items are one text under different ids, then nearly one text."""
    from specflow.llm.op8_decontamination import contaminated, decontaminate

    same = prose(2101, 30)
    rest = [(i, prose(2200 + i, 25)) for i in range(20)]
    rows = [(1, f"{prose(3101, 90)} {same} {prose(3102, 90)}"), (2, prose(3103, 150)), (3, f"{prose(3104, 60)} {rest[4][1]}")]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for copies, shard in (([same] * 10, 1200), ([f"extra{i} {same}" for i in range(10)], 1 << 20)):
        bench = spark.createDataFrame([(100 + i, x) for i, x in enumerate(copies)] + rest, "item_id long, text string").coalesce(1)
        got = [(r["doc_id"], r["item_id"]) for r in contaminated(d, bench, shard_bytes=shard).collect()]
        assert sorted(got) == [(1, 100 + i) for i in range(10)] + [(3, 4)]
        assert {r["doc_id"] for r in decontaminate(d, bench, shard_bytes=shard).collect()} == {2}


@pytest.mark.parametrize("hits", [1 << 22, 50])
def test_block_bounds_with_common_terms_only(monkeypatch, hits):
    """Items of a few words that all are common are retrieved like the others, in pieces of any size."""
    import pyarrow as pa
    from specflow.llm import op8_decontamination as o

    monkeypatch.setattr(o, "_HITS", hits)
    texts = [" ".join(f"w{(7 * i + j * j) % 13}" for j in range(12)) for i in range(40)] + [prose(2300 + i, 20) for i in range(10)]
    docs = [f"{prose(3200 + i, 60)} {texts[i]} {prose(3300 + i, 45)} {texts[49 - i]}" for i in range(50)]
    index = o.Index(list(range(50)), texts, 0.6, 4, 0.1)
    got = {(d, item, at) for d, item, _, _, _, at in index.find(pa.array(docs, pa.large_string()))}
    h, off = o._words(docs)
    want = set()
    for d in range(len(docs)):
        n = int(off[d + 1] - off[d])
        for lo in range(0, max(1, -(-n // index.longest) - 1) * index.longest, index.longest):
            held = set(h[off[d] + lo:off[d] + min(n, lo + 2 * index.longest)].tolist())
            want |= {(d, int(index.ids[k]), lo) for k, t in enumerate(index.terms)
                     if sum(w for w, x in zip(index.weights[k], index.vocab[t].tolist()) if x in held) >= 0.6 - 1e-9}
    assert got == want and {(d, d) for d in range(50)} <= {x[:2] for x in got}


def test_passages_meet_the_index_in_little_memory():
    """A worker keeps what a slice of texts needs, so 8 MB of them take a part of 100 MB, tables of hashing included."""
    import tracemalloc

    import pyarrow as pa
    from specflow.llm import op8_decontamination as o
    from specflow.llm import shingles
    from specflow.llm.common import byte_slices

    index = o.Index(list(range(200)), [prose(2600 + i, 20 + i % 40) for i in range(200)], 0.6, 8, 0.1)
    texts = pa.array([prose(3500 + i % 50, 300) for i in range(6000)], pa.large_string())
    assert texts.nbytes > 8 << 20
    shingles._powers.cache_clear()
    tracemalloc.start()
    try:
        for b in byte_slices([pa.RecordBatch.from_arrays([texts], names=["text"])], limit=o._SLICE):
            index.find(b.column("text"))
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()


def test_items_with_a_changed_word_are_found():
    """One word changed, dropped or put in at each place, whatever the length of the last sentence."""
    import pyarrow as pa
    from specflow.llm.op8_decontamination import Index, _pairs

    plain = lambda s, n: prose(s, n).replace(".", "").replace(",", "")
    texts = [f"{plain(2400 + 10 * q + a, q)}. {plain(2500 + 10 * q + a, a)}" for q in (2, 4, 9, 12, 30) for a in (1, 3, 6, 9, 10, 25) if q + a >= 8]
    index = Index(list(range(len(texts))), texts, 0.6, 8, 0.1)
    docs, want = [], []
    for k, t in enumerate(texts):
        w = t.split()
        for i in range(len(w)):
            for new in (["zzchanged"], [], [w[i], "zzadded"]):
                docs.append(f"{plain(3500 + k, 70)} {' '.join(w[:i] + new + w[i + 1:])} {plain(3600 + k, 60)}")
                want.append(k)
    got = _pairs([index], pa.array(docs, pa.large_string()), 0.6)
    assert not [(texts[k], docs[d]) for d, k in enumerate(want) if (d, k) not in got]
    halves = [" ".join(t.split()[:15]) for t in texts if len(t.split()) > 30] + [prose(3700 + i, 300) for i in range(30)]
    assert not _pairs([index], pa.array(halves, pa.large_string()), 0.6)


def test_short_items_are_word_sequences(spark):
    """Items under eight words are found as their words in a row, in one text, and not otherwise."""
    from specflow.llm.op8_decontamination import contaminated, decontaminate

    items = [(1, "What is zeal?"), (2, "Why 7 zz?\nNine yy xx ww"), (3, "zeal"), (4, "what IS zeal"), (5, "?!"), (6, ""), (7, prose(2601, 20)), (7, "zz top")]
    rows = [(1, f"{prose(3801, 40)} so, what is -- Zeal, then"), (2, "what is"), (3, "zeal what is"), (4, "why 7 zz nine yy xx ww"), (5, "why 7 zz nine yy xx"),
            (6, "Zeals what is"), (7, f"ZZ top {prose(2601, 20)} zz. TOP"), (8, None), (9, "?!"), (1, "zz top")]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["item_id"]) for r in contaminated(d, bench).collect()]
    assert sorted(got) == [(1, 1), (1, 3), (1, 4), (1, 7), (3, 3), (4, 2), (7, 7)]
    assert sorted(r["doc_id"] for r in decontaminate(d, bench).collect()) == [2, 5, 6, 8, 9]
    short = contaminated(d, bench.filter("item_id = 1"))
    assert [tuple(r) for r in short.collect()] == [(1, 1, 1.0, 1.0, 1.0, 41)]


# ------------------------------------------------------------------ 10
def without_repeats(rows, length):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0]))
    first, out = {}, {}
    for i in order:
        d, b = rows[i][0], (rows[i][1] or "").encode()
        for s in range(len(b) - length + 1):
            k = (d is not None, d or 0, s)
            first[b[s:s + length]] = min(k, first.get(b[s:s + length], k))
    for i in order:
        d, b = rows[i][0], (rows[i][1] or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < (d is not None, d or 0, s):
                gone[1 + s:1 + s + length] = True
        left = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out[i] = (d, len(b), len(b) - len(left), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest())
    return list(out.values())


@pytest.mark.parametrize("length", [100, 40])
def test_remove_repeats(docs, no_docs, length):
    from specflow.llm.op10_repeated_text import remove_repeats

    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(remove_repeats(docs, length=length), *cols) == sorted(without_repeats(edge_rows(), length), key=repr)
    if length == 100:
        assert remove_repeats(no_docs).count() == 0


def test_repeats_across_pieces_and_large_groups(spark, monkeypatch):
    from specflow.llm import op10_repeated_text as m

    monkeypatch.setattr(m, "_PIECE", 700)
    texts = ["".join(prose(s, 60)) for s in range(4)]
    col = m.large(__import__("pyarrow").array([texts[0] * 3, "", texts[1], "a" * 3000]))
    small = {tuple(x) for x in zip(*(c.tolist() for c in m.anchors(col, 100)[:2]))}
    monkeypatch.setattr(m, "_PIECE", 4 << 20)
    assert small >= {tuple(x) for x in zip(*(c.tolist() for c in m.anchors(col, 100)[:2]))}
    shared = prose(77, 30)
    rows = [(i, prose(100 + i, 15) + shared + prose(200 + i, 15)) for i in range(40)]
    ctx = m.repeated_spans
    known = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.hash("text"))
    a = {(r["doc_id"], bytes(r["spans"])) for r in ctx(known, 100).collect()}
    plain = m._compare
    monkeypatch.setattr(m, "_compare", lambda c, n: plain(c, n, index_bytes=500, group_bytes=900))
    assert a == {(r["doc_id"], bytes(r["spans"])) for r in ctx(known, 100).collect()} and len(a) == 39


def test_run_length_index():
    from specflow.llm.rlindex import RunLengthIndex, repeats

    r = np.random.default_rng(0)
    for length in (5, 9):
        base = r.integers(0, 3, 90, dtype=np.uint8).tobytes()
        texts = [base[a:a + int(r.integers(0, 50))] for a in r.integers(0, 40, 25)] + [b"", bytes(20), bytes(30)]
        raw, off = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
        name, back = {}, {}
        row, place, interval = repeats(raw, off, length)
        assert len(row) == sum(max(0, len(t) - length + 1) for t in texts)
        for a, b, c in zip(row.tolist(), place.tolist(), interval.tolist()):
            k = texts[a][b:b + length]
            assert name.setdefault(k, c) == c and back.setdefault(c, k) == k
        index = RunLengthIndex(raw, off, length)
        assert len(index.start) < len(raw) and len(index.sample) == len(index.start)
