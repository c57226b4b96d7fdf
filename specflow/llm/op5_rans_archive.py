"""Token-id archive coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus, is shared by all blocks.
A block holds whole documents in ascending doc_id order and is coded on its own with
``lanes`` interleaved 64-bit states and 32-bit renormalization words.  Every
``checkpoint_steps`` steps the block keeps the decoder's states and its word
position, so the pieces of a block decode in parallel; a CRC-32 covers the
words.  The archive is a folder with

``raw/``     the blocks' plain ids, from which the table is counted (may go once the rest is written)
``table/``   token, freq (they sum to ``2**SCALE``)
``blocks/``  part, block, first_start, doc_ids, doc_lens, lanes, every, states, words, crc
``parts/``   part, base: ids before the first of that part
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, id_text, large, workspace
from .tokens import encode, tokenizer

SCALE = 20
LOW = np.uint64(1 << 31)
RAW_SCHEMA = "part int, block long, first_start long, doc_ids array<long>, doc_lens array<long>, ids binary"
BLOCK_SCHEMA = ("part int, block long, first_start long, doc_ids array<long>, doc_lens array<long>, "
                "lanes int, every int, states binary, words binary, crc long")
DOC_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def quantize(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to ``2**scale``; every token that occurs keeps at least 1.

    The rounding rest goes to the most frequent tokens, largest first."""
    total, size = int(counts.sum()), 1 << scale
    if total == 0:
        return np.zeros_like(counts)
    freq = np.where(counts > 0, np.maximum(1, counts * size // total), 0)
    order = np.argsort(-freq, kind="stable")
    rest, i = size - int(freq.sum()), 0
    while rest:
        t = order[i % len(order)]
        step = rest if rest > 0 else -min(-rest, int(freq[t]) - 1)
        freq[t] += step
        rest -= step
        i += 1
    return freq


def rans_encode(runs: list[np.ndarray], freq: np.ndarray, lanes: int, every: int, scale: int = SCALE):
    """Code runs of ids side by side.  Returns per run (states, words): ``states``
    is a (pieces, lanes + 1) array of 64-bit decoder states and, in the last
    column, the position of the piece's first word."""
    start = np.r_[0, np.cumsum(freq)][:-1].astype(np.uint64)
    f64 = freq.astype(np.uint64)
    n = np.array([len(r) for r in runs])
    steps = -(-n // lanes)
    top = int(steps.max(initial=0))
    b = len(runs)
    x = np.full((b, lanes), LOW, np.uint64)
    out = np.zeros((top, b, lanes), np.uint32)
    emits = np.zeros((top, b, lanes), bool)
    keep = np.zeros((-(-top // every) or 1, b, lanes), np.uint64)
    keep[:] = LOW
    sym = np.zeros((top, b, lanes), np.uint32)
    live = np.zeros((top, b, lanes), bool)
    for i, r in enumerate(runs):
        s = sym[:steps[i], i].reshape(-1)
        s[:len(r)] = r
        sym[:steps[i], i] = s.reshape(-1, lanes)
        on = np.zeros(steps[i] * lanes, bool)
        on[:len(r)] = True
        live[:steps[i], i] = on.reshape(-1, lanes)
    shift, word, room = np.uint64(63 - scale), np.uint64(32), np.uint64(1 << scale)
    whole = live.all(axis=(1, 2)) if top else ()
    for t in range(top - 1, -1, -1):
        on = None if whole[t] else live[t]  # most steps have a symbol in every lane
        f = f64[sym[t]] if on is None else np.where(on, f64[sym[t]], np.uint64(1))
        full = x >= (f << shift) if on is None else on & (x >= (f << shift))
        out[t] = x.astype(np.uint32)
        emits[t] = full
        x = x >> (full * word)
        q = x // f
        new = x + q * (room - f) + start[sym[t]]  # (q << scale) + the remainder
        x = new if on is None else np.where(on, new, x)
        if t % every == 0:
            keep[t // every] = x
    coded = []
    for i in range(b):
        e = emits[:steps[i], i]
        pieces = max(1, -(-int(steps[i]) // every))
        at = np.r_[0, np.cumsum(e.sum(axis=1))]
        states = np.empty((pieces, lanes + 1), "<u8")
        states[:, :lanes] = keep[:pieces, i]
        states[:, lanes] = [at[min(p * every, len(at) - 1)] for p in range(pieces)]
        coded.append((states, out[:steps[i], i][e].astype("<u4")))
    return coded


def rans_decode(blocks: list[tuple[np.ndarray, np.ndarray, int]], freq: np.ndarray, every: int,
                scale: int = SCALE) -> list[np.ndarray]:
    """Ids of blocks given as (states, words, n_ids); all pieces run side by side."""
    if not blocks:
        return []
    start = np.r_[0, np.cumsum(freq)][:-1].astype(np.uint64)
    slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    f64 = freq.astype(np.uint64)
    lanes = blocks[0][0].shape[1] - 1
    words = np.concatenate([w for _, w, _ in blocks] + [np.zeros(lanes + 1, "<u4")]).astype(np.uint64)
    base = np.r_[0, np.cumsum([len(w) for _, w, _ in blocks])][:-1]
    pieces = [len(s) for s, _, _ in blocks]
    x = np.concatenate([s[:, :lanes] for s, _, _ in blocks]).astype(np.uint64)
    at = np.concatenate([s[:, lanes].astype(np.int64) + o for (s, _, _), o in zip(blocks, base)])
    n = np.concatenate([np.clip(k - np.arange(p) * every * lanes, 0, every * lanes)
                        for (_, _, k), p in zip(blocks, pieces)])
    order = np.argsort(-n, kind="stable")  # a step takes the first pieces, those that have ids left
    x, at, n = x[order], at[order], n[order]
    top = int(-(-n[0] // lanes))
    out = np.zeros((len(x), top, lanes), np.uint32)
    mask, word = np.uint64((1 << scale) - 1), np.uint64(32)
    for t, k in enumerate(np.searchsorted(-n, -lanes * np.arange(top))):
        y = x[:k]
        low = y & mask
        s = slot[low.view(np.int64)]
        out[:k, t] = s
        y = f64[s] * (y >> np.uint64(scale)) + low - start[s]
        need = y < LOW  # also lanes behind a piece's last id, which nothing reads any more
        last = np.cumsum(need, axis=1)
        got = words[np.minimum(at[:k, None] + last - 1, len(words) - 1)]
        x[:k] = np.where(need, (y << word) | got, y)
        at[:k] += last[:, -1]
    row = np.empty_like(order)
    row[order] = np.arange(len(order))
    res, i = [], 0
    for (_, _, k), p in zip(blocks, pieces):
        res.append(np.concatenate([out[r].reshape(-1)[:n[r]] for r in row[i:i + p]]))
        i += p
    return res


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    arrow = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    names, kinds = zip(*[f.split() for f in schema.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _raw_blocks(docs: DataFrame, vocab: str, path: str, end_id: int, block_ids: int, partitions: int, width: str) -> DataFrame:
    """Plain ids in blocks of whole documents, in ascending doc_id order."""
    def run(batches):
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids, lens, runs, held = [], [], [], 0
        for b in byte_slices(batches):
            rows = []
            flat, off = encode(vocab, large(b.column("text")), end_id)
            flat = flat.astype(width)
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                ids.append(d)
                lens.append(int(off[i + 1] - off[i]))
                runs.append(flat[off[i]:off[i + 1]])
                held += lens[-1]
                if held >= block_ids:
                    rows.append((part, block, before, ids, lens, b"".join(r.tobytes() for r in runs)))
                    block, before = block + 1, before + held
                    ids, lens, runs, held = [], [], [], 0
            if rows:
                yield _batch(rows, RAW_SCHEMA)
        if ids:
            yield _batch([(part, block, before, ids, lens, b"".join(r.tobytes() for r in runs))], RAW_SCHEMA)

    (docs.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, RAW_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/raw"))
    return docs.sparkSession.read.schema(RAW_SCHEMA).parquet(f"{path}/raw")


def _counts(raw: DataFrame, size: int, width: str) -> np.ndarray:
    """Ids counted over all documents.  The vocabulary bounds what reaches the driver."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("ids").to_pylist():
                total += np.bincount(np.frombuffer(x, width), minlength=size)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["token", "n"])

    rows = raw.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[rows["token"].to_numpy()] = rows["n"].to_numpy()
    return counts


def write_archive(docs: DataFrame, vocab: str, path: str, end_id: int = 0, block_ids: int = 1 << 15,
                  lanes: int = 32, checkpoint_steps: int = 512, partitions: int | None = None) -> None:
    """Encode all texts and write the archive below ``path``, in ascending doc_id order.

    The documents are range-partitioned by doc_id (ties by text), so part p
    holds smaller ids than part p + 1; their ids are made once, inside the sorted
    parts, counted, and then coded block by block.  Null texts count as empty;
    null doc_ids come first; repeated rows are separate documents; an empty table
    gives empty tables.
    """
    spark = docs.sparkSession
    size = max(tokenizer(vocab).get_vocab_size(with_added_tokens=True), end_id + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = _raw_blocks(id_text(docs), vocab, path, end_id, block_ids, n, width)
    freq = quantize(_counts(raw, size, width))
    spark.createDataFrame([(int(t), int(freq[t])) for t in np.flatnonzero(freq)], "token long, freq long").coalesce(1).write.parquet(f"{path}/table")

    def code(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                rows = b.slice(lo, 64).to_pylist()
                coded = rans_encode([np.frombuffer(r["ids"], width) for r in rows], freq, lanes, checkpoint_steps)
                yield _batch([(r["part"], r["block"], r["first_start"], r["doc_ids"], r["doc_lens"], lanes, checkpoint_steps,
                               states.tobytes(), w := words.tobytes(), zlib.crc32(w)) for r, (states, words) in zip(rows, coded)], BLOCK_SCHEMA)

    raw.mapInArrow(code, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    own = F.aggregate("doc_lens", F.lit(0).cast("long"), lambda a, b: a + b)
    (spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").groupBy("part").agg(F.sum(own).alias("n"))
     .select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long").alias("base"))
     .coalesce(1).write.parquet(f"{path}/parts"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Decode the archive: doc_id, start, n_tokens and the CRC-32 of each document's ids.

    A block whose words don't have their checksum raises."""
    rows = spark.read.schema("token long, freq long").parquet(f"{path}/table").toArrow()  # the vocabulary bounds it
    freq = np.zeros(int(max(rows["token"].to_pylist(), default=-1)) + 1, np.int64)
    freq[rows["token"].to_numpy()] = rows["freq"].to_numpy()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                r = b.slice(lo, 64).to_pylist()
                for x in r:
                    if zlib.crc32(x["words"]) != x["crc"]:
                        raise ValueError(f"block {x['block']} of part {x['part']}: checksum differs")
                coded = [(np.frombuffer(x["states"], "<u8").reshape(-1, x["lanes"] + 1),
                          np.frombuffer(x["words"], "<u4"), sum(x["doc_lens"])) for x in r]
                ids = rans_decode(coded, freq, r[0]["every"])
                out = [(x["part"], d, x["first_start"] + int(o), int(k), zlib.crc32(run_ids[o:o + k].astype("<u4").tobytes()))
                       for x, run_ids in zip(r, ids)
                       for d, k, o in zip(x["doc_ids"], x["doc_lens"], np.r_[0, np.cumsum(x["doc_lens"])][:-1])]
                yield _batch(out, DOC_SCHEMA)

    docs = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").mapInArrow(run, DOC_SCHEMA)
    parts = spark.read.schema("part int, base long").parquet(f"{path}/parts")  # one row per part
    return docs.join(parts, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"),
                                           "n_tokens", "ids_crc32")


def token_archive(docs: DataFrame, vocab: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the archive (below the shared folder unless ``path`` is given) and read it back."""
    path = path or workspace(docs.sparkSession, "rans")
    write_archive(docs, vocab, path, end_id)
    return read_archive(docs.sparkSession, path)
