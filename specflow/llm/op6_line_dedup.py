"""Line dedup by two Bloom filters.

Pass 1 gathers a filter of line hashes seen once and one of hashes seen
twice; pass 2 shuffles only lines that the second filter suspects, confirms
them on their exact keys and picks the document that keeps each; pass 3
drops the others' lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialize

SEGMENT_BITS = 1 << 20
#: Bits of a filter for each line, and its least and largest size (64 MB). Above
#: the largest more lines are suspected and shuffled; the result stays the same.
BITS_PER_LINE, LEAST_BITS, MOST_BITS = 16, SEGMENT_BITS, 1 << 29
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_SPACE = b" \t\n\r\x0b\x0c"


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _long_keys(lines: list[bytes], least: int) -> set[bytes]:
    """The different keys of at least ``least`` code points."""
    return {k for k in map(_key, lines) if len(k) >= least and (k.isascii() or len(k.decode("utf-8", "surrogatepass")) >= least)}


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two places per hash in a filter of ``bits`` (a power of two)."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return (hashes[None, :] * _MULT[:, None]) >> shift


def _twice_filter(docs: DataFrame, bits: int, least: int) -> bytes:
    """The merged filter of hashes seen in two documents or more, ``bits`` / 8 bytes."""
    segments = bits // SEGMENT_BITS

    def gather(batches):
        own = []
        for b in byte_slices(batches):
            for t in b.column("text").to_pylist():
                ks = _long_keys(_lines(t), least)
                if ks:
                    own.append(np.fromiter((xxhash.xxh3_64_intdigest(k) for k in ks), np.uint64, len(ks)))
        if not own:
            return
        h, n = np.unique(np.concatenate(own), return_counts=True)
        for seen, hashes in ((1, h), (2, h[n > 1])):
            pos = np.unique(_positions(hashes, bits))
            cut = np.searchsorted(pos, np.arange(segments + 1, dtype=np.uint64) * np.uint64(SEGMENT_BITS))
            hit = np.flatnonzero(np.diff(cut))
            if len(hit):
                data = []
                for s in hit:
                    p = (pos[cut[s]:cut[s + 1]] - np.uint64(int(s) * SEGMENT_BITS)).astype("<u4")
                    if len(p) * 32 >= SEGMENT_BITS:  # no partial is larger than the segment's bitmap
                        on = np.zeros(SEGMENT_BITS, bool)
                        on[p] = True
                        data.append(np.packbits(on).tobytes())
                    else:
                        data.append(p.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hit, pa.int32()), pa.array([seen] * len(hit), pa.int32()), pa.array(data, pa.binary())],
                    names=["segment", "seen", "data"])

    def merge(batches):
        """Partials come sorted by segment and task: one segment at a time is held."""
        at, once, twice, mine = None, None, None, None
        done = []
        for b in batches:
            for r in b.to_pylist():
                if r["segment"] != at:
                    if at is not None:
                        done.append((at, np.packbits(twice).tobytes()))
                    at, once, twice = r["segment"], np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                if len(r["data"]) * 8 == SEGMENT_BITS:
                    p = np.flatnonzero(np.unpackbits(np.frombuffer(r["data"], np.uint8)))
                else:
                    p = np.frombuffer(r["data"], "<u4")
                if r["seen"] == 2:
                    twice[p] = True
                else:
                    mine = p[once[p]]
                    twice[mine] = True
                    once[p] = True
        if at is not None:
            done.append((at, np.packbits(twice).tobytes()))
        if done:
            s, d = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(d, pa.binary())], names=["segment", "data"])

    parts = (docs.mapInArrow(gather, "segment int, seen int, data binary")
             .repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, data binary"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toArrow().to_pylist():  # at most MOST_BITS / 8 bytes
        out[r["segment"] * SEGMENT_BITS // 8:(r["segment"] + 1) * SEGMENT_BITS // 8] = np.frombuffer(r["data"], np.uint8)
    return out.tobytes()


def filter_bits(docs: DataFrame) -> int:
    """A power of two from the number of lines in all documents."""
    lines = docs.select(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (int(lines) * BITS_PER_LINE - 1).bit_length() if lines else 0))


def dropped_lines(docs: DataFrame, least: int = 40, min_docs: int = 5, bits: int | None = None) -> DataFrame:
    """(doc_id, drop): the 128-bit digests of the keys whose lines a document loses.

    ``docs`` has doc_id and text."""
    spark = docs.sparkSession
    bits = bits or filter_bits(docs)
    seen = spark.sparkContext.broadcast(_twice_filter(docs, bits, least))

    def suspects(batches):
        twice = np.frombuffer(seen.value, np.uint8)
        for b in byte_slices(batches):
            keys, ids = [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ks = sorted(_long_keys(_lines(t), least))
                keys += ks
                ids += [d] * len(ks)
            if not keys:
                continue
            h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
            p = _positions(h, bits).astype(np.int64)
            hit = np.flatnonzero(((twice[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in hit], pa.int64()), pa.array([keys[i] for i in hit], pa.binary()),
                 pa.array([xxhash.xxh3_128_digest(keys[i]) for i in hit], pa.binary())], names=["doc_id", "key", "digest"])

    found = materialize(docs.mapInArrow(suspects, "doc_id long, key binary, digest binary"), "line-suspects")
    kept = (found.groupBy("digest", "key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep"))
            .filter((F.col("n") >= min_docs) & F.col("keep").isNotNull()).select("digest", "keep"))
    lost = (found.select("doc_id", "digest").join(kept, "digest")
            .filter(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keep"))))
    return lost.groupBy("doc_id").agg(F.collect_set("digest").alias("drop"))


def line_dedup(docs: DataFrame, least: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text",
               n_lines: str = "n_lines", n_dropped: str = "n_dropped", bits: int | None = None) -> DataFrame:
    """``docs`` with the kept lines as text, and two counts under the given names.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased.  A key of at least ``least`` code points found in at least
    ``min_docs`` rows loses all its lines, except in the rows with the largest
    doc_id that hold it.  A null text is one empty line and comes back as an
    empty text.  Rows with a null doc_id lose such lines as if their id were the smallest (where
    all ids are null, nothing is lost).  Each repeated row counts as a document.
    An empty table comes back empty; other columns are kept as they are, but
    those called like a count are replaced.
    """
    docs = docs.drop(n_lines, n_dropped)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lost = dropped_lines(plain, least, min_docs, bits)
    names = docs.columns
    own = "drop"
    while own in names:
        own += "_"
    lost = lost.select(F.col("doc_id").alias(f"{own}_id"), F.col("drop").alias(own))
    both = docs.join(lost, F.col(id_col).cast("long").eqNullSafe(F.col(f"{own}_id")), "left").drop(f"{own}_id")
    schema = docs.schema.add(n_lines, "long").add(n_dropped, "long")
    at = names.index(text_col)

    def apply(batches):
        for b in batches:
            texts, n, gone = [], [], []
            for t, drop in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                lines = _lines(t)
                left = lines
                if drop:
                    drop = set(drop)
                    left = [x for x in lines if xxhash.xxh3_128_digest(_key(x)) not in drop]
                texts.append(b"\n".join(left).decode("utf-8", "surrogatepass"))
                n.append(len(lines))
                gone.append(len(lines) - len(left))
            cols = list(b.columns[:len(names)])
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
                                             names=[*names, n_lines, n_dropped])

    return both.mapInArrow(apply, schema)
