"""Embedding whitening with MLlib block matrices.

A vector's entries are scaled and floored to integers x.  The fit list holds each different
x once: n vectors with sums S.  Centred rows are indexed into blocks; blocks transposed and
multiplied give the scatter, whose local eigenvectors over the square roots of their
eigenvalues are the whitening matrix; the blocks of all rows times that matrix are the result.

Two things keep the products within bounds.  Before the scatter every task turns its centred
rows into their triangular factor R (R'R = C'C), so that only those move.  And since MLlib
deals the blocks of a product out by a square grid over rows and columns, a tall column of
blocks would reach the square root of the tasks only: the blocks are therefore laid out as a
square of blocks, (i, j) for the block i * side + j, against whitening matrices down the
diagonal (for the scatter, against the same factors transposed along one row for each i), which
leaves every product as it is and reaches all tasks.

Defined results: vectors that are null or hold null or non-finite entries go, and so do those
of another length than the commonest (of equally common ones the longest); entries beyond the
long range saturate.  Null and repeated ids keep their rows.  A component whose eigenvalue is 0
up to rounding has a null whitened value and isn't part of identity_error, which is null where
no component has another; explained is null where the trace is 0.  A deviation beyond the long
range is null.  An empty table gives an empty result.  Other columns are left behind.  Driver
memory holds a few matrices of width * width and two integers for each block of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of a block of rows at most; smaller tables get smaller blocks.
BLOCK_BYTES = 4 << 20

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
            .filter(F.col("v").isNotNull()).filter(~bad)
            .select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x")))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _blocks(rows: int, width: int):
    """(vec_id, x) rows -> a row for each block: its task, its number there, ids and entries."""
    schema = pa.schema([("part", pa.int32()), ("b", pa.int32()), ("ids", pa.list_(pa.int64())), ("x", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, b, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            t = table.combine_chunks()
            x = _matrix(t.column("x").chunk(0), width)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([b], pa.int32()), pa.array([t.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                                               pa.array([x.tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, rows - n)
                held.append(take)
                n += take.num_rows
                batch = batch.slice(take.num_rows)
                if n == rows:
                    yield block(pa.Table.from_batches(held))
                    b, held, n = b + 1, [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    return cut


def _opened(x: bytes, width: int) -> np.ndarray:
    return np.frombuffer(x, "<i8").reshape(-1, width)


def _add_exact(x: np.ndarray) -> list[int]:
    """Column sums as Python integers."""
    if x.size and (x.max() >= 1 << 40 or x.min() <= -(1 << 40)):
        return [int(v) for v in x.astype(object).sum(axis=0)]
    return x.sum(axis=0).tolist()


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Exact sums over dimensions of (n * x - S)^2; None beyond the long range."""
    if x.size and (x.max() >= 1 << 20 or x.min() <= -(1 << 20)):
        got = ((n * x.astype(object) - np.array(s, object)) ** 2).sum(axis=1)
    else:
        squares = (x * x).sum(axis=1).astype(object)
        cross, left, shift = 0, [abs(v) for v in s], 0
        while any(left) or shift == 0:  # S in digits of 24 bits, so that each product fits
            digit = np.array([(v & 0xFFFFFF) * (1 if whole >= 0 else -1) for v, whole in zip(left, s)], np.int64)
            cross = cross + (x @ digit).astype(object) * (1 << shift)
            left, shift = [v >> 24 for v in left], shift + 24
        got = n * n * squares - 2 * n * cross + sum(v * v for v in s)
    return [int(v) if v < 1 << 63 else None for v in got]


def _factor(width: int, mean: np.ndarray):
    """Distinct rows -> the triangular factor of the task's centred rows."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            if b.num_rows:
                c = _matrix(b.column("x"), width) - mean
                r = np.linalg.qr(c if r is None else np.vstack([r, c]), mode="r")
        if r is not None:
            square = np.zeros((width, width))
            square[:len(r)] = r
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([square.tobytes()], pa.binary())], names=["k", "r"])

    return fold


def _scatter(fit: DataFrame, width: int, mean: np.ndarray) -> np.ndarray:
    """C'C of the centred fit list, as products of transposed blocks and blocks."""
    factors = fit.select("x").mapInArrow(_factor(width, mean), "k int, r binary").rdd
    side = int(np.ceil(np.sqrt(max(1, factors.getNumPartitions()))))

    def square(data: bytes, turned: bool) -> DenseMatrix:
        return DenseMatrix(width, width, np.frombuffer(data).copy(), isTransposed=not turned)  # row by row; turned: its transpose

    left = BlockMatrix(factors.map(lambda f: ((f["k"] // side, f["k"]), square(f["r"], True))), width, width, side * width, side * side * width)
    right = BlockMatrix(factors.map(lambda f: ((f["k"], f["k"] % side), square(f["r"], False))), width, width, side * side * width, side * width)
    return left.multiply(right).blocks.map(lambda b: b[1].toArray()).treeReduce(np.add)


def _project(blocks: DataFrame, base: dict[int, int], n_blocks: int, rows: int, width: int, mean: np.ndarray, white: np.ndarray) -> DataFrame:
    """(loc, w) of all rows: blocks of centred rows times the whitening matrix."""
    spark = blocks.sparkSession
    comps, side = white.shape[1], int(np.ceil(np.sqrt(n_blocks)))

    def centred(f) -> tuple:
        k, x = base[f["part"]] + f["b"], _opened(bytes(f["x"]), width)
        c = np.zeros((rows, width))
        c[:len(x)] = x - mean
        return (k // side, k % side), DenseMatrix(rows, width, c.ravel(), isTransposed=True)

    all_rows = BlockMatrix(blocks.select("part", "b", "x").rdd.map(centred), rows, width, side * rows, side * width)
    down = spark.sparkContext.parallelize(range(side), min(side, 64)).map(lambda j: ((j, j), DenseMatrix(width, comps, white.ravel(), isTransposed=True)))
    got = all_rows.multiply(BlockMatrix(down, width, comps, side * width, side * comps)).blocks
    flat = spark.createDataFrame(got.map(lambda b: ((b[0][0] * side + b[0][1]), bytearray(np.ascontiguousarray(b[1].toArray()).tobytes()))), "k int, w binary")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, w in zip(b.column("k").to_pylist(), b.column("w").to_pylist()):
                loc = np.arange(k * rows, (k + 1) * rows, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(loc), pa.array(np.frombuffer(w).reshape(rows, comps).tolist(), pa.list_(pa.float64()))], names=["loc", "w"])

    return flat.mapInArrow(each, "loc long, w array<double>")


def whitened(vectors: DataFrame, components: int = 4, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row and component."""
    spark = vectors.sparkSession
    ints = _integers(vectors, id_col, vec_col, scale)
    lengths = ints.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not lengths or lengths[0]["width"] == 0:
        return spark.createDataFrame([], OUT)
    width, total = lengths[0]["width"], lengths[0]["count"]
    rows = int(max(1, min(BLOCK_BYTES // (8 * width), max(256, total // 256))))
    blocks = materialize(ints.filter(F.size("x") == width).mapInArrow(_blocks(rows, width), "part int, b int, ids array<long>, x binary"), "vector-blocks")
    base, at = {}, 0
    for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect():  # one row for each task that wrote
        base[r["part"]] = at
        at += r["n"]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, i, x in zip(*(b.column(c).to_pylist() for c in ("part", "b", "x"))):
                m = _opened(x, width)
                loc = (base[part] + i) * rows + np.arange(len(m), dtype=np.int64)
                lists = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * width, pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(loc), lists], names=["loc", "x"])

    fit = materialize(blocks.select("part", "b", "x").mapInArrow(rows_of, "loc long, x array<long>").groupBy("x").agg(F.min("loc").alias("loc")), "fit-list")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, [0] * width
        for b in batches:
            n += b.num_rows
            s = [p + q for p, q in zip(s, _add_exact(_matrix(b.column("x"), width)))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([str(v) for v in [n, *s]])], names=["dim", "s"])

    got = dict(fit.select("x").mapInArrow(sums, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    n, s = int(got[-1]), [int(got[i]) for i in range(width)]
    mean = np.array([v / n for v in s])

    cov = _scatter(fit, width, mean) / n
    values, directions = np.linalg.eigh((cov + cov.T) / 2)
    values, directions = values[::-1], directions[:, ::-1]
    shown = min(components, width)
    usable = [bool(v > width * np.finfo(float).eps * values[0]) for v in values[:shown]]
    white = np.column_stack([directions[:, i] / np.sqrt(values[i]) if usable[i] else np.zeros(width) for i in range(shown)])
    projected = materialize(_project(blocks, base, at, rows, width, mean, white), "projected")

    seen = [i for i in range(shown) if usable[i]]
    error = None
    if seen:
        pairs = [(i, j) for i in seen for j in seen if i <= j]
        over = projected.join(fit.select("loc"), "loc").agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
        error = max(abs(v - (i == j)) for (i, j), v in zip(pairs, over))

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, i, ids, x in zip(*(b.column(c).to_pylist() for c in ("part", "b", "ids", "x"))):
                m = _opened(x, width)
                yield pa.RecordBatch.from_arrays([pa.array((base[part] + i) * rows + np.arange(len(m), dtype=np.int64)), pa.array(ids, pa.int64()),
                                                  pa.array(deviations(m, n, s), pa.int64())], names=["loc", "vec_id", "deviation"])

    trace = float(values.sum())
    explained = F.array(*[F.lit(float(values[i] / trace) if trace > 0 else None).cast("double") for i in range(shown)])
    used = F.array(*[F.lit(u) for u in usable])
    ids = blocks.mapInArrow(light, "loc long, vec_id long, deviation long")
    return (ids.join(projected, "loc").select("vec_id", "deviation", F.posexplode("w").alias("k", "w"))
            .select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                    F.when(used[F.col("k")], F.col("w")).alias("whitened"), explained[F.col("k")].alias("explained"),
                    F.lit(error).cast("double").alias("identity_error")))
