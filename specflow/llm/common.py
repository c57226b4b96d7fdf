"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.session import ensure_checkpoint_dir

#: Text bytes that one step of a Python operator handles at a time.
SLICE_BYTES = 16 << 20
#: Largest Bloom filter.
MOST_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder that the cluster names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: recovery from a lost
    executor then rereads files instead of recomputing the lineage."""
    path = workspace(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; a null text counts as empty.
    Any other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def may_be_among(key: Column, keys: DataFrame) -> Column:
    """True where the long ``key`` is in the one column of ``keys``, and by chance for one other in 70.

    A Bloom filter, which goes to every task in place of the keys: two bits of 16 to 32 a
    key, up to ``MOST_BITS`` (16 MB); above, more keys pass by chance."""
    name = keys.columns[0]
    keys = keys.filter(F.col(name).isNotNull()).select(F.col(name).cast("long").alias("key"))
    bits = min(MOST_BITS, max(1 << 10, 1 << (16 * keys.count()).bit_length()))
    places = lambda k: [F.pmod(F.xxhash64(k, F.lit(i)), F.lit(bits)) for i in range(2)]
    made = (keys.select(F.explode(F.array(*places(F.col("key")))).alias("at"))
             .groupBy(F.shiftright("at", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(at % 8 as int)))").alias("on")).toArrow())
    on = np.zeros(bits // 8, np.uint8)
    on[made["byte"].to_numpy()] = made["on"].to_numpy()
    sent = keys.sparkSession.sparkContext.broadcast(on)

    @F.pandas_udf("boolean")
    def hit(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.to_numpy(), b.to_numpy()
        return pd.Series((sent.value[x >> 3] >> (x & 7)) & (sent.value[y >> 3] >> (y & 7)) & 1 == 1)

    return hit(*places(key))


def byte_slices(batches: Iterator[pa.RecordBatch], col: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about ``limit`` text bytes."""
    for b in batches:
        if b.num_rows == 0:
            continue
        sizes = pc.binary_length(b.column(col)).to_numpy(zero_copy_only=False)
        run = (np.cumsum(sizes) - sizes) // limit
        cuts = np.flatnonzero(np.diff(run)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows]):
            yield b.slice(int(lo), int(hi - lo))


def large(col: pa.Array) -> pa.Array:
    """Strings with 64-bit offsets, so a slice may pass 2 GB."""
    return col.cast(pa.large_string())


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without nulls, rebased to zero."""
    col = large(col)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset:]
    lo, hi = int(offs[0]), int(offs[-1])
    raw = np.frombuffer(data, dtype=np.uint8, count=hi)[lo:hi] if hi else np.zeros(0, np.uint8)
    return offs - lo, raw
