"""Small DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(big: DataFrame, small: DataFrame) -> DataFrame:
    """Give every row of ``big`` the columns of ``small``.

    Only for a ``small`` side whose size is bounded by the model, not the data
    (an axis, a one-row aggregate, a weight matrix); it is broadcast, so the
    large side never moves.
    """
    return big.withColumn("_one", F.lit(1)).join(F.broadcast(small.withColumn("_one", F.lit(1))), "_one").drop("_one")


TARGET_PARTITION_BYTES = 128 * 1024 * 1024
#: Rows of a partition where their number, not their size, makes the work.
TARGET_PARTITION_ROWS = 2048


def right_size(df: DataFrame, n_rows: int, row_bytes: int,
               target_bytes: int = TARGET_PARTITION_BYTES, target_rows: int | None = None) -> DataFrame:
    """Narrow a materialised (persisted) frame to ~``target_bytes`` per partition, or ``target_rows`` where that is less.

    ``coalesce`` is a narrow dependency (no shuffle); it only ever lowers the
    partition count, so a large frame keeps its parallelism."""
    want = max(1, -(-int(n_rows) * int(row_bytes) // int(target_bytes)))
    if target_rows:
        want = max(want, -(-int(n_rows) // target_rows))
    have = df.rdd.getNumPartitions()
    if want >= have:
        return df
    out = df.coalesce(want).persist()
    out.count()
    df.unpersist()
    return out


def deal_groups(df: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """``df`` with groups of few bytes and much work in tasks of their own: by their number, not by their size or by a
    join's key, and in more partitions than groups, so that few share one."""
    return df.repartition(max(1, min(1024, 4 * int(groups))), *keys)
