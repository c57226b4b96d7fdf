"""Global orderings without a single-partition window.

A window ``row_number() over (order by ...)`` with no partition key moves
every row into one task.  Instead the rows are range-partitioned on the
order key and sorted inside each partition, then each row's position is
``offset(partition) + position inside the partition``.  Only one number per
partition crosses the stage boundary.

Determinism: the range bounds belong to the shuffle dependency (sampled
once), the order key is unique and sorted within partitions, and the tagged
rows are persisted -- so recomputing a lost partition reproduces the same
rows in the same order and the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LOCAL_MASK = (1 << 33) - 1


ROWS_PER_RANGE = 1_000_000


def range_sorted(df: DataFrame, order_cols: list, num_partitions: int | None = None) -> DataFrame:
    """Range-partition + sort inside partitions (order key must be unique).

    The partition count is explicit so that the persisted, numbered rows and
    the per-partition sizes always describe the same partitioning; without a
    given count it follows the data: ~1M rows per range."""
    if not num_partitions:
        num_partitions = max(1, -(-df.count() // ROWS_PER_RANGE))
    return df.repartitionByRange(int(num_partitions), *order_cols).sortWithinPartitions(*order_cols)


def partition_offsets(summary: DataFrame, size_col: str, out: str = "_offset") -> DataFrame:
    """Exclusive running sum of ``size_col`` over partitions ordered by ``_pid``.

    ``summary`` has one row per non-empty partition, so this window is over
    one row for each million rows numbered.
    """
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumn(out, F.coalesce(F.sum(size_col).over(w), F.lit(0)).cast("long"))


def global_index(df: DataFrame, order_cols: list, name: str = "_gidx",
                 num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based position in the total order ``order_cols`` (must be unique)."""
    ranged = range_sorted(df, order_cols, num_partitions)
    mid = F.monotonically_increasing_id()
    tagged = ranged.select("*", F.shiftright(mid, 33).alias("_pid"),
                           mid.bitwiseAND(F.lit(_LOCAL_MASK)).alias("_local")).persist()
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = partition_offsets(sizes, "_n").select("_pid", "_offset")
    out = tagged.join(F.broadcast(offs), "_pid")
    return out.withColumn(name, F.col("_offset") + F.col("_local")).drop("_pid", "_local", "_offset")
