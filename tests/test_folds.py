"""Fold assignment against a hand-worked example and a single-window formulation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF01

def test_grouped_folds_worked_by_hand(spark):
    """Sorted by value, the runs of a sample are S1@1, S3@2, S2@3, S4@4, S1@5, S5@6: folds 1 2 3 4 5 1.
    S1 has two values apart, so two runs and two folds (Q9)."""
    from specflow.operators.folds import stratify
    rows = [("p1", "S2", 3.0), ("p2", "S1", 1.0), ("p3", "S1", 1.0), ("p4", "S3", 2.0), ("p5", "S1", 5.0),
            ("p6", "S4", 4.0), ("p7", "S4", 4.0), ("p8", "S5", 6.0)]
    meta = spark.createDataFrame(rows, "pkey string, Sample_Name string, SiO2 double")
    for parts in (1, 4):
        got = stratify(meta, 5, num_partitions=parts).where(F.col("fold_col") == "SiO2_Folds")
        assert {r["pkey"]: r["fold"] for r in got.collect()} == {
            "p2": 1, "p3": 1, "p4": 2, "p1": 3, "p6": 4, "p7": 4, "p5": 5, "p8": 1}


def test_distributed_runs_equal_single_window(spark):
    """W1 over many partitions equals the single-window formulation (orders, 15k rows)."""
    from pyspark.sql import Window

    from specflow.operators.folds import grouped_folds
    from specflow.sources import tables as tb
    from specflow.sources.io import metadata_to_targets
    t = metadata_to_targets(tb.orders_meta(spark, SF01), ["totalprice"])
    ours = grouped_folds(t, 5, num_partitions=13).toPandas().set_index("pkey")["fold"]
    pairs = t.select("y", F.col("sample_name").alias("s")).distinct()
    w = Window.orderBy("y", "s")
    ch = pairs.withColumn("c", F.when(F.lag("s").over(w).isNull() | (F.lag("s").over(w) != F.col("s")), 1).otherwise(0))
    r = ch.withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    ref = t.join(r, (t["y"] == r["y"]) & (t["sample_name"] == r["s"])) \
        .select("pkey", ((F.col("run") % 5) + 1).alias("fold")).toPandas().set_index("pkey")["fold"]
    assert (ours.sort_index() == ref.sort_index()).all()


def test_ungrouped_and_loo(spark):
    from specflow.operators.folds import loo_folds, ungrouped_folds
    pdf = pd.DataFrame({"pkey": list("abcdef"), "sample_name": [None] * 6, "variable": ["v"] * 6,
                        "y": [3.0, 1.0, None, 2.0, 5.0, 4.0]})
    t = spark.createDataFrame(pdf)
    f = dict((r["pkey"], r["fold"]) for r in ungrouped_folds(t, 2).collect())
    assert f == {"b": 1, "d": 2, "a": 1, "f": 2, "e": 1, "c": -1}
    zero = dict((r["pkey"], r["fold"]) for r in ungrouped_folds(t, 0).collect())
    assert sorted(v for v in zero.values() if v != -1) == [1, 2, 3, 4, 5]  # Q10: k = 0 works
    meta = spark.createDataFrame(pd.DataFrame({"pkey": ["1", "2", "3"], "Sample_Name": ["B", "A", "B"]}))
    lf = dict((r["pkey"], r["fold"]) for r in loo_folds(meta, "sample").collect())
    assert lf == {"1": 1, "2": 0, "3": 1}


def test_split_sizes(spark):
    from specflow.operators.folds import split_sizes
    df = spark.createDataFrame([(1,), (1,), (2,), (2,), (2,), (3,), (-1,), (None,)], "fold int")
    s = {r["fold"]: (r["n_test"], r["n_train"], r["min_samples"]) for r in split_sizes(df).collect()}
    assert s == {1: (2, 4, 1), 2: (3, 3, 1), 3: (1, 5, 1)}
    s2 = {r["fold"]: r["n_train"] for r in split_sizes(df, test_fold=3).collect()}
    assert s2 == {1: 3, 2: 2}


def test_ungrouped_default_partitioning_keeps_every_row(spark):
    """W2 with the data-derived range partitioning equals the single-window form."""
    from pyspark.sql import Window

    from specflow.operators.folds import ungrouped_folds
    from specflow.sources import tables as tb
    from specflow.sources.io import metadata_to_targets
    t = metadata_to_targets(tb.customer_meta(spark, SF01), ["acctbal"])
    ours = ungrouped_folds(t, 5).toPandas().set_index("pkey")["fold"].sort_index()
    w = Window.orderBy("y", "pkey")
    ref = t.where(F.col("y").isNotNull()).select("pkey", ((F.row_number().over(w) - 1) % 5 + 1).alias("fold")) \
        .unionByName(t.where(F.col("y").isNull()).select("pkey", F.lit(-1).alias("fold"))) \
        .toPandas().set_index("pkey")["fold"].sort_index()
    assert len(ours) == 1500 and (ours == ref).all()


def test_grouped_folds_with_hot_sample(spark):
    """A sample holding a third of all rows (many values) is folded exactly like the
    single-window formulation; it collapses to its distinct values before ordering."""
    from pyspark.sql import Window

    from specflow.operators.folds import grouped_folds
    rng = np.random.default_rng(5)
    n = 3000
    samples = np.where(np.arange(n) % 3 == 0, "HOT", np.char.add("S", (rng.integers(0, 400, n)).astype(str)))
    y = np.round(rng.uniform(0, 50, n), 1)
    pdf = pd.DataFrame({"pkey": [str(i) for i in range(n)], "sample_name": samples, "variable": "v", "y": y})
    t = spark.createDataFrame(pdf)
    ours = grouped_folds(t, 5, num_partitions=7).toPandas().set_index("pkey")["fold"].sort_index()
    pairs = t.select("y", F.col("sample_name").alias("s")).distinct()
    w = Window.orderBy("y", "s")
    ch = pairs.withColumn("c", F.when(F.lag("s").over(w).isNull() | (F.lag("s").over(w) != F.col("s")), 1).otherwise(0))
    r = ch.withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    ref = t.join(r, (t["y"] == r["y"]) & (t["sample_name"] == r["s"])) \
        .select("pkey", ((F.col("run") % 5) + 1).alias("fold")).toPandas().set_index("pkey")["fold"].sort_index()
    assert len(ours) == n and (ours == ref).all()
