"""Fold assignment and fold bookkeeping.

Grouped stratified folds (W1): rows sorted by (value, sample); a new fold
starts at every change of sample, cycling 1..k; k = 0 gives every run its
own fold; a missing value gets fold -1.  Runs are found on the distinct
(value, sample) pairs, so a hot sample holding a third of all rows
collapses to a handful of pairs before any ordering work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specflow.plans.ordering import global_index, range_sorted
from specflow.session import cut_lineage

_RUN_SCHEMA = T.StructType([
    T.StructField("variable", T.StringType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("s", T.StringType()),
    T.StructField("_pid", T.IntegerType()),
    T.StructField("_local", T.LongType()),
    T.StructField("_lrun", T.LongType()),
])


def _local_runs(batches):
    """Per sorted partition: local run index (0 at the partition's first row)."""
    import numpy as np
    import pandas as pd
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    prev_var, prev_s, run, pos = None, None, -1, 0
    for b in batches:
        if len(b) == 0:
            continue
        var = b["variable"].to_numpy(dtype=object)
        s = b["s"].to_numpy(dtype=object)
        pv = np.empty(len(b), dtype=object)
        ps = np.empty(len(b), dtype=object)
        pv[0], ps[0] = prev_var, prev_s
        pv[1:], ps[1:] = var[:-1], s[:-1]
        null_s = pd.isna(s)
        change = (var != pv) | (s != ps) | null_s
        if pos == 0:
            change[0] = True
        runs = run + np.cumsum(change)
        out = pd.DataFrame({"variable": var, "y": b["y"].to_numpy(), "s": s,
                            "_pid": np.int32(pid),
                            "_local": np.arange(pos, pos + len(b), dtype=np.int64),
                            "_lrun": runs.astype(np.int64)})
        run = int(runs[-1])
        prev_var, prev_s = var[-1], s[-1]
        pos += len(b)
        yield out


def _fold_expr(run: F.Column, n_folds: int) -> F.Column:
    return (run + 1) if n_folds == 0 else (run % n_folds) + 1


def grouped_folds(target: DataFrame, n_folds: int = 5,
                  num_partitions: int | None = None) -> DataFrame:
    """W1 on ``target(pkey, sample_name, variable, y)`` -> ``(pkey, variable, fold)``.

    Sort key is (variable, y, sample); runs restart per variable.
    """
    t = target.select("pkey", "variable", "y",
                      F.coalesce("sample_name", F.concat(F.lit("\uffff"), "pkey")).alias("s"))
    pairs = t.where(F.col("y").isNotNull()).select("variable", "y", "s").distinct()
    ranged = range_sorted(pairs, ["variable", "y", "s"], num_partitions)
    # one row per distinct (variable, value, sample): persisted because it feeds
    # the partition summary and the numbering; recomputation after a lost
    # executor repeats the range sort on a unique key, so it gives the same rows
    runs = ranged.mapInPandas(_local_runs, _RUN_SCHEMA).persist()
    summ = runs.groupBy("_pid").agg(
        F.max("_lrun").alias("_last_run"),
        F.min_by("variable", "_local").alias("_fv"), F.min_by("s", "_local").alias("_fs"),
        F.max_by("variable", "_local").alias("_lv"), F.max_by("s", "_local").alias("_ls"))
    w = Window.orderBy("_pid")
    # base of partition p = base of previous non-empty partition + its run count
    # (+1 unless the previous partition ends inside the same run)
    summ = summ.select(
        "_pid",
        F.when(F.lag("_pid").over(w).isNull(), F.lit(0)).otherwise(
            F.lag("_last_run").over(w) +
            F.when((F.lag("_lv").over(w) == F.col("_fv")) & (F.lag("_ls").over(w) == F.col("_fs"))
                   & ~F.col("_fs").startswith("\uffff"), 0).otherwise(1)).alias("_inc"),
        "_fv", "_lv")
    summ = summ.withColumn("_base", F.sum("_inc").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # run indices restart at 0 for every variable: subtract the first run of the variable
    numbered = runs.join(F.broadcast(summ.select("_pid", "_base")), "_pid") \
        .withColumn("_grun", F.col("_base") + F.col("_lrun"))
    first_run = numbered.groupBy("variable").agg(F.min("_grun").alias("_r0"))
    numbered = numbered.join(F.broadcast(first_run), "variable") \
        .select("variable", "y", "s", (F.col("_grun") - F.col("_r0")).alias("_run"))
    folded = numbered.select("variable", "y", "s", _fold_expr(F.col("_run"), n_folds).cast("int").alias("fold"))
    joined = t.join(folded, ["variable", "y", "s"], "left")
    out = joined.select("pkey", "variable", F.coalesce("fold", F.lit(-1)).cast("int").alias("fold"))
    # the fold table is small next to the spectra and feeds many jobs: write it
    # once to the shared checkpoint folder instead of replaying the ordering
    out = cut_lineage(out)
    runs.unpersist()
    return out


def ungrouped_folds(target: DataFrame, n_folds: int = 5,
                    num_partitions: int | None = None) -> DataFrame:
    """Rows sorted by (variable, y, pkey); fold = position % k + 1 per variable."""
    t = target.select("pkey", "variable", "y")
    present = t.where(F.col("y").isNotNull())
    idx = global_index(present, ["variable", "y", "pkey"], "_g", num_partitions)
    first = idx.groupBy("variable").agg(F.min("_g").alias("_g0"))
    idx = idx.join(F.broadcast(first), "variable").withColumn("_r", F.col("_g") - F.col("_g0"))
    folded = idx.select("pkey", "variable", _fold_expr(F.col("_r"), n_folds).cast("int").alias("fold"))
    missing = t.where(F.col("y").isNull()).select("pkey", "variable", F.lit(-1).alias("fold"))
    return cut_lineage(folded.unionByName(missing))


def row_sum_target(meta: DataFrame, variables: list[str], sample_col: str | None = "Sample_Name") -> DataFrame:
    """Per row the sum over all variables, NULL when any variable (or the
    sample name, Q11) is missing -> tall target with variable ``sum``."""
    any_null = F.lit(False)
    for v in variables:
        any_null = any_null | F.col(f"`{v}`").isNull() | F.isnan(F.col(f"`{v}`"))
    if sample_col and sample_col in meta.columns:
        any_null = any_null | F.col(f"`{sample_col}`").isNull()
    total = sum((F.col(f"`{v}`").cast("double") for v in variables), F.lit(0.0))
    return meta.select(
        F.col("pkey").cast("string").alias("pkey"),
        (F.col(f"`{sample_col}`").cast("string") if sample_col and sample_col in meta.columns
         else F.lit(None).cast("string")).alias("sample_name"),
        F.lit("sum").alias("variable"),
        F.when(any_null, F.lit(None).cast("double")).otherwise(total).alias("y"))


def stratify(meta: DataFrame, n_folds: int = 5, num_partitions: int | None = None) -> DataFrame:
    """The reference's stratify step -> tall ``(pkey, fold_col, fold)``.

    One fold column per variable (``<var>_Folds``) and, with two or more
    variables, the general ``Folds`` column from the row sum.  Grouped when
    the metadata has ``Sample_Name``.
    """
    from specflow.sources.io import metadata_to_targets
    variables = [c for c in meta.columns if c not in ("index", "pkey", "Sample_Name")]
    if not variables:
        raise ValueError("no variables identified to stratify")
    has_sample = "Sample_Name" in meta.columns
    if has_sample:
        tall = metadata_to_targets(meta, variables)
    else:
        tall = meta.select(F.col("pkey").cast("string").alias("pkey"),
                           F.lit(None).cast("string").alias("sample_name"),
                           *[F.col(f"`{v}`").cast("double").alias(v) for v in variables]) \
            .unpivot(["pkey", "sample_name"], variables, "variable", "y")
    if len(variables) > 1:
        tall = tall.unionByName(row_sum_target(meta, variables, "Sample_Name" if has_sample else None))
    fn = grouped_folds if has_sample else ungrouped_folds
    folds = fn(tall, n_folds, num_partitions)
    return folds.select("pkey",
                        F.when(F.col("variable") == "sum", F.lit("Folds"))
                        .otherwise(F.concat("variable", F.lit("_Folds"))).alias("fold_col"),
                        "fold")


def loo_folds(meta: DataFrame, by: str = "sample", num_partitions: int | None = None) -> DataFrame:
    """Leave-one-out fold ids, 0-based: one per distinct sample or per spectrum."""
    key = "Sample_Name" if by == "sample" else "pkey"
    ids = meta.select(F.col(key).cast("string").alias("_k")).distinct()
    idx = global_index(ids, ["_k"], "_fold", num_partitions)
    return meta.select(F.col("pkey").cast("string").alias("pkey"), F.col(key).cast("string").alias("_k")) \
        .join(idx, "_k").select("pkey", F.col("_k").alias("id"), F.col("_fold").cast("int").alias("fold"))


def resolve_fold(folds: DataFrame, variable: str) -> DataFrame:
    """``<var>_Folds`` if present for the row, else the general ``Folds``."""
    spec = folds.where(F.col("fold_col") == f"{variable}_Folds").select("pkey", F.col("fold").alias("_f1"))
    gen = folds.where(F.col("fold_col") == "Folds").select("pkey", F.col("fold").alias("_f2"))
    return spec.join(gen, "pkey", "full").select("pkey", F.coalesce("_f1", "_f2").alias("fold"))


def split_sizes(folded: DataFrame, test_fold: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """A14 + F6 + U3: per CV fold the train/test sizes and the minimum over all.

    ``folded`` has ``keys..., fold``.  Rows with fold -1 or NULL never enter
    training (Q4 decided: excluded); the test fold is removed first (Q23).
    """
    if not keys:
        folded, keys = folded.withColumn("_all", F.lit(0)), ["_all"]
    f = folded.where(F.col("fold").isNotNull() & (F.col("fold") != -1))
    if test_fold is not None:
        f = f.where(F.col("fold") != test_fold)
    per = f.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("n_test"))
    tot = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    per = per.join(tot, keys)
    per = per.withColumn("n_train", F.col("_n") - F.col("n_test")).drop("_n")
    mins = per.groupBy(*keys).agg(F.least(F.min("n_train"), F.min("n_test")).alias("min_samples"))
    out = per.join(mins, keys)
    return out.drop("_all") if "_all" in keys else out
