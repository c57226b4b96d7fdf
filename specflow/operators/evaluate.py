"""Error metrics and evaluation tables.

R^2 is ``1 - SSres/SStot`` (not a squared correlation); adjusted R^2 uses
``k`` = frame width - 1 of the reference's table for the operator (2 for
modelling and LOQ, 1 for applying a model).  Divisions by zero give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def r2_expr(ssres: Column, sstot: Column) -> Column:
    return F.when(sstot == 0, F.when(ssres == 0, F.lit(1.0)).otherwise(F.lit(0.0))) \
        .otherwise(1 - F.try_divide(ssres, sstot))


def adj_r2_expr(r2: Column, n: Column, k: int) -> Column:
    return 1 - F.try_divide((1 - r2) * (n - 1), (n - F.lit(k) - 1).cast("double"))


def regression_metrics(df: DataFrame, keys: list[str], actual: str = "actual", pred: str = "pred",
                       k: int = 2, prefix: str = "") -> DataFrame:
    """A1-A3 grouped by ``keys``: n, rmse, r2, adj_r2 (one pass, partial aggregation)."""
    e = F.col(actual) - F.col(pred)
    agg = df.groupBy(*keys).agg(
        F.count(F.col(actual)).alias("_n"),
        F.sum(e * e).alias("_ssres"),
        (F.var_pop(actual) * F.count(F.col(actual))).alias("_sstot"))
    r2 = r2_expr(F.col("_ssres"), F.col("_sstot"))
    return agg.select(
        *keys, F.col("_n").alias(f"n{prefix}"),
        F.sqrt(F.try_divide(F.col("_ssres"), F.col("_n").cast("double"))).alias(f"rmse{prefix}"),
        r2.alias(f"r2{prefix}"),
        adj_r2_expr(r2, F.col("_n"), k).alias(f"adj_r2{prefix}"))


def rmsecv(df: DataFrame, keys: list[str], fold: str = "fold", actual: str = "actual",
           pred: str = "pred") -> DataFrame:
    """A4: unweighted mean over folds of the per-fold RMSE."""
    e = F.col(actual) - F.col(pred)
    per = df.groupBy(*keys, fold).agg(F.sqrt(F.avg(e * e)).alias("_rmse"))
    return per.groupBy(*keys).agg(F.avg("_rmse").alias("rmsecv"), F.count(F.lit(1)).alias("n_folds"))


def pls2_cv_summary(fold_rmse: DataFrame, param: str = "param", variable: str = "variable",
                    fold: str = "fold", rmse: str = "rmse") -> DataFrame:
    """A5: per-variable RMSECV and the 'average' row = mean over folds of the
    mean over variables, via one GROUPING SETS aggregate."""
    per_fold_avg = fold_rmse.groupBy(param, fold).agg(F.avg(rmse).alias("_m"))
    by_var = fold_rmse.groupBy(param, variable).agg(F.avg(rmse).alias("rmsecv"))
    avg = per_fold_avg.groupBy(param).agg(F.avg("_m").alias("rmsecv")) \
        .select(param, F.lit("average").alias(variable), "rmsecv")
    return by_var.unionByName(avg)


def legacy_cv_msecv(df: DataFrame, order_cols: list[str], keys: list[str] | None = None,
                    actual: str = "actual", pred: str = "pred", n_splits: int = 5) -> DataFrame:
    """Contiguous K folds over the row order (first n % K folds one larger),
    mean of the per-fold MSE (the legacy 'RMSE-CV', Q21 -> named msecv)."""
    from specflow.plans.ordering import global_index
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    idx = global_index(df, [*keys, *order_cols], "_g")
    base = idx.groupBy(*keys).agg(F.min("_g").alias("_g0"), F.count(F.lit(1)).alias("_n"))
    idx = idx.join(F.broadcast(base), keys)
    r = F.col("_g") - F.col("_g0")
    q = F.floor(F.col("_n") / n_splits)
    rem = F.col("_n") % n_splits
    big = rem * (q + 1)
    fold = F.when(r < big, F.floor(r / (q + 1))).otherwise(rem + F.floor((r - big) / q))
    e = F.col(actual) - F.col(pred)
    per = idx.withColumn("_fold", fold).groupBy(*keys, "_fold").agg(F.avg(e * e).alias("_mse"))
    out = per.groupBy(*keys).agg(F.avg("_mse").alias("msecv"))
    return out.drop("_all")


def loq_table(coefs: DataFrame, pred_true: DataFrame, sensitivity: DataFrame,
              keys: list[str] = ("variable", "method")) -> DataFrame:
    """A7 + A8 + F7 + J11.

    coefs(keys, wave, coef); pred_true(keys, split in {train,test}, actual, pred);
    sensitivity(keys, sensitivity).  LOQ = 10 * ||coef||_2 * sensitivity;
    before/after-LOQ n, median (2 dp), RMSE, R^2 and adjusted R^2 (k = 2).
    """
    keys = list(keys)
    norm = coefs.groupBy(*keys).agg(F.sqrt(F.sum(F.col("coef") * F.col("coef"))).alias("_norm"))
    loq = norm.join(sensitivity, keys).select(*keys, (10 * F.col("_norm") * F.col("sensitivity")).alias("loq"))
    pt = pred_true.join(F.broadcast(loq), keys)           # one LOQ per model: bounded
    above = F.col("pred") > F.col("loq")
    a_act = F.when(above, F.col("actual"))
    a_e2 = F.when(above, F.pow(F.col("actual") - F.col("pred"), 2))
    # one pass over the predictions: before- and after-LOQ aggregates side by side
    g = pt.groupBy(*keys, "split").agg(
        F.median("actual").alias("_med"), F.count(a_act).alias("_n"), F.sum(a_e2).alias("_ss"),
        (F.var_pop(a_act) * F.count(a_act)).alias("_st"), F.median(a_act).alias("_meda"))
    r2 = r2_expr(F.col("_ss"), F.col("_st"))
    out = loq
    for split, tag in (("train", "rmsec"), ("test", "rmsep")):
        part = g.where(F.col("split") == split).select(
            *keys, F.round("_med", 2).alias(f"median_conc_{split}"),
            F.when(F.col("_n") > 0, F.col("_n")).alias(f"n_{split}_above_loq"),
            F.round("_meda", 2).alias(f"median_conc_{split}_above_loq"),
            F.sqrt(F.try_divide(F.col("_ss"), F.col("_n").cast("double"))).alias(f"{tag}_above_loq"),
            F.when(F.col("_n") > 0, r2).alias(f"r2_{split}_above_loq"),
            F.when(F.col("_n") > 0, adj_r2_expr(r2, F.col("_n"), 2)).alias(f"adj_r2_{split}_above_loq"))
        out = out.join(part, keys, "left")
    return out


def sensitivity_stats(df: DataFrame, keys: list[str], value: str = "sensitivity") -> DataFrame:
    """A9 + F12: NaN/NULL dropped; median rounded to 9 dp and mean."""
    v = F.nanvl(F.col(value), F.lit(None))
    clean = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull())
    return clean.groupBy(*keys).agg(F.round(F.median("_v"), 9).alias("median_sens"),
                                    F.avg("_v").alias("mean_sens"), F.count(F.lit(1)).alias("n"))


def equal_width_bin(v: Column, lo: Column, hi: Column, bins: Column) -> Column:
    """numpy-style bin of ``v`` among ``bins`` equal bins on [lo, hi], last bin closed.

    Edges are lo + i*(hi-lo)/bins as ``linspace`` builds them; the first
    guess is corrected against the neighbouring edges exactly as numpy does.
    """
    step = (hi - lo) / bins
    guess = F.least(F.floor((v - lo) / (hi - lo) * bins), bins - 1)
    guess = F.when(hi == lo, F.lit(0)).otherwise(guess)
    edge = lambda i: F.when(i == bins, hi).otherwise(lo + i * step)
    dec = F.when((hi != lo) & (v < edge(guess)), guess - 1).otherwise(guess)
    inc = F.when((hi != lo) & (dec != bins - 1) & (v >= edge(dec + 1)), dec + 1).otherwise(dec)
    return inc.cast("int")


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 20) -> DataFrame:
    """A10: ``bins`` equal-width bins between min and max; counts per bin."""
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    rng = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    j = df.join(F.broadcast(rng), keys)
    b = equal_width_bin(F.col(value), F.col("_lo"), F.col("_hi"), F.lit(bins))
    out = j.withColumn("bin", b).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    out = out.select(*keys, "bin", (F.col("_lo") + F.col("bin") * step).alias("bin_lo"), "count")
    return out.drop("_all")


def fd_bins(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Freedman-Diaconis bin count and range per key.

    width = 2 * IQR * n^(-1/3) from exact percentiles (linear interpolation);
    bins = ceil(range / width), 1 when the width is 0.
    """
    s = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"),
        F.percentile(value, 0.5).alias("median"))
    width = 2 * (F.col("q3") - F.col("q1")) * F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3.0))
    nb = F.when(width > 0, F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / width))).otherwise(F.lit(1))
    return s.select(*keys, "n", "lo", "hi", (F.col("q3") - F.col("q1")).alias("iqr"), "median",
                    nb.cast("int").alias("bins"))


def mean_abs_diff_all_pairs(a: DataFrame, b: DataFrame, keys: list[str], va: str, vb: str) -> DataFrame:
    """mean over all pairs (i in a, j in b) of |a_i - b_j| per key, without
    forming pairs: sort the union, running counts/sums give each a_i's
    distance total to every b_j (O(n log n))."""
    u = a.select(*keys, F.col(va).alias("_v"), F.lit(1).alias("_isa")) \
        .unionByName(b.select(*keys, F.col(vb).alias("_v"), F.lit(0).alias("_isa")))
    # b values <= current value: within ties b rows (_isa = 0) sort first
    w = Window.partitionBy(*keys).orderBy("_v", "_isa").rowsBetween(Window.unboundedPreceding, 0)
    bb = F.when(F.col("_isa") == 0, 1).otherwise(0)
    bv = F.when(F.col("_isa") == 0, F.col("_v")).otherwise(0.0)
    x = u.select(*keys, "_v", "_isa",
                 F.sum(bb).over(w).alias("_cnt_le"), F.sum(bv).over(w).alias("_sum_le"))
    tot = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb"), F.sum(vb).alias("_sb"))
    na = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na"))
    y = x.where(F.col("_isa") == 1).join(tot, keys).select(
        *keys,
        (F.col("_v") * F.col("_cnt_le") - F.col("_sum_le")
         + (F.col("_sb") - F.col("_sum_le")) - F.col("_v") * (F.col("_nb") - F.col("_cnt_le"))).alias("_d"))
    return y.groupBy(*keys).agg(F.sum("_d").alias("_sd")).join(na, keys).join(tot, keys) \
        .select(*keys, (F.col("_sd") / (F.col("_na") * F.col("_nb"))).alias("mean_abs_diff"))


def fold_representativeness(target: DataFrame, folds: DataFrame) -> DataFrame:
    """A11 + A12: FD histogram of each variable (rows with a value and fold != -1),
    the same bins per fold as fractions, mean absolute difference to the full
    histogram both over all bin pairs (Q1, the reference's broadcast) and
    bin-wise, and the best fold under each (ties -> lowest fold).

    target(pkey, variable, y); folds(pkey, variable, fold).
    """
    from specflow.session import cut_lineage
    d = target.join(folds, ["pkey", "variable"]).where(F.col("y").isNotNull() & (F.col("fold") != -1))
    d = cut_lineage(d.select("variable", "fold", "y"))
    fd = cut_lineage(fd_bins(d, ["variable"], "y"))
    j = d.join(F.broadcast(fd.select("variable", "lo", "hi", "bins")), "variable")
    # one (variable, fold, bin) row per spectrum feeds every histogram below
    j = cut_lineage(j.withColumn("bin", equal_width_bin(F.col("y"), F.col("lo"), F.col("hi"), F.col("bins")))
                    .select("variable", "fold", "bin"))
    all_h = j.groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("_c"))
    all_n = j.groupBy("variable").agg(F.count(F.lit(1)).alias("_n"))
    bins = fd.select("variable", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    all_frac = bins.join(all_h, ["variable", "bin"], "left").join(all_n, "variable") \
        .select("variable", "bin", (F.coalesce("_c", F.lit(0)) / F.col("_n")).alias("frac_all"))
    fold_list = j.select("variable", "fold").distinct()
    fh = j.groupBy("variable", "fold", "bin").agg(F.count(F.lit(1)).alias("_c"))
    fn = j.groupBy("variable", "fold").agg(F.count(F.lit(1)).alias("_n"))
    fold_frac = fold_list.join(bins, "variable").join(fh, ["variable", "fold", "bin"], "left") \
        .join(fn, ["variable", "fold"]) \
        .select("variable", "fold", "bin", (F.coalesce("_c", F.lit(0)) / F.col("_n")).alias("frac"))
    # all bin pairs, per fold: keys (variable, fold); the full histogram repeated per fold
    full_per_fold = fold_list.join(all_frac, "variable")
    pairs = mean_abs_diff_all_pairs(fold_frac, full_per_fold, ["variable", "fold"], "frac", "frac_all") \
        .withColumnRenamed("mean_abs_diff", "diff_all_pairs")
    binwise = fold_frac.join(all_frac, ["variable", "bin"]).groupBy("variable", "fold") \
        .agg(F.avg(F.abs(F.col("frac") - F.col("frac_all"))).alias("diff_binwise"))
    res = pairs.join(binwise, ["variable", "fold"])
    best = res.groupBy("variable").agg(
        F.min_by("fold", F.struct("diff_all_pairs", "fold")).alias("best_all_pairs"),
        F.min_by("fold", F.struct("diff_binwise", "fold")).alias("best_binwise"))
    return res.join(best, "variable").join(fd.select("variable", "bins", "iqr", "median"), "variable")


def plot_limits(df: DataFrame, keys: list[str], actual: str = "actual", pred: str = "pred",
                buffer: float = 0.1) -> DataFrame:
    """1:1 plot limits with a 10 % buffer; positives clamp the minimum to 0 and
    negatives move towards zero by ``value - buffer*value`` (Q19)."""
    def lo(c):
        return F.when(c > 0, F.lit(0.0)).otherwise(c - buffer * c)

    def hi(c):
        return F.when(c > 0, c + buffer * c).otherwise(F.lit(0.0))

    a = df.groupBy(*keys).agg(F.min(actual).alias("_amin"), F.max(actual).alias("_amax"),
                              F.min(pred).alias("_pmin"), F.max(pred).alias("_pmax"))
    return a.select(*keys,
                    hi(F.greatest("_amax", "_pmax")).alias("plt_max"),
                    lo(F.least("_amin", "_pmin")).alias("plt_min"),
                    lo(F.col("_amin")).alias("x_min"), hi(F.col("_amax")).alias("x_max"),
                    lo(F.col("_pmin")).alias("y_min"), hi(F.col("_pmax")).alias("y_max"))


def avg_train_rmse(rmsecv: Column, rmsec: Column) -> Column:
    """A15."""
    return (rmsecv + rmsec) / 2


def iteration_caps(meta: DataFrame, by: str = "sample", pct: float | None = None) -> DataFrame:
    """Distinct ids, default iteration cap N - 2 and ``int(pct * N)`` outlier cap
    (a pct >= 1 is a percentage)."""
    key = "Sample_Name" if by == "sample" else "pkey"
    n = meta.agg(F.count_distinct(key).alias("n_ids"))
    out = n.withColumn("max_iter", F.col("n_ids") - 2)
    if pct is not None:
        frac = pct / 100.0 if pct >= 1 else pct
        out = out.withColumn("max_outliers", F.floor(F.col("n_ids") * F.lit(frac)).cast("long"))
    return out
