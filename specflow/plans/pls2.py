"""Multi-target PLS.

One model predicts every variable.  Fold moments carry all targets (the
augmented Gram has one column per variable), so the CV for every
component count and variable comes from one recursion per split.  The
component used for the final fit defaults to the first local minimum of
the 'average' RMSECV (mean over folds of the mean over variables).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specflow.functions import grids, linalg
from specflow.operators import moments, selection
from specflow.session import cut_lineage

KEY = "_model"


def complete_rows(targets: DataFrame, variables: list[str]) -> DataFrame:
    """keep spectra with a value for every variable -> wide ``(pkey, v1..vm)``."""
    t = targets.where(F.col("variable").isin(*variables))
    w = t.groupBy("pkey").pivot("variable", variables).agg(F.first("y"))
    cond = F.lit(True)
    for v in variables:
        cond = cond & F.col(f"`{v}`").isNotNull()
    return w.where(cond)


def _cv_fn(variables, max_components):
    m = len(variables)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(max(pdf["i"].max(), pdf["j"].max())) + 1
        part = lambda k: pdf[pdf["kind"] == k]
        tot = linalg.Moments.from_upper(part("total")["i"].to_numpy(), part("total")["j"].to_numpy(),
                                        part("total")["v"].to_numpy(), size, m)
        tst = linalg.Moments.from_upper(part("test")["i"].to_numpy(), part("test")["j"].to_numpy(),
                                        part("test")["v"].to_numpy(), size, m)
        tr = tot - tst
        mx, my, C, c = tr.centred()
        path = linalg.pls_path(C, c, max_components)
        rows = []
        split = int(pdf["split"].iloc[0])
        for a in range(2, max_components + 1):
            B = path[a - 1]
            b0 = my - mx @ B
            for col, v in enumerate(variables):
                sse = max(float(tst.sse(B[:, [col]], np.array([b0[col]]), col)[0]), 0.0)
                rows.append((split, a, v, sse, int(round(tst.n))))
        return pd.DataFrame(rows, columns=["split", "components", "variable", "sse", "n_test"])
    return fn


def _fit_fn(variables, shifts, comp_col="components"):
    m = len(variables)

    def fn(mom: pd.DataFrame, ch: pd.DataFrame) -> pd.DataFrame:
        size = int(max(mom["i"].max(), mom["j"].max())) + 1
        G = linalg.Moments.from_upper(mom["i"].to_numpy(), mom["j"].to_numpy(), mom["v"].to_numpy(), size, m)
        a = int(ch[comp_col].iloc[0])
        mx, my, C, c = G.centred()
        B = linalg.pls_path(C, c, a)[a - 1]
        cx, cy = shifts[(0,)]
        b0 = my - mx @ B + np.asarray(cy) - np.asarray(cx) @ B
        return pd.DataFrame({"variable": variables, "components": a, "intercept": b0,
                             "coef": [B[:, k].tolist() for k in range(m)]})
    return fn


def pls2_report(spectra_vec: DataFrame, targets: DataFrame, folds: DataFrame, variables: list[str],
                max_components: int = grids.DEFAULT_MAX_COMPONENTS, components: int | None = None,
                has_sample_name: bool = False) -> dict:
    """folds: ``(pkey, fold)`` from the general ``Folds`` column (required)."""
    if len(variables) < 2:
        raise ValueError("PLS2 requires multiple y variables")
    wide = complete_rows(targets, variables)
    ycols = [f"_y{k}" for k in range(len(variables))]
    data = wide.select("pkey", *[F.col(f"`{v}`").cast("double").alias(c) for v, c in zip(variables, ycols)]) \
        .join(folds.select("pkey", "fold"), "pkey").join(spectra_vec, "pkey") \
        .withColumn(KEY, F.lit(0)).persist()
    from specflow.functions.frames import TARGET_PARTITION_ROWS, right_size
    data = right_size(data, data.count(), 8 * (data.select(F.max(F.size("x"))).first()[0] or 1) + 64, target_rows=TARGET_PARTITION_ROWS)
    n_folds_rows = data.where(F.col("fold") != -1)
    sizes = n_folds_rows.groupBy("fold").count()
    tot_n = n_folds_rows.count()
    min_samples = sizes.agg(F.least(F.min("count"), F.lit(tot_n) - F.max("count"))).first()[0]
    max_c = min(max_components, int(min_samples))  # Q12: PLS2 caps by the smallest split
    mom, shifts = moments.fold_moments(data, [KEY], ycols)
    mom = mom.persist()
    mom = right_size(mom, mom.count(), 48)
    fm = mom.where(F.col("fold") != -1)
    total = fm.groupBy(KEY, "i", "j").agg(F.sum("v").alias("v"))
    splits = fm.select(KEY, F.col("fold").alias("split")).distinct()
    both = total.join(splits, KEY).withColumn("kind", F.lit("total")).unionByName(
        fm.select(KEY, F.col("fold").alias("split"), "i", "j", "v").withColumn("kind", F.lit("test")))
    schema = "split int, components int, variable string, sse double, n_test long"
    cv = both.groupBy(KEY, "split").applyInPandas(_cv_fn(variables, max_c), schema)
    fr = cv.select("variable", "split", "components", F.sqrt(F.col("sse") / F.col("n_test")).alias("rmse"))
    from specflow.operators.evaluate import pls2_cv_summary
    summ = cut_lineage(pls2_cv_summary(fr, param="components", fold="split"))
    best = selection.first_local_minimum(summ.withColumn("param", F.col("components")),
                                         ["variable"], pos="components", params=["param"])
    if components is None:
        components = int(best.where(F.col("variable") == "average").first()["components"])
    ch = fm.select(F.col(KEY).alias(KEY)).distinct().withColumn("components", F.lit(components))
    model = total.groupBy(KEY).cogroup(ch.groupBy(KEY)).applyInPandas(
        _fit_fn(variables, shifts), "variable string, components int, intercept double, coef array<double>")
    model = cut_lineage(model)
    train = data.where(F.col("fold") != -1)
    long_y = train.select("pkey", "x", F.explode(F.arrays_zip(
        F.array(*[F.lit(v) for v in variables]).alias("variable"),
        F.array(*ycols).alias("actual"))).alias("_z")) \
        .select("pkey", "x", F.col("_z.variable").alias("variable"), F.col("_z.actual").alias("actual"))
    from specflow.operators.scoring import dot
    pred = long_y.join(F.broadcast(model), "variable").select(
        "pkey", "variable", "actual", (dot(F.col("x"), F.col("coef")) + F.col("intercept")).alias("pred"))
    width_k = 2 * len(variables) + (1 if has_sample_name else 0)  # A3: frame width - 1
    from specflow.operators.evaluate import regression_metrics
    met = regression_metrics(pred, ["variable"], k=width_k)
    rcv = summ.where(F.col("components") == components).select("variable", "rmsecv")
    info = met.join(rcv, "variable").join(model.select("variable", "intercept"), "variable").select(
        "variable", F.col("intercept").alias("model_intercept"), "rmsecv", F.col("rmse").alias("rmsec"),
        F.col("r2").alias("r2"), F.col("adj_r2").alias("adj_r2"), F.col("n").alias("n_standards"))
    overall = info.agg(F.first("n_standards").alias("n_standards"), F.lit(components).alias("components"),
                       F.round(F.avg("rmsecv"), 3).alias("avg_rmsecv"), F.round(F.avg("rmsec"), 3).alias("avg_rmsec"),
                       F.round(F.avg("r2"), 3).alias("avg_r2"), F.round(F.avg("adj_r2"), 3).alias("avg_adj_r2"))
    return {"cv": summ, "best": best, "model": model, "pred": pred, "info": info, "overall": overall}


def apply_pls2(spectra_vec: DataFrame, model: DataFrame, targets: DataFrame | None = None,
               requested: list[str] | None = None, k: int | None = None) -> dict:
    """S3 + J3 + U4: every variable of the PLS2 model for every spectrum; with
    metadata, the natural join on pkey and per-variable metrics; variables
    requested but absent from the metadata are reported."""
    from specflow.operators.scoring import dot
    from specflow.functions.frames import attach
    pred = attach(spectra_vec, model.select("variable", "intercept", "coef"))
    pred = pred.select("pkey", "variable", (dot(F.col("x"), F.col("coef")) + F.col("intercept")).alias("pred"))
    out = {"pred": pred}
    if targets is not None:
        variables = [r["variable"] for r in model.select("variable").collect()]
        present = {r["variable"] for r in targets.select("variable").distinct().collect()}
        out["missing"] = [v for v in (requested or variables) if v not in present]
        j = pred.join(targets.select("pkey", "variable", F.col("y").alias("actual")), ["pkey", "variable"])
        from specflow.operators.evaluate import regression_metrics
        out["metrics"] = regression_metrics(j.where(F.col("actual").isNotNull()), ["variable"],
                                            k=k if k is not None else 2 * len(variables))
    return out
