"""Registered queries over the driver tables, each with a DuckDB SQL twin.

Every query reads the given tables at full size through the adapters in
``specflow.sources.tables`` and runs the library's own operators.  Doubles
are rounded identically on both sides (sums 4-6 dp, ratios 6-9 dp) so the
order-insensitive value hash is stable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.sources import tables as tb

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# DuckDB's round() on a double scales by 10^n first, so a value like
# 51890.854999999996 becomes .86; the reference rounds the exact binary value
# (.85), as Spark does.  Oracle SQL therefore rounds medians via DECIMAL.


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---------------------------------------------------------------- SQL pieces
PRED_TRUE_SQL = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pkey,
       l_returnflag AS variable, l_linestatus AS method, l_linenumber AS fold,
       l_extendedprice AS actual, l_extendedprice * (1 - l_discount) AS pred
FROM lineitem"""


def _metrics_sql(src: str, keys: str, k: int, n: str = "n", rmse: str = "rmse", r2: str = "r2",
                 adj: str = "adj_r2", nd: int = 6) -> str:
    return f"""
SELECT {keys}, n AS {n}, round(sqrt(ss / n), {nd}) AS {rmse}, round(r2, {nd}) AS {r2},
       round(1 - (1 - r2) * (n - 1) / nullif(n - {k} - 1, 0), {nd}) AS {adj}
FROM (SELECT {keys}, count(actual) AS n, sum((actual - pred) * (actual - pred)) AS ss,
             CASE WHEN var_pop(actual) * count(actual) = 0
                  THEN CASE WHEN sum((actual - pred) * (actual - pred)) = 0 THEN 1.0 ELSE 0.0 END
                  ELSE 1 - sum((actual - pred) * (actual - pred)) / (var_pop(actual) * count(actual)) END AS r2
      FROM ({src}) GROUP BY {keys})"""


# ---------------------------------------------------------------- A1-A3
@register("metrics_pred_actual", _metrics_sql(PRED_TRUE_SQL, "variable, method", 2))
def q_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A1-A3: RMSE, R^2, adjusted R^2 (k = 2) per (variable, method)."""
    from specflow.operators.evaluate import regression_metrics
    m = regression_metrics(tb.pred_true(spark, sf), ["variable", "method"], k=2)
    return m.select("variable", "method", "n", _r("rmse").alias("rmse"), _r("r2").alias("r2"),
                    _r("adj_r2").alias("adj_r2"))


# ---------------------------------------------------------------- A4
@register("rmsecv_by_fold", f"""
SELECT variable, method, round(avg(r), 6) AS rmsecv, count(*) AS n_folds
FROM (SELECT variable, method, fold, sqrt(avg((actual - pred) * (actual - pred))) AS r
      FROM ({PRED_TRUE_SQL}) GROUP BY variable, method, fold)
GROUP BY variable, method""")
def q_rmsecv(spark, sf):
    """A4: unweighted mean over folds (l_linenumber) of the fold RMSE."""
    from specflow.operators.evaluate import rmsecv
    r = rmsecv(tb.pred_true(spark, sf), ["variable", "method"])
    return r.select("variable", "method", _r("rmsecv").alias("rmsecv"), "n_folds")


# ---------------------------------------------------------------- A5
@register("pls2_cv_summary", f"""
WITH fr AS (SELECT method AS param, variable, fold, sqrt(avg((actual - pred) * (actual - pred))) AS rmse
            FROM ({PRED_TRUE_SQL}) GROUP BY method, variable, fold)
SELECT param, variable, round(avg(rmse), 6) AS rmsecv FROM fr GROUP BY param, variable
UNION ALL
SELECT param, 'average' AS variable, round(avg(m), 6) AS rmsecv
FROM (SELECT param, fold, avg(rmse) AS m FROM fr GROUP BY param, fold) GROUP BY param""")
def q_pls2_summary(spark, sf):
    """A5: per-variable RMSECV and the 'average' over variables (mean over folds)."""
    from specflow.operators.evaluate import pls2_cv_summary
    pt = tb.pred_true(spark, sf)
    e = F.col("actual") - F.col("pred")
    fr = pt.groupBy(F.col("method").alias("param"), "variable", "fold").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    s = pls2_cv_summary(fr)
    return s.select("param", "variable", _r("rmsecv").alias("rmsecv"))


# ---------------------------------------------------------------- A6
@register("legacy_msecv", f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY pkey) - 1 AS r,
                  count(*) OVER (PARTITION BY variable) AS n FROM ({PRED_TRUE_SQL})),
f AS (SELECT *, n // 5 AS q, n % 5 AS rem FROM o),
g AS (SELECT variable, actual, pred,
             CASE WHEN r < rem * (q + 1) THEN r // (q + 1) ELSE rem + (r - rem * (q + 1)) // q END AS fold FROM f)
SELECT variable, round(avg(mse), 4) AS msecv
FROM (SELECT variable, fold, avg((actual - pred) * (actual - pred)) AS mse FROM g GROUP BY variable, fold)
GROUP BY variable""")
def q_legacy_msecv(spark, sf):
    """Contiguous 5-fold split in row order (pkey), mean of fold MSE."""
    from specflow.operators.evaluate import legacy_cv_msecv
    r = legacy_cv_msecv(tb.pred_true(spark, sf), ["pkey"], ["variable"])
    return r.select("variable", _r("msecv", 4).alias("msecv"))


# ---------------------------------------------------------------- A7 A8 F7 J11
COEFS_SQL = """
SELECT l_returnflag AS variable, l_linestatus AS method, CAST(l_linenumber AS DOUBLE) AS wave,
       avg(l_extendedprice) / 1000 AS coef
FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber"""


def _loq_split_sql(split: str, tag: str) -> str:
    cond = "l_shipdate >= TIMESTAMP '2000-01-01'" if split == "test" else "l_shipdate < TIMESTAMP '2000-01-01'"
    return f"""
{split}_rows AS (SELECT p.*, l.loq FROM ({PRED_TRUE_SQL.replace('FROM lineitem', 'FROM lineitem WHERE ' + cond)}) p
                 JOIN loq l USING (variable, method)),
{split}_b AS (SELECT variable, method, CAST(round(CAST(median(actual) AS DECIMAL(38, 12)), 2) AS DOUBLE) AS median_conc_{split}
              FROM {split}_rows GROUP BY ALL),
{split}_a AS (SELECT variable, method, count(*) AS n_{split}_above_loq,
                     CAST(round(CAST(median(actual) AS DECIMAL(38, 12)), 2) AS DOUBLE) AS median_conc_{split}_above_loq,
                     sqrt(sum((actual - pred) ^ 2) / count(*)) AS {tag}_above_loq,
                     CASE WHEN var_pop(actual) * count(*) = 0 THEN (CASE WHEN sum((actual - pred) ^ 2) = 0 THEN 1.0 ELSE 0.0 END)
                          ELSE 1 - sum((actual - pred) ^ 2) / (var_pop(actual) * count(*)) END AS r2_{split}_above_loq
              FROM {split}_rows WHERE pred > loq GROUP BY ALL)"""


@register("loq_summary", f"""
WITH coefs AS ({COEFS_SQL}),
sens AS (SELECT median(value) AS sensitivity FROM events WHERE event_type = 'purchase'),
loq AS (SELECT variable, method, 10 * sqrt(sum(coef * coef)) * (SELECT sensitivity FROM sens) AS loq
        FROM coefs GROUP BY variable, method),
{_loq_split_sql('train', 'rmsec')},
{_loq_split_sql('test', 'rmsep')}
SELECT l.variable, l.method, round(l.loq, 6) AS loq,
       median_conc_train, n_train_above_loq, median_conc_train_above_loq,
       round(rmsec_above_loq, 6) AS rmsec_above_loq, round(r2_train_above_loq, 6) AS r2_train_above_loq,
       round(1 - (1 - r2_train_above_loq) * (n_train_above_loq - 1) / nullif(n_train_above_loq - 3, 0), 6) AS adj_r2_train_above_loq,
       median_conc_test, n_test_above_loq, median_conc_test_above_loq,
       round(rmsep_above_loq, 6) AS rmsep_above_loq, round(r2_test_above_loq, 6) AS r2_test_above_loq,
       round(1 - (1 - r2_test_above_loq) * (n_test_above_loq - 1) / nullif(n_test_above_loq - 3, 0), 6) AS adj_r2_test_above_loq
FROM loq l LEFT JOIN train_b USING (variable, method) LEFT JOIN train_a USING (variable, method)
LEFT JOIN test_b USING (variable, method) LEFT JOIN test_a USING (variable, method)""")
def q_loq(spark, sf):
    """A7 + A8 + F7 + J11: LOQ = 10 * ||coef|| * sensitivity and above-LOQ metrics.

    Stand-in inputs: coefficients per (variable, method, channel = l_linenumber)
    = avg(l_extendedprice) / 1000; train rows shipped before 2000, test rows
    after; sensitivity = median purchase event value (A9)."""
    from specflow.operators.evaluate import loq_table
    li = tb.table(spark, sf, "lineitem")
    coefs = li.groupBy(F.col("l_returnflag").alias("variable"), F.col("l_linestatus").alias("method"),
                       F.col("l_linenumber").cast("double").alias("wave")) \
        .agg((F.avg("l_extendedprice") / 1000).alias("coef"))
    pt = tb.pred_true(spark, sf, with_split=True)
    ev = tb.table(spark, sf, "events").where(F.col("event_type") == "purchase")
    sens_v = ev.agg(F.median("value").alias("sensitivity"))
    models = coefs.select("variable", "method").distinct()
    from specflow.functions.frames import attach
    sens = attach(models, sens_v)
    t = loq_table(coefs, pt, sens)
    out = t.select("variable", "method", _r("loq").alias("loq"),
                   "median_conc_train", "n_train_above_loq", "median_conc_train_above_loq",
                   _r("rmsec_above_loq").alias("rmsec_above_loq"), _r("r2_train_above_loq").alias("r2_train_above_loq"),
                   _r("adj_r2_train_above_loq").alias("adj_r2_train_above_loq"),
                   "median_conc_test", "n_test_above_loq", "median_conc_test_above_loq",
                   _r("rmsep_above_loq").alias("rmsep_above_loq"), _r("r2_test_above_loq").alias("r2_test_above_loq"),
                   _r("adj_r2_test_above_loq").alias("adj_r2_test_above_loq"))
    return out


# ---------------------------------------------------------------- A9 A10 F12
@register("sensitivity_median_mean", """
SELECT event_type, round(median(value), 9) AS median_sens, round(avg(value), 9) AS mean_sens, count(*) AS n
FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type""")
def q_sens(spark, sf):
    """A9 + F12: median (9 dp) and mean of sensitivities per instrument (event_type)."""
    from specflow.operators.evaluate import sensitivity_stats
    ev = tb.table(spark, sf, "events").select("event_type", F.col("value").alias("sensitivity"))
    s = sensitivity_stats(ev, ["event_type"])
    return s.select("event_type", "median_sens", _r("mean_sens", 9).alias("mean_sens"), "n")


@register("sensitivity_histogram", """
WITH r AS (SELECT event_type, min(value) lo, max(value) hi FROM events GROUP BY event_type),
b AS (SELECT e.event_type, e.value v, r.lo, r.hi, (r.hi - r.lo) / 20 AS step,
             CASE WHEN r.hi = r.lo THEN 0 ELSE least(floor((e.value - r.lo) / (r.hi - r.lo) * 20), 19) END AS g
      FROM events e JOIN r USING (event_type)),
c AS (SELECT *, CASE WHEN hi <> lo AND v < (CASE WHEN g = 20 THEN hi ELSE lo + g * step END) THEN g - 1 ELSE g END AS g2 FROM b),
d AS (SELECT *, CASE WHEN hi <> lo AND g2 <> 19 AND v >= (CASE WHEN g2 + 1 = 20 THEN hi ELSE lo + (g2 + 1) * step END)
                     THEN g2 + 1 ELSE g2 END AS bin FROM c)
SELECT event_type, CAST(bin AS INTEGER) AS bin, round(min(lo) + bin * min(step), 6) AS bin_lo, count(*) AS count
FROM d GROUP BY event_type, bin""")
def q_sens_hist(spark, sf):
    """A10: 20 equal-width bins of the sensitivities per instrument."""
    from specflow.operators.evaluate import histogram
    ev = tb.table(spark, sf, "events")
    h = histogram(ev, ["event_type"], "value", 20)
    return h.select("event_type", "bin", _r("bin_lo").alias("bin_lo"), "count")


# ---------------------------------------------------------------- A16
@register("plot_limits", f"""
WITH a AS (SELECT variable, method, min(actual) amin, max(actual) amax, min(pred) pmin, max(pred) pmax
           FROM ({PRED_TRUE_SQL}) GROUP BY ALL)
SELECT variable, method,
  round(CASE WHEN greatest(amax, pmax) > 0 THEN greatest(amax, pmax) * 1.1 ELSE 0 END, 4) AS plt_max,
  round(CASE WHEN least(amin, pmin) > 0 THEN 0 ELSE least(amin, pmin) - 0.1 * least(amin, pmin) END, 4) AS plt_min,
  round(CASE WHEN amin > 0 THEN 0 ELSE amin - 0.1 * amin END, 4) AS x_min,
  round(CASE WHEN amax > 0 THEN amax + 0.1 * amax ELSE 0 END, 4) AS x_max,
  round(CASE WHEN pmin > 0 THEN 0 ELSE pmin - 0.1 * pmin END, 4) AS y_min,
  round(CASE WHEN pmax > 0 THEN pmax + 0.1 * pmax ELSE 0 END, 4) AS y_max
FROM a""")
def q_plot_limits(spark, sf):
    """1:1-plot limits per (variable, method)."""
    from specflow.operators.evaluate import plot_limits
    p = plot_limits(tb.pred_true(spark, sf), ["variable", "method"])
    return p.select("variable", "method", *[_r(c, 4).alias(c) for c in
                                            ["plt_max", "plt_min", "x_min", "x_max", "y_min", "y_max"]])


# ---------------------------------------------------------------- W12 W13 Q3
GRID_WALK_SQL = """
SELECT p_brand AS variable, p_size AS pos, CAST(p_size AS VARCHAR) AS param,
       round(avg(p_retailprice), 0) AS rmsecv
FROM part GROUP BY p_brand, p_size"""


@register("first_local_minimum", f"""
WITH g AS (SELECT variable, rmsecv, min(pos) AS pos, arg_max(param, pos) AS param
           FROM ({GRID_WALK_SQL}) GROUP BY variable, rmsecv),
w AS (SELECT *, min(rmsecv) OVER (PARTITION BY variable ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM g),
s AS (SELECT variable, min(pos) AS stop FROM w WHERE rmsecv > prev GROUP BY variable),
c AS (SELECT w.* FROM w LEFT JOIN s USING (variable) WHERE s.stop IS NULL OR w.pos < s.stop),
r AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY rmsecv, pos) AS rn FROM c)
SELECT variable, pos, rmsecv, param FROM r WHERE rn = 1""")
def q_first_local_min(spark, sf):
    """W12 + Q3: first local minimum over a tie-collapsed grid (part: brand x size)."""
    from specflow.operators.selection import first_local_minimum
    return first_local_minimum(_grid_walk(spark, sf), ["variable"])


@register("global_minimum", f"""
WITH g AS (SELECT variable, rmsecv, min(pos) AS pos, arg_max(param, pos) AS param
           FROM ({GRID_WALK_SQL}) GROUP BY variable, rmsecv),
r AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY rmsecv, pos) AS rn FROM g)
SELECT variable, pos, rmsecv, param FROM r WHERE rn = 1""")
def q_global_min(spark, sf):
    """W13 + Q3: global minimum over the tie-collapsed grid."""
    from specflow.operators.selection import global_minimum
    return global_minimum(_grid_walk(spark, sf), ["variable"])


def _grid_walk(spark, sf):
    p = tb.table(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("variable"), F.col("p_size").alias("pos")) \
        .agg(F.round(F.avg("p_retailprice"), 0).alias("rmsecv")) \
        .withColumn("param", F.col("pos").cast("string"))


# ---------------------------------------------------------------- T1
@register("worst_spectrum", f"""
WITH d AS (SELECT variable, method, pkey, actual - pred AS diff FROM ({PRED_TRUE_SQL})),
r AS (SELECT *, row_number() OVER (PARTITION BY variable, method ORDER BY diff DESC, pkey DESC) rn FROM d)
SELECT variable, method, pkey AS outlier, round(diff, 4) AS diff FROM r WHERE rn = 1""")
def q_worst_spectrum(spark, sf):
    """T1 (Q5): the held-out spectrum with the largest signed actual - pred."""
    from specflow.operators.outliers import worst_spectrum
    w = worst_spectrum(tb.pred_true(spark, sf), ["variable", "method"])
    return w.select("variable", "method", "outlier", _r("diff", 4).alias("diff"))


# ---------------------------------------------------------------- A18
@register("iteration_caps", """
SELECT count(DISTINCT o_custkey) AS n_ids, count(DISTINCT o_custkey) - 2 AS max_iter,
       CAST(floor(count(DISTINCT o_custkey) * 0.1) AS BIGINT) AS max_outliers FROM orders""")
def q_caps(spark, sf):
    """Samples (o_custkey), default iteration cap N - 2, 10 % outlier cap."""
    from specflow.operators.evaluate import iteration_caps
    return iteration_caps(tb.orders_meta(spark, sf), "sample", 10)


# ================================================================ folds
def _w1_sql(src: str, k: int) -> str:
    """Grouped stratified folds over ``src(pkey, variable, s, y)``."""
    fold = f"r.run % {k} + 1" if k else "r.run + 1"
    return f"""
WITH t AS ({src}),
pairs AS (SELECT DISTINCT variable, y, s FROM t WHERE y IS NOT NULL),
ch AS (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY variable ORDER BY y, s) IS NULL
                        OR lag(s) OVER (PARTITION BY variable ORDER BY y, s) <> s THEN 1 ELSE 0 END AS c FROM pairs),
r AS (SELECT variable, y, s, sum(c) OVER (PARTITION BY variable ORDER BY y, s ROWS UNBOUNDED PRECEDING) - 1 AS run FROM ch)
SELECT t.pkey, t.variable, CAST(coalesce({fold}, -1) AS INTEGER) AS fold
FROM t LEFT JOIN r ON t.variable = r.variable AND t.y = r.y AND t.s = r.s"""


CUSTOMER_ACCTBAL_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS pkey, 'acctbal' AS variable, CAST(c_nationkey AS VARCHAR) AS s,
       CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS y FROM customer"""
CUSTOMER_NATION_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS pkey, 'nation' AS variable, CAST(c_nationkey AS VARCHAR) AS s,
       CAST(c_nationkey AS DOUBLE) AS y FROM customer"""
CUSTOMER_SUM_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS pkey, 'sum' AS variable, CAST(c_nationkey AS VARCHAR) AS s,
       CASE WHEN c_acctbal >= 0 THEN c_acctbal + CAST(c_nationkey AS DOUBLE) END AS y FROM customer"""
ORDERS_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS pkey, 'totalprice' AS variable, CAST(o_custkey AS VARCHAR) AS s,
       o_totalprice AS y FROM orders"""
EMB_TARGET_SQL = """
SELECT CAST(vec_id AS VARCHAR) AS pkey, 'label' AS variable, 'S' || CAST(vec_id // 4 AS VARCHAR) AS s,
       CAST(label AS DOUBLE) AS y FROM embeddings"""


def _customer_targets(spark, sf):
    from specflow.sources.io import metadata_to_targets
    return metadata_to_targets(tb.customer_meta(spark, sf), ["acctbal"])


@register("folds_grouped_customer", _w1_sql(CUSTOMER_ACCTBAL_SQL, 5))
def q_folds_customer(spark, sf):
    """Grouped stratified 5 folds of c_acctbal (negative = missing -> -1), samples = nation."""
    from specflow.operators.folds import grouped_folds
    return grouped_folds(_customer_targets(spark, sf), 5)


@register("folds_grouped_orders", _w1_sql(ORDERS_SQL, 5))
def q_folds_orders(spark, sf):
    """W1 on orders: o_totalprice grouped by customer."""
    from specflow.operators.folds import grouped_folds
    from specflow.sources.io import metadata_to_targets
    return grouped_folds(metadata_to_targets(tb.orders_meta(spark, sf), ["totalprice"]), 5)


@register("folds_loo_runs_orders", _w1_sql(ORDERS_SQL, 0))
def q_folds_orders_loo(spark, sf):
    """W1 with n_folds = 0: every run of a sample its own fold."""
    from specflow.operators.folds import grouped_folds
    from specflow.sources.io import metadata_to_targets
    return grouped_folds(metadata_to_targets(tb.orders_meta(spark, sf), ["totalprice"]), 0)


@register("folds_ungrouped_customer", """
SELECT pkey, variable, CAST(CASE WHEN y IS NULL THEN -1
       ELSE (row_number() OVER (PARTITION BY variable, y IS NULL ORDER BY y, pkey) - 1) % 5 + 1 END AS INTEGER) AS fold
FROM (""" + CUSTOMER_ACCTBAL_SQL + ")")
def q_folds_ungrouped(spark, sf):
    """Ungrouped stratified folds (sorted by value, ties by pkey)."""
    from specflow.operators.folds import ungrouped_folds
    return ungrouped_folds(_customer_targets(spark, sf), 5)


@register("stratify_customer", f"""
SELECT pkey, variable || '_Folds' AS fold_col, fold FROM ({_w1_sql(CUSTOMER_ACCTBAL_SQL, 5)})
UNION ALL SELECT pkey, variable || '_Folds' AS fold_col, fold FROM ({_w1_sql(CUSTOMER_NATION_SQL, 5)})
UNION ALL SELECT pkey, 'Folds' AS fold_col, fold FROM ({_w1_sql(CUSTOMER_SUM_SQL, 5)})""")
def q_stratify(spark, sf):
    """W1 + W3 + A13: one fold column per variable and the general ``Folds`` from the row sum."""
    from specflow.operators.folds import stratify
    m = tb.customer_meta(spark, sf)
    return stratify(m, 5)


@register("loo_folds_per_sample", """
SELECT CAST(o_orderkey AS VARCHAR) AS pkey, CAST(o_custkey AS VARCHAR) AS id,
       CAST(dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS INTEGER) AS fold FROM orders""")
def q_loo(spark, sf):
    """One leave-one-out fold per sample (customer), 0-based."""
    from specflow.operators.folds import loo_folds
    return loo_folds(tb.orders_meta(spark, sf), "sample")


@register("cv_split_sizes", f"""
WITH f AS ({_w1_sql(CUSTOMER_ACCTBAL_SQL, 5)}),
g AS (SELECT fold, count(*) AS n_test FROM f WHERE fold <> -1 GROUP BY fold),
n AS (SELECT count(*) AS n FROM f WHERE fold <> -1),
s AS (SELECT g.fold, g.n_test, n.n - g.n_test AS n_train FROM g, n)
SELECT fold, n_test, n_train, least(min(n_train) OVER (), min(n_test) OVER ()) AS min_samples,
       least(40, least(min(n_train) OVER (), min(n_test) OVER ())) AS max_neighbors FROM s""")
def q_split_sizes(spark, sf):
    """A14 + F6 + U3: CV train/test sizes, the minimum, and the clipped kNN limit."""
    from specflow.operators.folds import grouped_folds, split_sizes
    f = grouped_folds(_customer_targets(spark, sf), 5)
    s = split_sizes(f.select("fold"))
    return s.select("fold", "n_test", "n_train", "min_samples",
                    F.least(F.lit(40).cast("long"), F.col("min_samples")).alias("max_neighbors"))


def _bin_sql(v, lo, hi, bins):
    step = f"(({hi}) - ({lo})) / ({bins})"
    g = f"CASE WHEN {hi} = {lo} THEN 0 ELSE least(floor(({v} - {lo}) / ({hi} - {lo}) * {bins}), {bins} - 1) END"
    edge = lambda i: f"(CASE WHEN ({i}) = {bins} THEN {hi} ELSE {lo} + ({i}) * {step} END)"
    g2 = f"(CASE WHEN {hi} <> {lo} AND {v} < {edge(g)} THEN ({g}) - 1 ELSE {g} END)"
    return f"CAST(CASE WHEN {hi} <> {lo} AND {g2} <> {bins} - 1 AND {v} >= {edge(g2 + ' + 1')} THEN {g2} + 1 ELSE {g2} END AS INTEGER)"


@register("fold_representativeness", f"""
WITH t AS ({CUSTOMER_ACCTBAL_SQL}),
f AS ({_w1_sql(CUSTOMER_ACCTBAL_SQL, 5)}),
d AS (SELECT t.y, f.fold FROM t JOIN f USING (pkey) WHERE t.y IS NOT NULL AND f.fold <> -1),
s AS (SELECT count(*) AS n, min(y) AS lo, max(y) AS hi, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3,
             quantile_cont(y, 0.5) AS med FROM d),
fb AS (SELECT *, CAST(CASE WHEN 2 * (q3 - q1) * pow(n, -1.0 / 3.0) > 0
                           THEN greatest(1, ceil((hi - lo) / (2 * (q3 - q1) * pow(n, -1.0 / 3.0)))) ELSE 1 END AS INTEGER) AS bins FROM s),
b AS (SELECT d.fold, {_bin_sql('d.y', 'fb.lo', 'fb.hi', 'fb.bins')} AS bin FROM d, fb),
allbins AS (SELECT unnest(range(0, bins)) AS bin FROM fb),
folds AS (SELECT DISTINCT fold FROM b),
af AS (SELECT a.bin, coalesce(c.c, 0) / (SELECT count(*) FROM b) AS fa
       FROM allbins a LEFT JOIN (SELECT bin, count(*) AS c FROM b GROUP BY bin) c USING (bin)),
ff AS (SELECT fo.fold, a.bin, coalesce(c.c, 0) / nf.n AS fr
       FROM folds fo CROSS JOIN allbins a
       LEFT JOIN (SELECT fold, bin, count(*) AS c FROM b GROUP BY fold, bin) c ON c.fold = fo.fold AND c.bin = a.bin
       JOIN (SELECT fold, count(*) AS n FROM b GROUP BY fold) nf ON nf.fold = fo.fold),
pairs AS (SELECT ff.fold, avg(abs(ff.fr - af.fa)) AS diff_all_pairs FROM ff CROSS JOIN af GROUP BY ff.fold),
bw AS (SELECT ff.fold, avg(abs(ff.fr - af.fa)) AS diff_binwise FROM ff JOIN af USING (bin) GROUP BY ff.fold),
res AS (SELECT fold, diff_all_pairs, diff_binwise FROM pairs JOIN bw USING (fold))
SELECT 'acctbal' AS variable, fold, round(diff_all_pairs, 9) AS diff_all_pairs, round(diff_binwise, 9) AS diff_binwise,
       (SELECT fold FROM res ORDER BY diff_all_pairs, fold LIMIT 1) AS best_all_pairs,
       (SELECT fold FROM res ORDER BY diff_binwise, fold LIMIT 1) AS best_binwise,
       (SELECT bins FROM fb) AS bins, (SELECT round(q3 - q1, 6) FROM fb) AS iqr, (SELECT round(med, 6) FROM fb) AS median
FROM res""")
def q_fold_repr(spark, sf):
    """A11 + A12: Freedman-Diaconis histogram, per-fold fractions, all-pairs (Q1)
    and bin-wise mean absolute difference, most representative fold."""
    from specflow.operators.evaluate import fold_representativeness
    from specflow.operators.folds import grouped_folds
    t = _customer_targets(spark, sf)
    f = grouped_folds(t, 5)
    r = fold_representativeness(t, f)
    return r.select("variable", "fold", _r("diff_all_pairs", 9).alias("diff_all_pairs"),
                    _r("diff_binwise", 9).alias("diff_binwise"), "best_all_pairs", "best_binwise",
                    "bins", _r("iqr").alias("iqr"), _r("median").alias("median"))


# ================================================================ preprocessing
SPECTRA_LONG_SQL = """
SELECT CAST(vec_id AS VARCHAR) AS pkey, 240.0 + 10.0 * i AS wave, CAST(v AS DOUBLE) + 1.0 AS intensity
FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings)"""


def _axis_sql(long_sql: str) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY wave) - 1 AS INTEGER) AS idx, wave FROM (SELECT DISTINCT wave FROM ({long_sql}))"


def _edges_sql(axis_sql: str) -> str:
    return f"""
SELECT idx, wave,
       CASE WHEN lag(wave) OVER w IS NULL THEN wave - (lead(wave) OVER w - wave) / 2 ELSE (lag(wave) OVER w + wave) / 2 END AS lo,
       CASE WHEN lead(wave) OVER w IS NULL THEN wave + (wave - lag(wave) OVER w) / 2 ELSE (wave + lead(wave) OVER w) / 2 END AS hi
FROM ({axis_sql}) WINDOW w AS (ORDER BY idx)"""


def _resample_sql(long_sql: str, new_axis_sql: str, err: bool = False) -> str:
    """``new_axis_sql`` may refer to ``oa`` (the old axis)."""
    e_in = ", sqrt(sum(pow(w.overlap * l.err, 2))) / sum(w.overlap) AS error" if err else ""
    e_fill = ", 0.0 AS error" if err else ""
    return f"""
WITH l AS ({long_sql}), oa AS ({_axis_sql('SELECT wave FROM l')}), na AS ({new_axis_sql}),
oe AS ({_edges_sql('SELECT * FROM oa')}), ne AS ({_edges_sql('SELECT * FROM na')}),
rng AS (SELECT min(lo) AS omin, max(hi) AS omax FROM oe),
nf AS (SELECT ne.*, (ne.lo < rng.omin OR ne.hi > rng.omax) AS fill FROM ne, rng),
w AS (SELECT nf.wave AS new_wave, oe.wave AS old_wave, least(oe.hi, nf.hi) - greatest(oe.lo, nf.lo) AS overlap
      FROM nf JOIN oe ON oe.lo < nf.hi AND oe.hi > nf.lo WHERE NOT nf.fill)
SELECT l.pkey, w.new_wave AS wave, sum(w.overlap * l.intensity) / sum(w.overlap) AS intensity{e_in}
FROM l JOIN w ON l.wave = w.old_wave GROUP BY l.pkey, w.new_wave
UNION ALL
SELECT k.pkey, nf.wave, 0.0 AS intensity{e_fill} FROM (SELECT DISTINCT pkey FROM l) k, nf WHERE nf.fill"""


def _long(spark, sf):
    return tb.spectra_long(spark, sf)


def _round_long(df, n=9, cols=("intensity",)):
    return df.select(*[c for c in df.columns if c not in cols], *[_r(c, n).alias(c) for c in cols])


@register("convert_spectra", f"""
SELECT pkey, count(*) AS n_channels, round(arg_min(intensity, wave), 9) AS x_first,
       round(arg_max(intensity, wave), 9) AS x_last, round(sum(intensity), 6) AS x_sum
FROM ({SPECTRA_LONG_SQL}) GROUP BY pkey""")
def q_convert(spark, sf):
    """long rows -> one array per spectrum (wave order)."""
    from specflow.operators.spectra import to_vec
    v = to_vec(_long(spark, sf))
    return v.select("pkey", F.size("x").alias("n_channels"), _r(F.col("x")[0], 9).alias("x_first"),
                    _r(F.element_at("x", -1), 9).alias("x_last"),
                    _r(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("x_sum"))


@register("select_spectra_by_attribute", f"""
SELECT s.pkey, count(*) AS n_channels, round(sum(intensity), 6) AS total
FROM ({SPECTRA_LONG_SQL}) s SEMI JOIN (SELECT CAST(vec_id AS VARCHAR) AS pkey FROM embeddings WHERE label = 4) m
ON s.pkey = m.pkey GROUP BY s.pkey""")
def q_select(spark, sf):
    """F10 + F1: metadata subset by attribute (label = 4), matching spectra by semi join."""
    from specflow.operators.spectra import select_spectra
    meta = tb.metadata(spark, sf).where(F.col("label") == 4)
    s = select_spectra(tb.spectra_vec(spark, sf), meta)
    return s.select("pkey", F.size("x").alias("n_channels"),
                    _r(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@register("first_derivative", f"""
SELECT pkey, wave, round(d, 9) AS intensity FROM (
  SELECT pkey, wave, (intensity - lag(intensity) OVER w) / (wave - lag(wave) OVER w) AS d, lag(wave) OVER w AS pw
  FROM ({SPECTRA_LONG_SQL}) WINDOW w AS (PARTITION BY pkey ORDER BY wave)) WHERE pw IS NOT NULL""")
def q_derivative(spark, sf):
    """First derivative of every spectrum."""
    from specflow.operators.preprocess import first_derivative
    return _round_long(first_derivative(_long(spark, sf)))


def _norm_sql(regions) -> str:
    vals = ", ".join(f"({i}, {lo}, {hi})" for i, (lo, hi) in enumerate(regions))
    return f"""
SELECT l.pkey, l.wave, r.region, round(l.intensity / sum(l.intensity) OVER (PARTITION BY l.pkey, r.region), 9) AS intensity
FROM ({SPECTRA_LONG_SQL}) l JOIN (VALUES {vals}) r(region, lo, hi) ON l.wave >= r.lo AND l.wave <= r.hi"""


def _norm_query(preset):
    def q(spark, sf):
        from specflow.operators.preprocess import normalize_preset
        return _round_long(normalize_preset(_long(spark, sf), preset))
    q.__doc__ = f"W6 with the {preset} regions."
    return q


from specflow.operators.preprocess import PRESETS as _PRESETS  # noqa: E402

for _name, _regions in _PRESETS.items():
    register(f"normalize_{_name}", _norm_sql(_regions))(_norm_query(_name))


@register("normalize_total", f"""
SELECT pkey, wave, round(intensity / sum(intensity) OVER (PARTITION BY pkey), 9) AS intensity FROM ({SPECTRA_LONG_SQL})""")
def q_norm_total(spark, sf):
    """Whole-spectrum L1 normalisation."""
    from specflow.operators.preprocess import normalize_total
    return _round_long(normalize_total(_long(spark, sf)))


@register("normalize_regions_vec", """
WITH l AS (""" + SPECTRA_LONG_SQL + """),
r AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {lo}, {hi})" for i, (lo, hi) in enumerate(_PRESETS["norm5_SC"])) + """) r(region, lo, hi)),
n AS (SELECT l.pkey, r.region, l.wave, l.intensity / sum(l.intensity) OVER (PARTITION BY l.pkey, r.region) AS v
      FROM l JOIN r ON l.wave >= r.lo AND l.wave <= r.hi)
SELECT pkey, count(*) AS n_channels, round(sum(v), 6) AS total, round(max(v), 9) AS vmax FROM n GROUP BY pkey""")
def q_norm_vec(spark, sf):
    """W6 in array form (no shuffle): norm5_SC regions, per-row slices."""
    from specflow.operators.preprocess import normalize_regions_vec
    n = normalize_regions_vec(tb.spectra_vec(spark, sf), tb.axis(spark, sf), _PRESETS["norm5_SC"])
    return n.select("pkey", F.size("x").alias("n_channels"),
                    _r(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("total"),
                    _r(F.array_max("x"), 9).alias("vmax"))


@register("resample_shifted_axis", _resample_sql(SPECTRA_LONG_SQL, "SELECT idx, wave + 5.0 AS wave FROM oa")
          .replace("sum(w.overlap * l.intensity) / sum(w.overlap) AS intensity",
                   "round(sum(w.overlap * l.intensity) / sum(w.overlap), 9) AS intensity"))
def q_resample(spark, sf):
    """X1 + J7 + W14: flux-conserving resample onto the axis shifted by half a step
    (the last new bin leaves the old range and is filled with 0)."""
    from specflow.operators.preprocess import axis_of, resample_long
    lg = _long(spark, sf)
    ax = axis_of(lg)
    new = ax.select("idx", (F.col("wave") + 5.0).alias("wave"))
    return _round_long(resample_long(lg, new))


COARSE_AXIS_SQL = """
SELECT CAST(i AS INTEGER) AS idx, lo + 25.0 * i AS wave
FROM (SELECT min(wave) AS lo, max(wave) AS hi FROM oa) m, range(0, CAST(floor((m.hi - m.lo) / 25.0) AS BIGINT) + 1) t(i)"""


@register("resample_coarse_vec", _resample_sql(SPECTRA_LONG_SQL, COARSE_AXIS_SQL)
          .replace("sum(w.overlap * l.intensity) / sum(w.overlap) AS intensity",
                   "round(sum(w.overlap * l.intensity) / sum(w.overlap), 9) AS intensity"))
def q_resample_vec(spark, sf):
    """X1 in array form: resample onto a 25 nm axis inside each row (no shuffle)."""
    from specflow.operators.preprocess import resample_vec
    from specflow.operators.spectra import to_long
    ax = tb.axis(spark, sf)
    rng = ax.agg(F.min("wave").alias("lo"), F.max("wave").alias("hi"))
    new = rng.select(F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / 25.0).cast("int"))).alias("idx"),
                     "lo").select("idx", (F.col("lo") + 25.0 * F.col("idx")).alias("wave"))
    rv = resample_vec(tb.spectra_vec(spark, sf), ax, new)
    return _round_long(to_long(rv, new))


@register("resample_with_errors", _resample_sql(
    "SELECT pkey, wave, intensity, 0.05 * abs(intensity) AS err FROM (" + SPECTRA_LONG_SQL + ")",
    COARSE_AXIS_SQL, err=True)
    .replace("sum(w.overlap * l.intensity) / sum(w.overlap) AS intensity",
             "round(sum(w.overlap * l.intensity) / sum(w.overlap), 9) AS intensity")
    .replace("sqrt(sum(pow(w.overlap * l.err, 2))) / sum(w.overlap) AS error",
             "round(sqrt(sum(pow(w.overlap * l.err, 2))) / sum(w.overlap), 9) AS error"))
def q_resample_err(spark, sf):
    """Resample with uncertainties (stand-in error = 5 % of |intensity|)."""
    from specflow.operators.preprocess import axis_of, resample_long
    lg = _long(spark, sf).withColumn("err", 0.05 * F.abs("intensity"))
    ax = axis_of(lg)
    rng = ax.agg(F.min("wave").alias("lo"), F.max("wave").alias("hi"))
    new = rng.select(F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / 25.0).cast("int"))).alias("idx"),
                     "lo").select("idx", (F.col("lo") + 25.0 * F.col("idx")).alias("wave"))
    out = resample_long(lg, new, errors="err")
    return _round_long(out, 9, ("intensity", "error"))


BAND = 503.0


@register("band_normalize", f"""
WITH r AS ({_resample_sql(SPECTRA_LONG_SQL, f"SELECT CAST(row_number() OVER (ORDER BY wave) - 1 AS INTEGER) AS idx, wave FROM (SELECT wave FROM oa UNION ALL SELECT {BAND})")}),
b AS (SELECT pkey, intensity AS bv FROM r WHERE wave = {BAND})
SELECT r.pkey, r.wave, round(r.intensity / b.bv, 9) AS intensity FROM r JOIN b USING (pkey) WHERE r.wave <> {BAND}""")
def q_band(spark, sf):
    """X5 + T5 + Q6: normalise to the intensity at 503 nm (not a channel: inserted, resampled, dropped)."""
    from specflow.operators.preprocess import band_normalize
    return _round_long(band_normalize(_long(spark, sf), BAND))


@register("closest_channel", f"""
SELECT idx, wave FROM ({_axis_sql(SPECTRA_LONG_SQL)}) ORDER BY abs(wave - {BAND}), idx LIMIT 1""")
def q_closest(spark, sf):
    """T5: channel nearest the band."""
    from specflow.operators.preprocess import axis_of, closest_channel
    return closest_channel(axis_of(_long(spark, sf)), BAND)


@register("min_step_axis", f"""
WITH a AS ({_axis_sql(SPECTRA_LONG_SQL)}),
s AS (SELECT min(d) AS step, min(wave) AS first, max(wave) AS last
      FROM (SELECT wave, wave - lag(wave) OVER (ORDER BY idx) AS d FROM a))
SELECT CAST(i AS INTEGER) AS idx, first + i * step AS wave
FROM s, range(0, CAST(ceil((last + step - first) / step) AS BIGINT)) t(i)""")
def q_min_step(spark, sf):
    """Uniform axis with the minimum step (arange semantics)."""
    from specflow.operators.preprocess import axis_of, min_step_axis
    return min_step_axis(axis_of(_long(spark, sf)))


@register("drop_channels_audit", f"""
WITH l AS ({SPECTRA_LONG_SQL}), a AS ({_axis_sql(SPECTRA_LONG_SQL)}),
k AS (SELECT l.* FROM l JOIN a USING (wave) WHERE a.idx NOT IN (31, 63))
SELECT (SELECT count(*) FROM l) AS rows_before, count(*) AS rows_after, (SELECT count(*) FROM l) - count(*) AS rows_dropped,
       count(DISTINCT wave) AS channels_after, count(*) FILTER (WHERE intensity IS NULL) AS null_values FROM k""")
def q_audit(spark, sf):
    """drop two named channels (the last of each half), null audit and dropped-row count."""
    from specflow.operators.preprocess import axis_of, drop_channels_audit
    lg = _long(spark, sf)
    return drop_channels_audit(lg, axis_of(lg), [31, 63])


# ================================================================ modelling
EMB_X_SQL = """
SELECT CAST(vec_id AS VARCHAR) AS pkey, CAST(i AS INTEGER) AS i, CAST(v AS DOUBLE) + 1.0 AS x
FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings)"""


def _emb_rows(spark, sf, n_folds=5):
    from specflow.operators.folds import grouped_folds
    from specflow.operators.spectra import modelling_rows
    tg = tb.targets(spark, sf)
    return modelling_rows(tb.spectra_vec(spark, sf), tg, grouped_folds(tg, n_folds))


@register("gram_by_fold", f"""
WITH f AS ({_w1_sql(EMB_TARGET_SQL, 5)}), s AS ({EMB_X_SQL})
SELECT f.variable, f.fold, a.i, b.i AS j, round(sum(a.x * b.x), 6) AS v
FROM f JOIN s a ON a.pkey = f.pkey JOIN s b ON b.pkey = f.pkey AND a.i <= b.i
GROUP BY f.variable, f.fold, a.i, b.i""")
def q_gram(spark, sf):
    """M0: per-fold Gram X'X of the 64-channel spectra, by blocks of 24 channels (three by three, the last one short)."""
    from specflow.operators.moments import gram_long
    g = gram_long(_emb_rows(spark, sf), ["variable"], "fold", 24)
    return g.select("variable", "fold", "i", "j", _r("v").alias("v"))


@register("ols_from_moments", """
SELECT l_returnflag AS variable, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       round(regr_slope(l_extendedprice, l_quantity), 6) AS slope
FROM lineitem GROUP BY l_returnflag""")
def q_ols(spark, sf):
    """M0 + M1: OLS solved from moments (y = l_extendedprice, x = l_quantity per l_returnflag)."""
    from specflow.operators.moments import fold_moments
    from specflow.plans.linear import fit_chosen
    li = tb.table(spark, sf, "lineitem")
    d = li.select(F.col("l_returnflag").alias("variable"), F.lit(0).alias("fold"),
                  F.col("l_extendedprice").alias("y"), F.array(F.col("l_quantity")).alias("x"))
    mom, sh = fold_moments(d, ["variable"])
    chosen = d.select("variable").distinct().select("variable", F.lit("OLS").alias("method"), F.lit("NA").alias("param"))
    m = fit_chosen(mom, chosen, ["variable"], sh)
    return m.select("variable", _r("intercept").alias("intercept"), _r(F.col("coef")[0]).alias("slope"))


def _knn_sql() -> str:
    return f"""
WITH f AS ({_w1_sql(EMB_TARGET_SQL, 5)}),
t AS (SELECT f.pkey, f.fold, CAST(e.label AS DOUBLE) AS y, list_transform(e.embedding, lambda v: CAST(v AS DOUBLE) + 1.0) AS x
      FROM f JOIN embeddings e ON f.pkey = CAST(e.vec_id AS VARCHAR) WHERE f.fold <> -1),
sz AS (SELECT fold, count(*) AS n FROM t GROUP BY fold),
cap AS (SELECT least(40, least(min(n), min((SELECT count(*) FROM t) - n))) AS mx FROM sz),
pr AS (SELECT q.pkey AS qk, q.fold, q.y AS qy, c.pkey AS ck, c.y AS cy, list_distance(q.x, c.x) AS d
       FROM t q JOIN t c ON q.fold <> c.fold),
rk AS (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY d, ck) AS k FROM pr),
top AS (SELECT * FROM rk WHERE k <= (SELECT CASE WHEN mx > 1 THEN mx - 1 ELSE 1 END FROM cap)),
run AS (SELECT qk, fold, qy, k,
               sum(cy) OVER w / k AS pu,
               sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) OVER w AS n0,
               sum(CASE WHEN d = 0 THEN cy ELSE 0 END) OVER w AS s0,
               sum(CASE WHEN d = 0 THEN 0 ELSE 1 / d END) OVER w AS sw,
               sum(CASE WHEN d = 0 THEN 0 ELSE cy / d END) OVER w AS swy
        FROM top WINDOW w AS (PARTITION BY qk ORDER BY k ROWS UNBOUNDED PRECEDING)),
e AS (SELECT fold, k, 0 AS wt, (qy - pu) ^ 2 AS e2 FROM run
      UNION ALL SELECT fold, k, 1 AS wt, (qy - CASE WHEN n0 > 0 THEN s0 / n0 ELSE swy / sw END) ^ 2 AS e2 FROM run),
cv AS (SELECT k, wt, avg(r) AS rmsecv FROM (SELECT fold, k, wt, sqrt(avg(e2)) AS r FROM e GROUP BY fold, k, wt) GROUP BY k, wt)"""


@register("knn_cv_grid", _knn_sql() + """
SELECT 'label' AS variable, CAST((k - 1) * 2 + wt AS INTEGER) AS pos,
       'n_neighbors=' || CAST(k AS VARCHAR) || ' weights=' || CASE WHEN wt = 0 THEN 'uniform' ELSE 'distance' END AS param,
       round(rmsecv, 9) AS rmsecv FROM cv""")
def q_knn_cv(spark, sf):
    """M14 + J9 + T4: exact blocked kNN, every (k, weights) RMSECV from one neighbour list."""
    return _knn_cv_table(spark, sf).select("variable", "pos", "param", _r("rmsecv", 9).alias("rmsecv"))


def _knn_cv_table(spark, sf):
    from specflow.operators.folds import split_sizes
    from specflow.operators.knn import knn_cv
    from specflow.plans.linear import rmsecv_table
    from specflow.functions.frames import right_size
    d = _emb_rows(spark, sf).persist()
    d = right_size(d, d.count(), 8 * (d.select(F.max(F.size("x"))).first()[0] or 1) + 64)
    ms = split_sizes(d.select("fold")).agg(F.min("min_samples")).first()[0]
    cv = knn_cv(d, ["variable"], min(40, int(ms)))
    return rmsecv_table(cv, ["variable"])


@register("knn_choice", _knn_sql() + """,
c AS (SELECT rmsecv, min((k - 1) * 2 + wt) AS pos, arg_max(k, (k - 1) * 2 + wt) AS kk,
             arg_max(wt, (k - 1) * 2 + wt) AS ww FROM cv GROUP BY rmsecv)
SELECT 'label' AS variable, 'kNN' AS method, CAST(pos AS INTEGER) AS pos,
       'n_neighbors=' || CAST(kk AS VARCHAR) || ' weights=' || CASE WHEN ww = 0 THEN 'uniform' ELSE 'distance' END AS param,
       round(rmsecv, 9) AS rmsecv
FROM c ORDER BY rmsecv, pos LIMIT 1""")
def q_knn_choice(spark, sf):
    """M14 + W13 + Q3: global-minimum choice over the tie-collapsed kNN grid."""
    from specflow.operators.selection import choose
    ch = choose(_knn_cv_table(spark, sf), ["variable"])
    return ch.select("variable", "method", "pos", "param", _r("rmsecv", 9).alias("rmsecv"))


UNIV_MODEL_SQL = f"""
l AS ({SPECTRA_LONG_SQL}),
m AS (SELECT CAST(vec_id AS VARCHAR) AS pkey, CAST(label AS DOUBLE) AS y FROM embeddings),
c AS (SELECT wave, regr_slope(y, intensity) / (SELECT count(DISTINCT wave) FROM l) AS coef, avg(intensity) AS mx
      FROM l JOIN m USING (pkey) GROUP BY wave),
b AS (SELECT (SELECT avg(y) FROM m) - sum(coef * mx) AS b0 FROM c),
p AS (SELECT l.pkey, sum(l.intensity * c.coef) + (SELECT b0 FROM b) AS pred FROM l JOIN c USING (wave) GROUP BY l.pkey)"""


def _univariate_model(spark, sf):
    """Stand-in linear model fitted by Spark from the tables: per channel the
    univariate slope of label on intensity / channel count; intercept from means."""
    lg = tb.spectra_long(spark, sf)
    m = tb.metadata(spark, sf).select("pkey", F.col("label").alias("y"))
    nch = lg.select(F.count_distinct("wave").alias("_p"))
    per = lg.join(m, "pkey").groupBy("wave").agg(F.regr_slope("y", "intensity").alias("_s"),
                                                 F.avg("intensity").alias("mx"))
    from specflow.functions.frames import attach
    per = attach(per, nch).withColumn("coef", F.col("_s") / F.col("_p"))
    ybar = m.agg(F.avg("y").alias("_ybar"))
    model = attach(per.agg(F.array_sort(F.collect_list(F.struct("wave", "coef"))).alias("_c"),
                           F.sum(F.col("coef") * F.col("mx")).alias("_cm")), ybar)
    model = model.select(F.lit("label").alias("variable"), F.lit("univariate").alias("method"),
                         (F.col("_ybar") - F.col("_cm")).alias("intercept"),
                         F.transform("_c", lambda s: s["coef"]).alias("coef"))
    return per.select("wave", "coef", "mx"), model


@register("predictions", f"""
WITH {UNIV_MODEL_SQL}
SELECT pkey, 'label' AS variable, 'univariate' AS method, round(pred, 6) AS pred FROM p""")
def q_predictions(spark, sf):
    """Apply a linear model table to every spectrum (array dot product, broadcast model)."""
    from specflow.operators.scoring import predict_linear
    _, model = _univariate_model(spark, sf)
    p = predict_linear(tb.spectra_vec(spark, sf), model)
    return p.select("pkey", "variable", "method", _r("pred").alias("pred"))


@register("apply_model_metrics", f"""
WITH {UNIV_MODEL_SQL},
j AS (SELECT p.pred, m.y AS actual FROM p LEFT JOIN m USING (pkey) WHERE m.y IS NOT NULL),
a AS (SELECT count(*) AS n, sum((actual - pred) ^ 2) AS ss, var_pop(actual) * count(*) AS st FROM j),
r AS (SELECT n, sqrt(ss / n) AS rmse, CASE WHEN st = 0 THEN (CASE WHEN ss = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - ss / st END AS r2 FROM a)
SELECT 'label' AS variable, 'univariate' AS method, n AS n_pred,
       CASE WHEN n > 2 THEN round(rmse, 6) END AS rmsep, CASE WHEN n > 2 THEN round(r2, 6) END AS r2_test,
       CASE WHEN n > 2 THEN round(1 - (1 - r2) * (n - 1) / nullif(n - 2, 0), 6) END AS adj_r2_test FROM r""")
def q_apply(spark, sf):
    """S1 + S2 + J2: predictions left-joined to metadata; metrics (k = 1) only for > 2 pairs."""
    from specflow.operators.scoring import compare_to_metadata, predict_linear
    _, model = _univariate_model(spark, sf)
    p = predict_linear(tb.spectra_vec(spark, sf), model)
    c = compare_to_metadata(p, tb.targets(spark, sf), k=1)
    return c.select("variable", "method", "n_pred", _r("rmsep").alias("rmsep"), _r("r2_test").alias("r2_test"),
                    _r("adj_r2_test").alias("adj_r2_test"))


@register("model_card_scores", f"""
WITH {UNIV_MODEL_SQL},
card AS (SELECT c.wave, c.coef, (SELECT b0 FROM b) AS icpt, avg(l.intensity) AS mean_sub, 1.0 AS std_div
         FROM c JOIN l USING (wave) GROUP BY c.wave, c.coef)
SELECT l.pkey, 'label' AS variable, 'univariate' AS method,
       round(sum((l.intensity - card.mean_sub) / card.std_div * card.coef) + min(card.icpt), 6) AS pred
FROM l JOIN card USING (wave) GROUP BY l.pkey""")
def q_card(spark, sf):
    """IO8 + S4: model card (coefficient, intercept, mean to subtract, std to divide) and scoring from it."""
    from specflow.operators.scoring import model_card, score_model_card
    per, model = _univariate_model(spark, sf)
    coefs = per.select(F.lit("label").alias("variable"), F.lit("univariate").alias("method"), "wave", "coef")
    lg = tb.spectra_long(spark, sf)
    card = model_card(lg, coefs, model.select("variable", "method", "intercept"))
    s = score_model_card(lg, card)
    return s.select("pkey", "variable", "method", _r("pred").alias("pred"))


@register("key_audit", """
WITH l AS (SELECT DISTINCT o_orderkey AS k FROM orders), r AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
j AS (SELECT l.k AS lk, r.k AS rk FROM l FULL OUTER JOIN r ON l.k = r.k)
SELECT count(lk) AS n_left, count(rk) AS n_right, count(*) FILTER (WHERE lk IS NOT NULL AND rk IS NOT NULL) AS n_both,
       count(*) FILTER (WHERE rk IS NULL) AS only_left, count(*) FILTER (WHERE lk IS NULL) AS only_right FROM j""")
def q_audit_keys(spark, sf):
    """Key agreement audit between two keyed tables (orders vs lineitem)."""
    from specflow.operators.spectra import key_audit
    o = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    li = tb.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return key_audit(o, li, "k")


# ================================================================ rows-only (no SQL twin)
def _results_cols(df):
    num = ["rmsecv", "model_intercept", "rmsec", "r2_train", "adj_r2_train", "rmsep", "r2_test", "adj_r2_test"]
    return df.select(*[_r(c, 9).alias(c) if c in num else F.col(c) for c in df.columns])


@register("pls_train_report")
def q_pls_report(spark, sf):
    """Flagship: PLS components chosen by first local minimum of
    RMSECV over grouped stratified folds, refit, train/test metrics (test fold 5)."""
    from specflow.operators.folds import grouped_folds
    from specflow.plans.train import train_report
    tg = tb.targets(spark, sf)
    r = train_report(tb.spectra_vec(spark, sf), tg, grouped_folds(tg, 5), ["PLS"], test_fold=5)
    return _results_cols(r["results"])


@register("linear_train_report")
def q_linear_report(spark, sf):
    """M15 + M16: OLS, OMP, LASSO, Ridge, ElasticNet, PLS, PCR-lin and kNN in one report (no test fold)."""
    from specflow.operators.folds import grouped_folds
    from specflow.plans.train import train_report
    tg = tb.targets(spark, sf)
    r = train_report(tb.spectra_vec(spark, sf), tg, grouped_folds(tg, 5),
                     ["OLS", "OMP", "LASSO", "Ridge", "ElasticNet", "PLS", "PCR-lin", "kNN"])
    return _results_cols(r["results"])


@register("baseline_removal")
def q_baseline(spark, sf):
    """Adaptive reweighted penalised least squares baseline removed from every spectrum."""
    from specflow.operators.baseline import remove_baseline
    b = remove_baseline(tb.spectra_vec(spark, sf))
    return b.select("pkey", F.size("x").alias("n_channels"),
                    _r(F.aggregate("x", F.lit(0.0), lambda a, c: a + c), 6).alias("x_sum"),
                    _r(F.array_min("x"), 9).alias("x_min"), _r(F.array_max("x"), 9).alias("x_max"))


@register("preprocess_recipe")
def q_recipe(spark, sf):
    """IO5 recipe in array form: resample to a 25 nm axis -> baseline removal -> norm5 regions."""
    from specflow.operators.baseline import remove_baseline
    from specflow.operators.preprocess import normalize_regions_vec, resample_vec
    ax = tb.axis(spark, sf)
    rng = ax.agg(F.min("wave").alias("lo"), F.max("wave").alias("hi"))
    new = rng.select(F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / 25.0).cast("int"))).alias("idx"),
                     "lo").select("idx", (F.col("lo") + 25.0 * F.col("idx")).alias("wave"))
    v = resample_vec(tb.spectra_vec(spark, sf), ax, new)
    v = remove_baseline(v)
    n = normalize_regions_vec(v, new, _PRESETS["norm5_SC"])
    return n.select("pkey", F.size("x").alias("n_channels"),
                    _r(F.aggregate("x", F.lit(0.0), lambda a, c: a + c), 6).alias("x_sum"))


def _pls2_inputs(spark, sf):
    """Two targets per spectrum: ``label`` and ``band_sum`` (sum of the first 8 channels)."""
    from specflow.operators.folds import grouped_folds
    from specflow.sources.io import metadata_to_targets
    meta = tb.metadata(spark, sf).join(
        tb.spectra_vec(spark, sf).select("pkey", F.aggregate(F.slice("x", 1, 8), F.lit(0.0), lambda a, b: a + b)
                                         .alias("band_sum")), "pkey")
    tg = metadata_to_targets(meta, ["label", "band_sum"])
    from specflow.operators.folds import row_sum_target
    folds = grouped_folds(row_sum_target(meta, ["label", "band_sum"]), 5).select("pkey", "fold")
    return tg, folds


@register("pls2_report")
def q_pls2(spark, sf):
    """M7 + A5 + A17 + F5: one PLS model for two targets; per-variable and average
    RMSECV, component by first local minimum of the average, train metrics."""
    from specflow.plans.pls2 import pls2_report
    tg, folds = _pls2_inputs(spark, sf)
    r = pls2_report(tb.spectra_vec(spark, sf), tg, folds, ["label", "band_sum"], has_sample_name=True)
    return r["info"].select("variable", "n_standards", _r("model_intercept", 9).alias("model_intercept"),
                            _r("rmsecv", 9).alias("rmsecv"), _r("rmsec", 9).alias("rmsec"),
                            _r("r2", 9).alias("r2"), _r("adj_r2", 9).alias("adj_r2"))


@register("outlier_iterations")
def q_outliers(spark, sf):
    """O1-O4 + T2: iterative per-sample outlier removal for ``label`` with PLS,
    stopping after three removals (the max_iter rule of the feature)."""
    from specflow.plans.outliers import iterative_outliers
    log = iterative_outliers(spark, tb.spectra_vec(spark, sf), tb.targets(spark, sf), "label", "PLS",
                             "per_sample", "max_iter", 3)
    return log.select("iter", "outlier", _r("avg_train_RMSE", 9).alias("avg_train_RMSE"),
                      _r("difference", 9).alias("difference"), "percent_difference")


WORST_SAMPLE_SQL_SRC = """
SELECT l_returnflag AS variable, CAST(l_suppkey AS VARCHAR) AS Sample_Name,
       sqrt(avg(CASE WHEN l_linestatus = 'F' THEN (l_extendedprice * l_discount) ^ 2 END)) AS avg_train_RMSE,
       sqrt(avg(CASE WHEN l_linestatus = 'O' THEN (l_extendedprice * l_discount) ^ 2 END)) AS RMSEP
FROM lineitem GROUP BY l_returnflag, l_suppkey"""


@register("worst_sample", f"""
WITH r AS ({WORST_SAMPLE_SQL_SRC}),
s AS (SELECT variable, arg_min(Sample_Name, (avg_train_RMSE, Sample_Name)) AS wtrain,
             arg_min(Sample_Name, (-RMSEP, Sample_Name)) AS wtest,
             quantile_cont(avg_train_RMSE, 0.25) AS p25, quantile_cont(RMSEP, 0.75) AS p75 FROM r GROUP BY variable),
c AS (SELECT r.variable, arg_min(r.Sample_Name, (r.avg_train_RMSE, r.Sample_Name)) AS cand
      FROM r JOIN s USING (variable) WHERE r.avg_train_RMSE < s.p25 AND r.RMSEP > s.p75 GROUP BY r.variable)
SELECT s.variable, CASE WHEN wtrain = wtest THEN wtrain ELSE c.cand END AS outlier
FROM s LEFT JOIN c USING (variable)""")
def q_worst_sample(spark, sf):
    """Per-sample outlier choice (lowest train RMSE = highest RMSEP, else the
    P25/P75 rule) on a per-sample error table (supplier x return flag)."""
    from specflow.operators.outliers import worst_sample
    li = tb.table(spark, sf, "lineitem")
    e2 = F.pow(F.col("l_extendedprice") * F.col("l_discount"), 2)
    r = li.groupBy(F.col("l_returnflag").alias("variable"), F.col("l_suppkey").cast("string").alias("Sample_Name")) \
        .agg(F.sqrt(F.avg(F.when(F.col("l_linestatus") == "F", e2))).alias("avg_train_RMSE"),
             F.sqrt(F.avg(F.when(F.col("l_linestatus") == "O", e2))).alias("RMSEP"))
    return worst_sample(r, ["variable"])


@register("tree_train_report")
def q_trees(spark, sf):
    """M12 + M13: random forest and gradient boosting (Spark ML), max features
    {sqrt, log2} chosen by global-minimum RMSECV, refit, test fold 5."""
    from specflow.operators.folds import grouped_folds
    from specflow.plans.train import train_report
    tg = tb.targets(spark, sf)
    r = train_report(tb.spectra_vec(spark, sf), tg, grouped_folds(tg, 5), ["RF", "GBR"], test_fold=5)
    return _results_cols(r["results"])


@register("stream_predictions", f"""
WITH {UNIV_MODEL_SQL}
SELECT pkey, 'label' AS variable, 'univariate' AS method, round(pred, 6) AS pred FROM p""")
def q_stream(spark, sf):
    """Structured Streaming: spectra files read as a stream, scored by a
    stream-static join with the model table (availableNow trigger)."""
    from specflow.streaming.score import run_available, score_stream, spectra_stream
    _, model = _univariate_model(spark, sf)
    model = model.persist()
    model.count()
    path = run_available(score_stream(spectra_stream(spark, sf), model), "predictions")
    out = spark.read.parquet(path)
    return out.select("pkey", "variable", "method", _r("pred").alias("pred"))


@register("svr_train_report")
def q_svr(spark, sf):
    """Linear SVR (C = 1) over the eps grid logspace(-4, 1, 30), global-minimum
    RMSECV, refit, coefficients and intercept, test fold 5."""
    from specflow.operators.folds import grouped_folds
    from specflow.plans.train import train_report
    tg = tb.targets(spark, sf)
    r = train_report(tb.spectra_vec(spark, sf), tg, grouped_folds(tg, 5), ["SVR-lin"], test_fold=5)
    return _results_cols(r["results"])


@register("svr_poly_train_report")
def q_svr_poly(spark, sf):
    """Polynomial-kernel SVR (C = 1, degree 2) over the eps grid logspace(-4, 1, 30),
    global-minimum RMSECV, refit, test fold 5."""
    from specflow.operators.folds import grouped_folds
    from specflow.plans.train import train_report
    tg = tb.targets(spark, sf)
    r = train_report(tb.spectra_vec(spark, sf), tg, grouped_folds(tg, 5), ["SVR-py"], test_fold=5)
    return _results_cols(r["results"])


@register("preprocess_recipes")
def q_recipes(spark, sf):
    """IO5 + IO6: three recipes over the spectra (resample 25 nm + baseline + norm5_SC,
    resample 25 nm + baseline + norm3_SL_10K, baseline only), written partitioned by
    dataset and recipe, read back and summarised per spectrum."""
    import uuid

    from specflow.plans.recipes import baseline, normalise, resample_to, run_recipes, write_recipes
    from specflow.session import ensure_checkpoint_dir
    ax = tb.axis(spark, sf)
    rng = ax.agg(F.min("wave").alias("lo"), F.max("wave").alias("hi"))
    new = rng.select(F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / 25.0).cast("int"))).alias("idx"),
                     "lo").select("idx", (F.col("lo") + 25.0 * F.col("idx")).alias("wave"))
    recipes = {"resample_baseline_norm5": [resample_to(new), baseline, normalise("norm5_SC")],
               "resample_baseline_norm3": [resample_to(new), baseline, normalise("norm3_SL_10K")],
               "baseline": [baseline]}
    out = run_recipes(tb.spectra_vec(spark, sf), ax, recipes, "embeddings")
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/recipes-{uuid.uuid4().hex}"
    write_recipes(out, path)
    back = spark.read.parquet(path)
    return back.select("dataset", "recipe", "pkey", F.size("x").alias("n_channels"),
                       _r(F.aggregate("x", F.lit(0.0), lambda a, c: a + c), 6).alias("x_sum"))


from specflow import catalog_more  # noqa: E402,F401  registers the rest
