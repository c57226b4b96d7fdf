"""Spectral preprocessing as relational jobs.

Two forms of the same spectra table are used:
  long  ``(pkey, wave, intensity)``: axis-wise relational work and SQL checks;
  vec   ``(pkey, x array<double>)`` + an axis: row-local work with no shuffle.
Axis tables are model-sized (one row per channel), so joins against them
are broadcast; the spectra side is never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specflow.functions.frames import attach

# Normalisation regions (nm, inclusive) of the reference presets.
NORM5_SC = [(243.79, 341.36), (379.26, 464.54), (537.57, 619.82), (620.08, 712.14), (712.17, 852.77)]
NORM3_CL = [(246.68, 338.42), (387.9, 469.1), (492.65, 849.1)]
NORM3_SL_10K = [(233.12, 351.35), (370.16, 479.07), (498.14, 859.44)]
NORM3_SL_18K = [(233.12, 351.35), (370.16, 479.07), (508.3, 869.2)]
PRESETS = {"norm5_SC": NORM5_SC, "norm3_CL": NORM3_CL,
           "norm3_SL_10K": NORM3_SL_10K, "norm3_SL_18K": NORM3_SL_18K}


def is_numeric_label(c) -> F.Column:
    """Label parses as a number."""
    return F.expr(f"try_cast({c} as double)").isNotNull() if isinstance(c, str) else \
        c.try_cast("double").isNotNull()


def region_table(spark: SparkSession, regions) -> DataFrame:
    return spark.createDataFrame([(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(regions)],
                                 "region int, lo double, hi double")


def wave_filter(long: DataFrame, lo: float, hi: float) -> DataFrame:
    """inclusive wavelength window."""
    return long.where((F.col("wave") >= lo) & (F.col("wave") <= hi))


def assign_regions(long: DataFrame, regions: DataFrame) -> DataFrame:
    """Broadcast range join of channels to regions (inclusive)."""
    r = F.broadcast(regions)
    return long.join(r, (long["wave"] >= r["lo"]) & (long["wave"] <= r["hi"])).drop("lo", "hi")


def normalize_regions(long: DataFrame, regions) -> DataFrame:
    """Value / sum (not sum of |value|) within each (pkey, region); channels
    outside every region are dropped; regions concatenated."""
    if not isinstance(regions, DataFrame):
        regions = region_table(long.sparkSession, regions)
    j = assign_regions(long, regions)
    w = Window.partitionBy("pkey", "region")
    return j.select("pkey", "wave", "region", F.try_divide(F.col("intensity"), F.sum("intensity").over(w)).alias("intensity"))


def normalize_total(long: DataFrame) -> DataFrame:
    """Whole-spectrum L1 normalisation."""
    w = Window.partitionBy("pkey")
    return long.select("pkey", "wave", F.try_divide(F.col("intensity"), F.sum("intensity").over(w)).alias("intensity"))


def normalize_preset(long: DataFrame, name: str) -> DataFrame:
    """The named region presets."""
    return normalize_regions(long, PRESETS[name])


def normalize_regions_vec(vec: DataFrame, axis: DataFrame, regions) -> DataFrame:
    """W6 in array form: per-row sums over index ranges, no shuffle.

    Output ``(pkey, x)`` whose channels are the in-region channels in region
    order (a channel in two regions appears twice, as concatenation does)."""
    if not isinstance(regions, DataFrame):
        regions = region_table(vec.sparkSession, regions)
    spans = (axis.join(F.broadcast(regions), (axis["wave"] >= regions["lo"]) & (axis["wave"] <= regions["hi"]))
             .groupBy("region").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
             .agg(F.array_sort(F.collect_list(F.struct("region", "a", "b"))).alias("spans")))
    j = attach(vec, spans)

    def seg(s):
        part = F.slice(F.col("x"), s["a"] + 1, s["b"] - s["a"] + 1)
        tot = F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v)
        return F.transform(part, lambda v: v / tot)
    return j.select("pkey", F.flatten(F.transform("spans", seg)).alias("x"))


def first_derivative(long: DataFrame) -> DataFrame:
    """(I_i - I_{i-1}) / (w_i - w_{i-1}) at w_i; the first channel has none and is dropped."""
    w = Window.partitionBy("pkey").orderBy("wave")
    d = long.select("pkey", "wave",
                    F.try_divide(F.col("intensity") - F.lag("intensity").over(w),
                                 F.col("wave") - F.lag("wave").over(w)).alias("intensity"),
                    F.lag("wave").over(w).alias("_prev"))
    return d.where(F.col("_prev").isNotNull()).drop("_prev")


def axis_of(long: DataFrame) -> DataFrame:
    """IO3 + index: ``(idx, wave)`` of the distinct ascending axis.

    The distinct step is partially aggregated per task; the numbering window
    then runs over one row per channel (model-sized)."""
    waves = long.select("wave").where(F.col("wave").isNotNull()).distinct()
    return waves.select(F.row_number().over(Window.orderBy("wave")).alias("idx") - 1, "wave") \
        .toDF("idx", "wave")


def bin_edges(axis: DataFrame) -> DataFrame:
    """Edges at midpoints, half a step beyond each end -> ``(idx, wave, lo, hi)``.

    The axis is one row per channel, so this window is model-sized."""
    w = Window.orderBy("idx")
    prev = F.lag("wave").over(w)
    nxt = F.lead("wave").over(w)
    lo = F.when(prev.isNull(), F.col("wave") - (nxt - F.col("wave")) / 2).otherwise((prev + F.col("wave")) / 2)
    hi = F.when(nxt.isNull(), F.col("wave") + (F.col("wave") - prev) / 2).otherwise((F.col("wave") + nxt) / 2)
    return axis.select("idx", "wave", lo.alias("lo"), hi.alias("hi"))


def resample_weights(old_axis: DataFrame, new_axis: DataFrame) -> DataFrame:
    """Overlap of every new bin with every old bin it touches.

    ``(new_idx, new_wave, old_idx, old_wave, overlap, fill)``; new bins
    reaching beyond the old range carry ``fill = true`` and no old bin
    (N5).  Both sides are axes (one row per channel)."""
    o = bin_edges(old_axis).select(F.col("idx").alias("old_idx"), F.col("wave").alias("old_wave"),
                                   F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    n = bin_edges(new_axis).select(F.col("idx").alias("new_idx"), F.col("wave").alias("new_wave"),
                                   F.col("lo").alias("nlo"), F.col("hi").alias("nhi"))
    rng = o.agg(F.min("olo").alias("_omin"), F.max("ohi").alias("_omax"))
    n = attach(n, rng)
    n = n.withColumn("fill", (F.col("nlo") < F.col("_omin")) | (F.col("nhi") > F.col("_omax")))
    inside = n.where(~F.col("fill"))
    ov = inside.join(F.broadcast(o), (o["olo"] < inside["nhi"]) & (o["ohi"] > inside["nlo"]))
    ov = ov.select("new_idx", "new_wave", "old_idx", "old_wave",
                   (F.least("ohi", "nhi") - F.greatest("olo", "nlo")).alias("overlap"), F.lit(False).alias("fill"))
    filled = n.where(F.col("fill")).select("new_idx", "new_wave", F.lit(None).cast("int").alias("old_idx"),
                                           F.lit(None).cast("double").alias("old_wave"),
                                           F.lit(None).cast("double").alias("overlap"), F.lit(True).alias("fill"))
    return ov.unionByName(filled)


def resample_long(long: DataFrame, new_axis: DataFrame, fill: float = 0.0,
                  errors: str | None = None) -> DataFrame:
    """X1 (+ X2 when ``errors`` names an uncertainty column): flux-conserving
    resample, ``sum(overlap * flux) / sum(overlap)`` per new bin; errors
    ``sqrt(sum((overlap * err)^2)) / sum(overlap)``; out-of-range bins = fill."""
    old_axis = axis_of(long)
    wts = resample_weights(old_axis, new_axis)
    inside = F.broadcast(wts.where(~F.col("fill")))
    j = long.join(inside, long["wave"] == inside["old_wave"])
    aggs = [(F.sum(F.col("overlap") * F.col("intensity")) / F.sum("overlap")).alias("intensity")]
    if errors:
        aggs.append((F.sqrt(F.sum(F.pow(F.col("overlap") * F.col(errors), 2))) / F.sum("overlap")).alias("error"))
    out = j.groupBy("pkey", F.col("new_wave").alias("wave")).agg(*aggs)
    fills = wts.where(F.col("fill")).select(F.col("new_wave").alias("wave"))
    keys = long.select("pkey").distinct()
    fcols = [F.lit(fill).cast("double").alias("intensity")]
    if errors:
        fcols.append(F.lit(fill).cast("double").alias("error"))
    filled = attach(keys, fills).select("pkey", "wave", *fcols)
    return out.unionByName(filled)


def resample_vec(vec: DataFrame, old_axis: DataFrame, new_axis: DataFrame, fill: float = 0.0) -> DataFrame:
    """X1 in array form: the sparse weight matrix (one entry list per new bin)
    is broadcast once; each spectrum is resampled inside its row -- no shuffle."""
    wts = resample_weights(old_axis, new_axis)
    per_bin = wts.groupBy("new_idx").agg(
        F.first("fill").alias("fill"),
        F.array_sort(F.collect_list(F.struct("old_idx", "overlap"))).alias("e"))
    spec = per_bin.agg(F.array_sort(F.collect_list(F.struct("new_idx", "fill", "e"))).alias("bins"))
    j = attach(vec, spec)

    def one(b):
        num = F.aggregate(b["e"], F.lit(0.0),
                          lambda acc, e: acc + F.coalesce(e["overlap"] * F.element_at("x", e["old_idx"] + 1), F.lit(0.0)))
        den = F.aggregate(b["e"], F.lit(0.0), lambda acc, e: acc + F.coalesce(e["overlap"], F.lit(0.0)))
        return F.when(b["fill"], F.lit(fill).cast("double")).otherwise(num / den)
    return j.select("pkey", F.transform("bins", one).alias("x"))


def min_step_axis(axis: DataFrame) -> DataFrame:
    """Uniform axis from the first wave to the last + step with the minimum step
    (numpy ``arange`` semantics: first + i * step, i < ceil(span / step))."""
    w = Window.orderBy("idx")
    st = axis.select("wave", (F.col("wave") - F.lag("wave").over(w)).alias("d")) \
        .agg(F.min("d").alias("step"), F.min("wave").alias("first"), F.max("wave").alias("last"))
    n = F.ceil((F.col("last") + F.col("step") - F.col("first")) / F.col("step"))
    return st.select(F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("idx"), "first", "step") \
        .select("idx", (F.col("first") + F.col("idx") * F.col("step")).alias("wave"))


def resample_to_min_step(long: DataFrame, fill: float = 0.0) -> DataFrame:
    """Resample onto the minimum-step uniform axis; an equal axis is a no-op (Q7)."""
    ax = axis_of(long)
    new = min_step_axis(ax)
    diff = new.join(ax, "wave", "left_anti").count() + ax.join(new, "wave", "left_anti").count()
    return long if diff == 0 else resample_long(long, new, fill)


def closest_channel(axis: DataFrame, band: float) -> DataFrame:
    """T5: the channel nearest ``band`` (ties -> lower index)."""
    return axis.agg(F.min_by(F.struct("idx", "wave"), F.struct(F.abs(F.col("wave") - band), "idx")).alias("c")) \
        .select(F.col("c.idx").alias("idx"), F.col("c.wave").alias("wave"))


def band_normalize(long: DataFrame, band: float, fill: float = 0.0) -> DataFrame:
    """Divide every channel by the spectrum's intensity at ``band``.

    If ``band`` is not a channel it is inserted into the axis, everything is
    resampled onto that axis (which also changes the neighbouring bins, Q6),
    the band value is read, and the band channel is dropped again."""
    ax = axis_of(long)
    lim = ax.agg(F.min("wave").alias("lo"), F.max("wave").alias("hi")).first()
    if not (lim["lo"] < band < lim["hi"]):
        raise ValueError(f"band {band} not within spectrum bounds ({lim['lo']} - {lim['hi']})")
    exact = ax.where(F.col("wave") == F.lit(band)).limit(1).count() > 0
    if exact:
        src = long
    else:
        spark = long.sparkSession
        extra = spark.createDataFrame([(float(band),)], "wave double")
        new_axis = ax.select("wave").unionByName(extra)
        new_axis = new_axis.select(F.row_number().over(Window.orderBy("wave")).alias("idx") - 1, "wave") \
            .toDF("idx", "wave")
        src = resample_long(long, new_axis, fill)
    bv = src.where(F.col("wave") == F.lit(band)).select("pkey", F.col("intensity").alias("_b"))
    out = src.join(bv, "pkey").select("pkey", "wave", F.try_divide(F.col("intensity"), F.col("_b")).alias("intensity"))
    if not exact:
        out = out.where(F.col("wave") != F.lit(band))
    return out


def drop_channels_audit(long: DataFrame, axis: DataFrame, drop_idx: list[int]) -> DataFrame:
    """drop channels by index, then a null audit and a dropped-row count."""
    keep = axis.where(~F.col("idx").isin(*drop_idx)).select("wave")
    kept = long.join(F.broadcast(keep), "wave")
    before = long.agg(F.count(F.lit(1)).alias("rows_before"))
    after = kept.agg(F.count(F.lit(1)).alias("rows_after"),
                     F.count_if(F.col("intensity").isNull()).alias("null_values"),
                     F.count_distinct("wave").alias("channels_after"))
    return attach(before, after).select("rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_dropped"),
                "channels_after", "null_values")


def assert_no_nulls_vec(vec: DataFrame, x_col: str = "x") -> DataFrame:
    """fail the job when any spectrum holds a NULL or NaN (before baseline removal)."""
    return vec.withColumn(x_col, F.when(F.exists(x_col, lambda v: v.isNull() | F.isnan(v)),
                                        F.raise_error(F.lit("a spectrum has missing intensities: drop or fill them first")))
                          .otherwise(F.col(x_col)))
