"""Adapters from the driver's parquet tables to the engine's logical schemas.

They only rename and reshape columns into the schemas the operators take
(spectra, metadata, predicted/actual, grids); no operator work happens here.

Role mapping (fixed):
  spectra      embeddings: pkey = vec_id, channel i of ``embedding`` at
               wave = WAVE0 + WAVE_STEP * i, intensity = value + 1.0
  metadata     embeddings: variable ``label``; sample = four consecutive shots
  pred/actual  lineitem: variable l_returnflag, method l_linestatus,
               actual l_extendedprice, pred l_extendedprice * (1 - l_discount)
  folds        customer (c_acctbal by c_nationkey), orders (o_totalprice by o_custkey)
  grid walk    part: variable p_brand, position p_size, rmsecv avg(p_retailprice)
  sensitivity  events: value by event_type
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The synthetic axis laid over embedding channels (nm).
WAVE0 = 240.0
WAVE_STEP = 10.0
SHOTS_PER_SAMPLE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pkey string, x array<double>)``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("pkey"),
                    F.transform("embedding", lambda v: v.cast("double") + F.lit(1.0)).alias("x"))


def axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(idx int, wave double)`` for the channels present in the table."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.max(F.size("embedding")).alias("p"))
    return (n.select(F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("idx"))
            .select("idx", (F.lit(WAVE0) + F.lit(WAVE_STEP) * F.col("idx")).alias("wave")))


def spectra_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pkey string, wave double, intensity double)``."""
    e = table(spark, sf_dir, "embeddings")
    return (e.select(F.col("vec_id").cast("string").alias("pkey"),
                     F.posexplode("embedding").alias("idx", "v"))
            .select("pkey", (F.lit(WAVE0) + F.lit(WAVE_STEP) * F.col("idx")).alias("wave"),
                    (F.col("v").cast("double") + F.lit(1.0)).alias("intensity")))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide metadata ``(pkey, Sample_Name, label)``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("pkey"),
                    F.concat(F.lit("S"), (F.col("vec_id") / SHOTS_PER_SAMPLE).cast("long").cast("string")).alias("Sample_Name"),
                    F.col("label").cast("double").alias("label"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tall ``target(pkey, sample_name, variable, y)``."""
    from specflow.sources.io import metadata_to_targets
    return metadata_to_targets(metadata(spark, sf_dir), ["label"])


def pred_true(spark: SparkSession, sf_dir: str, with_split: bool = False) -> DataFrame:
    """``(pkey, variable, method, fold, actual, pred[, split])`` from lineitem;
    the split is 'test' for rows shipped from 2000 on, else 'train'."""
    li = table(spark, sf_dir, "lineitem")
    extra = [F.when(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp"), "test")
             .otherwise("train").alias("split")] if with_split else []
    return li.select(*extra,
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pkey"),
        F.col("l_returnflag").alias("variable"), F.col("l_linestatus").alias("method"),
        F.col("l_linenumber").alias("fold"),
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pred"))


def customer_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata ``(pkey, Sample_Name, acctbal)``; a negative balance is a missing value."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("pkey"),
                    F.col("c_nationkey").cast("string").alias("Sample_Name"),
                    F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("acctbal"),
                    F.col("c_nationkey").cast("double").alias("nation"))


def orders_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("pkey"),
                    F.col("o_custkey").cast("string").alias("Sample_Name"),
                    F.col("o_totalprice").alias("totalprice"))
