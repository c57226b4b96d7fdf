"""Streaming preprocessing and scoring.

Every operator here is row-local in the array form or a join against a
static, size-checked table (axis weights, model coefficients), so it runs
unchanged on ``readStream`` input: new spectra arriving as files are
resampled / normalised / baseline-corrected and scored as they come.  No
operator keeps cross-row state, so no watermark is needed.  Checkpoints go
to the shared checkpoint folder of the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specflow.session import ensure_checkpoint_dir

EMBEDDINGS_SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])


def spectra_stream(spark: SparkSession, folder: str, file_glob: str = "embeddings.parquet",
                   files_per_trigger: int = 1) -> DataFrame:
    """Spectra in ``folder`` as a stream of ``(pkey, x)`` rows: files that match, and files of folders that do."""
    # as a pattern even where it is a plain name: a path without one has to be a folder
    raw = (spark.readStream.schema(EMBEDDINGS_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
           .parquet(f"{folder.rstrip('/')}/{{{file_glob}}}"))
    return raw.select(F.col("vec_id").cast("string").alias("pkey"),
                      F.transform("embedding", lambda v: v.cast("double") + F.lit(1.0)).alias("x"))


def score_stream(stream: DataFrame, models: DataFrame) -> DataFrame:
    """S1 on a stream: stream-static join with the (bounded) model table."""
    from specflow.operators.scoring import predict_linear
    return predict_linear(stream, models)


def run_available(df: DataFrame, name: str, fmt: str = "parquet") -> str:
    """Process everything available now into a table under the checkpoint folder; return its path."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{name}-{uuid.uuid4().hex}"
    q = (df.writeStream.format(fmt).option("path", base + "/table")
         .option("checkpointLocation", base + "/state").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return base + "/table"


def preprocess_stream(stream: DataFrame, old_axis: DataFrame, new_axis: DataFrame, regions,
                      baseline: bool = True) -> DataFrame:
    """IO5 recipe on a stream: resample (broadcast weights) -> baseline removal
    (Arrow batches) -> region normalisation (row-local slices)."""
    from specflow.operators.baseline import remove_baseline
    from specflow.operators.preprocess import normalize_regions_vec, resample_vec
    v = resample_vec(stream, old_axis, new_axis)
    if baseline:
        v = remove_baseline(v)
    return normalize_regions_vec(v, new_axis, regions)
