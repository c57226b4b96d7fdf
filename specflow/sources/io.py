"""Spectra / metadata / result readers and writers (IO1-IO7, IO9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed names: columns that are never target variables.
ID_COLUMNS = ("pkey", "Sample_Name", "Sample Name")
FOLD_MARK = "Folds"


def read_spectra_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """IO1: wide CSV (``wave`` then one column per spectrum) -> long rows.

    Result ``(pkey string, wave double, intensity double)``.  Non-numeric
    axis labels become NULL waves and are kept (callers drop them, X8).
    """
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return wide_to_long(raw)


def wide_to_long(wide: DataFrame, axis_col: str = "wave") -> DataFrame:
    cols = [c for c in wide.columns if c != axis_col]
    casted = wide.select(
        F.expr(f"try_cast(`{axis_col}` as double)").alias("wave"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    long = casted.unpivot(["wave"], cols, "pkey", "intensity")
    return long.select("pkey", "wave", F.nanvl("intensity", F.lit(None)).alias("intensity"))


def read_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def variable_columns(meta: DataFrame) -> list[str]:
    """IO2 rule: every column that is not an id column and not a fold column."""
    return [c for c in meta.columns if c not in ID_COLUMNS and FOLD_MARK not in c]


def sample_column(meta: DataFrame) -> str | None:
    for c in ("Sample_Name", "Sample Name"):
        if c in meta.columns:
            return c
    return None


def metadata_to_targets(meta: DataFrame, variables: list[str] | None = None) -> DataFrame:
    """IO2: wide metadata -> ``target(pkey, sample_name, variable, y)``; NaN -> NULL."""
    variables = variables or variable_columns(meta)
    if not variables:
        raise ValueError("no target variables identified")
    s = sample_column(meta)
    base = meta.select(
        F.col("pkey").cast("string").alias("pkey"),
        (F.col(f"`{s}`").cast("string") if s else F.lit(None).cast("string")).alias("sample_name"),
        *[F.col(f"`{v}`").cast("double").alias(v) for v in variables])
    tall = base.unpivot(["pkey", "sample_name"], variables, "variable", "y")
    return tall.withColumn("y", F.nanvl("y", F.lit(None)))


def metadata_to_folds(meta: DataFrame) -> DataFrame:
    """Fold columns ``<var>_Folds`` / ``Folds`` -> ``folds(pkey, fold_col, fold)``."""
    fcols = [c for c in meta.columns if c.endswith(FOLD_MARK)]
    if not fcols:
        return meta.sparkSession.createDataFrame([], "pkey string, fold_col string, fold int")
    base = meta.select(F.col("pkey").cast("string").alias("pkey"),
                       *[F.col(f"`{c}`").cast("int").alias(c) for c in fcols])
    return base.unpivot(["pkey"], fcols, "fold_col", "fold")


def axis_scan(spectra_long: DataFrame) -> DataFrame:
    """IO3: the distinct axis only (column pruning keeps the scan to ``wave``)."""
    return spectra_long.select("wave").where(F.col("wave").isNotNull()).distinct()


def read_result_folders(spark: SparkSession, root: str,
                        file_name: str = "modelling_results.csv") -> DataFrame:
    """IO4 + U2: every ``modelling_results.csv`` below ``root`` with its folder.

    Columns are aligned by name: files are read together with those that have
    the same header, and a column that a file lacks is NULL."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_name)
    heads = files.text(root, wholetext=True).select(
        F.regexp_extract("value", r"^\s*([^\r\n]*)", 1).alias("header"), F.col("_metadata.file_path").alias("path"))
    out = None
    for r in heads.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect():
        df = spark.read.option("header", True).option("inferSchema", True).csv(r["paths"])
        path = F.col("_metadata.file_path")
        df = df.withColumn("folder", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
        df = df.toDF(*[c.strip() for c in df.columns])  # Q15: leading space in a header
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no {file_name} below {root}")
    return out


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                fmt: str = "parquet", mode: str = "overwrite", order_by: list | None = None) -> None:
    """IO6: one writer for every output table.

    T3: with ``order_by`` the rows keep that order over the files (file names
    ascend with it) and inside each file; a range sort, no single task."""
    if order_by:
        df = df.orderBy(*order_by)
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def parse_model_name(col: str | F.Column) -> tuple[F.Column, F.Column]:
    """IO9: ``<variable>_<method>_model`` -> (variable, method)."""
    c = F.col(col) if isinstance(col, str) else col
    base = F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?$", 1)
    return (F.regexp_extract(base, r"^(.+)_([^_]+)_model$", 1).alias("variable"),
            F.regexp_extract(base, r"^(.+)_([^_]+)_model$", 2).alias("method"))


def save_models(models: DataFrame, path: str) -> None:
    """IO7: linear model table ``(variable, method, param, intercept, coef)`` as Parquet,
    partitioned by variable and method (replaces pickled estimators)."""
    write_table(models, path, ["variable", "method"])


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def coefficient_table(models: DataFrame, axis: DataFrame) -> DataFrame:
    """Tall ``(variable, method, wave, coef)`` from the model table and the axis."""
    e = models.select("variable", "method", F.posexplode("coef").alias("idx", "coef"))
    return e.join(F.broadcast(axis), "idx").select("variable", "method", "wave", "coef")


def coefficient_overlay(coefs: DataFrame, spectrum_long: DataFrame) -> DataFrame:
    """J10 + F8: non-zero coefficients on numeric channels next to one spectrum's intensity."""
    c = coefs.where(F.col("coef") != 0).where(F.col("wave").isNotNull())
    return c.join(spectrum_long.select("wave", "intensity"), "wave")


def validate_inputs(spectra_wide: DataFrame | None, meta: DataFrame, min_variables: int = 1,
                    test_fold: int | None = None, fold_col: str | None = None) -> list[str]:
    """first columns ``wave`` / ``pkey``, enough variables, requested test fold present.

    Returns the variables; raises ValueError otherwise.  The fold check is a
    left-anti join of the requested fold against the distinct folds."""
    if spectra_wide is not None and spectra_wide.columns[0] != "wave":
        raise ValueError("first spectra column must be 'wave'")
    if meta.columns[0] != "pkey":
        raise ValueError("first metadata column must be 'pkey'")
    variables = variable_columns(meta)
    if len(variables) < min_variables:
        raise ValueError(f"need at least {min_variables} variable(s), found {variables}")
    if test_fold is not None:
        spark = meta.sparkSession
        want = spark.createDataFrame([(int(test_fold),)], "fold int")
        have = meta.select(F.col(f"`{fold_col}`").cast("int").alias("fold")).where(F.col("fold") != -1).distinct()
        if want.join(have, "fold", "left_anti").limit(1).count():
            raise ValueError(f"test fold {test_fold} not among the folds")
    return variables


def resolve_variable_column(meta: DataFrame, variable: str) -> str:
    """The metadata column for a model variable, trying ``_`` -> space."""
    if variable in meta.columns:
        return variable
    alt = variable.replace("_", " ")
    if alt in meta.columns:
        return alt
    raise ValueError(f"variable {variable} not in metadata")
