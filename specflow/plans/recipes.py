"""Batches of preprocessing recipes over datasets (IO5, IO6).

A recipe is a function ``(vec, axis) -> (vec, axis)`` on the array form.
Every (dataset, recipe) output becomes rows tagged with both ids and is
written partitioned by them -- the files and recipes are columns, not a
driver loop over files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specflow.operators.baseline import remove_baseline
from specflow.operators.preprocess import PRESETS, normalize_regions_vec, resample_vec


def resample_to(new_axis: DataFrame):
    def step(vec, axis):
        return resample_vec(vec, axis, new_axis), new_axis
    return step


def baseline(vec, axis):
    return remove_baseline(vec), axis


def normalise(preset: str):
    def step(vec, axis):
        return normalize_regions_vec(vec, axis, PRESETS[preset]), None
    return step


def run_recipes(vec: DataFrame, axis: DataFrame, recipes: dict, dataset: str) -> DataFrame:
    """``(dataset, recipe, pkey, x)`` for every recipe (a list of steps)."""
    out = None
    for name, steps in recipes.items():
        v, a = vec, axis
        for st in steps:
            v, a = st(v, a)
        part = v.select(F.lit(dataset).alias("dataset"), F.lit(name).alias("recipe"), "pkey", "x")
        out = part if out is None else out.unionByName(part)
    return out


def write_recipes(df: DataFrame, path: str) -> None:
    """IO6: one folder per (dataset, recipe)."""
    df.write.mode("overwrite").partitionBy("dataset", "recipe").parquet(path)
