"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node reachable.

    A round gives each node the smallest label around it and then that label's own
    label, so the rounds grow with the logarithm of a path's length.  Nulls and loops
    are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    both = materialize(e.union(e.select("b", "a")).distinct(), "cc-edges")
    label = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "cc-labels")
    for _ in range(most_rounds):
        far = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        step = label.join(far, label["node"] == far["a"]).select("node", "comp", F.least("comp", "near").alias("next"))
        root = label.select(F.col("node").alias("root"), F.col("comp").alias("up"))
        new = materialize(step.join(root, step["next"] == root["root"])
                          .select("node", F.col("comp").alias("old"), F.least("next", "up").alias("comp")), "cc-labels")
        if new.filter("old <> comp").isEmpty():
            return new.select("node", "comp")
        label = new.select("node", "comp")
    raise RuntimeError(f"labels still change after {most_rounds} rounds")
