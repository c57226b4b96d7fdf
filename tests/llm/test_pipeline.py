"""The pipeline's stages take effect, keep the columns, and end in packed sequences."""

import pytest
from conftest import SF001
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, sizes, at = docs.columns, [docs.count()], docs
    for i, (name, stage) in enumerate(c.STAGES):
        stage(spark, at, SF001).write.parquet(str(tmp_path / str(i)))
        new = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(c.STAGES) - 1:
            assert new.columns == columns and 0 < new.count() <= sizes[-1], name
            assert new.join(at, "doc_id", "left_anti").isEmpty()
            sizes.append(new.count())
            at = new
    assert sizes[1] < sizes[0] and sizes[4] <= sizes[3]
    packed = spark.read.parquet(str(tmp_path / "4"))
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_empty(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        got = stage(spark, docs, SF001)
        assert got.count() == 0


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
