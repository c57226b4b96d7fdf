"""From documents to packed sequences: quality rules, line dedup, near duplicates,
decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.llm.common import materialize, table
from specflow.llm.op3_jaccard_join import one_of_each
from specflow.llm.op6_line_dedup import line_dedup
from specflow.llm.op7_mcd_quality import keep_good
from specflow.llm.op8_decontamination import decontaminate
from specflow.llm.op9_packing import packing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier test reject go."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another document keeps go; n_chars, where there is one, follows the text."""
    counts = ["kept_lines", "lost_lines"]
    while any(c in docs.columns for c in counts):
        counts = ["_" + c for c in counts]
    got = line_dedup(docs, n_lines=counts[0], n_dropped=counts[1])
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        kind = dict(docs.dtypes)["n_chars"]
        got = got.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return got.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as pieces in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenization isn't SQL: the stages are tested against brute force instead.
ORACLE_SQL = None
