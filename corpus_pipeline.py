"""From raw documents to packed windows: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.llm import decontamination, packing
from scoreweave.llm.common import tasks_find_library
from scoreweave.llm.jaccard import one_of_each
from scoreweave.llm.quality import quality
from scoreweave.llm.secrets import without_secrets
from scoreweave.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns, whatever these are named."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return quality(rows).filter("quality.kept").select("row.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8) the document with the least id, null last."""
    tasks_find_library(spark)
    return one_of_each(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of a benchmark item."""
    tasks_find_library(spark)
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; ``n_chars`` follows the new text."""
    out = without_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, in windows of 1024 tokens."""
    tasks_find_library(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", one_of_near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", packed),
]

#: SQL can't tokenize; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
