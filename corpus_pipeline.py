"""The corpus pipeline: quality, near-duplicates, decontamination, packing.

Every stage works on all rows that its predecessor kept. The first three return the columns of documents; the last returns one
row per packed piece. Between stages the rows are written below the shared folder and read back, so a lost executor costs at
most one stage and no stage repeats the work of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlake.llm import decontaminate, minhash, packing, quality
from postlake.llm.common import materialize

#: Percent of shared shingles from which two documents count as near-duplicates.
NEAR_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts; it learns from their own labels."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id."""
    return minhash.keep_first(docs, percent=NEAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the remaining documents with their sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", first_of_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: Forests, signatures and tokenizers have no SQL form; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
