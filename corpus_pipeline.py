"""A corpus pipeline: toxicity, exact and near copies, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet and read again as the next stage's documents. The first four keep the
columns of documents; the last adds how often each document is taken (copies), its
source's weight, its tokens and its block.

Every stage takes null, empty and very long texts, null and shared ids, repeated
rows, empty tables and further columns of any name: rows are decided one by one by
their own text, null and empty texts count as one empty text (which is never toxic,
near-duplicate or contaminated; of several one stays after exact dedup), of ties
the smallest id stays and null ids come last, and further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelbase.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from voxelbase.llm.common import materialize

#: Similarity of near copies: the general contract; 85 is that of the query op5_near_dedup alone.
NEAR_PERCENT = 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar's model doesn't call toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.80 of five-word shingles) the smallest id."""
    return near_dedup.drop_near_copies(docs, NEAR_PERCENT)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, whole, with its number of copies; no source is repeated more than four times."""
    return mixing.with_copies(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_leaks),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learned toxicity model and the bisection of the mix have no SQL form; tests/llm hold run() against brute force.
ORACLE_SQL = None
