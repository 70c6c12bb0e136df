"""A corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing and token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as a Parquet table in
the shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystat.llm import decontaminate, jaccard_join, mixing, quality_rules, token_output
from quarrystat.llm.common import materialize
from quarrystat.llm.queries import token_config

#: Five-word shingles, similarity of at least 0.8.
NEAR = jaccard_join.Join(k=5, num=80, den=100)
#: 90 per cent of the tokens that are left, each document once.
MIX = mixing.Mix(budget_percent=90, max_epochs=1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # fewer cached pieces than alone: workers that served earlier stages hold memory too
    return token_output.digest(docs, token_config(cached=120_000, batch_bytes=2_000_000))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("token output", tokens),
]

#: The near-duplicate components, the byte-level BPE and the shard files can't be expressed in SQL; tests compare with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs
