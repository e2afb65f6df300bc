"""A corpus pipeline over ``documents``: each stage calls one llm operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sellerdesk.llm.stages import STAGES
from sellerdesk.session import stage

ORACLE_SQL = None  # XXH64 fingerprints, learned weights and tokenizer ids: SQL cannot express them


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
