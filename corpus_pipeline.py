"""Corpus preparation: toxicity filter, exact and near deduplication, pseudonyms, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import stages
from flowlens.llm.common import staged
from flowlens.plans.small import scratch_path, workspace

STAGES = [
    ("toxicity", stages.toxicity),
    ("exact_dedup", stages.exact),
    ("near_dedup", stages.near),
    ("pii", stages.private),
    ("packing", stages.packed),
]
# Near duplicates, the fitted classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage works on what the one before kept, written to the shared folder as Parquet and deleted at the end."""
    out = scratch_path(spark, "pipeline")
    with workspace(spark):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES:
            docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        docs.write.parquet(out)
    return spark.read.schema(docs.schema).parquet(out)
