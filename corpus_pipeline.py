"""A training corpus from `documents`: toxic and duplicate documents and benchmark leaks go, sources are mixed, the rest is dealt to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablelore.llm import stages
from tablelore.llm.common import scratch_path

STAGES = [
    ("toxicity", stages.toxicity),
    ("ngram_jaccard", stages.ngram_jaccard),
    ("decontamination", stages.decontamination),
    ("mixing", stages.mixing),
    ("sharding", stages.sharding),
]

#: The first stage is a fitted model; tests hold every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over all that the one before kept, written as Parquet and read again in between."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
