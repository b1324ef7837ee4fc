"""A training corpus from raw documents: STAGES in order, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import pipeline_stages as stages
from weftline.llm.shared import materialised

#: (name, function of spark, docs and the tables' folder); all but the last return the columns of ``documents``.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_dedup", stages.drop_near_duplicates),
    ("secrets", stages.redact_secrets),
    ("packing", stages.pack),
]

#: SQL can't express the trained stage; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all packed sequences, from the folder's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
