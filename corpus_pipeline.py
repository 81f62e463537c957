"""The corpus pipeline: stages over ``documents``, each reading what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import language_id, mixing, near_duplicates, sentencepieces, surrogates
from corpusloom.session import scratch_folder

#: name, function(spark, docs, sf_dir). All stages but the last return the columns of documents.
STAGES = [
    ("language_id", language_id.stage),
    ("near_duplicates", near_duplicates.stage),
    ("pii_surrogates", surrogates.stage),
    ("source_mix", mixing.stage),
    ("sentencepiece", sentencepieces.stage),
]

#: Several stages (a trained network, keyed surrogates, a tokenizer) are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written as Parquet below the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = scratch_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
