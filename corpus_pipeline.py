"""Clean, deduplicated, decontaminated, masked and packed training data from raw documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dosebin.llm.stages import STAGES
from dosebin.llm import files

# Not expressible in SQL: tokenizers, trained models and loopy message passing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each result is written as Parquet and read back."""
    folder = files.new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = files.written(stage(spark, docs, sf_dir), folder, name)
    return docs
