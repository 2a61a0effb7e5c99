"""The corpus pipeline: stages over ``documents``, each calling one operator of ``tessera.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import shared, stages

#: Name and function of each stage; a function takes (spark, docs, sf_dir).
STAGES = [
    ("quality_rules", stages.quality_rules),
    ("quality_classifier", stages.quality_classifier),
    ("near_duplicates", stages.near_duplicates),
    ("decontamination", stages.decontamination),
    ("byte_pairs", stages.byte_pairs),
]
#: The learned stages can't be expressed in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is written to the shared folder and read again, and the
    intermediate tables of the stage go."""
    docs = shared.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.written(docs, name, last=True)
    return docs
