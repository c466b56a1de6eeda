"""Corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that the one before kept, written as Parquet and read
again in the shared folder, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmill.llm.common import read_table, staged
from gridmill.llm.stages import packing_stage, pii_stage, quality_stage, simhash_stage, toxicity_stage

STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", simhash_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: Classifier, fingerprints and tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; returns the last one's rows."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
