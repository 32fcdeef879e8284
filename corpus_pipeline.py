"""A corpus pipeline of five stages over the documents of a data folder; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.llm.common import stash, table

#: Name and function of every stage; a function takes (spark, docs, sf_dir).
STAGES = [
    ("toxicity", stages.without_toxic),
    ("quality_rules", stages.of_quality),
    ("ngram_join", stages.without_near_copies),
    ("mixing", stages.mixed),
    ("packing", stages.packed),
]

#: The stages train models and build signatures, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
