"""The operators as stages of a corpus pipeline: each takes (spark, docs, sf_dir) and returns what it keeps.

Every stage but the last returns the columns it was given, with their own values whatever their names: they are renamed
for the operator and back. Null, empty and very long texts, null and repeated ids, and empty tables are taken as the
operators take them: texts without words pass the toxicity stage, fail the quality rules and so end there; rows that
repeat an id stay or go together in the near-copy stage and are mixed together; a null id is never a near copy; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, ngram_join, packing, quality_rules, toxicity
from tessera.llm.common import stash, table


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that can't clash with an operator's, and the new name of every column."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't predict toxic."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    d, names = _renamed(docs)
    return toxicity.score(d, model, names["text"]).where("predicted = 0").select(*names.values()).toDF(*names)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; ratios and threshold are learned from all documents of the stage."""
    model = quality_rules.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    d, names = _renamed(docs)
    return quality_rules.judge(d, model, names["doc_id"], names["text"]).where("kept").select(*names.values()).toDF(*names)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every class of near copies; rows that share an id stay or go together."""
    classes = ngram_join.ngram_join(docs.select("doc_id", "text"))
    gone = stash(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    d, names = _renamed(docs)
    side = F.broadcast(gone) if gone.count() <= ngram_join.BROADCAST_IDS else gone
    return d.join(side, F.col(names["doc_id"]) == F.col("gone"), "left_anti").toDF(*names)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources: documents as often as it takes them."""
    return mixing.realise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences."""
    return packing.pack(docs)
