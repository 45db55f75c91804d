"""The corpus pipeline: quality rules, language, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swarmframe.llm import language_id, mixing, near_dedup, packing, quality_rules
from swarmframe.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or score below the cut go."""
    return quality_rules.keep_good(docs, quality_rules.learn_quality(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not clearly in one of the languages learned go: other languages, mixed ones, no language."""
    return language_id.keep_identified(docs, language_id.learn_languages(docs), least_margin=language_id.LEAST_MARGIN)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, sorted into the order in which the mixture takes them; packing follows the order of the written files."""
    return mixing.mix_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, in the order of the mixture."""
    return packing.pack_sequences(docs, in_order=True)


STAGES = [("quality rules", quality), ("language ID", language), ("near-dedup", dedup), ("mixing", mixture), ("packing", pack)]
#: Models, sketches and a linear program are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
