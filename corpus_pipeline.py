"""The corpus pipeline: five stages over ``documents``, each one of the operators of ``tallyrow.llm``.

Every stage is written as Parquet and read again by the next one, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyrow.llm import contamination, mixing, neardup, quality, repeats
from tallyrow.llm.base import table
from tallyrow.session import materialize

NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it learns from the labelled rows of ``documents``."""
    return quality.keep_good(docs, quality.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates, linked from a similarity of 0.8 on."""
    return neardup.one_of_each(docs, NEAR_PERCENT)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts word spans that occur twice or more out of the texts; every document stays."""
    return repeats.without_repeats(docs)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a phrase of a benchmark item."""
    return contamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every document its rate and number of copies; none falls below one."""
    return mixing.mixed(docs, mixing.by_language(docs, table(spark, sf_dir, "labels")))


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", repeat_stage),
    ("benchmark_decontamination", contamination_stage),
    ("source_mixing", mixing_stage),
]
#: No stage but the exact ones can be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
