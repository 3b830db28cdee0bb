"""The corpus pipeline: five stages over ``documents``, each one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet to the shared folder and read again as the next one's ``docs``; a
stage's table is deleted once the next one stands.  All but the last return
the columns of ``documents``.

Every stage takes any rows: null and empty texts, null and repeated ids, rows
that repeat as a whole, other columns.  What it does with them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factmill.llm import mixing, near_dedup, packing, quality, toxicity
from factmill.session import cut, drop, ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all of ``labels``, doesn't reject.

    Null texts are judged as empty ones; rows that repeat are judged each.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain, fitted on all of ``labels``, doesn't reject.

    Null and empty texts aren't toxic and stay; rows that repeat are judged each.
    """
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8).

    Documents without words stay, one of each that repeat with their id;
    of rows with one id and text, and of rows without an id that have one text, one stays.
    """
    return near_dedup.deduplicated(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them.

    Documents without words are never taken; a null source is a source of its own.
    """
    return mixing.mixed_documents(docs, docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each piece of each document; one without words has no bin, one that the mixture repeats has copies."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-duplicates", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifiers can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on ``documents``."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
            drop(before)
    return docs
