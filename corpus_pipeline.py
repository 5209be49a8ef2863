"""A corpus from documents: language, quality, near duplicates, benchmark copies, packed sequences.

Each stage takes what its predecessor wrote.  The stages are judged one by one: a row that one rejects is gone
for the next.  Columns of any name pass through every stage but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from signalcontext.llm import decontamination, jaccard_join, language_id, packing, robust_outliers
from signalcontext.llm.common import scope, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts in which no learned language prevails, go.

    Null and empty texts go; repeated rows are judged each; a null doc_id or lang is judged like any other row (a null
    lang is not learned from); an empty table, and one without any lang, gives no rows."""
    return language_id.apply(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie far from their language and source go.

    Null and empty texts fail the base rule; null languages and sources are groups; repeated rows count each."""
    return robust_outliers.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, that of the smallest doc_id.

    Of rows that repeat a doc_id one stays; rows with a null doc_id or a text without words stay."""
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go; with an empty benchmark, or items of null text alone, all stay."""
    return decontamination.apply(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences: each row's ids in gapless sequences; an empty table gives none."""
    return packing.pack(docs)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("sequences", sequences)]

#: Languages and quality are learned and windows packed greedily: tests hold the rows of run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir; each stage is written to the shared folder and read again.
    What a stage kept for itself is deleted when it is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
