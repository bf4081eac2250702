"""Cleaning and packing a corpus: five stages of the subpackage ``loregraph.llm``.

Empty tables give empty results at every stage; further columns are kept, whatever their names, by all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loregraph.llm import decontaminate, exact_dedup, language_id, ngram_join, packing
from loregraph.llm._scratch import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language.

    Null texts and texts without a letter have none and go; without any learned language all go. Ids do not matter.
    """
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, the longest, then that of the smallest id; null ids rank last.

    Null, empty and blank texts are one group; rows that repeat id and text become one.
    """
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component of documents that share word five-grams (Jaccard 0.8 or more).

    Texts without words stay. Null ids rank last; of a component without any id the row of the least text hash stays.
    """
    return ngram_join.keep_one_per_component(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that benchmark items do not contaminate; each row is judged by itself, texts without words stay."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their bins: doc_id, piece, start, length, bin_id, slot, bin_used.

    Null and empty texts are their separator alone; repeated rows and null ids are packed each by itself.
    """
    return packing.packing_report(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("best_fit_packing", pack_bins),
]

#: PPM scores and best-fit packing cannot be put in SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each one written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
