"""The training corpus: documents through quality rules, language ID, MinHash near-dedup, suffix-array dedup and packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and its result is written as
Parquet and read again as the next one's docs. The first four return the columns of documents; the last returns the
parts of the packed documents (doc_id, part, bin_id, bin_offset, n_tokens, source, cluster).

Edge cases are those of the operators: rows with a null or empty text have no words and fail the quality rules,
repeated rows are near copies of each other and one stays, a table without rows gives no rows, and columns that
documents does not know pass through the first four stages untouched. n_chars follows a text that was shortened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweave.llm.common import cut, read_table
from sparkweave.llm.language_id import language_filter
from sparkweave.llm.near_dedup import near_dedup
from sparkweave.llm.packing import best_fit_packing
from sparkweave.llm.quality import quality_filter
from sparkweave.llm.suffix_dedup import suffix_dedup_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; trained on the labelled ones among docs."""
    return quality_filter(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known."""
    return language_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest, of each class of near copies."""
    return near_dedup(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 100 bytes that an earlier place holds."""
    return suffix_dedup_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Parts of documents in bins."""
    return best_fit_packing(docs)


STAGES = [("quality", quality), ("language", language), ("near_copies", near_copies), ("repeats", repeats), ("packing", packing)]
#: The classifiers, the packing and the signatures of the stages are not SQL; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
