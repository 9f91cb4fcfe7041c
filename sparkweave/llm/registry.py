"""Queries opN_<name>: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .chat_format import chat_digest, hostile
from .common import ROW, read_table, with_row_ids
from .embedding_dedup import embedding_near_duplicates
from .language_id import language_id
from .lm_scoring import lm_scoring
from .near_dedup import near_classes, near_duplicates
from .packing import best_fit_packing
from .pieces import pieces_digest
from .quality import quality_rules
from .suffix_dedup import suffix_dedup_digest
from .token_files import token_file_digest


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer files are; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup_digest(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), kept, n_shingles."""
    found = near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", found.class_rid.alias("class_id"), (found.rid == found.class_rid).alias("kept"), "n_shingles")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return chat_digest(turns.unionByName(hostile(spark)))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(read_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(read_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No bin holds two documents of one class of near copies (five words, 0.8)."""
    rows = with_row_ids(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"), ROW, every=True)
    return best_fit_packing(rows, cluster=ROW, classes=near_classes(rows))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_suffix_dedup,
        op2_minhash_near_dedup,
        op3_chat_formatting,
        op4_sentencepiece,
        op5_token_files,
        op6_best_fit_packing,
        op7_language_id,
        op8_lm_scoring,
        op9_quality_rules,
        op10_embedding_near_dedup,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": oracles.SUFFIX_DEDUP,
        "op2_minhash_near_dedup": oracles.NEAR_DEDUP,
        "op3_chat_formatting": oracles.CHAT_FORMATTING,
        "op10_embedding_near_dedup": oracles.EMBEDDING_NEAR_DEDUP,
    }
