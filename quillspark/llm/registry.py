"""Queries of this subpackage: each applies one operator to its whole table; SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.tables import table

from . import bpe, chunk_store, hmm, lang_id, line_quality, mixing, near_dedup, pii, prefix_trie, simhash, token_count, vector_codes, warc
from .sql import ORACLE_SQL

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"

__all__ = ["ORACLE_SQL", "QUERIES"]


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files are; they're the same on every worker."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(table(spark, sf_dir, "documents"))


def op3_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.spans(table(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.cross_fitted(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_store.round_trip(table(spark, sf_dir, "documents"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.counted(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE)))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_line_quality": op2_line_quality,
    "op3_pii_disclosure": op3_pii_disclosure,
    "op4_language_id": op4_language_id,
    "op5_source_mixing": op5_source_mixing,
    "op6_chunk_store": op6_chunk_store,
    "op7_token_count": op7_token_count,
    "op8_hidden_markov": op8_hidden_markov,
    "op9_warc": op9_warc,
    "op10_bpe": op10_bpe,
    "op11_vector_codes": op11_vector_codes,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}
