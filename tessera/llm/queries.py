"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_format as _chat
from tessera.llm import hard_negatives as _negatives
from tessera.llm import quality_rules as _quality
from tessera.llm.byte_bpe import round_trip
from tessera.llm.common import read_table
from tessera.llm.fingerprints import edit_likeness
from tessera.llm.html_tree import main_text
from tessera.llm.kneser_ney import language_model
from tessera.llm.licenses import scan_licenses
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.periodic_runs import run_digests
from tessera.llm.token_counts import count_tokens
from tessera.llm.toxicity import toxicity


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.quality_rules(read_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("at_fault").alias("n_sentences_at_fault"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(read_table(spark, sf_dir, "documents"), order=3)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


def op8_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(read_table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat.conversation_digests(_chat.with_planted(read_table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _negatives.mine(read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_packing, op3_toxicity, op4_byte_bpe, op5_language_model, op6_near_dedup,
    op7_token_counts, op8_html_tree, op9_licenses, op10_fingerprints, op11_periodic_runs,
    op12_chat_format, op13_hard_negatives,
)}
ORACLE_SQL = {"op1_quality_rules": _quality.ORACLE_SQL, "op12_chat_format": _chat.ORACLE_SQL,
              "op13_hard_negatives": _negatives.ORACLE_SQL}
