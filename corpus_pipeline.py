"""The corpus pipeline: from raw documents to packed training sequences.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  Every stage works on all its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import keep_rows, read_table
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.quality_rules import quality_rules
from tessera.llm.toxicity import without_toxic
from tessera.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules keep, as they are."""
    return keep_rows(docs, quality_rules(docs).filter("kept"))


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic by a model trained on the
    labelled ones among them; null and empty texts stay, every row is decided by
    its own text."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; of repeated rows of that
    document, one."""
    kept = keep_rows(docs, near_duplicates(docs).filter("kept"))
    repeated = docs.groupBy("doc_id").count().filter("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id"])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in their sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("toxicity", clean_language),
    ("near_dedup", one_of_each),
    ("packing", packing),
]

# Model training, LSH and tokenizing have no SQL form; tests/llm compares the
# stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
