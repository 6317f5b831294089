"""Shared helpers of the llm operators."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space of the word rule [^\x20\x09-\x0D]+.  bytes.split() and
# bytes.lower() follow the same ASCII rules, so word work in Python is done on
# UTF-8 bytes.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the columns an operator works on, so that other columns of the
    caller cannot clash with the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def held_out(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod`` is 1; a null doc_id counts as ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod) == 1


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null and blank texts have none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def utf8(text: Column) -> Column:
    """Text as UTF-8 bytes, null as empty: what the Python stages read."""
    return F.coalesce(text, F.lit("")).cast("binary")


def slices(batches, column: str, max_bytes: int = 8 << 20):
    """Cut Arrow batches so that one slice holds at most ``max_bytes`` of the
    column (or a single longer row): bounds the Python objects of a task."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(int(np.searchsorted(ends, base + max_bytes, side="right")), start + 1)
            yield batch.slice(start, end - start)
            start = end


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is among kept's; a null doc_id matches null."""
    ids = kept.select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__kept"]), "left_semi")
