"""Quality rules: per-document counts and cross-document line frequency.

Native: DataFrame functions only.

* Base counts of each text (words, characters in words, symbols, repeated
  lines, words in repeated 3-word windows) come from array functions inside
  the row; nothing of a text is shuffled.
* Line frequency: every non-blank line is normalised (lower case, white space
  collapsed) and hashed; one row per (document, line) goes to the count of
  distinct documents per (host, line), pre-aggregated before the shuffle.  A
  line above a limit counts as removed in every document of the host but its
  first, so that one document of a group of copies stays whole.  A document
  that loses more than ``max_removed`` of its words is depleted and rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_RUN, SPACES, only, words

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    """A line is above the limits of its host if more than ``max_docs``
    distinct documents hold it, or more than ``min_docs`` and more than
    ``max_share`` of the host's documents."""

    max_docs: int = 100
    min_docs: int = 10
    max_share: float = 0.1
    max_removed: float = 0.5
    min_words: int = 50
    max_repeat: float = 0.5


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def normalised(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACES)), SPACE_RUN, " "))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Null and empty texts count 0 everywhere.  Windows are compared by their
    64-bit hash inside one text.
    """
    w, n, s = F.col("__w"), F.col("__n"), F.col("__s")
    windows = F.arrays_zip(
        F.slice(w, F.lit(1), n - 2).alias("a"), F.slice(w, F.lit(2), n - 2).alias("b"), F.slice(w, F.lit(3), n - 2).alias("c")
    )
    hashed = F.transform(windows, lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")

    def twice(x, j):
        same = lambda k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return same(j - 1) | same(j + 1)

    p, k = F.col("__p"), F.size("__p")
    # each position covers three words; a later one adds only what is new
    covered = F.aggregate(
        F.zip_with(F.slice(p, F.lit(1), k - 1), F.slice(p, F.lit(2), k - 1), lambda a, b: F.least(F.lit(3), b - a)),
        F.lit(3),
        lambda acc, x: acc + x,
    )
    lines = F.col("__l")
    return (
        docs.withColumn("__w", words(F.col(text)))
        .withColumn("__n", F.size("__w"))
        .withColumn("__l", _lines(F.col(text)))
        .withColumn("__s", F.when(n >= 4, F.sort_array(hashed)).otherwise(none))
        .withColumn("__d", F.filter(s, twice))
        .withColumn("__p", F.sort_array(F.transform("__d", lambda x: x["i"])))
        .withColumn("__c", F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.when(k > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        ))
        # generated, so that a caller's filter stays above: pushed below, it
        # would repeat these expressions many times over
        .select(*docs.columns, F.inline(F.array("__c")))
    )


def line_frequency(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per document (doc_id, host, text_hash): words in its lines and words in
    removed lines.  Rows that repeat a document exactly count once."""
    per_line = (
        docs.select("doc_id", "host", F.xxhash64("text").alias("text_hash"), F.explode(_lines(F.col("text"))).alias("line"))
        .select(
            "doc_id", "host", "text_hash", F.xxhash64(normalised(F.col("line"))).alias("line"), F.size(words(F.col("line"))).alias("n")
        )
        .groupBy("doc_id", "host", "text_hash", "line")
        .agg(F.sum("n").alias("n"))
    )
    host_docs = docs.groupBy("host").agg(F.count("*").alias("host_docs"))
    counts = per_line.groupBy("host", "line").agg(
        F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "text_hash")).alias("first")
    )
    common = counts.filter(F.col("n_docs") > limits.min_docs).alias("c").join(
        host_docs.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host"))
    ).filter(
        (F.col("n_docs") > limits.max_docs) | (F.col("n_docs") > F.col("host_docs") * limits.max_share)
    ).select(F.col("c.host").alias("c_host"), F.col("line").alias("c_line"), "first")
    d = per_line.alias("d")
    joined = d.join(
        common, F.col("d.host").eqNullSafe(F.col("c_host")) & (F.col("d.line") == F.col("c_line")), "left"
    )
    removed = F.col("c_line").isNotNull() & ~F.struct("d.doc_id", "d.text_hash").eqNullSafe(F.col("first"))
    return joined.groupBy("d.doc_id", "d.host", "d.text_hash").agg(
        F.sum("d.n").alias("line_words"), F.sum(F.when(removed, F.col("d.n")).otherwise(0)).alias("removed_words")
    )


def quality_rules(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """One row per input row: doc_id, the base counts, n_removed_words,
    base_failed and kept.

    Null or blank texts have no words, fail the base rule and are not kept.
    Repeated rows get equal rows; null doc_ids and hosts are values of their own.
    """
    d = only(docs, "doc_id", "text", host).withColumnRenamed(host, "host")
    freq = line_frequency(d, limits).select(
        F.col("doc_id").alias("f_id"), F.col("host").alias("f_host"), F.col("text_hash").alias("f_hash"), "line_words", "removed_words"
    ).filter(F.col("removed_words") > 0)
    base = base_counts(d.withColumn("text_hash", F.xxhash64("text"))).drop("text")
    out = base.join(
        freq,
        F.col("doc_id").eqNullSafe(F.col("f_id")) & F.col("host").eqNullSafe(F.col("f_host")) & (F.col("text_hash") == F.col("f_hash")),
        "left",
    )
    n, r = F.col("n_words"), F.col("n_repeat_words")
    # rows that repeat a document exactly share one sum: bring it back to one
    gone = F.coalesce(F.expr("removed_words * n_words div line_words"), F.lit(0)).cast("long")
    out = out.withColumn("n_removed_words", gone)
    out = out.withColumn("base_failed", (n < limits.min_words) | (r * 100 > n * int(limits.max_repeat * 100)))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("n_removed_words") <= n * limits.max_removed)).alias("kept"),
        "n_removed_words",
    )


def remove_lines(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """docs with clean_text: each text without its lines above the limits.

    The removed line hashes of a document are gathered per document (never
    more than its own lines) and applied inside the row.
    """
    d = only(docs, "doc_id", "text", host).withColumnRenamed(host, "host")
    per_line = d.select(
        "doc_id", "host", F.xxhash64("text").alias("text_hash"), F.explode(F.array_distinct(
            F.transform(_lines(F.col("text")), lambda x: F.xxhash64(normalised(x))))).alias("line")
    ).distinct()
    counts = per_line.groupBy("host", "line").agg(
        F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "text_hash")).alias("first")
    ).filter(F.col("n_docs") > limits.min_docs)
    host_docs = d.groupBy("host").agg(F.count("*").alias("host_docs"))
    common = counts.alias("c").join(host_docs.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host"))).filter(
        (F.col("n_docs") > limits.max_docs) | (F.col("n_docs") > F.col("host_docs") * limits.max_share)
    ).select(F.col("c.host").alias("c_host"), F.col("line").alias("c_line"), "first")
    gone = per_line.join(common, F.col("host").eqNullSafe(F.col("c_host")) & (F.col("line") == F.col("c_line"))).filter(
        ~F.struct("doc_id", "text_hash").eqNullSafe(F.col("first"))
    ).groupBy(F.col("doc_id").alias("g_id"), F.col("host").alias("g_host"), F.col("text_hash").alias("g_hash")).agg(
        F.collect_set("line").alias("gone")
    )
    out = d.withColumn("text_hash", F.xxhash64("text")).join(
        gone,
        F.col("doc_id").eqNullSafe(F.col("g_id")) & F.col("host").eqNullSafe(F.col("g_host")) & (F.col("text_hash") == F.col("g_hash")),
        "left",
    )
    left = F.filter(
        F.split("text", "\n"),
        lambda x: (F.btrim(x, F.lit(SPACES)) == "") | ~F.array_contains(F.col("gone"), F.xxhash64(normalised(x))),
    )
    return out.select(
        "doc_id", F.col("host").alias(host), "text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("clean_text")
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, source, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM dup) GROUP BY doc_id),
ln AS (SELECT doc_id, source, lower(regexp_replace(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')) AS x,
              len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
       FROM (SELECT doc_id, source, unnest(l) AS x FROM w)),
pl AS (SELECT doc_id, source, x, sum(n) AS n FROM ln GROUP BY ALL),
hd AS (SELECT source, count(*) AS hd FROM d GROUP BY source),
c AS (SELECT source, x, count(*) AS nd, min(doc_id) AS f FROM pl GROUP BY ALL),
bad AS (SELECT c.source, x, f FROM c JOIN hd ON c.source IS NOT DISTINCT FROM hd.source
        WHERE nd > 10 AND (nd > 100 OR nd > hd * 0.1)),
gone AS (SELECT pl.doc_id, sum(n) AS g FROM pl JOIN bad ON pl.source IS NOT DISTINCT FROM bad.source AND pl.x = bad.x
         WHERE pl.doc_id <> f GROUP BY pl.doc_id),
o AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
             coalesce(g, 0)::BIGINT AS n_removed_words
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AS base_failed,
       (NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND n_removed_words <= n_words * 0.5) AS kept,
       n_removed_words
FROM o
"""
