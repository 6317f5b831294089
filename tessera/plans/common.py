"""Derived fixture tables shared by several plans (all lazy DataFrames)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import Tables


def ts(s: str):
    """A timestamp_ntz literal (fixture timestamps are NTZ)."""
    return F.lit(s).cast("timestamp_ntz")


def docs_labels(t: Tables) -> DataFrame:
    """documents LEFT JOIN labels (real nulls for unlabelled documents)."""
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")


DOCS_LABELS_SQL = (
    "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)


def nation_pairs(t: Tables) -> DataFrame:
    """Lines with the customer and supplier nation of each line."""
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linenumber")
    o = t.orders.select("o_orderkey", "o_custkey")
    c = t.customer.select("c_custkey", "c_nationkey")
    s = t.supplier.select("s_suppkey", "s_nationkey")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .join(s, li.l_suppkey == s.s_suppkey)
        .select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "c_nationkey", "s_nationkey")
    )


NATION_PAIRS_SQL = (
    "(SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag, l.l_extendedprice, c.c_nationkey, s.s_nationkey "
    "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
    "JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey)"
)


def nation_monthly(t: Tables) -> DataFrame:
    """Monthly series per customer nation ("country"): avg price of pending
    orders, null in months without one (the climate-series analogue)."""
    o = t.orders.select("o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    c = t.customer.select("c_custkey", "c_nationkey")
    n = t.nation.select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy(
        F.col("n_name").alias("country"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
    ).agg(
        F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("value"),
        F.count(F.lit(1)).alias("n_orders"),
    )


NATION_MONTHLY_SQL = (
    "(SELECT n.n_name AS country, CAST(year(o.o_orderdate) AS INTEGER) AS year, "
    "CAST(month(o.o_orderdate) AS INTEGER) AS month, "
    "max(CASE WHEN o.o_orderstatus = 'P' THEN o.o_totalprice END) AS value, count(*) AS n_orders "
    "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey "
    "GROUP BY 1, 2, 3)"
)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)
