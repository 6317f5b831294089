"""Source and sink queries (S1-S3, S8-S14, S17) and the streaming bidder (K5).

Every file these queries write goes to a fresh folder under the shared
scratch location (derived from ``spark.checkpoint.dir``)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import relational as R
from tessera.plans.common import nation_monthly, tables
from tessera.plans.registry import query
from tessera.session import scratch_path
from tessera.sources import files as FS
from tessera.sources.html import html_to_text
from tessera.streaming import bidder_stream as BS

ORDERS_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.StringType()),
])


@query("scan_csv", "SELECT * FROM orders")
def scan_csv(spark, sf_dir):
    """CSV with header read back with an explicit schema (round trip)."""
    path = scratch_path(spark, "orders-csv")
    FS.write_csv(tables(spark, sf_dir).orders, path)
    return FS.read_csv(spark, path, ORDERS_SCHEMA)


_BULK_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType()),
])


@query(
    "bulk_load",
    "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d "
    "LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def bulk_load(spark, sf_dir):
    """Typed table dropped, re-created and bulk-loaded from CSV, where an
    empty field is NULL."""
    t = tables(spark, sf_dir)
    src = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")
    csv = scratch_path(spark, "bulk-csv")
    FS.write_csv(src.select(*[f.name for f in _BULK_SCHEMA.fields]), csv, null_value="")
    name = FS.scratch_table_name("tessera_bulk")
    return FS.bulk_load(spark, csv, _BULK_SCHEMA, name, scratch_path(spark, "bulk-table"))


@query(
    "sink_roundtrip",
    "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderstatus FROM orders",
)
def sink_roundtrip(spark, sf_dir):
    """Parquet sink partitioned by status, read back (no index column)."""
    path = scratch_path(spark, "orders-parquet")
    FS.write_partitioned(tables(spark, sf_dir).orders, path, ["o_orderstatus"])
    back = spark.read.parquet(path)
    return back.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")


# ------------------------------------------------------------------ climate-style text files
def climate_dir(spark, sf_dir) -> str:
    """Write one commented text file per country from the monthly series."""
    s = nation_monthly(tables(spark, sf_dir)).select(
        "country", "year", "month", F.round(F.col("value") / 100000, 3).alias("anomaly"),
        (F.col("n_orders") / 100.0).alias("unc"))
    path = scratch_path(spark, "climate")
    FS.write_keyed_text(FS.climate_lines(s, "country"), "country", path)
    return path


@query("scan_dir_keyed")
def scan_dir_keyed(spark, sf_dir):
    """Directory of per-country files read at once; the key is the name of the
    file; lines and data lines per key."""
    lines = FS.read_dir_lines(spark, climate_dir(spark, sf_dir), "country", encoded=True)
    return lines.groupBy("country").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(~F.col("value").contains("%") & (F.trim("value") != "")).alias("n_data_lines"),
        F.countDistinct("file").alias("n_files"))


@query("parse_climate")
def parse_climate(spark, sf_dir):
    lines = FS.read_dir_lines(spark, climate_dir(spark, sf_dir), "country", encoded=True)
    return FS.parse_anomalies(lines, "country")


@query("parse_baseline")
def parse_baseline(spark, sf_dir):
    files = FS.read_dir_files(spark, climate_dir(spark, sf_dir), "country", encoded=True)
    return FS.parse_baselines(files, "country", first_line=54)


# ------------------------------------------------------------------ documents
@query("html_extract")
def html_extract(spark, sf_dir):
    """Text of <article> elements, without nav, script, style and ad blocks."""
    return html_to_text(tables(spark, sf_dir).pages, "page_id", "html", keep_cols=["url"])


@query(
    "doc_ingest",
    "SELECT doc_id AS doc_num, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS page_num, "
    "source AS doc_source, unnest(string_split(text, chr(10))) AS page_content FROM documents",
)
def doc_ingest(spark, sf_dir):
    """Paged ingestion: one row per page (line) with page and document
    numbers and the source."""
    d = tables(spark, sf_dir).documents
    ex = d.select(F.col("doc_id").alias("doc_num"), F.col("source").alias("doc_source"),
                  F.posexplode(F.split("text", "\n")).alias("pos", "page_content"))
    return ex.select("doc_num", (F.col("pos") + 1).alias("page_num"), "doc_source", "page_content")


@query(
    "doc_union_sources",
    "SELECT 'documents' AS source, doc_id AS doc_num, CAST(length(text) AS INTEGER) AS n_chars FROM documents "
    "UNION ALL SELECT 'pages', page_id, CAST(length(html) AS INTEGER) FROM pages "
    "UNION ALL SELECT 'benchmark', item_id, CAST(length(text) AS INTEGER) FROM benchmark",
)
def doc_union_sources(spark, sf_dir):
    """Per-source jobs unioned into one collection, written partitioned by
    source and read back."""
    t = tables(spark, sf_dir)
    parts = [
        t.documents.select(F.lit("documents").alias("source"), F.col("doc_id").alias("doc_num"), "text"),
        t.pages.select(F.lit("pages").alias("source"), F.col("page_id").alias("doc_num"), F.col("html").alias("text")),
        t.benchmark.select(F.lit("benchmark").alias("source"), F.col("item_id").alias("doc_num"), "text"),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    path = scratch_path(spark, "collection")
    FS.write_partitioned(u, path, ["source"])
    back = spark.read.parquet(path)
    return back.select("source", "doc_num", F.length("text").alias("n_chars"))


@query(
    "head_tail",
    "SELECT * FROM (SELECT 'head' AS part, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5) "
    "UNION ALL SELECT * FROM (SELECT 'tail' AS part, o_orderkey, o_totalprice FROM orders "
    "ORDER BY o_orderkey DESC LIMIT 5)",
)
def head_tail(spark, sf_dir):
    """First and last rows in an explicit order (each a partial top-k)."""
    o = tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice")
    head = o.orderBy("o_orderkey").limit(5).select(F.lit("head").alias("part"), "o_orderkey", "o_totalprice")
    tail = o.orderBy(F.desc("o_orderkey")).limit(5).select(F.lit("tail").alias("part"), "o_orderkey", "o_totalprice")
    return head.unionByName(tail)


@query("vector_collection", "SELECT vec_id, label, embedding FROM embeddings")
def vector_collection(spark, sf_dir):
    """Vector collection sink: re-create (overwrite) with one part of the
    vectors, append the rest, read the collection back."""
    e = tables(spark, sf_dir).embeddings.select("vec_id", "label", "embedding")
    path = scratch_path(spark, "vectors")
    FS.write_partitioned(e.where(F.col("label") < 5), path, ["label"], mode="overwrite")
    FS.write_partitioned(e.where(F.col("label") >= 5), path, ["label"], mode="append")
    return spark.read.parquet(path).select("vec_id", "label", "embedding")


@query("schema_table")
def schema_table(spark, sf_dir):
    """Schema of lineitem as rows, with non-null counts from one scan."""
    return R.schema_table(tables(spark, sf_dir).lineitem)


# ------------------------------------------------------------------ streaming
@query("next_bid_stream")
def next_bid_stream(spark, sf_dir):
    """K4 as a stateful stream over a replayed file source (availableNow): four
    files shuffled in time and two that close the log, one file a trigger; the
    watermark's delay covers the log's whole span."""
    ev = tables(spark, sf_dir).events
    n, thr = ev.agg(F.count(F.lit(1)), F.count(F.lit(1)) / F.countDistinct("user_id") / F.lit(10.0)).first()
    src = scratch_path(spark, "events-replay")
    BS.write_replay_files(ev, src, 4)
    out = BS.run_bidder_stream(spark, src, ev.schema, float(thr), scratch_path(spark, "bids-sink"),
                               scratch_path(spark, "bids-ckpt"), "60 days", shards=max(64, n // 5_000))
    return out.select("event_type", "user_id", "event_id", "ts", "draws", "wins", F.round("cost", 6).alias("cost"),
                      F.round("cost_seen", 6).alias("cost_seen"), "clicks", "bid", "next_bid")
