"""File sources and sinks.

Reads always take an explicit schema (no inference); every intermediate
folder comes from :func:`tessera.session.scratch_path`, i.e. the shared folder
the cluster names, never a machine-local temp folder.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ------------------------------------------------------------------ CSV
def write_csv(df: DataFrame, path: str, null_value: str | None = None) -> None:
    """CSV with a header and no index column."""
    w = df.write.mode("overwrite").option("header", True)
    if null_value is not None:
        w = w.option("nullValue", null_value).option("emptyValue", '""')
    w.csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, null_value: str | None = None,
             mode: str = "FAILFAST") -> DataFrame:
    r = spark.read.schema(schema).option("header", True).option("mode", mode)
    if null_value is not None:
        r = r.option("nullValue", null_value)
    return r.csv(path)


def bulk_load(spark: SparkSession, csv_path: str, schema: T.StructType, table: str, location: str) -> DataFrame:
    """Drop and re-create a typed Parquet table at ``location``, then load a
    CSV into it (empty field = NULL, malformed rows fail the load)."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"CREATE TABLE {table} ({cols}) USING parquet LOCATION '{location}'")
    src = read_csv(spark, csv_path, schema, null_value="", mode="FAILFAST")
    src.write.insertInto(table, overwrite=True)
    return spark.table(table)


def scratch_table_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:10]}"


# ------------------------------------------------------------------ keyed text directories
def file_key(ending: str = ".txt", encoded: bool = False) -> Column:
    """The key that a file is named after: its name without the ending, URL
    decoded once more if it was written by ``write_keyed_text``."""
    plus = F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))  # a URI's plus is a plus
    name = F.regexp_replace(F.url_decode(plus), re.escape(ending) + "$", "")
    return F.url_decode(name) if encoded else name


def _read_dir(spark: SparkSession, path: str, key: str | None, ending: str, encoded: bool, **options) -> DataFrame:
    path_of = F.col("_metadata.file_path")
    if key is None:
        return spark.read.text(path, **options).withColumn("file", path_of)
    found = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=f"*{ending}", **options)
    return found.select("value", path_of.alias("file"), file_key(ending, encoded).alias(key))


def read_dir_lines(spark: SparkSession, path: str, key: str | None = None, ending: str = ".txt", encoded: bool = False) -> DataFrame:
    """Lines of every file under ``path`` with the file path and, as ``key``,
    the name of the file without its ending; without ``key`` a ``key=value``
    folder level becomes a column by partition discovery."""
    return _read_dir(spark, path, key, ending, encoded)


def read_dir_files(spark: SparkSession, path: str, key: str | None = None, ending: str = ".txt", encoded: bool = False) -> DataFrame:
    """The same with one row per file (whole text); for files of bounded size."""
    return _read_dir(spark, path, key, ending, encoded, wholetext=True)


# ------------------------------------------------------------------ climate text files
ANOMALY_COLUMNS = [
    "Year", "Month", "Monthly_Anomaly", "Monthly_Unc", "Annual_Anomaly", "Annual_Unc", "Five_year_Anomaly",
    "Five_year_Unc", "Ten_year_Anomaly", "Ten_year_Unc", "Twenty_year_Anomaly", "Twenty_year_Unc",
]


def parse_anomalies(lines: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Commented, whitespace-delimited rows to a typed table: drop lines with
    ``%`` and blank lines, split on whitespace, 2 int + 10 double columns
    (``NaN`` becomes null), keep rows with a monthly anomaly."""
    body = lines.where(~F.col(value).contains("%") & (F.trim(F.col(value)) != ""))
    tok = body.select(key, F.split(F.trim(F.col(value)), r"\s+").alias("t"))
    cols = []
    for i, name in enumerate(ANOMALY_COLUMNS):
        raw = F.try_element_at(F.col("t"), F.lit(i + 1))
        if i < 2:
            cols.append(raw.try_cast("int").alias(name))
        else:
            d = raw.try_cast("double")
            cols.append(F.nanvl(d, F.lit(None).cast("double")).alias(name))
    out = tok.select(key, *cols)
    return out.where(F.col("Monthly_Anomaly").isNotNull())


def parse_baselines(files: DataFrame, key: str, first_line: int = 54, value: str = "value") -> DataFrame:
    """Positional header block to 12 monthly baselines.

    Non-blank lines ``first_line`` .. ``first_line + 2`` (1-based) hold month
    names, temperatures and "+/-" uncertainties; tokens are aligned by
    position, the uncertainty row is shifted by one (its extra "+/-" token)
    and the label positions 0 and 13 are dropped.
    """
    lines = files.select(key, F.posexplode(F.filter(F.split(F.col(value), "\n"), lambda s: F.trim(s) != ""))
                         .alias("pos", "line"))
    block = lines.where(F.col("pos").between(first_line - 1, first_line + 1)).select(
        key, (F.col("pos") - (first_line - 1)).alias("row"), F.split(F.trim("line"), r"\s+").alias("toks"))
    toks = block.select(key, "row", F.posexplode("toks").alias("p", "tok"))
    w = Window.partitionBy(key, "row").orderBy("p")
    toks = toks.withColumn("next_tok", F.lead("tok").over(w))
    wide = toks.groupBy(key, "p").agg(
        F.max(F.when(F.col("row") == 0, F.col("tok"))).alias("Month"),
        F.max(F.when(F.col("row") == 1, F.col("tok"))).alias("base"),
        F.max(F.when(F.col("row") == 2, F.col("next_tok"))).alias("unc"),
    )
    return wide.where((F.col("p") > 0) & (F.col("p") < 13)).select(
        key, F.col("p").alias("month_no"), "Month",
        F.nanvl(F.col("base").try_cast("double"), F.lit(None).cast("double")).alias("Baseline_Temp"),
        F.nanvl(F.col("unc").try_cast("double"), F.lit(None).cast("double")).alias("Unc"))


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def climate_lines(series: DataFrame, key: str, header_lines: int = 53) -> DataFrame:
    """Render monthly series (key, year, month, anomaly, unc) in the
    commented text layout: ``header_lines`` comment lines (with blank lines
    mixed in, which readers skip), the 3-line baseline block, then one data
    row per month with NaN for missing values.  Returns (key, line_no, text)."""
    hdr = series.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(header_lines))).alias("h"))
    comments = hdr.select(
        key, (F.col("h") * 2).alias("line_no"),
        F.concat(F.lit("% header line "), F.col("h").cast("string"), F.lit(" for "), F.col(key)).alias("text"))
    blanks = hdr.where(F.col("h") % 10 == 0).select(key, (F.col("h") * 2 + 1).alias("line_no"), F.lit("").alias("text"))
    stats = series.groupBy(key, "month").agg(F.round(F.avg("anomaly"), 2).alias("b"),
                                             F.round(F.coalesce(F.stddev_samp("anomaly"), F.lit(0.0)), 2).alias("u"))
    months = series.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    base = months.join(stats, [key, "month"], "left")
    fmt = lambda c: F.when(c.isNull(), F.lit("NaN")).otherwise(F.format_string("%.2f", c))
    blk = base.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", "b"))), lambda s: fmt(s["b"])), " ")
        .alias("bs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", "u"))), lambda s: fmt(s["u"])), " ")
        .alias("us"))
    start = header_lines * 2 + 10
    b1 = blk.select(key, F.lit(start).alias("line_no"), F.lit("%      " + "  ".join(MONTHS)).alias("text"))
    b2 = blk.select(key, F.lit(start + 1).alias("line_no"), F.concat(F.lit("%     "), F.col("bs")).alias("text"))
    b3 = blk.select(key, F.lit(start + 2).alias("line_no"), F.concat(F.lit("% +/- "), F.col("us")).alias("text"))
    nan = F.lit("NaN")
    num = lambda c: F.when(c.isNull(), nan).otherwise(F.format_string("%.3f", c))
    rows = series.select(
        key, (F.lit(start + 10) + F.col("year") * 12 + F.col("month")).alias("line_no"),
        F.concat_ws("  ", F.col("year").cast("string"), F.col("month").cast("string"), num(F.col("anomaly")),
                    num(F.col("unc")), *[nan] * 8).alias("text"))
    return comments.unionByName(blanks).unionByName(b1).unionByName(b2).unionByName(b3).unionByName(rows)


def write_keyed_text(lines: DataFrame, key: str, path: str, ending: str = ".txt") -> None:
    """One text file per key, named after it (URL-encoded), lines in
    ``line_no`` order: all lines of a key go to one task, sorted before
    writing.  The driver renames one file per key."""
    spark = lines.sparkSession
    parts = f"{path.rstrip('/')}/_by_key"
    (lines.withColumn("__key", F.url_encode(key)).repartition("__key").sortWithinPartitions("__key", "line_no").select("__key", "text")
     .write.mode("overwrite").partitionBy("__key").option("maxRecordsPerFile", 0).text(parts))
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(parts)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if folder.isDirectory() and name.startswith("__key="):
            for f in fs.listStatus(folder.getPath()):
                if f.getPath().getName().startswith("part-"):
                    plain = url_unescaped(name[len("__key="):])
                    fs.rename(f.getPath(), hadoop.Path(path, plain + ending))
    fs.delete(root, True)


def url_unescaped(folder: str) -> str:
    """A partition folder's value: Spark escapes the percent sign once more."""
    from urllib.parse import unquote

    return unquote(folder)


# ------------------------------------------------------------------ partitioned sinks
def write_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "parquet", mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).format(fmt).save(path)
