"""Feature engineering and encoders (F*): fit on one frame, apply to any.

Fitted categories are a table with ordinals (``Dictionary``), joined where
they are applied; only one column per category needs a small vocabulary on the
driver, as its plan has that many columns.
Sampling and splits are exact and distributed: rows are ranked inside their
class by a seeded hash, using a two-level histogram so no class is ever sorted
in a single task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.scan import global_row_number
from tessera.session import scratch_path

# The generic words that mark a pet name as invalid (matched
# case-insensitively as substrings).
GENERIC_NAME_WORDS = [
    "Kitten", "Kittens", "Kitty", "Adoption", "Baby", "Name", "Kitties", "Stray", "Lost Dog",
    "Mixed", "Male", "Female", "MPSP", "Puppy", "Puppies", "Pups", "Pup",
]


def _require(df: DataFrame, col: str) -> None:
    if col not in df.columns:
        raise ValueError(f"no column {col!r} among {', '.join(df.columns)}")


# F1
def invalid_name(df: DataFrame, col: str, generic_words: Sequence[str] = GENERIC_NAME_WORDS,
                 fill: str = "No_Name", out: str = "invalid_name") -> DataFrame:
    import re

    _require(df, col)
    filled = F.coalesce(F.col(col), F.lit(fill))
    pattern = "(?i)(" + "|".join(re.escape(w) for w in generic_words) + ")"
    flag = ((F.length(filled) <= 2) | filled.rlike(pattern)).cast("int")
    return df.withColumn(col, filled).withColumn(out, flag)


def _safe(v) -> str:
    import re

    return re.sub(r"[^0-9A-Za-z]+", "_", str(v)).strip("_") or "blank"


@dataclass
class Vocabulary:
    """Sorted category list of one column, nulls last as their own category."""

    column: str
    values: list

    @classmethod
    def fit(cls, df: DataFrame, col: str, max_categories: int = 10_000) -> "Vocabulary":
        _require(df, col)
        vals = [r[0] for r in df.select(col).distinct().limit(max_categories + 1).collect()]
        if len(vals) > max_categories:
            raise ValueError(f"{col} has more than {max_categories} categories; use hashing instead")
        non_null = sorted(v for v in vals if v is not None)
        return cls(col, non_null + ([None] if any(v is None for v in vals) else []))

    @property
    def size(self) -> int:
        return len(self.values)

    def ordinal(self) -> Column:
        """1-based position in the vocabulary; 0 for unseen values."""
        c = F.col(self.column)
        known = [v for v in self.values if v is not None]
        found = F.lit(0)
        if known:
            found = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, v in enumerate(known, 1) for x in (v, i)]), c), F.lit(0))
        return F.when(c.isNull(), F.lit(len(self.values) if None in self.values else 0)).otherwise(found)

    def encode(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, self.ordinal())


@dataclass
class Dictionary:
    """All categories of one column as a table (value, ordinal): ordinals from
    1 in the order of the values, nulls last.  Any number of categories; the
    driver sees their count and the few hot values."""

    column: str
    table: DataFrame
    size: int
    hot: dict

    BROADCAST = 50_000  # rows up to which the table is sent to the tasks

    @classmethod
    def fit(cls, df: DataFrame, col: str) -> "Dictionary":
        _require(df, col)
        spark = df.sparkSession
        path = scratch_path(spark, "dictionary")
        counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        known = global_row_number(counts.where("value IS NOT NULL"), ["value"], "ordinal")
        known.write.parquet(path)
        n = spark.read.parquet(path).count()
        counts.where("value IS NULL").withColumn("ordinal", F.lit(n + 1).cast("long")).write.mode("append").parquet(path)
        table = spark.read.parquet(path)
        size, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        # a value with more than its part of the rows is dealt over several tasks; there are at most as many as parts
        part = max(total / int(spark.conf.get("spark.sql.shuffle.partitions")), 1.0)
        hot = {r.value: math.ceil(r.n / part) for r in table.where((F.col("n") > part) & F.col("value").isNotNull()).collect()}
        return cls(col, table.select("value", "ordinal"), size, hot)

    def encode(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the ordinal of its value as ``out``; 0 for unseen values."""
        d = self.table.select(F.col("value").alias("__value"), F.col("ordinal").alias("__ordinal"))
        if self.size <= self.BROADCAST:
            j = df.join(F.broadcast(d), F.col(self.column).eqNullSafe(F.col("__value")), "left")
        else:
            salts = F.lit(1)
            if self.hot:
                salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in self.hot.items() for x in kv]), F.col("__value")), F.lit(1))
            spread = d.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
            rows = df.withColumn("__value", F.col(self.column)).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int"))
            same = rows["__value"].eqNullSafe(spread["__value"]) & (rows["__salt"] == spread["__salt"])
            j = rows.join(spread, same, "left")
        return j.select(*[df[c] for c in df.columns], F.coalesce("__ordinal", F.lit(0)).alias(out))


def one_hot_vector(df: DataFrame, dictionary: Dictionary, out: str, keep_original: bool = True) -> DataFrame:
    """One sparse 0/1 vector per row, one place per category; all zeros for
    unseen values."""
    n = dictionary.size
    place = dictionary.encode(df, "__ordinal").withColumn("__place", F.when(F.col("__ordinal") > 0, F.col("__ordinal") - 1).otherwise(F.lit(n)).cast("double"))
    places = dictionary.table.select((F.col("ordinal") - 1).cast("double").alias("__place"))
    coder = OneHotEncoder(inputCol="__place", outputCol=out, handleInvalid="keep", dropLast=True).fit(places)
    coded = coder.transform(place).drop("__ordinal", "__place")
    return coded if keep_original else coded.drop(dictionary.column)


# F2 / F3
def one_hot(df: DataFrame, vocab: Vocabulary, keep_original: bool = False, named: bool = False) -> DataFrame:
    """``{col}_{i}`` 0/1 columns, i = 1-based vocabulary position, or
    ``{col}_{value}`` (``{col}_nan`` for nulls) if ``named``; unseen values get
    all zeros.  For more categories than columns are handy: ``one_hot_vector``."""
    c = F.col(vocab.column)
    cols = []
    for i, v in enumerate(vocab.values, start=1):
        cond = c.isNull() if v is None else (c == F.lit(v))
        name = ("nan" if v is None else v) if named else i
        cols.append(F.coalesce(cond.cast("int"), F.lit(0)).alias(f"{vocab.column}_{name}"))
    base = df.columns if keep_original else [x for x in df.columns if x != vocab.column]
    return df.select(*base, *cols)


# F4
def binary_encode(df: DataFrame, dictionary: Dictionary | Vocabulary) -> DataFrame:
    """Base-2 digits of the ordinal (most significant first) as
    ``{col}_0 .. {col}_{k-1}``; unseen values (ordinal 0) are all zeros."""
    n_bits = max(1, dictionary.size.bit_length())
    cols = [
        F.shiftright("__ordinal", n_bits - 1 - i).bitwiseAND(F.lit(1)).cast("int").alias(f"{dictionary.column}_{i}") for i in range(n_bits)
    ]
    coded = dictionary.encode(df, "__ordinal")
    return coded.select(*[x for x in df.columns if x != dictionary.column], *cols)


# F5
def relabel(df: DataFrame, col: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """Map codes through ``mapping``; codes not in it become null."""
    from tessera.functions.scalar import map_lookup

    _require(df, col)
    return df.withColumn(out or col, map_lookup(col, mapping))


# F6
def standardize(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Zero mean, unit population sd; the two moments are scalar subqueries
    over one aggregate."""
    _require(df, col)
    stats = df.agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("s"))
    m = stats.select("m").scalar()
    s = stats.select("s").scalar()
    return df.withColumn(out or f"{col}_z", (F.col(col) - m) / s)


# F11
def presence_flags(code: str | Column, first=(1, 3), second=(2, 3)) -> tuple[Column, Column]:
    c = F.col(code) if isinstance(code, str) else code
    return c.isin(*first).cast("int"), c.isin(*second).cast("int")


# F12
def multi_col_presence(df: DataFrame, cols: Sequence[str], labels: DataFrame, id_col: str, name_col: str,
                       prefix: str = "has_", max_labels: int = 1000) -> DataFrame:
    """One 0/1 column per label-table row (any of ``cols`` equals the label id)
    plus their count.  The label table is a small dimension, guarded."""
    rows = labels.select(id_col, name_col).orderBy(id_col).limit(max_labels + 1).collect()
    if len(rows) > max_labels:
        raise ValueError("label table too large for one column per label")
    arr = F.array(*[F.col(c) for c in cols])
    flags = [F.array_contains(arr, F.lit(r[0])).cast("int").alias(f"{prefix}{_safe(r[1]).lower()}") for r in rows]
    out = df.select("*", *flags)
    names = [f"{prefix}{_safe(r[1]).lower()}" for r in rows]
    total = F.lit(0)
    for n in names:
        total = total + F.col(n)
    return out.withColumn("n_present", total)


# F14
def text_score_features(df: DataFrame, text_flag_src: str, score: str, lang: str, keep_lang: str = "en") -> DataFrame:
    """Order matters: flag presence, fill 0, then zero out other languages
    (a missing language counts as "other", as pandas ``!=`` does)."""
    return (
        df.withColumn("has_text", F.col(text_flag_src).isNotNull().cast("int"))
        .withColumn(score, F.coalesce(F.col(score), F.lit(0)))
        .withColumn(score, F.when(~F.col(lang).eqNullSafe(keep_lang), F.lit(0)).otherwise(F.col(score)))
    )


# Exact hash-ranked selection per class
def hash_rank_select(df: DataFrame, group: str | None, ids: Sequence[str], seed: int,
                     quota: Mapping | Column | int, out: str = "selected", buckets_bits: int = 16) -> DataFrame:
    """Flag the ``quota`` rows with the smallest seeded hash in each group.

    ``quota`` is an int (same for all groups), a {group: n} mapping, or a
    Column expression over ``__n_group`` (the group size).  Exact: rows are
    bucketed by the top bits of the hash, bucket counts give the boundary
    bucket of every group, and only that one bucket is ranked row by row.
    """
    g = F.col(group) if group else F.lit(0)
    h = F.xxhash64(*[F.col(i) for i in ids], F.lit(seed))
    base = df.withColumn("__h", h).withColumn("__g", g).withColumn("__b", F.shiftright("__h", 64 - buckets_bits))
    hist = base.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__nb"))
    wg = Window.partitionBy("__g")
    hist = hist.withColumn("__n_group", F.sum("__nb").over(wg))
    if isinstance(quota, int):
        q = F.lit(quota)
    elif isinstance(quota, Mapping):
        q = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col("__g")),
                       F.lit(0))
    else:
        q = quota
    hist = hist.withColumn("__q", F.least(q.cast("long"), F.col("__n_group")))
    wc = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("__cum", F.sum("__nb").over(wc)).withColumn("__before", F.col("__cum") - F.col("__nb"))
    # below a group's boundary bucket all rows are in, above it none; of the
    # boundary bucket the first `__need` are
    inside = F.col("__cum") <= F.col("__q")
    cut = hist.groupBy("__g").agg(F.min(F.when(~inside, F.struct("__b", (F.col("__q") - F.col("__before")).alias("__need")))).alias("__cut"))
    cut = cut.select(F.col("__g").alias("__gc"), F.col("__cut.__b").alias("__at"), F.col("__cut.__need").alias("__need"))
    at, need, key = F.col("__at"), F.col("__need"), F.struct("__h", *ids)
    wb = Window.partitionBy("__g", "__b").orderBy("__h", *ids)
    spark, rows = df.sparkSession, cut.limit(_FEW_GROUPS + 1).collect()
    if len(rows) <= _FEW_GROUPS:
        # one row per group: the last row that is in, so that rows are flagged where they are read
        few = F.broadcast(spark.createDataFrame(rows, cut.schema))
        ranked = base.join(few, F.col("__g").eqNullSafe(F.col("__gc"))).where(F.col("__b") == at).select(
            "__g", key.alias("__key"), need.alias("__need"), F.row_number().over(wb).alias("__r"), F.rank().over(wb).alias("__k"))
        last = ranked.groupBy("__g").agg(F.max(F.when(F.col("__r") <= F.col("__need"), F.col("__key"))).alias("__last"),
                                         F.bool_or((F.col("__r") > F.col("__need")) & (F.col("__k") <= F.col("__need"))).alias("__tie"))
        found = {r["__g"]: r for r in last.collect()}
        if not any(r["__tie"] for r in found.values()):
            schema = T.StructType(cut.schema.fields[:2] + [last.schema["__last"]])
            ends = [(r["__gc"], r["__at"], found[r["__gc"]]["__last"] if r["__gc"] in found else None) for r in rows]
            j = base.join(F.broadcast(spark.createDataFrame(ends, schema)), F.col("__g").eqNullSafe(F.col("__gc")))
            flag = at.isNull() | (F.col("__b") < at) | ((F.col("__b") == at) & F.col("__last").isNotNull() & (key <= F.col("__last")))
            return j.withColumn(out, flag).drop("__h", "__g", "__b", "__gc", "__at", "__last")
        cut = few
    # many groups, or rows alike in all ids at a boundary: number them
    j = base.join(cut, F.col("__g").eqNullSafe(F.col("__gc")))
    open_ = at.isNotNull() & (F.col("__b") == at)
    part = j.where(open_).withColumn("__r", F.row_number().over(wb))
    part = part.withColumn(out, F.col("__r") <= need).drop("__r")
    rest = j.where(~open_).withColumn(out, at.isNull() | (F.col("__b") < at))
    return part.unionByName(rest).drop("__h", "__g", "__b", "__gc", "__at", "__need")


_FEW_GROUPS = 10_000  # boundaries of so many groups pass through the driver


def class_quota_fraction(frac: float) -> Column:
    """Quota = round-half-up(frac * group size), for stratified splits."""
    return F.floor(F.col("__n_group") * F.lit(frac) + F.lit(0.5))
