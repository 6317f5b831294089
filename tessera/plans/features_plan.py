"""Feature-engineering queries (F*) and exact splits/sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as X
from tessera.operators import features as FE
from tessera.plans.common import DOCS_LABELS_SQL, NATION_PAIRS_SQL, docs_labels, nation_pairs, tables, ts
from tessera.plans.registry import query

_PART_WORDS = ["widget", "gizmo", "thing"]


@query(
    "invalid_name",
    "SELECT p_partkey, coalesce(p_name, 'No_Name') AS p_name, "
    "CAST(length(coalesce(p_name, 'No_Name')) <= 2 OR regexp_matches(coalesce(p_name, 'No_Name'), "
    "'(?i)(widget|gizmo|thing)') AS INTEGER) AS invalid_name FROM part",
)
def invalid_name(spark, sf_dir):
    p = tables(spark, sf_dir).part.select("p_partkey", "p_name")
    return FE.invalid_name(p, "p_name", _PART_WORDS)


def _orders_split(t):
    o = t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority")
    train = o.where(F.col("o_orderdate") < ts("1999-01-01"))
    return o, train


@query(
    "onehot_fit_apply",
    "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS split, "
    + ", ".join(
        f"CAST(o_orderpriority = '{v}' AS INTEGER) AS o_orderpriority_{i}"
        for i, v in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], start=1)
    )
    + " FROM orders",
)
def onehot_fit_apply(spark, sf_dir):
    o, train = _orders_split(tables(spark, sf_dir))
    vocab = FE.Vocabulary.fit(train, "o_orderpriority", max_categories=1000)
    enc = FE.one_hot(o, vocab)
    return enc.select(
        "o_orderkey",
        F.when(F.col("o_orderdate") < ts("1999-01-01"), "train").otherwise("test").alias("split"),
        *[c for c in enc.columns if c.startswith("o_orderpriority_")],
    )


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "onehot_named",
    "SELECT o_orderkey, o_orderpriority, "
    + ", ".join(f"CAST(o_orderpriority = '{v}' AS INTEGER) AS \"o_orderpriority_{v}\"" for v in _PRIORITIES) + " FROM orders",
)
def onehot_named(spark, sf_dir):
    """One column per value, named after it, beside the original column."""
    o, train = _orders_split(tables(spark, sf_dir))
    vocab = FE.Vocabulary.fit(train, "o_orderpriority", max_categories=1000)
    return FE.one_hot(o.select("o_orderkey", "o_orderpriority"), vocab, keep_original=True, named=True)


@query(
    "onehot_vector",
    "WITH v AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS place, count(*) OVER () AS n FROM "
    "(SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')) "
    "SELECT o.o_orderkey, v.place, (SELECT count(*) FROM v) AS n_places FROM orders o LEFT JOIN v ON o.o_custkey = v.o_custkey",
)
def onehot_vector(spark, sf_dir):
    """Sparse vectors over all customers of the training years, as the place of
    the one (null: a customer not seen then) and the vector's length."""
    o = tables(spark, sf_dir).orders.select("o_orderkey", "o_orderdate", "o_custkey")
    known = FE.Dictionary.fit(o.where(F.col("o_orderdate") < ts("1997-01-01")), "o_custkey")
    coded = FE.one_hot_vector(o.select("o_orderkey", "o_custkey"), known, "v", keep_original=False)
    v = F.unwrap_udt("v")
    return coded.select("o_orderkey", F.get(v["indices"], 0).cast("long").alias("place"), v["size"].cast("long").alias("n_places"))


_BRAND_SQL = """
WITH v AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) AS INTEGER) AS o
           FROM (SELECT DISTINCT p_brand FROM part WHERE p_size <= 25)),
nb AS (SELECT CAST(floor(log2(count(*))) + 1 AS INTEGER) AS k FROM v)
SELECT p.p_partkey, {bits}
FROM part p LEFT JOIN v ON p.p_brand = v.p_brand
"""


@query(
    "binary_encode",
    _BRAND_SQL.format(
        bits=", ".join(f"CAST((coalesce(v.o, 0) >> {4 - i}) & 1 AS INTEGER) AS p_brand_{i}" for i in range(5))
    ),
)
def binary_encode(spark, sf_dir):
    p = tables(spark, sf_dir).part.select("p_partkey", "p_brand", "p_size")
    known = FE.Dictionary.fit(p.where(F.col("p_size") <= 25), "p_brand")
    return FE.binary_encode(p.select("p_partkey", "p_brand"), known)


@query(
    "relabel",
    "SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 END AS label, count(*) AS n "
    "FROM lineitem GROUP BY 1, 2",
)
def relabel(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem.select("l_returnflag")
    r = FE.relabel(li, "l_returnflag", {"A": 0, "R": 1}, out="label")
    return r.groupBy("l_returnflag", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "standardize",
    "SELECT l_orderkey, l_linenumber, round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / "
    "(SELECT stddev_pop(l_extendedprice) FROM lineitem), 6) AS price_z FROM lineitem",
)
def standardize(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    z = FE.standardize(li, "l_extendedprice", out="price_z")
    return z.select("l_orderkey", "l_linenumber", F.round("price_z", 6).alias("price_z"))


@query(
    "clip_bin_features",
    "SELECT least(greatest(l_quantity, 5), 40) AS qty_clipped, CAST(l_quantity = 1 AS INTEGER) AS is_single, "
    "CASE WHEN l_quantity >= 1 AND l_quantity < 2 THEN 'single' WHEN l_quantity >= 2 AND l_quantity < 11 THEN 'small' "
    "WHEN l_quantity >= 11 AND l_quantity < 26 THEN 'medium' WHEN l_quantity >= 26 THEN 'large' END AS qty_bin, "
    "CAST(l_quantity % 12 = 0 AND l_quantity BETWEEN 12 AND 108 AS INTEGER) AS qty_dozen, count(*) AS n "
    "FROM lineitem GROUP BY ALL",
)
def clip_bin_features(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    q = F.col("l_quantity")
    return li.groupBy(
        X.clip(q, 5, 40).alias("qty_clipped"),
        X.binarize(q == 1).alias("is_single"),
        X.cut(q, [1, 2, 11, 26, float("inf")], ["single", "small", "medium", "large"]).alias("qty_bin"),
        X.binarize(X.multiple_of(q, 12, 12, 108)).alias("qty_dozen"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "presence_flags",
    "SELECT doc_id, CAST(quality + 2 * toxic IN (1, 3) AS INTEGER) AS has_first, "
    "CAST(quality + 2 * toxic IN (2, 3) AS INTEGER) AS has_second FROM labels",
)
def presence_flags(spark, sf_dir):
    lab = tables(spark, sf_dir).labels
    a, b = FE.presence_flags(F.col("quality") + 2 * F.col("toxic"))
    return lab.select("doc_id", a.alias("has_first"), b.alias("has_second"))


@query(
    "multi_col_presence",
    f"SELECT c_nationkey, s_nationkey, "
    + ", ".join(f"CAST(list_contains([c_nationkey, s_nationkey], {i}) AS INTEGER) AS has_nation_{i}" for i in range(25))
    + ", CAST(" + " + ".join(f"CAST(list_contains([c_nationkey, s_nationkey], {i}) AS INTEGER)" for i in range(25))
    + f" AS INTEGER) AS n_present, count(*) AS n FROM {NATION_PAIRS_SQL} p GROUP BY ALL",
)
def multi_col_presence(spark, sf_dir):
    t = tables(spark, sf_dir)
    p = nation_pairs(t).select("c_nationkey", "s_nationkey")
    flagged = FE.multi_col_presence(p, ["c_nationkey", "s_nationkey"], t.nation, "n_nationkey", "n_name")
    keys = [c for c in flagged.columns]
    return flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_score_features",
    f"SELECT doc_id, CAST(quality IS NOT NULL AS INTEGER) AS has_text, "
    f"CASE WHEN lang IS DISTINCT FROM 'en' THEN 0 ELSE coalesce(quality, 0) END AS quality FROM {DOCS_LABELS_SQL} j",
)
def text_score_features(spark, sf_dir):
    j = docs_labels(tables(spark, sf_dir))
    return FE.text_score_features(j, "quality", "quality", "lang").select("doc_id", "has_text", "quality")


# ------------------------------------------------------------------ GOLD: exact splits
@query("balance_classes")
def balance_classes(spark, sf_dir):
    """Down-sample every l_returnflag class to the smallest class size."""
    li = tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    smallest = li.groupBy("l_returnflag").count().agg(F.min("count")).scalar()
    sel = FE.hash_rank_select(li, "l_returnflag", ids, seed=42, quota=smallest)
    return sel.where("selected").drop("selected")


@query("stratified_split")
def stratified_split(spark, sf_dir):
    """80/20 split stratified by l_returnflag; exact per-class test counts."""
    li = tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    sel = FE.hash_rank_select(li, "l_returnflag", ids, seed=42, quota=FE.class_quota_fraction(0.2), out="is_test")
    return sel.withColumn("split", F.when(F.col("is_test"), "test").otherwise("train")).drop("is_test")


@query("holdout_split")
def holdout_split(spark, sf_dir):
    """30 % train among labelled documents, complement (all other rows) = confirm."""
    j = docs_labels(tables(spark, sf_dir)).select("doc_id", "quality")
    labelled = j.where(F.col("quality").isNotNull())
    sel = FE.hash_rank_select(labelled, None, ["doc_id"], seed=14, quota=FE.class_quota_fraction(0.3), out="is_train")
    train = sel.where("is_train").select("doc_id")
    rest = j.join(train, "doc_id", "left_anti").select("doc_id").withColumn("split", F.lit("confirm"))
    return train.withColumn("split", F.lit("train")).unionByName(rest)
