"""Model queries (M*): impurity metrics in SQL, Spark ML fits as GOLD."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import features as FE
from tessera.operators import models as M
from tessera.plans.common import tables
from tessera.plans.registry import query

_LABEL = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
_PROBS = "[l_discount * 10, l_tax * 12.5, l_quantity / 50]"
_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _label_col():
    return F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)


def _pred_col():
    return M.argmax_index(F.array(F.col("l_discount") * 10, F.col("l_tax") * 12.5, F.col("l_quantity") / 50))


def _scored(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return li.select(_label_col().alias("label"), _pred_col().alias("prediction"))


@query(
    "entropy",
    "WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS s FROM c) "
    "SELECT round(sum(-(n / s) * log2(n / s)), 9) AS entropy FROM c CROSS JOIN t",
)
def entropy(spark, sf_dir):
    e = M.entropy(tables(spark, sf_dir).lineitem, "l_returnflag")
    return e.select(F.round("entropy", 9).alias("entropy"))


_IG_SQL = """
WITH d AS (SELECT l_returnflag AS y, {split} AS s{extra} FROM lineitem{unpivot}),
nn AS (SELECT count(*) AS n FROM lineitem),
pc AS (SELECT l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY 1),
ph AS (SELECT sum(-(pc.n / nn.n) * log2(pc.n / nn.n)) AS h FROM pc CROSS JOIN nn),
c AS (SELECT {keys}s, y, count(*) AS n FROM d GROUP BY ALL),
cs AS (SELECT {keys}s, sum(n) AS ns FROM c GROUP BY ALL),
hs AS (SELECT {ckeys}c.s, cs.ns, sum(-(c.n / cs.ns) * log2(c.n / cs.ns)) AS h FROM c JOIN cs USING ({using}s)
       GROUP BY ALL)
SELECT {keys}round(max(ph.h) - sum(hs.ns / nn.n * hs.h), 9) AS info_gain FROM hs CROSS JOIN ph CROSS JOIN nn
{group}
"""


@query("info_gain_binary", _IG_SQL.format(split="l_discount > 0.05", extra="", unpivot="", keys="", ckeys="",
                                          using="", group=""))
def info_gain_binary(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return M.info_gain_binary(li, "l_returnflag", "l_discount", 0.05).select(
        F.round("info_gain", 9).alias("info_gain"))


_UNPIVOT = (
    " CROSS JOIN LATERAL (VALUES ('l_quantity', CAST(l_quantity AS DOUBLE)), "
    "('l_discount', CAST(CAST(round(l_discount * 100) AS BIGINT) AS DOUBLE)), "
    "('l_tax', CAST(CAST(round(l_tax * 100) AS BIGINT) AS DOUBLE)), "
    "('l_linenumber', CAST(l_linenumber AS DOUBLE))) u(feature, v)"
)


@query("info_gain_all", _IG_SQL.format(split="v", extra=", feature", unpivot=_UNPIVOT, keys="feature, ",
                                       ckeys="feature, ", using="feature, ", group="GROUP BY feature"))
def info_gain_all(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    feats = {
        "l_quantity": F.col("l_quantity"),
        "l_discount": F.round(F.col("l_discount") * 100).cast("long"),
        "l_tax": F.round(F.col("l_tax") * 100).cast("long"),
        "l_linenumber": F.col("l_linenumber"),
    }
    return M.info_gain_all(li, "l_returnflag", feats).select("feature", F.round("info_gain", 9).alias("info_gain"))


@query(
    "argmax_class",
    f"SELECT CAST(list_position({_PROBS}, list_max({_PROBS})) - 1 AS INTEGER) AS prediction, count(*) AS n "
    f"FROM lineitem GROUP BY 1",
)
def argmax_class(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


_SCORED_SQL = (
    f"(SELECT {_LABEL} AS label, CAST(list_position({_PROBS}, list_max({_PROBS})) - 1 AS INTEGER) AS prediction "
    f"FROM lineitem)"
)


@query("accuracy", f"SELECT round(avg(CAST(label = prediction AS DOUBLE)), 9) AS accuracy FROM {_SCORED_SQL} s")
def accuracy(spark, sf_dir):
    return M.accuracy(_scored(spark, sf_dir), "label", "prediction").select(F.round("accuracy", 9).alias("accuracy"))


@query(
    "weighted_f1",
    f"""
WITH s AS {_SCORED_SQL},
t AS (SELECT label AS cls, count(*) AS support, count(*) FILTER (WHERE label = prediction) AS tp FROM s GROUP BY 1),
p AS (SELECT prediction AS cls, count(*) AS pred_n FROM s GROUP BY 1),
m AS (SELECT t.support, CASE WHEN coalesce(p.pred_n, 0) > 0 THEN t.tp / p.pred_n ELSE 0 END AS prec,
             t.tp / t.support AS rec FROM t LEFT JOIN p ON t.cls = p.cls)
SELECT round(sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END * support) / sum(support), 9)
  AS weighted_f1 FROM m
""",
)
def weighted_f1(spark, sf_dir):
    return M.weighted_f1(_scored(spark, sf_dir), "label", "prediction").select(
        F.round("weighted_f1", 9).alias("weighted_f1"))


@query(
    "confusion_matrix",
    f"SELECT label, count(*) FILTER (WHERE prediction = 0) AS pred_0, count(*) FILTER (WHERE prediction = 1) AS pred_1, "
    f"count(*) FILTER (WHERE prediction = 2) AS pred_2 FROM {_SCORED_SQL} s GROUP BY label",
)
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_scored(spark, sf_dir), "label", "prediction", [0, 1, 2])


# ------------------------------------------------------------------ GOLD: fitted models
def ml_frames(spark, sf_dir):
    """Lines with a numeric label, an exact stratified 80/20 train/test split,
    and a stratified validation flag inside train."""
    li = tables(spark, sf_dir).lineitem.select(*_IDS, "l_quantity", "l_discount", "l_tax",
                                                _label_col().alias("label"))
    split = FE.hash_rank_select(li, "label", _IDS, seed=42, quota=FE.class_quota_fraction(0.2), out="is_test")
    train = split.where(~F.col("is_test")).drop("is_test")
    test = split.where("is_test").drop("is_test")
    return FE.hash_rank_select(train, "label", _IDS, seed=7, quota=FE.class_quota_fraction(0.2), out="is_valid"), test


def _cells(spark, sf_dir):
    """The rows of ``ml_frames`` counted per cell: (train, test), train with
    its validation flag.  Fits and evaluations read these alone."""
    train, test = ml_frames(spark, sf_dir)
    every = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_valid", F.lit(False)).withColumn("is_test", F.lit(True)))
    stored = M.weighted_cells(every, _FEATURES, ["label", "is_valid", "is_test"])
    cells = M.held(stored)
    return stored, cells.where(~F.col("is_test")), cells.where("is_test")


@query("decision_tree")
def decision_tree(spark, sf_dir):
    """Tree (max depth 5, min leaf 200): accuracy and weighted F1 on train and test."""
    cells, train, test = _cells(spark, sf_dir)
    fitted, valid = train.where(~F.col("is_valid")), train.where("is_valid")
    fit = M.decision_tree(5, 200, rows=M.weight_of(fitted)).fit(fitted)
    rows = []
    for name, d in (("train", fitted), ("validation", valid), ("test", test)):
        m = M.evaluate(fit.transform(d))
        rows.append((name, m["accuracy"], m["weighted_f1"]))
    cells.unpersist()
    return spark.createDataFrame(rows, "split string, accuracy double, weighted_f1 double")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    cells, train, _ = _cells(spark, sf_dir)
    fit = M.decision_tree(5, 200, rows=M.weight_of(train)).fit(train)
    cells.unpersist()
    return spark.createDataFrame(M.feature_importance_rows(fit, _FEATURES), "feature string, importance double")


def _boosted(spark, sf_dir):
    """Boosted trees fitted on the training rows, stopped on the validation rows."""
    cells, train, test = _cells(spark, sf_dir)
    model, curve = M.boosted_multiclass(train.where(~F.col("is_valid")), train.where("is_valid"), [0.0, 1.0, 2.0])
    return model, curve, cells, train, test


@query("gbt_multiclass")
def gbt_multiclass(spark, sf_dir):
    """One-vs-rest boosted trees, each class stopped by patience on the
    validation loss: accuracy and weighted F1."""
    model, _, cells, train, test = _boosted(spark, sf_dir)
    rows = []
    for name, d in (("train", train), ("test", test)):
        m = M.evaluate(model.transform(d))
        rows.append((name, m["accuracy"], m["weighted_f1"]))
    cells.unpersist()
    return spark.createDataFrame(rows, "split string, accuracy double, weighted_f1 double")


@query("gbt_learning_curve")
def gbt_learning_curve(spark, sf_dir):
    """Per-iteration log-loss on train and validation for each one-vs-rest model."""
    _, curve, cells, _, _ = _boosted(spark, sf_dir)
    cells.unpersist()
    return spark.createDataFrame(curve, "class int, split string, iteration int, log_loss double")


@query("param_sweep")
def param_sweep(spark, sf_dir):
    """One-at-a-time sweep of max depth (1..10): train vs validation accuracy."""
    train, _ = ml_frames(spark, sf_dir)
    rows = M.param_sweep(train.where(~F.col("is_valid")), train.where("is_valid"), _FEATURES, "maxDepth",
                         list(range(1, 11)), base={"minInstancesPerNode": 200})
    return spark.createDataFrame(rows, "param string, value double, train_accuracy double, valid_accuracy double")


@query("grid_search_cv")
def grid_search_cv(spark, sf_dir):
    """5-fold CV over max depth 4..9 x min leaf 80..280 step 20 (66 settings)."""
    train, _ = ml_frames(spark, sf_dir)
    folded = M.stratified_folds(train, "label", _IDS, 5)
    rows = M.grid_search_cv(folded, _FEATURES, range(4, 10), range(80, 300, 20), "fold")
    return spark.createDataFrame(rows, "max_depth int, min_leaf int, cv_accuracy double")


@query("feature_ablation")
def feature_ablation(spark, sf_dir):
    """Drop each feature of non-zero importance in turn; validation accuracy."""
    cells, train, _ = _cells(spark, sf_dir)
    tr, va = train.where(~F.col("is_valid")), train.where("is_valid")
    n = M.weight_of(tr)
    full = M.decision_tree(5, 200, rows=n).fit(tr)
    imp = dict(M.feature_importance_rows(full, _FEATURES))
    rows = [("(none)", M.evaluate(full.transform(va))["accuracy"])]
    for f in _FEATURES:
        if imp.get(f, 0.0) <= 0.0:
            continue
        keep = [x for x in _FEATURES if x != f]
        m = M.fit_pipeline(tr.drop("features"), keep, M.decision_tree(5, 200, rows=n))
        rows.append((f, M.evaluate(m.transform(va.drop("features")))["accuracy"]))
    cells.unpersist()
    return spark.createDataFrame(rows, "dropped_feature string, valid_accuracy double")
