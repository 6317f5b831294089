"""Tree models and model evaluation (M*).

Impurity and information gain are SQL aggregates (one job for all features).
Models are Spark ML estimators, fitted on rows counted per cell of their
binned features; sweeps and cross-validation reuse one cached table of cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.scan import running_sums
from tessera.session import scratch_path


def _log2(x: Column) -> Column:
    return F.log2(x)


# M1 / M2
def entropy(df: DataFrame, label: str) -> DataFrame:
    """-sum p log2 p over the label distribution (p = 0 contributes 0)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = counts.agg(F.sum("n")).scalar()
    p = F.col("n") / tot
    return counts.agg(F.sum(F.when(p > 0, -p * _log2(p)).otherwise(0.0)).alias("entropy"))


def _split_entropy(df: DataFrame, keys: Sequence[str | Column], label: str) -> DataFrame:
    """Per (keys..., split value) entropy and size, from one count per label."""
    c = df.groupBy(*keys, "__split", label).agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy(*keys, "__split").agg(F.sum("n").alias("ns"))
    j = c.join(tot, [*keys, "__split"])
    p = F.col("n") / F.col("ns")
    return j.groupBy(*keys, "__split").agg(F.first("ns").alias("ns"), F.sum(-p * _log2(p)).alias("h"))


# M3
def info_gain_binary(df: DataFrame, label: str, feature: str, threshold: float = 0.0) -> DataFrame:
    d = df.select(label, (F.col(feature) > F.lit(threshold)).alias("__split"))
    parent = entropy(d, label).select("entropy").scalar()
    parts = _split_entropy(d, [], label)
    n = d.select(F.count(F.lit(1))).scalar()
    return parts.agg((parent - F.sum(F.col("ns") / n * F.col("h"))).alias("info_gain"))


# M4
def info_gain_all(df: DataFrame, label: str, features: dict[str, Column]) -> DataFrame:
    """Multi-way information gain of every feature (split on each distinct
    value) in one job: unpivot features, count (feature, value, label)."""
    arr = F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("__split")) for k, v in features.items()])
    long = df.select(label, F.inline(arr))
    parent = entropy(df, label).select("entropy").scalar()
    n = df.select(F.count(F.lit(1))).scalar()
    parts = _split_entropy(long, ["feature"], label)
    return parts.groupBy("feature").agg((parent - F.sum(F.col("ns") / n * F.col("h"))).alias("info_gain"))


# M7
def argmax_index(probs: Column) -> Column:
    return F.array_position(probs, F.array_max(probs)).cast("int") - 1


# M8-M10
def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def weighted_f1(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Support-weighted F1 from confusion counts (zero-division -> 0)."""
    tp = df.groupBy(F.col(label).alias("cls")).agg(
        F.count(F.lit(1)).alias("support"), F.count_if(F.col(label) == F.col(pred)).alias("tp"))
    pc = df.groupBy(F.col(pred).alias("cls")).agg(F.count(F.lit(1)).alias("pred_n"))
    j = tp.join(pc, "cls", "left")
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(0.0)
    rec = F.col("tp") / F.col("support")
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return j.agg((F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def confusion_matrix(df: DataFrame, label: str, pred: str, classes: Sequence[int]) -> DataFrame:
    cols = [F.count_if(F.col(pred) == F.lit(c)).alias(f"pred_{c}") for c in classes]
    return df.groupBy(label).agg(*cols)


# ------------------------------------------------------------------ estimators
def assemble(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def decision_tree(max_depth: int = 5, min_leaf: int = 200, seed: int = 42, label: str = "label",
                  rows: float | None = None) -> DecisionTreeClassifier:
    """With ``rows``, the sum of the weights, for rows of weight ``WEIGHT``."""
    tree = DecisionTreeClassifier(labelCol=label, featuresCol="features", maxDepth=max_depth, seed=seed, impurity="gini")
    return tree.setParams(minInstancesPerNode=min_leaf) if rows is None else tree.setParams(**_least(min_leaf, rows, max_depth))


# ------------------------------------------------------------------ weighted cells
WEIGHT = "weight"
_AS_THEY_ARE = 64  # distinct values up to which a feature is not cut into bins
_BINS = 32  # as many as the trees tell apart


def _least(min_leaf: int, rows: float, max_depth: int) -> dict:
    """Parameters of a tree of weighted rows whose leaves hold ``min_leaf``
    rows: Spark counts weighted rows once each, so the least weight stands for
    their number (half a row off whole numbers, so that rounding cannot tell)."""
    if 2 * min_leaf > rows:
        max_depth = 0  # no split leaves enough on both sides
    return {"weightCol": WEIGHT, "minInstancesPerNode": 1, "maxDepth": max_depth,
            "minWeightFractionPerNode": (min_leaf - 0.5) / rows if max_depth and min_leaf > 0 else 0.0}


def weighted_cells(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The rows counted per distinct (features, keep): ``WEIGHT`` rows each,
    with the assembled ``features``.

    Trees look at a feature through 32 bins at most.  A feature of more than
    ``_AS_THEY_ARE`` values is first cut at its quantiles into as many, so the
    cells are bounded by the bins whatever the rows, and a fit, which reads its
    rows at every level of every tree, reads the table once.  Cut features are
    replaced by the number of their bin; nulls stay null.
    """
    v = [F.col(f).cast("double") for f in features]
    n = df.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(v)]).first()
    many = [i for i in range(len(v)) if n[i] > _AS_THEY_ARE]
    if many:
        steps = [k / _BINS for k in range(1, _BINS)]
        ends = df.agg(*[F.percentile_approx(v[i], steps, 10_000).alias(f"e{i}") for i in many]).first()
        for i in many:
            above = [(v[i] > F.lit(e)).cast("int") for e in sorted(set(ends[f"e{i}"]))]
            v[i] = sum(above[1:], above[0]).cast("double")
    cells = df.select(*[c.alias(f) for c, f in zip(v, features)], *keep).groupBy(*features, *keep).agg(
        F.count(F.lit(1)).cast("double").alias(WEIGHT))
    return assemble(features).transform(cells)


def held(cells: DataFrame) -> DataFrame:
    """``cells`` in memory and in few partitions: fitting runs a job for every
    level of every tree, and small tables gain nothing from many tasks."""
    cells = cells.persist()
    return cells.coalesce(1 + cells.count() // 100_000)


def written(cells: DataFrame) -> DataFrame:
    """``cells`` as a table in the shared folder: what reads them plans and runs
    none of the steps that made them."""
    path = scratch_path(cells.sparkSession, "cells")
    cells.write.parquet(path)
    return cells.sparkSession.read.schema(cells.schema).parquet(path)


def weight_of(df: DataFrame) -> float:
    """Number of rows: of weighted ones, the sum of their weights."""
    return float(df.agg(F.sum(WEIGHT)).first()[0] or 0.0) if WEIGHT in df.columns else float(df.count())


@dataclass
class BoostedOneVsRest:
    """One boosted model per class; the class of the highest score is predicted."""

    models: list
    classes: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for k, m in enumerate(self.models):
            for set_col in (m.setRawPredictionCol, m.setProbabilityCol, m.setPredictionCol):
                set_col(f"__{set_col.__name__}_{k}")
            out = m.transform(out)
        scores = [vector_to_array(f"__setProbabilityCol_{k}")[1] for k in range(len(self.models))]
        best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-c).alias("c")) for p, c in zip(scores, self.classes)]))
        return out.select(*df.columns, (-best["c"]).alias("prediction"))


def _binary(df: DataFrame, cls: float, label: str) -> DataFrame:
    return df.select("features", (F.col(label) == cls).cast("double").alias(label), *[c for c in (WEIGHT,) if c in df.columns])


def boost_until(train: DataFrame, valid: DataFrame, patience: int, first: int = 8, tol: float = 1e-4, label: str = "label", **params):
    """Boosted trees for a 0/1 label up to the first iteration whose validation
    loss is the lowest (to within ``tol``), once ``patience`` further ones have
    not lowered it by more.

    The number of trees is doubled until that holds; the first trees of a
    longer run are those of a shorter one, the seed being the same, so the
    model is the last run cut off at the best number, not a further fit.
    Returns (model, losses on train, losses on valid) by iteration.
    """
    gbt = GBTClassifier(featuresCol="features", labelCol=label, **params)
    n = first
    while True:
        model = gbt.copy({gbt.maxIter: n}).fit(train)
        loss = model.evaluateEachIteration(valid)
        best = next(k for k, x in enumerate(loss, start=1) if x <= min(loss) + tol)
        if best + patience <= len(loss):
            return first_trees(model, best), model.evaluateEachIteration(train)[:best], loss
        n = max(2 * n, best + patience)


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The boosted model of the first ``n`` trees alone."""
    old, sc = model._java_obj, SparkSession.active().sparkContext
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for k in range(n):
        trees[k], weights[k] = old.trees()[k], old.treeWeights()[k]
    new = GBTClassificationModel(sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{model.uid}_{n}", trees, weights))
    return model._copyValues(new)


def boosted_multiclass(train: DataFrame, valid: DataFrame, classes: Sequence[float], patience: int = 10, step: float = 0.1,
                       max_depth: int = 5, min_leaf: int = 10, min_gain: float = 0.0, subsample: float = 1.0,
                       feature_subset: str = "all", seed: int = 42, label: str = "label"):
    """One-vs-rest boosted trees on assembled rows (features, label) or
    ``weighted_cells``, each class stopped by ``patience`` on the validation
    rows.  Returns the model
    and the curve rows (class, split, iteration, log loss)."""
    leaf = {"minInstancesPerNode": min_leaf, "maxDepth": max_depth}
    if WEIGHT in train.columns:
        leaf = _least(min_leaf, weight_of(train), max_depth)
    def fit(c):
        return boost_until(
            _binary(train, c, label), _binary(valid, c, label), patience, label=label, stepSize=step,
            minInfoGain=min_gain, subsamplingRate=subsample, featureSubsetStrategy=feature_subset, seed=seed, **leaf,
        )

    models, curve = [], []
    with ThreadPool(max(1, min(len(classes), 4))) as pool:  # the classes' trees know nothing of each other
        fitted = pool.map(fit, classes)
    for c, (m, on_train, on_valid) in zip(classes, fitted):
        models.append(m)
        for name, losses in (("train", on_train), ("validation", on_valid)):
            curve += [(int(c), name, k, float(x)) for k, x in enumerate(losses, start=1)]
    return BoostedOneVsRest(models, list(classes)), curve


def fit_pipeline(train: DataFrame, features: Sequence[str], estimator):
    return Pipeline(stages=[assemble(features), estimator]).fit(train)


def feature_importance_rows(model, features: Sequence[str]) -> list[tuple[str, float]]:
    imp = model.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def _metric(name: str, pred: DataFrame, label: str) -> float:
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName=name)
    return (ev.setWeightCol(WEIGHT) if WEIGHT in pred.columns else ev).evaluate(pred)


def evaluate(pred: DataFrame, label: str = "label") -> dict:
    return {"accuracy": _metric("accuracy", pred, label), "weighted_f1": _metric("weightedFMeasure", pred, label)}


def param_sweep(train: DataFrame, valid: DataFrame, features: Sequence[str], param: str, values: Sequence,
                base: dict | None = None, label: str = "label") -> list[tuple]:
    """One-at-a-time sweep of a tree parameter: (param, value, train_acc,
    valid_acc).  Rows are counted per cell once for all settings."""
    both = train.select(*features, label, F.lit(True).alias("__fit")).unionByName(valid.select(*features, label, F.lit(False).alias("__fit")))
    stored = weighted_cells(both, features, [label, "__fit"])
    cells = held(stored)
    rows = []
    try:
        tr, va = cells.where("__fit"), cells.where("NOT __fit")
        n = weight_of(tr)
        for v in values:
            kw = {"maxDepth": 5, "minInstancesPerNode": 1} | (base or {}) | {param: v}
            kw |= _least(kw["minInstancesPerNode"], n, kw["maxDepth"])
            m = DecisionTreeClassifier(labelCol=label, featuresCol="features", seed=42, **kw).fit(tr)
            rows.append((param, float(v), _metric("accuracy", m.transform(tr), label), _metric("accuracy", m.transform(va), label)))
    finally:
        stored.unpersist()
    return rows


def tree_arrays(model) -> dict[str, np.ndarray]:
    """A fitted tree of continuous splits as arrays: feature (-1 at a leaf),
    threshold, left, right and the prediction of every node, inner ones too.
    Splits and leaves come in one text; each inner node is asked only for its
    prediction, as a call to the JVM costs more than a job's share of it."""
    feature, threshold, left, right, value = [], [], [], [], []
    lines = iter([x for x in map(str.split, model.toDebugString.splitlines()[1:]) if x and x[0] != "Else"])

    def visit(node) -> int:
        k, line = len(feature), next(lines)  # If (feature 1 <= 0.5), or Predict: 2.0
        inner = line[0] == "If"
        here = node() if inner else None
        feature.append(int(line[2]) if inner else -1)
        threshold.append(float(line[4].rstrip(")")) if inner else 0.0)
        value.append(here.prediction() if inner else float(line[1]))
        left.append(-1)
        right.append(-1)
        if inner:
            left[k] = visit(here.leftChild)
            right[k] = visit(here.rightChild)
        return k

    visit(model._java_obj.rootNode)
    return {"feature": np.array(feature), "threshold": np.array(threshold), "left": np.array(left), "right": np.array(right), "value": np.array(value)}


def predict_depths(tree: dict[str, np.ndarray], x: np.ndarray, depths: Sequence[int]) -> dict[int, np.ndarray]:
    """Predictions of the tree cut off at each of the depths.  Trees grow level
    by level with the same choices whatever the greatest depth, so a deep tree
    cut off predicts as a shallower one fitted directly."""
    at, out = np.zeros(len(x), np.int64), {}
    for depth in range(max(depths) + 1):
        if depth in depths:
            out[depth] = tree["value"][at]
        f = tree["feature"][at]
        go_left = x[np.arange(len(x)), np.maximum(f, 0)] <= tree["threshold"][at]
        at = np.where(f < 0, at, np.where(go_left, tree["left"][at], tree["right"][at]))
    return out


def stratified_folds(df: DataFrame, label: str, ids: Sequence[str], num_folds: int, out: str = "fold", seed: int = 11) -> DataFrame:
    """Fold numbers with equal shares of every class: the rank of a row in its
    class, by a seeded hash of its ids, modulo the number of folds."""
    mixed = df.withColumn("__mixed", F.xxhash64(F.lit(seed), *ids))
    ranked = running_sums(mixed, [label], ["__mixed", *ids], {"__rank": F.lit(1).cast("long")})
    return ranked.withColumn(out, F.pmod("__rank", F.lit(num_folds)).cast("int")).drop("__mixed", "__rank")


def _fold(k: int) -> str:
    return f"__fold{k}"


def fold_cells(folded: DataFrame, features: Sequence[str], label: str, fold_col: str, num_folds: int) -> DataFrame:
    """``weighted_cells`` of the rows with a fold, and beside the ``WEIGHT`` of
    a cell's rows that of its rows in each fold."""
    cells = weighted_cells(folded, features, [label, fold_col]).where(F.col(fold_col).isNotNull())
    per_fold = [F.sum(F.when(F.col(fold_col) == k, F.col(WEIGHT)).otherwise(0.0)).alias(_fold(k)) for k in range(num_folds)]
    return assemble(features).transform(cells.groupBy(*features, label).agg(F.sum(WEIGHT).alias(WEIGHT), *per_fold))


def grid_search_cv(folded: DataFrame, features: Sequence[str], depths: Sequence[int], leaves: Sequence[int],
                   fold_col: str, label: str = "label", num_folds: int = 5, parallelism: int = 4):
    """Cross-validated accuracy of every (max depth, min leaf): one tree of the
    greatest depth is fitted per (min leaf, fold), and all depths are read from
    it.  The folds' rows are counted side by side in one row per cell, so a fit
    reads every cell once, not once per fold.  Returns rows (max_depth,
    min_leaf, mean accuracy over folds)."""
    spark = folded.sparkSession
    stored = written(fold_cells(folded, features, label, fold_col, num_folds))
    data = held(stored)
    try:
        whole, *size = data.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in (WEIGHT, *map(_fold, range(num_folds)))]).first()

        def fit(job):
            leaf, fold = job
            est = decision_tree(max(depths), leaf, label=label, rows=whole - size[fold])
            rows = data.select("features", label, (F.col(WEIGHT) - F.col(_fold(fold))).alias(WEIGHT))
            return tree_arrays(est.fit(rows.where(F.col(WEIGHT) > 0)))

        jobs = [(leaf, fold) for leaf in leaves for fold in range(num_folds)]
        with ThreadPool(parallelism) as pool:  # trees of a few hundred nodes each
            trees = spark.sparkContext.broadcast(dict(zip(jobs, pool.map(fit, jobs))))
        depths, columns = list(depths), list(features)

        def right(batches):
            for b in batches:
                x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])
                y, *folds = (b.column(c).to_numpy(zero_copy_only=False) for c in (label, *map(_fold, range(num_folds))))
                rows = []
                for (leaf, k), tree in trees.value.items():
                    here = folds[k] > 0
                    w = folds[k][here]
                    for depth, p in predict_depths(tree, x[here], depths).items():
                        rows.append((depth, leaf, k, int(w[p == y[here]].sum()), int(w.sum())))
                names = ["max_depth", "min_leaf", "fold", "hits", "n"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        hits = data.select(label, *map(_fold, range(num_folds)), *columns).mapInArrow(right, "max_depth long, min_leaf long, fold long, hits long, n long")
        per_fold = hits.groupBy("max_depth", "min_leaf", "fold").agg((F.sum("hits") / F.sum("n")).alias("a"))
        rows = per_fold.groupBy("max_depth", "min_leaf").agg(F.avg("a").alias("a")).collect()
        return sorted((int(r["max_depth"]), int(r["min_leaf"]), float(r["a"])) for r in rows)
    finally:
        stored.unpersist()
