"""Fitted models: boosting goes on past one tree, and the grid search reads
shallow trees from deep ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models as M
from tessera.plans import models_plan as MP
from tessera.plans.registry import entries


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    train, _ = MP.ml_frames(spark, sf_dir)
    return M.assemble(MP._FEATURES).transform(train).select("features", "label", *MP._FEATURES, *MP._IDS).cache()


def test_boosting_curve_goes_on(spark, sf_dir):
    curve = entries()["gbt_learning_curve"].fn(spark, sf_dir).collect()
    for c in (0, 1, 2):
        loss = [r.log_loss for r in sorted((r for r in curve if r["class"] == c and r.split == "validation"), key=lambda r: r.iteration)]
        best = next(k for k, x in enumerate(loss, start=1) if x <= min(loss) + 1e-4)
        assert len(loss) >= best + 10  # patience was used up


def test_more_trees_fit_better(spark):
    # a sum of three steps: no single shallow tree has it
    grid = spark.range(600).select(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000).alias(f"x{k}") for k in range(3)], "id")
    y = M.assemble(["x0", "x1", "x2"]).transform(grid).select(
        "features", "id", ((F.col("x0") > 0.5).cast("int") + (F.col("x1") > 0.5).cast("int") + (F.col("x2") > 0.5).cast("int") >= 2).cast("double").alias("label")
    ).cache()
    model, train_loss, valid_loss = M.boost_until(y.where("id % 3 > 0"), y.where("id % 3 = 0"), patience=2, first=4, tol=1e-2, stepSize=0.3, maxDepth=1, seed=1)
    assert model.getNumTrees > 3 and train_loss[-1] < train_loss[0] and valid_loss[model.getNumTrees - 1] < valid_loss[0]


def test_cut_tree_predicts_as_a_shallow_one(rows):
    x = np.array(rows.select(*MP._FEATURES).collect(), float)
    tree = M.tree_arrays(M.decision_tree(7, 40).fit(rows))
    cut = M.predict_depths(tree, x, range(1, 8))
    for depth in (1, 3, 5, 7):
        direct = M.decision_tree(depth, 40).fit(rows).transform(rows).select("prediction")
        assert [r.prediction for r in direct.collect()] == cut[depth].tolist()


def test_folds_are_stratified(rows):
    folded = M.stratified_folds(rows.select("label", *MP._IDS), "label", MP._IDS, 5)
    n = {(r.label, r.fold): r["count"] for r in folded.groupBy("label", "fold").count().collect()}
    assert folded.count() == rows.count()
    for label in {k[0] for k in n}:
        sizes = [n[label, f] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_grid_search(spark, sf_dir):
    got = entries()["grid_search_cv"].fn(spark, sf_dir).collect()
    assert len({(r.max_depth, r.min_leaf) for r in got}) == len(got) == 66
    assert all(0 < r.cv_accuracy < 1 for r in got)


def test_folds_are_counted_side_by_side(spark, rows):
    folded = rows.select("label", *MP._FEATURES, F.expr("CASE WHEN l_orderkey % 7 < 5 THEN l_orderkey % 7 END").cast("int").alias("fold"))
    cells = M.fold_cells(folded, MP._FEATURES, "label", "fold", 5)
    # one row per cell whatever the folds: a fit reads no more
    assert cells.count() == folded.where("fold IS NOT NULL").select("label", *MP._FEATURES).distinct().count()
    got = cells.agg(F.sum(M.WEIGHT), *[F.sum(M._fold(k)) for k in range(5)]).first()
    size = {r.fold: r["count"] for r in folded.groupBy("fold").count().collect()}
    assert list(got) == [sum(size[k] for k in range(5)), *[size[k] for k in range(5)]]


def test_tree_as_arrays(rows):
    model = M.decision_tree(4, 40).fit(rows)
    tree, root = M.tree_arrays(model), model._java_obj.rootNode()
    assert len(tree["value"]) == model.numNodes and (tree["feature"] >= 0).sum() * 2 + 1 == model.numNodes
    for node, k in ((root, 0), (root.leftChild(), tree["left"][0]), (root.rightChild(), tree["right"][0])):
        assert (node.split().featureIndex(), node.split().threshold(), node.prediction()) == (tree["feature"][k], tree["threshold"][k], tree["value"][k])


def test_cells_fit_as_their_rows(spark, rows):
    from tessera.operators import features as FE

    cells = M.weighted_cells(rows.select("label", *MP._FEATURES), MP._FEATURES, ["label"])
    n = M.weight_of(cells)
    assert n == rows.count() and cells.count() < n
    for leaf in (200, 2000, 4000):
        by_cell = M.decision_tree(3, leaf, rows=n).fit(cells)
        seen = by_cell.transform(rows).select("rawPrediction").distinct().count()
        least = min(r["count"] for r in by_cell.transform(rows).groupBy("rawPrediction").count().collect())
        assert least >= leaf and (seen > 1 or leaf > 2000)
    # many values: bins bound the cells
    wide = spark.range(20_000).select((F.col("id") / 7).alias("x"), (F.col("id") % 3).alias("label"))
    assert M.weighted_cells(wide, ["x"], ["label"]).count() <= 32 * 3
    # a split flags rows where they are read, ties at the boundary included
    sel = FE.hash_rank_select(wide, "label", ["x"], seed=1, quota=10)
    assert "Exchange hashpartitioning" not in sel._jdf.queryExecution().executedPlan().toString()
    same = spark.range(100).select(F.lit(1).alias("x"), F.lit(None).cast("int").alias("g"))
    assert FE.hash_rank_select(same, "g", ["x"], seed=1, quota=30).where("selected").count() == 30


def test_cut_boosting_is_not_fitted_again(spark, monkeypatch):
    """The best number of trees is cut from the last run, and predicts as a fit of that many."""
    rows = spark.range(900).select(((F.col("id") * 37) % 101).cast("double").alias("x"), ((F.col("id") * 37) % 101 > 50).cast("double").alias("y"),
                                   (F.col("id") % 3).alias("part"))
    d = M.assemble(["x"]).transform(rows.select("x", F.col("y").alias("label"), "part"))
    fits, fit = [], M.GBTClassifier._fit
    monkeypatch.setattr(M.GBTClassifier, "_fit", lambda self, df: fits.append(self.getMaxIter()) or fit(self, df))
    params = {"stepSize": 0.9, "maxDepth": 1, "seed": 3}
    model, on_train, on_valid = M.boost_until(d.where("part > 0"), d.where("part = 0"), patience=2, first=2, tol=1e-2, **params)
    n = model.getNumTrees
    assert fits == sorted(set(fits)) and len(on_train) == n < len(on_valid) == fits[-1]
    again = fit(M.GBTClassifier(maxIter=n, **params), d.where("part > 0"))
    assert [r.probability for r in model.transform(d).select("probability").collect()] == [
        r.probability for r in again.transform(d).select("probability").collect()]
    assert on_train == again.evaluateEachIteration(d.where("part > 0"))
