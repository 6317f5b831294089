"""Fits against numpy, factors and diagnostics by hand."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import linear as L

LETTERS = "abc"


def _data(n, seed):
    r = np.random.default_rng(seed)
    x1, x2 = 1e8 + r.normal(size=n), r.normal(size=n)
    f = r.integers(0, 3, n)
    y = 3 + 2 * (x1 - 1e8) - x2 + f * 0.7 + r.normal(size=n) * (1 + np.abs(x2))
    return x1, x2, f, y


def _frame(spark, x1, x2, f, y):
    rows = [(i, float(a), float(b), LETTERS[c], float(d)) for i, (a, b, c, d) in enumerate(zip(x1, x2, f, y))]
    return spark.createDataFrame(rows + [(-1, None, 1.0, "a", 1.0), (-2, 1e8, 1.0, "a", None)], "id long, x1 double, x2 double, f string, y double")


def test_fit_equals_numpy_at_large_means(spark):
    x1, x2, f, y = _data(800, 1)
    d = _frame(spark, x1, x2, f, y).repartition(40)  # more triangles than one merge takes
    fit = L.OLSFit(d, F.col("y"), {"x1": F.col("x1"), "x2": F.col("x2")}, factors={"f": F.col("f")}, keep=["id"])
    assert fit.terms == ["(Intercept)", "x1", "x2", "f[b]", "f[c]"] and fit.n == 800
    # the same model with x1 moved to zero, where plain formulas are exact
    x = np.stack([np.ones(800), x1 - 1e8, x2, f == 1, f == 2], 1).astype(float)
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    e = y - x @ b
    h = ((x @ inv) * x).sum(1)
    s2 = e @ e / (800 - 5)
    assert fit.coef[1:] == pytest.approx(b[1:], rel=1e-6) and fit.coef[0] + fit.coef[1] * 1e8 == pytest.approx(b[0], abs=1e-4)
    assert fit.se[1:] == pytest.approx(np.sqrt(np.diag(inv) * s2)[1:], rel=1e-6)
    assert fit.r2 == pytest.approx(1 - e @ e / ((y - y.mean()) @ (y - y.mean())), rel=1e-9)
    hc3 = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    assert fit.robust_se()[1:] == pytest.approx(np.sqrt(np.diag(hc3))[1:], rel=1e-5)
    rows = {r.id: r for r in fit.qq_pairs().collect()}
    std = e / np.sqrt(s2 * (1 - h))
    assert sorted(rows) == list(range(800))
    assert [rows[i].std_residual for i in range(800)] == pytest.approx(std.tolist(), abs=1e-4)
    assert [rows[i].cooks_d for i in range(800)] == pytest.approx((std**2 / 5 * h / (1 - h)).tolist(), abs=1e-5)
    order = sorted(rows.values(), key=lambda r: r.std_residual)
    assert [r.qq_rank for r in order] == list(range(1, 801))
    assert [r.theoretical for r in order] == pytest.approx([NormalDist().inv_cdf((i + 0.5) / 800) for i in range(800)], rel=1e-12)


def test_generalised_vif(spark):
    x1, x2, f, y = _data(400, 2)
    x1 = x1 + f  # tied to the factor
    fit = L.OLSFit(_frame(spark, x1, x2, f, y), F.col("y"), {"x1": F.col("x1"), "x2": F.col("x2")}, factors={"f": F.col("f"), "one": F.lit("k")})
    c = np.corrcoef(np.stack([x1, x2, f == 1, f == 2]).astype(float))
    det = np.linalg.det
    want = {"x1": (1 / (det(c) / det(c[1:, 1:])), 1), "x2": (det(np.delete(np.delete(c, 1, 0), 1, 1)) / det(c), 1),
            "f": (det(c[2:, 2:]) * det(c[:2, :2]) / det(c), 2)}
    got = {t: (g, k) for t, g, k, _ in fit.gvif()}
    assert set(got) == set(want)
    for t, (g, k) in want.items():
        assert got[t][0] == pytest.approx(g, rel=1e-6) and got[t][1] == k
    assert dict((t, s) for t, _, _, s in fit.gvif())["f"] == pytest.approx(want["f"][0] ** 0.25, rel=1e-6)
    assert dict(L.vif(_frame(spark, x1, x2, f, y).where("id >= 0"), ["x1", "x2"]))["x1"] == pytest.approx(1 / (1 - c[0, 1] ** 2), rel=1e-6)


def test_many_terms_and_dependent_terms(spark):
    r = np.random.default_rng(3)
    x, b = r.normal(size=(300, 90)), r.normal(size=90)
    d = spark.createDataFrame([(row.tolist(), float(row @ b)) for row in x], "x array<double>, y double")
    fit = L.OLSFit(d, F.col("y"), {f"x{i}": F.col("x")[i] for i in range(90)}, intercept=False)
    assert fit.coef == pytest.approx(b, abs=1e-9)
    with pytest.raises(ValueError, match="dependent"):
        L.OLSFit(d, F.col("y"), {"a": F.col("x")[0], "b": F.col("x")[0] * 2})
    with pytest.raises(ValueError, match="fewer rows"):
        L.OLSFit(d.limit(2), F.col("y"), {"a": F.col("x")[0], "b": F.col("x")[1]})


def test_normal_quantile(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.9251, 0.999999]
    d = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, -0.5, None]], "p double")
    got = [r.q for r in d.select(L.normal_quantile(F.col("p")).alias("q")).collect()]
    assert got[:len(ps)] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-13, abs=1e-15)
    assert got[len(ps):] == [None] * 4 and math.isfinite(got[0])
