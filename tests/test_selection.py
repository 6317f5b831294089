"""Exact quantiles and ranks of pairwise differences against brute force."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import quantiles as Q
from tessera.operators import stats as ST


@pytest.mark.parametrize("accuracy,rows,few", [(1000, 4_000_000, 20_000), (1000, 4_000_000, 3), (20, 10, 3)])
def test_exact_quantiles(spark, monkeypatch, accuracy, rows, few):
    monkeypatch.setattr(Q, "_FEW_VALUES", few)
    monkeypatch.setattr(Q, "_ACCURACY", accuracy)
    monkeypatch.setattr(Q, "_BRACKET_ROWS", rows)  # small: brackets are narrowed and missed ones opened again
    r = random.Random(1)
    data = [(r.gauss(0, 1), float(r.choice([1, 1, 1, 2, 9])), None if i % 3 else r.random(), r.randrange(10**6), None) for i in range(3000)]
    d = spark.createDataFrame(data, "a double, b double, c double, e long, f double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = Q.exact_quantiles(d, ["a", "b", "c", "e", "f"], qs)
    for i, c in enumerate("abce"):
        assert got[c] == pytest.approx(np.quantile([x[i] for x in data if x[i] is not None], qs).tolist(), rel=1e-12)
    assert got["f"] == [None] * len(qs)
    assert Q.exact_quantiles(d.limit(0), ["a"], [0.5]) == {"a": [None]}
    assert Q.exact_quantiles(d.limit(1), ["a"], [0.3])["a"] == [d.first().a]


@pytest.mark.parametrize("draw,size", [(lambda r, s: r.randrange(30) + s, 200), (lambda r, s: r.gauss(s, 1), 60)])
def test_location_shift(spark, draw, size):
    r = random.Random(2)
    x, y = [draw(r, 3) for _ in range(size)], [draw(r, 0) for _ in range(size)]
    d = spark.createDataFrame([(float(v), 0) for v in x] + [(float(v), 1) for v in y] + [(None, 0), (1.0, None)], "v double, g int")
    pairs = sorted(a - b for a in x for b in y)
    n, ties = 2 * size, sum(t**3 - t for t in np.unique(np.array(x + y), return_counts=True)[1].tolist())
    sd = math.sqrt(size * size / 12 * ((n + 1) - ties / (n * (n - 1))))
    c = max(1, math.floor(size * size / 2 - NormalDist().inv_cdf(0.975) * sd))
    want = (float(np.median(pairs)), pairs[c - 1], pairs[size * size - c])
    assert ST.location_shift(d, "v", "g", 0) == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert all(math.isnan(v) for v in ST.location_shift(d.where("g = 0"), "v", "g", 0))


def test_p_values(spark):
    r = random.Random(4)
    rows = [(round(r.gauss(0.3, 1), 1), round(r.gauss(0, 1), 1)) for _ in range(80)]
    d = spark.createDataFrame(rows, "a double, b double")
    diffs = [round(a - b, 10) for a, b in rows if round(a - b, 10)]
    size = sorted(map(abs, diffs))
    rank = {v: size.index(v) + (size.count(v) + 1) / 2 for v in size}
    v, n = sum(rank[abs(x)] for x in diffs if x > 0), len(diffs)
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(size.count(x) ** 3 - size.count(x) for x in set(size)) / 48
    z = (v - n * (n + 1) / 4 - math.copysign(0.5, v - n * (n + 1) / 4)) / math.sqrt(var)
    got = ST.signed_rank_test(ST.signed_rank_stats(d, "a", "b").first())
    assert got["z"] == pytest.approx(z) and got["p_value"] == pytest.approx(2 * (1 - NormalDist().cdf(abs(z))))
    paired = ST.paired_t_test(ST.paired_t_stats(d, "a", "b").first())
    x = np.array([a - b for a, b in rows])
    t = x.mean() / (x.std(ddof=1) / math.sqrt(80))
    assert paired["t"] == pytest.approx(t)
    # the density of t with 79 degrees of freedom, integrated beyond |t|
    grid = np.linspace(abs(t), 60, 400_001)
    density = np.exp(math.lgamma(40) - math.lgamma(39.5)) / math.sqrt(79 * math.pi) * (1 + grid**2 / 79) ** -40.0
    assert paired["p_value"] == pytest.approx(2 * float(((density[1:] + density[:-1]) / 2 * np.diff(grid)).sum()), rel=1e-6)


def test_signed_rank_of_many_rows(spark):
    # 3 million pairs: n (n + 1) (2 n + 1) is beyond a long
    n, d = 3_000_000, spark.range(3_000_000).select((F.col("id") % 2 * 2 - 1).cast("double").alias("a"), F.lit(0.0).alias("b"))
    row = ST.signed_rank_stats(d, "a", "b").first()
    var = n * (n + 1) * (2 * n + 1) / 24 - (n**3 - n) / 48
    assert (row["n"], row["v"], row["mean_v"]) == (n, n / 2 * (n + 1) / 2, n * (n + 1) / 4)
    assert row["var_v"] == pytest.approx(var, rel=1e-14)
    assert ST.signed_rank_test(row)["z"] == 0.0
