"""Statistical inference (T*): rank tests, t-tests, OLS with robust errors.

Sufficient statistics are computed by Spark aggregates (histograms, moments,
Gram matrices); only fixed-size results (a handful of scalars, a p x p matrix
with p small) reach the driver, where the distribution functions are
evaluated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.linear import OLSFit, vif  # noqa: F401 - the fits belong to the tests' interface
from tessera.operators.scan import midranks, running_sums


# ------------------------------------------------------------------ distributions
def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """1 + d1/(1 + d2/(1 + ...)), the continued fraction of the incomplete beta
    function (DLMF 8.17.22), from the tail inwards; the number of terms is
    doubled until the value stands."""
    def to(n: int) -> float:
        value = 1.0
        for k in range(n, 0, -1):
            m = k // 2
            if k % 2:
                d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            else:
                d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            value = 1.0 + d / value
        return value

    terms, before, now = 32, math.nan, to(16)
    while not abs(now - before) <= 1e-15 * abs(now):
        before, now, terms = now, to(terms), 2 * terms
        if terms > 1 << 16:
            raise ArithmeticError("the continued fraction does not settle")
    return now


def betainc_reg(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(lbeta)
    if x < (a + 1) / (a + b + 2):
        return front / (_beta_fraction(a, b, x) * a)
    return 1.0 - front / (_beta_fraction(b, a, 1 - x) * b)


def t_two_sided_p(t: float, df: float) -> float:
    if not math.isfinite(t):
        return 0.0
    x = df / (df + t * t)
    return betainc_reg(df / 2.0, 0.5, x)


# ------------------------------------------------------------------ rank tests
def rank_sum_stats(df: DataFrame, value: str, group: str, first) -> DataFrame:
    """Wilcoxon rank-sum (Mann-Whitney) statistic of the ``first`` group.

    Mid-ranks come from the distinct-value histogram and a distributed prefix
    sum, so no single task sorts the data.  Returns one row: n_x, n_y, w
    (R's W = rank sum of x minus n_x(n_x+1)/2), mean_w, var_w (tie-corrected).
    """
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    hist = d.groupBy(value).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(group) == F.lit(first)).alias("n_x")
    )
    ranked = midranks(hist, value, "n", "midrank")
    agg = ranked.agg(
        F.sum("n_x").alias("n_x"),
        (F.sum("n") - F.sum("n_x")).alias("n_y"),
        F.sum(F.col("midrank") * F.col("n_x")).alias("r_x"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"),
    )
    n = F.col("n_x") + F.col("n_y")
    return agg.select(
        "n_x", "n_y",
        (F.col("r_x") - F.col("n_x") * (F.col("n_x") + 1) / 2.0).alias("w"),
        (F.col("n_x") * F.col("n_y") / 2.0).alias("mean_w"),
        (F.col("n_x") * F.col("n_y") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1)))).alias("var_w"),
    )


def rank_sum_test(row) -> dict:
    """Normal approximation with continuity correction (two-sided)."""
    w, mu, var = row["w"], row["mean_w"], row["var_w"]
    diff = w - mu
    corr = 0.5 * (1 if diff > 0 else -1 if diff < 0 else 0)
    z = (diff - corr) / math.sqrt(var) if var > 0 else float("nan")
    return {"z": z, "p_value": 2 * min(normal_sf(z), 1 - normal_sf(z)) if var > 0 else float("nan")}


def signed_rank_test(row) -> dict:
    """z and two-sided p of ``signed_rank_stats`` (normal approximation with
    continuity correction, tie-corrected variance)."""
    return rank_sum_test({"w": row["v"], "mean_w": row["mean_v"], "var_w": row["var_v"]})


def paired_t_test(row) -> dict:
    """t and two-sided p of ``paired_t_stats``."""
    return {"t": row["t"], "p_value": t_two_sided_p(row["t"], row["df"])}


def signed_rank_stats(df: DataFrame, x: str | Column, y: str | Column, digits: int = 10) -> DataFrame:
    """Wilcoxon signed-rank V for paired x, y: differences rounded to
    ``digits`` (so float noise does not split ties), zeros dropped, mid-ranks
    of |d|, V = sum of ranks of positive differences."""
    xc = F.col(x) if isinstance(x, str) else x
    yc = F.col(y) if isinstance(y, str) else y
    d = df.select(F.round(xc - yc, digits).alias("d")).where((F.col("d") != 0) & F.col("d").isNotNull())
    hist = d.groupBy(F.abs("d").alias("absd")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("n_pos"))
    ranked = midranks(hist, "absd", "n", "midrank")
    n = F.col("n").cast("decimal(13,0)")  # cubes of more than 10^6 rows do not fit a long
    agg = ranked.agg(
        F.sum("n").alias("n"), F.sum(F.col("midrank") * F.col("n_pos")).alias("v"),
        F.sum(n * n * n - n).cast("double").alias("ties"),
    )
    return agg.select(
        "n", "v", ((n * (n + 1)).cast("double") / 4.0).alias("mean_v"),
        ((n * (n + 1) * (2 * n + 1)).cast("double") / 24.0 - F.col("ties") / 48.0).alias("var_v"),
    )


def difference_ranks(df: DataFrame, value: str, group: str, first, ranks: Sequence[int], fanout: int = 64) -> list[float]:
    """The differences x_i - y_j (x = ``first`` group) at the 1-based ``ranks``
    of all pairs in order, without forming the pairs; exact for integer-valued
    data, to 1e-12 of the bracket's size otherwise.

    The number of pairs with x - y <= d is sum_x n_x * #{y >= x - d}; it is
    evaluated for about ``fanout`` candidate d's of all ranks at once by merging
    the shifted x values with the y values in one distributed prefix sum.  Each
    pass narrows the bracket of every rank.
    """
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    xs = d.where(F.col(group) == F.lit(first)).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    ys = d.where(F.col(group) != F.lit(first)).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    st = xs.agg(F.min("v"), F.max("v"), F.sum("n")).first()
    sy = ys.agg(F.min("v"), F.max("v"), F.sum("n")).first()
    if st[2] is None or sy[2] is None:
        return [float("nan")] * len(ranks)
    ny = sy[2]
    integral = d.agg(F.bool_and(F.col(value).cast("double") == F.floor(F.col(value)))).first()[0]

    def counts_le(cands: list[float]) -> list[int]:
        """#pairs with x - y <= c for each candidate c."""
        cand = F.array(*[F.lit(float(c)) for c in cands])
        shifted = xs.select(F.posexplode(cand).alias("k", "c"), "v", "n").select(
            (F.col("v") - F.col("c")).alias("key"), F.lit(0).alias("kind"), "k", F.col("n").alias("nx"),
            F.lit(0).cast("long").alias("ny"))
        yrows = ys.select(F.col("v").alias("key"), F.lit(1).alias("kind"), F.lit(-1).alias("k"),
                          F.lit(0).cast("long").alias("nx"), F.col("n").alias("ny"))
        both = shifted.unionByName(yrows)
        # y rows sort after x rows at equal keys: the prefix sum before an x row
        # counts the y values strictly below x - c
        cum = running_sums(both, [], ["key", "kind", "k"], {"__ybelow": F.col("ny")})
        per = cum.where("kind = 0").groupBy("k").agg(F.sum(F.col("nx") * (F.lit(ny) - F.col("__ybelow"))).alias("cnt"))
        got = {r["k"]: r["cnt"] for r in per.collect()}
        return [int(got.get(i, 0)) for i in range(len(cands))]

    # no pair lies at or below the lower end, all at or below the upper one
    brackets = {r: (st[0] - sy[1] - 1.0, st[1] - sy[0]) for r in ranks}
    total = st[2] * ny
    counts = {b: n for lo, hi in brackets.values() for b, n in ((lo, 0), (hi, total))}
    if any(not 1 <= r <= total for r in ranks):
        raise ValueError(f"ranks go from 1 to {total}")

    def open_(lo: float, hi: float) -> bool:
        return hi - lo > (1 if integral else 1e-12 * max(1.0, abs(hi)))

    while todo := sorted({b for b in brackets.values() if open_(*b)}):
        steps = max(fanout // len(todo), 3)
        cands = set()
        for lo, hi in todo:
            inner = [lo + (hi - lo) / steps * (i + 1) for i in range(steps - 1)]
            if integral:
                inner = [c for c in map(math.floor, inner) if lo < c < hi] or [lo + 1]
            cands |= {float(c) for c in inner if lo < c < hi}
        if not cands:  # neighbouring doubles
            break
        cands = sorted(cands)
        counts |= zip(cands, counts_le(cands))
        known = sorted(counts)
        for r in brackets:
            at = next(i for i, c in enumerate(known) if counts[c] >= r)
            assert counts[known[at - 1]] < r <= counts[known[at]], "the bracket lost its rank"
            brackets[r] = (known[at - 1], known[at])
    return [float(brackets[r][1]) for r in ranks]


def hodges_lehmann(df: DataFrame, value: str, group: str, first, fanout: int = 64) -> float:
    """Median of all pairwise differences x_i - y_j (x = ``first`` group)."""
    return location_shift(df, value, group, first, None, fanout)[0]


def location_shift(df: DataFrame, value: str, group: str, first, level: float | None = 0.95, fanout: int = 64) -> tuple[float, float, float]:
    """Location shift with its confidence interval: (estimate, lower, upper).

    The bounds are the differences of rank C and n_x n_y + 1 - C, with C =
    floor(n_x n_y / 2 - z sd), at least 1, sd the tie-corrected standard
    deviation of the rank-sum statistic and z the normal quantile of the level
    (Hollander and Wolfe); estimate and bounds are selected together.
    ``level=None`` leaves the bounds out (NaN).
    """
    row = rank_sum_stats(df, value, group, first).first()
    nan = float("nan")
    if not row["n_x"] or not row["n_y"]:
        return nan, nan, nan
    total = int(row["n_x"] * row["n_y"])
    ranks = [(total + 1) // 2, total // 2 + 1]
    if level is not None:
        z = NormalDist().inv_cdf((1 + level) / 2)
        c = max(1, math.floor(total / 2 - z * math.sqrt(row["var_w"])))
        ranks += [c, total + 1 - c]
    got = difference_ranks(df, value, group, first, ranks, fanout)
    return (got[0] + got[1]) / 2, *(got[2:] or (nan, nan))


# ------------------------------------------------------------------ t-tests
def welch_stats(df: DataFrame, value: str, group: str, first) -> DataFrame:
    g = F.col(group) == F.lit(first)
    v = F.col(value).cast("double")
    agg = df.where(F.col(group).isNotNull() & v.isNotNull()).agg(
        F.avg(F.when(g, v)).alias("mean_x"), F.avg(F.when(~g, v)).alias("mean_y"),
        F.var_samp(F.when(g, v)).alias("var_x"), F.var_samp(F.when(~g, v)).alias("var_y"),
        F.count_if(g).alias("n_x"), F.count_if(~g).alias("n_y"),
    )
    sx = F.col("var_x") / F.col("n_x")
    sy = F.col("var_y") / F.col("n_y")
    return agg.select(
        "n_x", "n_y", "mean_x", "mean_y",
        ((F.col("mean_x") - F.col("mean_y")) / F.sqrt(sx + sy)).alias("t"),
        (F.pow(sx + sy, 2) / (F.pow(sx, 2) / (F.col("n_x") - 1) + F.pow(sy, 2) / (F.col("n_y") - 1))).alias("df"),
    )


def paired_t_stats(df: DataFrame, x: str, y: str) -> DataFrame:
    d = (F.col(x) - F.col(y)).cast("double")
    agg = df.where(d.isNotNull()).agg(F.count(d).alias("n"), F.avg(d).alias("mean_d"), F.stddev_samp(d).alias("sd_d"))
    return agg.select("n", "mean_d", "sd_d", (F.col("mean_d") / (F.col("sd_d") / F.sqrt("n"))).alias("t"),
                      (F.col("n") - 1).alias("df"))


# ------------------------------------------------------------------ OLS
def stars(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""
