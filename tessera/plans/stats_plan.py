"""Statistical-inference queries (T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import stats as ST
from tessera.plans.common import DOCS_LABELS_SQL, docs_labels, tables
from tessera.plans.registry import query

_RS_HIST = f"""
WITH d AS (SELECT n_chars AS v, quality AS g FROM {DOCS_LABELS_SQL} j WHERE quality IS NOT NULL),
h AS (SELECT v, count(*) AS n, count(*) FILTER (WHERE g = 0) AS n_x FROM d GROUP BY v),
r AS (SELECT v, n, n_x, sum(n) OVER (ORDER BY v) - (n - 1) / 2.0 AS midrank FROM h),
a AS (SELECT sum(n_x) AS n_x, sum(n) - sum(n_x) AS n_y, sum(midrank * n_x) AS r_x,
             sum(n * n * n - n) AS ties FROM r)
"""


@query(
    "rank_sum",
    _RS_HIST
    + """SELECT CAST(n_x AS BIGINT) AS n_x, CAST(n_y AS BIGINT) AS n_y,
  round(r_x - n_x * (n_x + 1) / 2.0, 6) AS w, round(n_x * n_y / 2.0, 6) AS mean_w,
  round(n_x * n_y / 12.0 * ((n_x + n_y + 1) - ties / ((n_x + n_y) * (n_x + n_y - 1))), 6) AS var_w FROM a""",
)
def rank_sum(spark, sf_dir):
    """Rank-sum statistic of n_chars, quality 0 vs 1 (W, mean, tie-corrected variance)."""
    j = docs_labels(tables(spark, sf_dir))
    s = ST.rank_sum_stats(j, "n_chars", "quality", 0)
    return s.select("n_x", "n_y", *[F.round(c, 6).alias(c) for c in ("w", "mean_w", "var_w")])


@query("rank_sum_test")
def rank_sum_test(spark, sf_dir):
    """Rank-sum z and two-sided p (normal approximation, continuity correction)."""
    j = docs_labels(tables(spark, sf_dir))
    row = ST.rank_sum_stats(j, "n_chars", "quality", 0).first()
    res = ST.rank_sum_test(row)
    return spark.createDataFrame(
        [(float(row["w"]), float(res["z"]), float(res["p_value"]))], "w double, z double, p_value double"
    )


@query(
    "hodges_lehmann",
    f"""
WITH d AS (SELECT n_chars AS v, quality AS g FROM {DOCS_LABELS_SQL} j WHERE quality IS NOT NULL)
SELECT CAST(median(x.v - y.v) AS DOUBLE) AS shift
FROM (SELECT v FROM d WHERE g = 0) x CROSS JOIN (SELECT v FROM d WHERE g = 1) y
""",
)
def hodges_lehmann(spark, sf_dir):
    """Location shift (quality 0 minus quality 1) of n_chars: median of all
    pairwise differences, computed without forming the pairs."""
    j = docs_labels(tables(spark, sf_dir))
    est = ST.hodges_lehmann(j, "n_chars", "quality", 0)
    return spark.createDataFrame([(float(est),)], "shift double")


@query(
    "location_shift",
    _RS_HIST + f""", c AS (SELECT CAST(n_x * n_y AS BIGINT) AS total, CAST(greatest(1, floor(n_x * n_y / 2.0 - 1.959963984540054 * sqrt(
    n_x * n_y / 12.0 * ((n_x + n_y + 1) - ties / ((n_x + n_y) * (n_x + n_y - 1)))))) AS BIGINT) AS c FROM a),
o AS (SELECT list_sort(list(x.v - y.v)) AS l FROM (SELECT v FROM d WHERE g = 0) x CROSS JOIN (SELECT v FROM d WHERE g = 1) y)
SELECT (l[(total + 1) // 2] + l[total // 2 + 1]) / 2.0 AS shift, CAST(l[c] AS DOUBLE) AS lower, CAST(l[total + 1 - c] AS DOUBLE) AS upper
FROM o CROSS JOIN c""",
)
def location_shift(spark, sf_dir):
    """Location shift of n_chars with its 95 % interval."""
    j = docs_labels(tables(spark, sf_dir))
    return spark.createDataFrame([ST.location_shift(j, "n_chars", "quality", 0)], "shift double, lower double, upper double")


@query(
    "signed_rank",
    """
WITH d AS (SELECT round(l_discount - l_tax, 10) AS d FROM lineitem WHERE round(l_discount - l_tax, 10) <> 0),
h AS (SELECT abs(d) AS a, count(*) AS n, count(*) FILTER (WHERE d > 0) AS n_pos FROM d GROUP BY 1),
r AS (SELECT a, n, n_pos, sum(n) OVER (ORDER BY a) - (n - 1) / 2.0 AS midrank FROM h),
s AS (SELECT sum(n) AS n, sum(midrank * n_pos) AS v, sum(n * n * n - n) AS ties FROM r)
SELECT CAST(n AS BIGINT) AS n, round(v, 6) AS v, round(n * (n + 1) / 4.0, 6) AS mean_v,
       round(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0, 6) AS var_v FROM s
""",
)
def signed_rank(spark, sf_dir):
    """Paired signed-rank V of l_discount vs l_tax per line."""
    li = tables(spark, sf_dir).lineitem
    s = ST.signed_rank_stats(li, "l_discount", "l_tax")
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("v", "mean_v", "var_v")])


@query("signed_rank_test")
def signed_rank_test(spark, sf_dir):
    """Signed-rank z and two-sided p of l_discount vs l_tax."""
    row = ST.signed_rank_stats(tables(spark, sf_dir).lineitem, "l_discount", "l_tax").first()
    res = ST.signed_rank_test(row)
    return spark.createDataFrame([(float(row["v"]), float(res["z"]), float(res["p_value"]))], "v double, z double, p_value double")


@query("paired_t_test")
def paired_t_test(spark, sf_dir):
    """Paired t with its two-sided p."""
    row = ST.paired_t_stats(tables(spark, sf_dir).lineitem, "l_discount", "l_tax").first()
    res = ST.paired_t_test(row)
    return spark.createDataFrame([(float(row["t"]), int(row["df"]), float(res["p_value"]))], "t double, df long, p_value double")


@query(
    "welch_t",
    f"""
WITH a AS (SELECT avg(n_chars) FILTER (WHERE quality = 0) AS mx, avg(n_chars) FILTER (WHERE quality <> 0) AS my,
  var_samp(n_chars) FILTER (WHERE quality = 0) AS vx, var_samp(n_chars) FILTER (WHERE quality <> 0) AS vy,
  count(*) FILTER (WHERE quality = 0) AS nx, count(*) FILTER (WHERE quality <> 0) AS ny
  FROM {DOCS_LABELS_SQL} j WHERE quality IS NOT NULL)
SELECT nx AS n_x, ny AS n_y, round(mx, 6) AS mean_x, round(my, 6) AS mean_y,
  round((mx - my) / sqrt(vx / nx + vy / ny), 6) AS t,
  round(pow(vx / nx + vy / ny, 2) / (pow(vx / nx, 2) / (nx - 1) + pow(vy / ny, 2) / (ny - 1)), 6) AS df FROM a
""",
)
def welch_t(spark, sf_dir):
    """Welch t statistic and degrees of freedom, n_chars by quality."""
    j = docs_labels(tables(spark, sf_dir))
    s = ST.welch_stats(j, "n_chars", "quality", 0)
    return s.select("n_x", "n_y", *[F.round(c, 6).alias(c) for c in ("mean_x", "mean_y", "t", "df")])


@query("welch_t_test")
def welch_t_test(spark, sf_dir):
    """Welch t-test with its two-sided p-value (t distribution on the driver)."""
    j = docs_labels(tables(spark, sf_dir))
    r = ST.welch_stats(j, "n_chars", "quality", 0).first()
    p = ST.t_two_sided_p(r["t"], r["df"])
    return spark.createDataFrame([(float(r["t"]), float(r["df"]), float(p))], "t double, df double, p_value double")


@query(
    "paired_t",
    "SELECT count(*) AS n, round(avg(l_discount - l_tax), 9) AS mean_d, round(stddev_samp(l_discount - l_tax), 9) "
    "AS sd_d, round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) AS t, "
    "count(*) - 1 AS df FROM lineitem",
)
def paired_t(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    s = ST.paired_t_stats(li, "l_discount", "l_tax")
    return s.select("n", F.round("mean_d", 9).alias("mean_d"), F.round("sd_d", 9).alias("sd_d"),
                    F.round("t", 6).alias("t"), "df")


@query(
    "ols_simple",
    "SELECT round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept, "
    "round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, "
    "round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 6) AS r2, "
    "CAST(regr_count(ln(l_extendedprice), ln(l_quantity)) AS BIGINT) AS n FROM lineitem",
)
def ols_simple(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    y, x = F.ln("l_extendedprice"), F.ln("l_quantity")
    return li.agg(
        F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_slope(y, x), 6).alias("slope"),
        F.round(F.regr_r2(y, x), 6).alias("r2"), F.regr_count(y, x).cast("long").alias("n"),
    )


def _models(li):
    y = F.ln("l_extendedprice")
    base = {"ln_quantity": F.ln("l_quantity")}
    m2 = dict(base, l_tax=F.col("l_tax"))
    m3 = dict(m2, flag_N=(F.col("l_returnflag") == "N").cast("double"),
              flag_R=(F.col("l_returnflag") == "R").cast("double"))
    return y, {"model_1": base, "model_2": m2, "model_3": m3}


@query("ols_multi")
def ols_multi(spark, sf_dir):
    """ln(price) ~ ln(quantity) + tax + return-flag dummies (A is the base
    level): coefficients, SE, t, p, R2, adjusted R2, HC3 robust SE."""
    li = tables(spark, sf_dir).lineitem
    y, models = _models(li)
    fit = ST.OLSFit(li, y, models["model_3"])
    rows = [r + (float(fit.r2), float(fit.adj_r2), fit.n) for r in fit.summary_rows()]
    return spark.createDataFrame(
        rows, "term string, coef double, se double, t double, p_value double, robust_se double, "
              "r2 double, adj_r2 double, n long")


@query("robust_se")
def robust_se(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    y, models = _models(li)
    fit = ST.OLSFit(li, y, models["model_3"])
    rse = fit.robust_se()
    return spark.createDataFrame([(t, float(s)) for t, s in zip(fit.terms, rse)], "term string, hc3_se double")


@query("vif")
def vif(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem.select(
        F.ln("l_quantity").alias("ln_quantity"), "l_tax",
        (F.col("l_returnflag") == "N").cast("double").alias("flag_N"),
        (F.col("l_returnflag") == "R").cast("double").alias("flag_R"))
    return spark.createDataFrame(ST.vif(li, li.columns), "term string, vif double")


@query(
    "residual_kurtosis",
    """
WITH c AS (SELECT regr_intercept(ln(l_extendedprice), ln(l_quantity)) AS a,
                  regr_slope(ln(l_extendedprice), ln(l_quantity)) AS b FROM lineitem)
SELECT round(kurtosis_pop(ln(l_extendedprice) - (c.a + c.b * ln(l_quantity))), 6) AS excess_kurtosis
FROM lineitem CROSS JOIN c
""",
)
def residual_kurtosis(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    y, x = F.ln("l_extendedprice"), F.ln("l_quantity")
    coef = li.agg(F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"))
    a = coef.select("a").scalar()
    b = coef.select("b").scalar()
    return li.agg(F.round(F.kurtosis(y - (a + b * x)), 6).alias("excess_kurtosis"))


@query("ols_diagnostics")
def ols_diagnostics(spark, sf_dir):
    """Per-row diagnostics table behind residual/QQ/leverage/Cook's plots."""
    li = tables(spark, sf_dir).lineitem
    y, models = _models(li)
    return ST.OLSFit(li, y, models["model_3"], keep=["l_orderkey", "l_linenumber"]).diagnostics()


@query("ols_qq")
def ols_qq(spark, sf_dir):
    """The same rows with their normal quantiles, and the line's key to trace
    a high Cook's D."""
    li = tables(spark, sf_dir).lineitem
    y, models = _models(li)
    return ST.OLSFit(li, y, models["model_2"], factors={"flag": F.col("l_returnflag")}, keep=["l_orderkey", "l_linenumber"]).qq_pairs()


@query("gvif")
def gvif(spark, sf_dir):
    """Generalised VIF of ln(quantity), tax and the factor return flag."""
    li = tables(spark, sf_dir).lineitem
    y, models = _models(li)
    fit = ST.OLSFit(li, y, models["model_2"], factors={"flag": F.col("l_returnflag")})
    return spark.createDataFrame(fit.gvif(), "term string, gvif double, df int, scaled double")


@query("model_table")
def model_table(spark, sf_dir):
    """Three nested models side by side: coefficient, HC3 SE, stars."""
    li = tables(spark, sf_dir).lineitem
    y, models = _models(li)
    rows = []
    for name, terms in models.items():
        fit = ST.OLSFit(li, y, terms)
        rse = fit.robust_se()
        for i, term in enumerate(fit.terms):
            t = fit.coef[i] / rse[i]
            p = ST.t_two_sided_p(t, fit.df_resid)
            rows.append((name, term, float(fit.coef[i]), float(rse[i]), ST.stars(p)))
        rows.append((name, "R2", float(fit.r2), None, ""))
    return spark.createDataFrame(rows, "model string, term string, coef double, robust_se double, stars string")


@query(
    "score_sum_valid",
    f"""
SELECT doc_id, coalesce(quality, -9) + coalesce(toxic, -9) + CAST(n_chars > 1000 AS INTEGER) AS score
FROM {DOCS_LABELS_SQL} j WHERE coalesce(quality, -9) >= 0 AND coalesce(toxic, -9) >= 0
""",
)
def score_sum_valid(spark, sf_dir):
    """Sum of indicators per document; a row is valid only if every indicator
    is (missing codes are negative, -9)."""
    j = docs_labels(tables(spark, sf_dir))
    inds = [F.coalesce("quality", F.lit(-9)), F.coalesce("toxic", F.lit(-9)), (F.col("n_chars") > 1000).cast("int")]
    valid = inds[0] >= 0
    for c in inds[1:]:
        valid = valid & (c >= 0)
    return j.where(valid).select("doc_id", (inds[0] + inds[1] + inds[2]).alias("score"))

