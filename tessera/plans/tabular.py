"""Relational and scalar queries over the fixture tables (S4-S6, S16, P, H,
J, A, W, U, X groups), each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as X
from tessera.operators import relational as R
from tessera.plans.common import (
    DOCS_LABELS_SQL,
    NATION_MONTHLY_SQL,
    NATION_PAIRS_SQL,
    docs_labels,
    nation_monthly,
    nation_pairs,
    tables,
    ts,
)
from tessera.plans.registry import query

# ------------------------------------------------------------------ flagship
TOP_SUPPLIERS_SQL = """
WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey),
top AS (SELECT l_suppkey FROM c ORDER BY n DESC, l_suppkey LIMIT 25),
tot AS (SELECT count(*) AS t FROM lineitem),
f AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_linestatus, l.l_quantity,
         CAST(CASE WHEN top.l_suppkey IS NULL THEN 0 ELSE 1 END AS INTEGER) AS is_top_supplier,
         round(c.n / tot.t, 6) AS supplier_share
  FROM lineitem l JOIN c ON l.l_suppkey = c.l_suppkey
  LEFT JOIN top ON l.l_suppkey = top.l_suppkey CROSS JOIN tot)
"""


def entity_features_df(spark, sf_dir):
    """top-25 supplier flag + supplier share per line, supplier id dropped."""
    t = tables(spark, sf_dir)
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus", "l_quantity")
    top = R.top_n_keys(li, "l_suppkey", 25)
    flagged = R.membership_flag(li, top, "l_suppkey", "is_top_supplier", bound=25)
    shares = R.value_share(li, "l_suppkey").select("l_suppkey", F.col("share").alias("supplier_share"))
    return flagged.join(shares, "l_suppkey").drop("l_suppkey")


@query("entity_features", TOP_SUPPLIERS_SQL + "SELECT * FROM f")
def entity_features(spark, sf_dir):
    return entity_features_df(spark, sf_dir)


@query(
    "group_mean",
    TOP_SUPPLIERS_SQL
    + "SELECT l_linestatus, is_top_supplier, round(avg(l_quantity), 6) AS mean_quantity, count(*) AS n_lines "
    "FROM f GROUP BY l_linestatus, is_top_supplier",
)
def group_mean(spark, sf_dir):
    f = entity_features_df(spark, sf_dir)
    return f.groupBy("l_linestatus", "is_top_supplier").agg(
        F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.count(F.lit(1)).alias("n_lines")
    )


# ------------------------------------------------------------------ S
@query(
    "preview_count",
    "SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) FROM orders) AS total_rows "
    "FROM orders ORDER BY o_orderkey LIMIT 10",
)
def preview_count(spark, sf_dir):
    o = tables(spark, sf_dir).orders
    total = o.select(F.count(F.lit(1))).scalar()
    return o.orderBy("o_orderkey").limit(10).select("o_orderkey", "o_custkey", "o_totalprice", total.alias("total_rows"))


_SQL_SELECT = """
SELECT o.o_orderpriority, count(*) AS n_lines,
       round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM {li} l JOIN {o} o ON l.l_orderkey = o.o_orderkey
WHERE l.l_returnflag <> 'R'
GROUP BY o.o_orderpriority
"""


@query("sql_select", _SQL_SELECT.format(li="lineitem", o="orders"))
def sql_select(spark, sf_dir):
    t = tables(spark, sf_dir)
    return spark.sql(_SQL_SELECT.format(li="{li}", o="{o}"), li=t.lineitem, o=t.orders)


@query(
    "param_in_list",
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey IN "
    "(SELECT n_nationkey FROM nation WHERE n_name IN ('NATION_3', 'NATION_7', 'NATION_11'))",
)
def param_in_list(spark, sf_dir):
    t = tables(spark, sf_dir)
    return spark.sql(
        "SELECT c_custkey, c_name, c_acctbal FROM {c} WHERE c_nationkey IN "
        "(SELECT n_nationkey FROM {n} WHERE n_name IN (:a, :b, :c))",
        args={"a": "NATION_3", "b": "NATION_7", "c": "NATION_11"},
        c=t.customer,
        n=t.nation,
    )


@query(
    "dict_projection",
    "SELECT l_orderkey AS order_id, l_quantity AS qty, l_extendedprice AS price, l_returnflag AS return_flag "
    "FROM lineitem",
)
def dict_projection(spark, sf_dir):
    t = tables(spark, sf_dir)
    dictionary = spark.createDataFrame(
        [("l_orderkey", "order_id"), ("l_quantity", "qty"), ("l_extendedprice", "price"),
         ("l_returnflag", "return_flag")],
        "variable string, title string",
    )
    return R.dict_projection(t.lineitem, dictionary)


# ------------------------------------------------------------------ P
@query(
    "project_rename",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS revenue, o_orderdate FROM orders",
)
def project_rename(spark, sf_dir):
    return R.rename_project(tables(spark, sf_dir).orders, {"o_totalprice": "revenue"}, drop=["o_orderpriority"])


@query(
    "filter_compound",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem "
    "WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 10",
)
def filter_compound(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return li.where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 10)).select(
        "l_orderkey", "l_linenumber", "l_quantity"
    )


@query(
    "filter_range",
    "SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders "
    "WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'",
)
def filter_range(spark, sf_dir):
    o = tables(spark, sf_dir).orders
    # half-open year range written on the timestamp so it reaches the scan
    return o.where((F.col("o_orderdate") >= ts("1996-01-01")) & (F.col("o_orderdate") < ts("1999-01-01"))).select(
        "o_orderkey", "o_orderdate", F.year("o_orderdate").alias("year")
    )


@query(
    "filter_not_in",
    f"SELECT doc_id, quality, toxic FROM {DOCS_LABELS_SQL} j WHERE toxic IS NULL OR toxic NOT IN (1)",
)
def filter_not_in(spark, sf_dir):
    j = docs_labels(tables(spark, sf_dir))
    return j.where(R.not_in_keep_null("toxic", [1])).select("doc_id", "quality", "toxic")


@query(
    "filter_not_null",
    f"SELECT doc_id, lang, quality FROM {DOCS_LABELS_SQL} j WHERE quality IS NOT NULL AND lang <> ''",
)
def filter_not_null(spark, sf_dir):
    j = docs_labels(tables(spark, sf_dir))
    return j.dropna(subset=["quality"]).where(F.col("lang") != "").select("doc_id", "lang", "quality")


@query(
    "threshold_sweep",
    "SELECT v.threshold, CAST(count(*) FILTER (WHERE l.l_quantity <= v.threshold) AS BIGINT) AS n_rows "
    "FROM lineitem l CROSS JOIN (VALUES (30), (20), (15), (5), (10)) v(threshold) GROUP BY v.threshold",
)
def threshold_sweep(spark, sf_dir):
    return R.threshold_counts(tables(spark, sf_dir).lineitem, "l_quantity", [30, 20, 15, 5, 10])


_FLAGS = {
    "returned": "l_returnflag = 'R'",
    "finished": "l_linestatus = 'F'",
    "high_discount": "l_discount > 0.05",
    "high_tax": "l_tax > 0.05",
}


def _flag_cols():
    return {
        "returned": F.col("l_returnflag") == "R",
        "finished": F.col("l_linestatus") == "F",
        "high_discount": F.col("l_discount") > 0.05,
        "high_tax": F.col("l_tax") > 0.05,
    }


@query(
    "any_all_flags",
    "SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, "
    f"CAST(count(*) FILTER (WHERE {' OR '.join(_FLAGS.values())}) AS BIGINT) AS n_any, "
    f"CAST(count(*) FILTER (WHERE {' AND '.join(_FLAGS.values())}) AS BIGINT) AS n_all "
    "FROM lineitem GROUP BY 1",
)
def any_all_flags(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    conds = list(_flag_cols().values())
    return li.groupBy(F.year("l_shipdate").alias("ship_year")).agg(
        F.count_if(X.any_of(conds)).alias("n_any"), F.count_if(X.all_of(conds)).alias("n_all")
    )


# ------------------------------------------------------------------ H
_MISSING_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
_MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing, "
    f"round(CAST(100.0 AS DOUBLE) * count(*) FILTER (WHERE {c} IS NULL) / count(*), 1) AS pct_missing "
    f"FROM {DOCS_LABELS_SQL} j"
    for c in _MISSING_COLS
)


@query("missing_profile", f"SELECT * FROM ({_MISSING_SQL}) WHERE n_missing > 0")
def missing_profile(spark, sf_dir):
    return R.missing_profile(docs_labels(tables(spark, sf_dir)), _MISSING_COLS)


@query(
    "assert_null_implies",
    f"SELECT lang, bool_and(quality IS NOT NULL OR toxic IS NULL) AS holds FROM {DOCS_LABELS_SQL} j GROUP BY lang",
)
def assert_null_implies(spark, sf_dir):
    j = docs_labels(tables(spark, sf_dir))
    return R.assert_implies(j, F.col("quality").isNull(), F.col("toxic").isNull(), by=["lang"])


@query(
    "dup_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def dup_keys(spark, sf_dir):
    return R.duplicate_keys(tables(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "funnel_accounting",
    """
WITH c AS (
  SELECT count(*) AS c0,
    count(*) FILTER (WHERE l_shipdate > TIMESTAMP '1997-01-01') AS c1,
    count(*) FILTER (WHERE l_shipdate > TIMESTAMP '1997-01-01' AND l_returnflag <> 'R') AS c2,
    count(*) FILTER (WHERE l_shipdate > TIMESTAMP '1997-01-01' AND l_returnflag <> 'R' AND l_discount > 0) AS c3
  FROM lineitem)
SELECT 0 AS step, 'all rows' AS step_name, c0 AS rows_left, CAST(0 AS BIGINT) AS rows_removed FROM c
UNION ALL SELECT 1, 'shipped after 1997-01-01', c1, c0 - c1 FROM c
UNION ALL SELECT 2, 'not returned', c2, c1 - c2 FROM c
UNION ALL SELECT 3, 'discounted', c3, c2 - c3 FROM c
""",
)
def funnel_accounting(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return R.funnel(
        li,
        [
            ("shipped after 1997-01-01", F.col("l_shipdate") > ts("1997-01-01")),
            ("not returned", F.col("l_returnflag") != "R"),
            ("discounted", F.col("l_discount") > 0),
        ],
    )


_CONTRA_A = "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 400000"
_CONTRA_B = "o_orderstatus = 'O' AND o_orderpriority = '5-LOW' AND o_totalprice < 20000"


@query(
    "contradiction_anti",
    f"""
WITH sus AS (SELECT o_orderkey FROM orders WHERE {_CONTRA_A}
             UNION ALL SELECT o_orderkey FROM orders WHERE {_CONTRA_B})
SELECT o_orderstatus, count(*) AS n_orders FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM sus) GROUP BY o_orderstatus
""",
)
def contradiction_anti(spark, sf_dir):
    o = tables(spark, sf_dir).orders
    a = o.where(_CONTRA_A).select("o_orderkey")
    b = o.where(_CONTRA_B).select("o_orderkey")
    sus = a.unionByName(b)
    kept = o.join(sus, "o_orderkey", "left_anti")
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"))


@query(
    "fill_missing",
    f"SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, coalesce(lang, 'NA') AS lang "
    f"FROM {DOCS_LABELS_SQL} j",
)
def fill_missing(spark, sf_dir):
    j = docs_labels(tables(spark, sf_dir))
    return R.fill_missing(j, {"quality": 0, "toxic": 0, "lang": "NA"}).select("doc_id", "quality", "toxic", "lang")


# ------------------------------------------------------------------ J
_STOPS_SQL = "(SELECT DISTINCT l_orderkey AS line, l_suppkey AS station FROM lineitem)"
_STATIONS_SQL = "(SELECT s_suppkey AS station, s_nationkey % 5 + 1 AS transfer_time FROM supplier)"


def stops_df(t):
    return t.lineitem.select(F.col("l_orderkey").alias("line"), F.col("l_suppkey").alias("station"))


def stations_df(t):
    return t.supplier.select(F.col("s_suppkey").alias("station"), (F.col("s_nationkey") % 5 + 1).alias("transfer_time"))


@query(
    "transfer_links",
    f"""
WITH s AS {_STOPS_SQL}, m AS (SELECT station FROM s GROUP BY station HAVING count(*) >= 2)
SELECT s.station, s.line, st.transfer_time FROM s JOIN m ON s.station = m.station
JOIN {_STATIONS_SQL} st ON s.station = st.station
""",
)
def transfer_links(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.transfer_links(stops_df(t), stations_df(t))


_SEQ_STOPS_SQL = (
    "(SELECT l_orderkey AS line, l_linenumber AS seq, min(l_suppkey) AS station FROM lineitem GROUP BY 1, 2)"
)


def seq_stops(t):
    """Stops by line and number, dealt by line: what is asked of the stops of a
    line needs no further shuffle."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("seq"), "l_suppkey")
    return rows.repartition("line").groupBy("line", "seq").agg(F.min("l_suppkey").alias("station"))


@query(
    "successor_join",
    f"SELECT a.line, a.seq AS from_seq, a.station AS from_station, b.station AS to_station "
    f"FROM {_SEQ_STOPS_SQL} a JOIN {_SEQ_STOPS_SQL} b ON a.line = b.line AND b.seq = a.seq + 1",
)
def successor_join(spark, sf_dir):
    return R.successor_join(seq_stops(tables(spark, sf_dir)))


_TRAVEL_SQL = (
    f"(SELECT c_nationkey AS station_1, s_nationkey AS station_2, CAST(floor(min(l_extendedprice)) AS BIGINT) "
    f"AS travel_time FROM {NATION_PAIRS_SQL} p WHERE c_nationkey < s_nationkey GROUP BY 1, 2)"
)


@query(
    "undirected_join",
    f"""
WITH seg AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM {NATION_PAIRS_SQL} p WHERE c_nationkey <> s_nationkey)
SELECT seg.a, seg.b, t.travel_time FROM seg JOIN {_TRAVEL_SQL} t
  ON (seg.a = t.station_1 AND seg.b = t.station_2) OR (seg.a = t.station_2 AND seg.b = t.station_1)
""",
)
def undirected_join(spark, sf_dir):
    p = nation_pairs(tables(spark, sf_dir))
    seg = p.where(F.col("c_nationkey") != F.col("s_nationkey")).select(
        F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")
    ).distinct()
    travel = (
        p.where(F.col("c_nationkey") < F.col("s_nationkey"))
        .groupBy(F.col("c_nationkey").alias("station_1"), F.col("s_nationkey").alias("station_2"))
        .agg(F.floor(F.min("l_extendedprice")).alias("travel_time"))
    )
    return R.undirected_join(seg, travel)


_POINTS_SQL = "(SELECT c_custkey, c_acctbal AS px, c_custkey % 1000 AS py FROM customer)"
_BOXES_SQL = (
    "(SELECT s_suppkey, s_acctbal - 50 AS x_lo, s_acctbal + 50 AS x_hi, "
    "s_suppkey * 10 - 50 AS y_lo, s_suppkey * 10 + 50 AS y_hi FROM supplier)"
)


def _points_boxes(t):
    pts = t.customer.select("c_custkey", F.col("c_acctbal").alias("px"), (F.col("c_custkey") % 1000).alias("py"))
    boxes = t.supplier.select(
        "s_suppkey",
        (F.col("s_acctbal") - 50).alias("x_lo"), (F.col("s_acctbal") + 50).alias("x_hi"),
        (F.col("s_suppkey") * 10 - 50).alias("y_lo"), (F.col("s_suppkey") * 10 + 50).alias("y_hi"),
    )
    return pts, boxes


@query(
    "box_range_join",
    f"SELECT b.s_suppkey, count(p.c_custkey) AS n_points, round(coalesce(sum(p.px), 0), 2) AS sum_acctbal "
    f"FROM {_BOXES_SQL} b LEFT JOIN {_POINTS_SQL} p ON p.px BETWEEN b.x_lo AND b.x_hi AND p.py BETWEEN b.y_lo AND b.y_hi "
    f"GROUP BY b.s_suppkey",
)
def box_range_join(spark, sf_dir):
    pts, boxes = _points_boxes(tables(spark, sf_dir))
    j = R.box_range_join(pts, boxes, "px", "py", "x_lo", "x_hi", "y_lo", "y_hi", cell=100.0)
    return j.groupBy("s_suppkey").agg(
        F.count("c_custkey").alias("n_points"),
        F.round(F.coalesce(F.sum("px"), F.lit(0.0)), 2).alias("sum_acctbal"),
    )


@query(
    "left_join_flag",
    TOP_SUPPLIERS_SQL.split("tot AS")[0].rstrip().rstrip(",")
    + " SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, "
    "CAST(CASE WHEN top.l_suppkey IS NULL THEN 0 ELSE 1 END AS INTEGER) AS is_top "
    "FROM lineitem l LEFT JOIN top ON l.l_suppkey = top.l_suppkey",
)
def left_join_flag(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    top = R.top_n_keys(li, "l_suppkey", 25)
    return R.membership_flag(li, top, "l_suppkey", "is_top", bound=25)


@query(
    "unmatched_anti",
    "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')",
)
def unmatched_anti(spark, sf_dir):
    """Customers without an urgent order (each has an order of some kind)."""
    t = tables(spark, sf_dir)
    c = t.customer.select("c_custkey", "c_name")
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT")
    return c.join(urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


_METRIC_SQL = f"""
SELECT n.n_nationkey, n.n_name, m.diff FROM nation n LEFT JOIN (
  SELECT country, round(max(CASE WHEN year = 2001 THEN v END) - max(CASE WHEN year = 1995 THEN v END), 2) AS diff
  FROM (SELECT country, year, sum(value) AS v FROM {NATION_MONTHLY_SQL} s GROUP BY 1, 2) y GROUP BY country
) m ON n.n_name = m.country
"""


@query("left_merge_metric", _METRIC_SQL)
def left_merge_metric(spark, sf_dir):
    t = tables(spark, sf_dir)
    yearly = nation_monthly(t).groupBy("country", "year").agg(F.sum("value").alias("v"))
    m = yearly.groupBy("country").agg(
        F.round(
            F.max(F.when(F.col("year") == 2001, F.col("v"))) - F.max(F.when(F.col("year") == 1995, F.col("v"))), 2
        ).alias("diff")
    )
    n = t.nation.select("n_nationkey", "n_name")
    return n.join(m, n.n_name == m.country, "left").select("n_nationkey", "n_name", "diff")


@query(
    "topn_flag",
    """
WITH top AS (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 25)
SELECT o.o_orderkey, CAST(CASE WHEN top.o_custkey IS NULL THEN 0 ELSE 1 END AS INTEGER) AS is_top_customer
FROM orders o LEFT JOIN top ON o.o_custkey = top.o_custkey
""",
)
def topn_flag(spark, sf_dir):
    o = tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey")
    top = R.top_n_keys(o, "o_custkey", 25)
    return R.membership_flag(o, top, "o_custkey", "is_top_customer", bound=25).select("o_orderkey", "is_top_customer")


_PRIORITY_CODES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "5-LOW": 5}


@query(
    "dict_map",
    "SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 "
    "WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 5 END AS priority_code, count(*) AS n_orders "
    "FROM orders GROUP BY 1, 2",
)
def dict_map(spark, sf_dir):
    o = tables(spark, sf_dir).orders
    return o.groupBy("o_orderpriority", X.map_lookup("o_orderpriority", _PRIORITY_CODES).alias("priority_code")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )


# map names derived from the nation table: region 0 exact, region 1 with "_"
# replaced by a space, region 2 lower case, regions 3-4 renamed ("Land of X").
# The two manual overrides.
_OVERRIDES = {"Land of NATION_3": "NATION_3", "Land of NATION_9": "NATION_9"}
_MAP_NAMES_SQL = """(SELECT CASE n_regionkey WHEN 0 THEN n_name WHEN 1 THEN replace(n_name, '_', ' ')
  WHEN 2 THEN lower(n_name) ELSE 'Land of ' || n_name END AS map_name FROM nation)"""


@query(
    "tiered_resolve",
    f"""
WITH m AS {_MAP_NAMES_SQL},
ov AS (SELECT * FROM (VALUES ('Land of NATION_3', 'NATION_3'), ('Land of NATION_9', 'NATION_9')) v(f, t))
SELECT m.map_name,
  coalesce(nm.n_nationkey, ne.n_nationkey, nn.n_nationkey) AS n_nationkey,
  CASE WHEN nm.n_nationkey IS NOT NULL THEN 'manual' WHEN ne.n_nationkey IS NOT NULL THEN 'exact'
       WHEN nn.n_nationkey IS NOT NULL THEN 'normalised' END AS tier
FROM m LEFT JOIN ov ON m.map_name = ov.f
LEFT JOIN nation nm ON ov.t = nm.n_name
LEFT JOIN nation ne ON m.map_name = ne.n_name
LEFT JOIN nation nn ON lower(replace(m.map_name, '_', ' ')) = lower(replace(nn.n_name, '_', ' '))
""",
)
def tiered_resolve(spark, sf_dir):
    n = tables(spark, sf_dir).nation
    names = n.select(
        F.when(F.col("n_regionkey") == 0, F.col("n_name"))
        .when(F.col("n_regionkey") == 1, F.replace("n_name", F.lit("_"), F.lit(" ")))
        .when(F.col("n_regionkey") == 2, F.lower("n_name"))
        .otherwise(F.concat(F.lit("Land of "), F.col("n_name")))
        .alias("map_name")
    )
    return R.tiered_resolve(names, n, "map_name", "n_name", "n_nationkey", _OVERRIDES)


@query(
    "tiered_misses",
    f"""
SELECT n_nationkey, n_name FROM nation n WHERE NOT EXISTS (
  SELECT 1 FROM {_MAP_NAMES_SQL} m
  LEFT JOIN (VALUES ('Land of NATION_3', 'NATION_3'), ('Land of NATION_9', 'NATION_9')) ov(f, t) ON m.map_name = ov.f
  WHERE ov.t = n.n_name OR m.map_name = n.n_name
     OR lower(replace(m.map_name, '_', ' ')) = lower(replace(n.n_name, '_', ' ')))
""",
)
def tiered_misses(spark, sf_dir):
    """Dimension rows that no map name resolves to (the other-way miss)."""
    res = tiered_resolve(spark, sf_dir).where(F.col("n_nationkey").isNotNull()).select("n_nationkey")
    n = tables(spark, sf_dir).nation.select("n_nationkey", "n_name")
    return n.join(res, "n_nationkey", "left_anti")


# ------------------------------------------------------------------ A
@query("value_counts", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1")
def value_counts(spark, sf_dir):
    return R.value_counts(tables(spark, sf_dir).lineitem, "l_returnflag")


@query(
    "value_share",
    "SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share "
    "FROM orders GROUP BY 1",
)
def value_share(spark, sf_dir):
    return R.value_share(tables(spark, sf_dir).orders, "o_orderpriority")


@query(
    "indicator_counts",
    " UNION ALL ".join(
        f"SELECT l_returnflag, '{k}' AS indicator, CAST(count(*) FILTER (WHERE {v}) AS BIGINT) AS n_on "
        f"FROM lineitem GROUP BY l_returnflag"
        for k, v in _FLAGS.items()
    ),
)
def indicator_counts(spark, sf_dir):
    return R.unpivot_counts(tables(spark, sf_dir).lineitem, ["l_returnflag"], _flag_cols())


@query(
    "crosstab",
    "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, "
    "count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY 1",
)
def crosstab(spark, sf_dir):
    return R.crosstab(tables(spark, sf_dir).lineitem, "l_returnflag", "l_linestatus", ["F", "O"])


@query(
    "range_per_key",
    f"SELECT country, min(year) AS min_year, max(year) AS max_year, "
    f"CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS n_null FROM {NATION_MONTHLY_SQL} s GROUP BY country",
)
def range_per_key(spark, sf_dir):
    s = nation_monthly(tables(spark, sf_dir))
    return s.groupBy("country").agg(
        F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.count_if(F.col("value").isNull()).alias("n_null")
    )


@query("coverage_distinct", f"SELECT DISTINCT country, year FROM {NATION_MONTHLY_SQL} s WHERE value IS NOT NULL")
def coverage_distinct(spark, sf_dir):
    return nation_monthly(tables(spark, sf_dir)).where(F.col("value").isNotNull()).select("country", "year").distinct()


@query(
    "coverage_by_year",
    f"""
WITH s AS (SELECT * FROM {NATION_MONTHLY_SQL} x WHERE value IS NOT NULL),
r AS (SELECT CAST(unnest(range(min(year), max(year) + 1)) AS INTEGER) AS year FROM s),
c AS (SELECT year, count(DISTINCT country) AS n_keys FROM s GROUP BY year)
SELECT r.year, coalesce(c.n_keys, 0) AS n_keys FROM r LEFT JOIN c ON r.year = c.year
""",
)
def coverage_by_year(spark, sf_dir):
    s = nation_monthly(tables(spark, sf_dir)).where(F.col("value").isNotNull())
    return R.coverage_with_gaps(s, "year", "country")


@query(
    "histogram_fixed",
    "SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1",
)
def histogram_fixed(spark, sf_dir):
    return R.fixed_histogram(tables(spark, sf_dir).orders, "o_totalprice", 50000)


@query(
    "two_date_pivot",
    f"""
SELECT country, v1995_01, v2001_05, round(v2001_05 - v1995_01, 2) AS diff FROM (
  SELECT country, max(CASE WHEN year = 1995 AND month = 1 THEN value END) AS v1995_01,
         max(CASE WHEN year = 2001 AND month = 5 THEN value END) AS v2001_05
  FROM {NATION_MONTHLY_SQL} s GROUP BY country)
""",
)
def two_date_pivot(spark, sf_dir):
    s = nation_monthly(tables(spark, sf_dir))
    y, m = F.col("year"), F.col("month")
    p = s.groupBy("country").agg(
        F.max(F.when((y == 1995) & (m == 1), F.col("value"))).alias("v1995_01"),
        F.max(F.when((y == 2001) & (m == 5), F.col("value"))).alias("v2001_05"),
    )
    return p.withColumn("diff", F.round(X.guarded_diff("v2001_05", "v1995_01"), 2))


@query(
    "row_sum",
    f"SELECT doc_id, coalesce(quality, 0) + coalesce(toxic, 0) AS row_sum, quality + toxic AS row_sum_strict "
    f"FROM {DOCS_LABELS_SQL} j",
)
def row_sum(spark, sf_dir):
    j = docs_labels(tables(spark, sf_dir))
    return j.select(
        "doc_id",
        X.row_sum(["quality", "toxic"], skip_null=True).alias("row_sum"),
        X.row_sum(["quality", "toxic"], skip_null=False).alias("row_sum_strict"),
    )


_DESC_COLS = ["l_quantity", "l_discount", "l_tax"]


@query(
    "describe_cols",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, "
        f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
        f"round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM lineitem"
        for c in _DESC_COLS
    ),
)
def describe_cols(spark, sf_dir):
    return R.describe(tables(spark, sf_dir).lineitem, _DESC_COLS, exact=True)


@query(
    "metric_means",
    "SELECT round(avg(l_discount), 6) AS mean_f1, round(avg(l_tax), 6) AS mean_rouge, "
    "round(avg(l_quantity / 50), 6) AS mean_bleu FROM lineitem",
)
def metric_means(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return li.agg(
        F.round(F.avg("l_discount"), 6).alias("mean_f1"),
        F.round(F.avg("l_tax"), 6).alias("mean_rouge"),
        F.round(F.avg(F.col("l_quantity") / 50), 6).alias("mean_bleu"),
    )


# ------------------------------------------------------------------ W
@query(
    "argmin_per_group",
    """
SELECT l_partkey, l_extendedprice AS best_price, l_suppkey AS best_suppkey FROM (
  SELECT l_partkey, l_extendedprice, l_suppkey,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_suppkey) AS rn FROM lineitem)
WHERE rn = 1
""",
)
def argmin_per_group(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    out = R.argmin_per_group(li, "l_partkey", ["l_extendedprice", "l_suppkey"], ["l_extendedprice", "l_suppkey"])
    return out.select("l_partkey", F.col("l_extendedprice").alias("best_price"), F.col("l_suppkey").alias("best_suppkey"))


@query(
    "share_per_row",
    "SELECT o_orderkey, o_orderpriority, round(count(*) OVER (PARTITION BY o_orderpriority) / "
    "(SELECT count(*) FROM orders), 6) AS share FROM orders",
)
def share_per_row(spark, sf_dir):
    o = tables(spark, sf_dir).orders.select("o_orderkey", "o_orderpriority")
    return R.share_per_row(o, "o_orderpriority")


@query(
    "topn_keys",
    "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 25",
)
def topn_keys(spark, sf_dir):
    return R.top_n_keys(tables(spark, sf_dir).lineitem, "l_suppkey", 25)


@query("order_limit", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30")
def order_limit(spark, sf_dir):
    c = tables(spark, sf_dir).customer
    return c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(30).select("c_custkey", "c_acctbal")


@query(
    "order_limit_per_group",
    """
SELECT c_nationkey, c_custkey, c_acctbal, CAST(rank AS INTEGER) AS rank FROM (
  SELECT c_nationkey, c_custkey, c_acctbal,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer)
WHERE rank <= 3
""",
)
def order_limit_per_group(spark, sf_dir):
    c = tables(spark, sf_dir).customer.select("c_nationkey", "c_custkey", "c_acctbal")
    return R.top_k_per_group(c, "c_nationkey", [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@query(
    "multi_sort",
    "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 ORDER BY 1, 2, 3",
)
def multi_sort(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return (
        li.groupBy("l_returnflag", "l_linestatus", "l_linenumber")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("l_returnflag", "l_linestatus", "l_linenumber")
    )


@query(
    "lead_shift",
    f"SELECT country, year, month, value, lead(value) OVER (PARTITION BY country ORDER BY year, month) AS next_value "
    f"FROM {NATION_MONTHLY_SQL} s",
)
def lead_shift(spark, sf_dir):
    from pyspark.sql import Window

    s = nation_monthly(tables(spark, sf_dir)).select("country", "year", "month", "value")
    w = Window.partitionBy("country").orderBy("year", "month")
    return s.withColumn("next_value", F.lead("value").over(w))


@query(
    "seq_id",
    "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq "
    "FROM conversations",
)
def seq_id(spark, sf_dir):
    from pyspark.sql import Window

    c = tables(spark, sf_dir).conversations.select("conv_id", "turn")
    return c.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)


@query(
    "split_by_rank",
    """
SELECT item_id, rn, CASE WHEN rn <= 10 THEN 'dev' WHEN rn <= 40 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS rn FROM benchmark)
""",
)
def split_by_rank(spark, sf_dir):
    b = tables(spark, sf_dir).benchmark.select("item_id")
    return R.split_by_rank(b, ["item_id"], {"dev": 10, "validation": 30, "test": 0})


@query(
    "midranks",
    "SELECT l_quantity, n, (sum(n) OVER (ORDER BY l_quantity) - (n - 1) / 2.0)::DOUBLE AS midrank "
    "FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1)",
)
def midranks_q(spark, sf_dir):
    return R.value_midranks(tables(spark, sf_dir).lineitem, "l_quantity")


# ------------------------------------------------------------------ U
@query(
    "union_all",
    "SELECT c_custkey AS party_key, c_name AS party_name, c_nationkey AS nationkey, c_acctbal AS acctbal, "
    "'customer' AS kind FROM customer UNION ALL "
    "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 'supplier' FROM supplier",
)
def union_all(spark, sf_dir):
    t = tables(spark, sf_dir)
    c = t.customer.select(
        F.col("c_custkey").alias("party_key"), F.col("c_name").alias("party_name"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"), F.lit("customer").alias("kind"),
    )
    s = t.supplier.select(
        F.col("s_suppkey").alias("party_key"), F.col("s_name").alias("party_name"),
        F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"), F.lit("supplier").alias("kind"),
    )
    return c.unionByName(s)


def _customers_in_year(t, year):
    o = t.orders.where((F.col("o_orderdate") >= ts(f"{year}-01-01")) & (F.col("o_orderdate") < ts(f"{year + 1}-01-01")))
    return o.select("o_custkey")


@query(
    "union_distinct",
    "SELECT DISTINCT c.c_name FROM customer c JOIN ("
    "SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995 UNION ALL "
    "SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996) o ON c.c_custkey = o.o_custkey",
)
def union_distinct(spark, sf_dir):
    t = tables(spark, sf_dir)
    both = _customers_in_year(t, 1995).unionByName(_customers_in_year(t, 1996))
    c = t.customer.select("c_custkey", "c_name")
    return both.join(c, both.o_custkey == c.c_custkey).select("c_name").distinct()


@query(
    "set_difference",
    "SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1995 AND o_custkey NOT IN "
    "(SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996)",
)
def set_difference(spark, sf_dir):
    t = tables(spark, sf_dir)
    return _customers_in_year(t, 1995).distinct().join(_customers_in_year(t, 1996), "o_custkey", "left_anti")


# ------------------------------------------------------------------ X
@query(
    "regex_any",
    "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)(ring|rod|plate)')",
)
def regex_any(spark, sf_dir):
    p = tables(spark, sf_dir).part
    return p.where(X.contains_any("p_name", ["ring", "rod", "plate"])).select("p_partkey", "p_name")


_FOLD = {"1-URGENT": "HIGH", "2-HIGH": "HIGH", "4-NOT SPECIFIED": "LOW", "5-LOW": "LOW"}


@query(
    "recode_fold",
    "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' "
    "WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'LOW' ELSE o_orderpriority END AS priority_class, "
    "CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS status_class, count(*) AS n "
    "FROM orders GROUP BY 1, 2",
)
def recode_fold(spark, sf_dir):
    o = tables(spark, sf_dir).orders
    return o.groupBy(
        X.recode("o_orderpriority", _FOLD).alias("priority_class"),
        X.recode("o_orderstatus", {"P": "O"}).alias("status_class"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "clip",
    "SELECT CASE WHEN l_quantity IS NULL THEN NULL ELSE least(greatest(l_quantity, 5), 40) END AS qty_clipped, "
    "count(*) AS n FROM lineitem GROUP BY 1",
)
def clip_q(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return li.groupBy(X.clip("l_quantity", 5, 40).alias("qty_clipped")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "binarize",
    "SELECT CAST(l_discount > 0.05 AS INTEGER) AS disc_flag, CAST(l_tax <> 0 AS INTEGER) AS tax_flag, count(*) AS n "
    "FROM lineitem GROUP BY 1, 2",
)
def binarize(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return li.groupBy(
        X.binarize(F.col("l_discount") > 0.05).alias("disc_flag"), X.binarize(F.col("l_tax") != 0).alias("tax_flag")
    ).agg(F.count(F.lit(1)).alias("n"))


_BINS = ([1, 2, 11, 26, float("inf")], ["single", "small", "medium", "large"])


@query(
    "cut_bins",
    "SELECT CASE WHEN l_quantity >= 1 AND l_quantity < 2 THEN 'single' WHEN l_quantity >= 2 AND l_quantity < 11 "
    "THEN 'small' WHEN l_quantity >= 11 AND l_quantity < 26 THEN 'medium' WHEN l_quantity >= 26 THEN 'large' END "
    "AS qty_bin, count(*) AS n FROM lineitem GROUP BY 1",
)
def cut_bins(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return li.groupBy(X.cut("l_quantity", *_BINS).alias("qty_bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "multiple_of",
    "SELECT l_quantity % 12 = 0 AND l_quantity BETWEEN 12 AND 108 AS is_multiple, count(*) AS n FROM lineitem GROUP BY 1",
)
def multiple_of(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return li.groupBy(X.multiple_of("l_quantity", 12, 12, 108).alias("is_multiple")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "any_col_equals",
    f"SELECT l_returnflag, list_contains([c_nationkey, s_nationkey], 7) AS touches_7, count(*) AS n "
    f"FROM {NATION_PAIRS_SQL} p GROUP BY 1, 2",
)
def any_col_equals(spark, sf_dir):
    p = nation_pairs(tables(spark, sf_dir))
    return p.groupBy("l_returnflag", X.any_equals(["c_nationkey", "s_nationkey"], 7).alias("touches_7")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "all_cols_in",
    f"SELECT l_returnflag, (c_nationkey IN (0, 1, 2, 3) OR c_nationkey = 0) AND (s_nationkey IN (0, 1, 2, 3) "
    f"OR s_nationkey = 0) AS all_generic, count(*) AS n FROM {NATION_PAIRS_SQL} p GROUP BY 1, 2",
)
def all_cols_in(spark, sf_dir):
    p = nation_pairs(tables(spark, sf_dir))
    return p.groupBy("l_returnflag", X.all_in(["c_nationkey", "s_nationkey"], [0, 1, 2, 3]).alias("all_generic")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "string_norm",
    "SELECT s_suppkey, 'sup-' || regexp_replace(lower(trim(s_name)), '#0+', '#', 'g') AS norm_name FROM supplier",
)
def string_norm(spark, sf_dir):
    s = tables(spark, sf_dir).supplier
    return s.select("s_suppkey", F.concat(F.lit("sup-"), F.regexp_replace(X.normalise_name("s_name"), "#0+", "#"))
                    .alias("norm_name"))


@query(
    "narrow_integral",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity, "
    "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem",
)
def narrow_integral(spark, sf_dir):
    return R.narrow_integral(tables(spark, sf_dir).lineitem)


@query(
    "unit_convert",
    "SELECT l_returnflag, round(sum(floor(l_extendedprice) / 60.0), 4) AS minutes, "
    "round(sum(l_quantity * 1609.34), 4) AS meters FROM lineitem GROUP BY 1",
)
def unit_convert(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return li.groupBy("l_returnflag").agg(
        F.round(F.sum(X.seconds_to_minutes("l_extendedprice")), 4).alias("minutes"),
        F.round(F.sum(X.miles_to_meters("l_quantity")), 4).alias("meters"),
    )


@query(
    "log_transform",
    "SELECT l_returnflag, round(avg(ln(l_extendedprice)), 6) AS mean_ln_price, round(avg(exp(l_discount)), 6) "
    "AS mean_exp_disc, round(avg(pow(l_quantity, 0.5)), 6) AS mean_sqrt_qty FROM lineitem GROUP BY 1",
)
def log_transform(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return li.groupBy("l_returnflag").agg(
        F.round(F.avg(F.ln("l_extendedprice")), 6).alias("mean_ln_price"),
        F.round(F.avg(F.exp("l_discount")), 6).alias("mean_exp_disc"),
        F.round(F.avg(F.pow("l_quantity", 0.5)), 6).alias("mean_sqrt_qty"),
    )


@query(
    "elasticity",
    "SELECT round(b, 6) AS slope, round(pow(1.1, b) - 1, 6) AS pct_for_10pct, round(exp(b) - 1, 6) AS pct_per_unit "
    "FROM (SELECT regr_slope(ln(l_extendedprice), ln(l_quantity)) AS b FROM lineitem)",
)
def elasticity(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    b = li.agg(F.regr_slope(F.ln("l_extendedprice"), F.ln("l_quantity")).alias("b"))
    return b.select(
        F.round("b", 6).alias("slope"),
        F.round(X.elasticity_pct("b", 0.10), 6).alias("pct_for_10pct"),
        F.round(X.semi_elasticity_pct("b"), 6).alias("pct_per_unit"),
    )


@query(
    "array_map",
    "SELECT l.l_orderkey, list(p.p_name ORDER BY l.l_linenumber, p.p_name) AS part_names "
    "FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1",
)
def array_map(spark, sf_dir):
    t = tables(spark, sf_dir)
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    p = t.part.select("p_partkey", "p_name")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.groupBy("l_orderkey").agg(X.ordered_list(F.struct("l_linenumber", "p_name"), "p_name").alias("part_names"))


@query(
    "array_fold",
    "SELECT l_orderkey, list_reduce(list(l_quantity), lambda a, x: a + x) AS total_qty, count(*) AS n_lines "
    "FROM lineitem GROUP BY 1",
)
def array_fold(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    g = li.groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("qs"), F.count(F.lit(1)).alias("n_lines"))
    return g.select("l_orderkey", X.array_total("qs").alias("total_qty"), "n_lines")


@query("geo_box")
def geo_box(spark, sf_dir):
    """WGS-84 search box (5 miles each way) around a point per customer; the
    point is derived from the account balance (latitude) and nation
    (longitude)."""
    c = tables(spark, sf_dir).customer
    lat = (F.col("c_acctbal") + 1000.0) / 11000.0 * 170.0 - 85.0
    lon = F.col("c_nationkey") * 14.4 - 180.0
    pts = c.select("c_custkey", lat.alias("lat"), lon.alias("lon"))
    box = X.geo_box("lat", "lon", 5.0)
    return pts.select("c_custkey", "lat", "lon", *[v.alias(k) for k, v in box.items()])
