"""Graph queries (G*, J12-J14, W12, A15) on graphs derived from the tables.

* Nation graph: vertex = nation; edge c -> s when customers of nation c buy
  from suppliers of nation s, weight = floor(min line price) of that pair; all
  pairs.  Hubs = the three nations with most customers.
* Neighbour graph: of each nation the edges to its five cheapest partners (the
  usual sparse graph of nearest neighbours), for what looks at hops or
  communities and would say nothing on a complete graph.
* Transit graph (G3): line = order, station = supplier, stop sequence =
  line number, as the layered depart/arrive/line-station graph of all lines.
  Transit hubs = the three stations with most lines.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import relational as R
from tessera.plans.common import NATION_PAIRS_SQL, nation_pairs, tables
from tessera.plans.registry import query
from tessera.plans.tabular import _points_boxes, seq_stops, stations_df

# ------------------------------------------------------------------ derived graphs
_PAIRS_W_SQL = (
    f"(SELECT c_nationkey AS src, s_nationkey AS dst, CAST(floor(min(l_extendedprice)) AS BIGINT) AS weight "
    f"FROM {NATION_PAIRS_SQL} p WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"
)
EDGES_SQL = _PAIRS_W_SQL
NEAR = 5
NEAR_SQL = (f"(SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight, dst) AS nth "
            f"FROM {_PAIRS_W_SQL} w) WHERE nth <= {NEAR})")
HUBS_SQL = "(SELECT c_nationkey AS id FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)"
_SP_SQL = f"""
WITH RECURSIVE e AS {EDGES_SQL}, hubs AS {HUBS_SQL},
sp(source, node, cost) USING KEY (source, node) AS (
  SELECT id, id, CAST(0 AS DOUBLE) FROM hubs
  UNION
  (SELECT c.source, c.node, c.cost FROM (
     SELECT s.source, e.dst AS node, min(s.cost + e.weight) AS cost
     FROM sp s JOIN e ON s.node = e.src GROUP BY ALL) c
   LEFT JOIN recurring.sp r ON r.source = c.source AND r.node = c.node
   WHERE r.cost IS NULL OR c.cost < r.cost))
"""


def nation_edges(t):
    p = nation_pairs(t).where(F.col("c_nationkey") != F.col("s_nationkey"))
    return p.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(
        F.floor(F.min("l_extendedprice")).alias("weight"))


def near_edges(t):
    return R.top_k_per_group(nation_edges(t), "src", [F.asc("weight"), F.asc("dst")], NEAR).select("src", "dst", "weight")


def nation_vertices(t):
    return t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
                           F.col("n_regionkey").alias("region"))


def hubs(t):
    return R.top_n_keys(t.customer.select(F.col("c_nationkey").alias("id")), "id", 3).select("id")


def _sp(spark, sf_dir):
    t = tables(spark, sf_dir)
    return G.shortest_paths(nation_edges(t), hubs(t))


# ------------------------------------------------------------------ building
@query(
    "graph_vertices",
    "SELECT b.s_suppkey AS id, s.s_name AS name, count(p.c_custkey) AS population "
    "FROM (SELECT s_suppkey, s_acctbal - 50 AS x_lo, s_acctbal + 50 AS x_hi, s_suppkey * 10 - 50 AS y_lo, "
    "s_suppkey * 10 + 50 AS y_hi FROM supplier) b JOIN supplier s ON b.s_suppkey = s.s_suppkey "
    "LEFT JOIN (SELECT c_custkey, c_acctbal AS px, c_custkey % 1000 AS py FROM customer) p "
    "ON p.px BETWEEN b.x_lo AND b.x_hi AND p.py BETWEEN b.y_lo AND b.y_hi GROUP BY 1, 2",
)
def graph_vertices(spark, sf_dir):
    """One vertex per supplier, population = customers inside its box (one
    range join instead of a query per vertex)."""
    t = tables(spark, sf_dir)
    pts, boxes = _points_boxes(t)
    j = R.box_range_join(pts, boxes, "px", "py", "x_lo", "x_hi", "y_lo", "y_hi", cell=100.0)
    pop = j.groupBy("s_suppkey").agg(F.count("c_custkey").alias("population"))
    return pop.join(t.supplier.select("s_suppkey", "s_name"), "s_suppkey").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "population")


@query(
    "graph_edges",
    f"SELECT src, dst, min(weight) AS weight FROM (SELECT src, dst, weight FROM {EDGES_SQL} a "
    f"UNION ALL SELECT dst, src, weight FROM {EDGES_SQL} b) GROUP BY 1, 2",
)
def graph_edges(spark, sf_dir):
    return G.two_way(nation_edges(tables(spark, sf_dir)))


@query(
    "graph_counts",
    f"SELECT (SELECT count(*) FROM nation) AS n_vertices, (SELECT count(*) FROM {EDGES_SQL} e) AS n_edges",
)
def graph_counts(spark, sf_dir):
    t = tables(spark, sf_dir)
    nv = nation_vertices(t).select(F.count(F.lit(1))).scalar()
    ne = nation_edges(t).select(F.count(F.lit(1))).scalar()
    return spark.range(1).select(nv.alias("n_vertices"), ne.alias("n_edges"))


@query(
    "graph_listing",
    f"SELECT a.n_name AS src_name, b.n_name AS dst_name, e.weight, 'LINK' AS rel_type FROM {EDGES_SQL} e "
    f"JOIN nation a ON e.src = a.n_nationkey JOIN nation b ON e.dst = b.n_nationkey",
)
def graph_listing(spark, sf_dir):
    t = tables(spark, sf_dir)
    v = nation_vertices(t)
    e = nation_edges(t)
    a = v.select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    b = v.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    return e.join(a, "src").join(b, "dst").select("src_name", "dst_name", "weight", F.lit("LINK").alias("rel_type"))


@query(
    "edges_resolve",
    f"SELECT a.n_nationkey AS src, b.n_nationkey AS dst, e.weight FROM "
    f"(SELECT x.n_name AS src_name, CASE WHEN y.n_regionkey = 4 THEN 'unknown ' || y.n_name ELSE y.n_name END "
    f"AS dst_name, e.weight FROM {EDGES_SQL} e JOIN nation x ON e.src = x.n_nationkey "
    f"JOIN nation y ON e.dst = y.n_nationkey) e "
    f"JOIN nation a ON e.src_name = a.n_name JOIN nation b ON e.dst_name = b.n_name",
)
def edges_resolve(spark, sf_dir):
    """Edges given by vertex names (some names unknown) resolved to ids;
    edges with an unknown endpoint are dropped."""
    t = tables(spark, sf_dir)
    v = nation_vertices(t)
    e = nation_edges(t)
    a = v.select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    b = v.select(F.col("id").alias("dst"), F.col("name").alias("dst_name0"), "region")
    named = e.join(a, "src").join(b, "dst").select(
        "src_name",
        F.when(F.col("region") == 4, F.concat(F.lit("unknown "), F.col("dst_name0"))).otherwise(F.col("dst_name0"))
        .alias("dst_name"), "weight")
    return G.resolve_edges(named, v).select("src", "dst", "weight")


_LAYERED_SQL = """
WITH seq AS (SELECT l_orderkey AS line, l_linenumber AS seq, min(l_suppkey) AS station FROM lineitem GROUP BY 1, 2),
stops AS (SELECT DISTINCT line, station FROM seq),
st AS (SELECT s_suppkey AS station, s_nationkey % 5 + 1 AS transfer_time, s_nationkey FROM supplier),
multi AS (SELECT station FROM stops GROUP BY station HAVING count(*) >= 2),
seg AS (SELECT a.line, a.station AS s1, b.station AS s2 FROM seq a JOIN seq b
        ON a.line = b.line AND b.seq = a.seq + 1 WHERE a.station <> b.station),
tt AS (SELECT DISTINCT least(s1, s2) AS station_1, greatest(s1, s2) AS station_2 FROM seg),
travel AS (SELECT tt.station_1, tt.station_2, CAST(abs(x.s_nationkey - y.s_nationkey) + 1 AS BIGINT) AS travel_time
           FROM tt JOIN st x ON tt.station_1 = x.station JOIN st y ON tt.station_2 = y.station),
segw AS (SELECT seg.line, seg.s1, seg.s2, travel.travel_time FROM seg JOIN travel
         ON (seg.s1 = travel.station_1 AND seg.s2 = travel.station_2)
         OR (seg.s1 = travel.station_2 AND seg.s2 = travel.station_1))
SELECT 'depart ' || station AS src, line || ' ' || station AS dst, CAST(0 AS BIGINT) AS weight FROM stops
UNION ALL SELECT line || ' ' || station, 'arrive ' || station, CAST(0 AS BIGINT) FROM stops
UNION ALL SELECT s.line || ' ' || s.station, 'transfer ' || s.station, CAST(st.transfer_time AS BIGINT)
  FROM stops s JOIN multi m ON s.station = m.station JOIN st ON s.station = st.station
UNION ALL SELECT 'transfer ' || s.station, s.line || ' ' || s.station, CAST(0 AS BIGINT)
  FROM stops s JOIN multi m ON s.station = m.station
UNION ALL SELECT line || ' ' || s1, line || ' ' || s2, travel_time FROM segw
UNION ALL SELECT line || ' ' || s2, line || ' ' || s1, travel_time FROM segw
"""


def layered_edges(t):
    """Layered transit graph over the whole lineitem table; travel time of a
    station pair = |nation difference| + 1."""
    seq = seq_stops(t)
    nat = t.supplier.select(F.col("s_suppkey").alias("station"), "s_nationkey")
    seg = R.successor_join(seq).where(F.col("from_station") != F.col("to_station"))
    tt = seg.select(F.least("from_station", "to_station").alias("station_1"),
                    F.greatest("from_station", "to_station").alias("station_2")).distinct()
    x = nat.select(F.col("station").alias("station_1"), F.col("s_nationkey").alias("n1"))
    y = nat.select(F.col("station").alias("station_2"), F.col("s_nationkey").alias("n2"))
    travel = tt.join(x, "station_1").join(y, "station_2").select(
        "station_1", "station_2", (F.abs(F.col("n1") - F.col("n2")) + 1).cast("long").alias("travel_time"))
    return G.transit_edges(seq, stations_df(t), travel)


@query("layered_graph", _LAYERED_SQL)
def layered_graph(spark, sf_dir):
    return layered_edges(tables(spark, sf_dir))


# ------------------------------------------------------------------ paths
@query("shortest_paths", _SP_SQL + "SELECT source, node, cost FROM sp")
def shortest_paths(spark, sf_dir):
    """Weighted shortest-path cost from each hub to every reachable nation."""
    return _sp(spark, sf_dir).select("source", "node", "cost")


@query("shortest_path_routes")
def shortest_path_routes(spark, sf_dir):
    """Hub -> nation routes: node list and cumulative costs along the path."""
    return G.paths_to(_sp(spark, sf_dir))


@query("path_attr_sum")
def path_attr_sum(spark, sf_dir):
    """Sum of a vertex attribute (customers per nation) along each hub route."""
    t = tables(spark, sf_dir)
    pop = t.customer.groupBy(F.col("c_nationkey").alias("node")).agg(F.count(F.lit(1)).alias("value"))
    return G.path_sums(_sp(spark, sf_dir), pop).withColumnRenamed("path_sum", "path_population")


_THRESHOLDS = [1000, 1200, 1500, 2000]


@query(
    "reachable_within",
    _SP_SQL
    + "SELECT sp.source, v.threshold, CAST(count(*) FILTER (WHERE sp.cost <= v.threshold AND sp.node <> sp.source) "
    "AS BIGINT) AS n_reachable FROM sp CROSS JOIN (VALUES (1000), (1200), (1500), (2000)) v(threshold) GROUP BY 1, 2",
)
def reachable_within(spark, sf_dir):
    sp = _sp(spark, sf_dir).where(F.col("node") != F.col("source"))
    one = sp.groupBy("source").agg(*[F.count_if(F.col("cost") <= t).alias(f"t{t}") for t in _THRESHOLDS])
    return one.select("source", F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"),
                                                             F.col(f"t{t}").alias("n_reachable"))
                                                    for t in _THRESHOLDS])))


@query(
    "reachable_distinct",
    _SP_SQL + "SELECT node, min(cost) AS cost FROM sp WHERE cost <= 1200 AND node <> source GROUP BY node",
)
def reachable_distinct(spark, sf_dir):
    sp = _sp(spark, sf_dir).where((F.col("cost") <= 1200) & (F.col("node") != F.col("source")))
    return sp.groupBy("node").agg(F.min("cost").alias("cost"))


@query(
    "nearest_hub",
    _SP_SQL
    + "SELECT node, source AS hub, cost, cost <= 1200 AS within_threshold FROM (SELECT *, row_number() OVER "
    "(PARTITION BY node ORDER BY cost, source) AS rn FROM sp) WHERE rn = 1",
)
def nearest_hub(spark, sf_dir):
    sp = _sp(spark, sf_dir)
    best = R.argmin_per_group(sp, "node", ["cost", "source"], ["cost", "source"])
    return best.select("node", F.col("source").alias("hub"), "cost", (F.col("cost") <= 1200).alias("within_threshold"))


@query("cross_excl_self", _SP_SQL + "SELECT source, node AS target, cost FROM sp WHERE node IN (SELECT id FROM hubs) "
                                    "AND node <> source")
def cross_excl_self(spark, sf_dir):
    """Hub-to-hub costs for every ordered pair of distinct hubs, from the one
    multi-source run (no cross product of hub lists)."""
    t = tables(spark, sf_dir)
    sp = _sp(spark, sf_dir)
    h = hubs(t).select(F.col("id").alias("node"))
    return sp.join(R.bounded_broadcast(h, 1000), "node").where(F.col("node") != F.col("source")).select(
        "source", F.col("node").alias("target"), "cost")


# ------------------------------------------------------------------ paths on the transit graph
_TRANSIT_SQL = f"""
WITH RECURSIVE g AS MATERIALIZED ({{layered}}),
start AS (SELECT 'depart ' || station AS id FROM (
  SELECT station, count(DISTINCT line) AS n FROM (SELECT l_orderkey AS line, l_linenumber AS seq, min(l_suppkey) AS station
    FROM lineitem GROUP BY 1, 2) GROUP BY 1 ORDER BY n DESC, station LIMIT 3)),
sp(source, node, cost, hops, pred) USING KEY (source, node) AS (
  SELECT id, id, CAST(0 AS DOUBLE), 0, CAST(NULL AS VARCHAR) FROM start
  UNION
  (SELECT c.source, c.node, c.b.cost, c.b.hops, c.b.pred FROM (
     SELECT s.source, g.dst AS node,
            min(struct_pack(cost := s.cost + g.weight, hops := s.hops + 1, pred := s.node)) AS b
     FROM sp s JOIN g ON s.node = g.src GROUP BY ALL) c
   LEFT JOIN recurring.sp r ON r.source = c.source AND r.node = c.node
   WHERE r.cost IS NULL OR c.b < struct_pack(cost := r.cost, hops := r.hops, pred := r.pred)))
""".format(layered=_LAYERED_SQL)


def _transit(spark, sf_dir):
    """Distances from the departures of the three busiest stations to every
    node of the layered graph."""
    t = tables(spark, sf_dir)
    lines = seq_stops(t).select("line", "station").distinct()
    busiest = R.top_n_keys(lines.select("station"), "station", 3).select(
        F.concat(F.lit("depart "), F.col("station").cast("string")).alias("id"))
    doors = [F.lit(f"{kind} ") for kind in ("depart", "arrive", "transfer")]

    def by_line(node):
        """The nodes of a line together, those of a station anywhere."""
        of_station = functools.reduce(operator.or_, [F.startswith(node, d) for d in doors])
        return F.when(of_station, node).otherwise(F.substring_index(node, " ", 1))

    return G.shortest_paths(layered_edges(t), busiest, place=by_line)


def _arrivals(dist):
    return dist.where(F.col("node").startswith("arrive ")).select(F.col("node").alias("id")).distinct()


@query("transit_paths", _TRANSIT_SQL + "SELECT source, node, cost, hops, pred FROM sp")
def transit_paths(spark, sf_dir):
    """Cheapest way, its changes and the stop before, to every node of the
    layered graph over all lines."""
    return _transit(spark, sf_dir)


@query("transit_routes", _TRANSIT_SQL + """, walk(source, target, cur, nodes) AS (
  SELECT source, node, pred, [node] FROM sp WHERE node LIKE 'arrive %'
  UNION ALL SELECT w.source, w.target, s.pred, list_prepend(w.cur, w.nodes) FROM walk w
    JOIN sp s ON s.source = w.source AND s.node = w.cur)
SELECT w.source, w.target, s.cost AS total, w.nodes FROM walk w JOIN sp s ON s.source = w.source AND s.node = w.target
WHERE w.cur IS NULL""")
def transit_routes(spark, sf_dir):
    """Station-to-station routes: every node on the way to each arrival."""
    dist = _transit(spark, sf_dir)
    return G.paths_to(dist, _arrivals(dist)).select("source", "target", "total", "nodes")


@query("transit_path_sum", _TRANSIT_SQL + """, walk(source, target, cur, n) AS (
  SELECT source, node, pred, CAST(0 AS BIGINT) FROM sp WHERE node LIKE 'arrive %'
  UNION ALL SELECT w.source, w.target, s.pred, w.n + CASE WHEN w.cur LIKE 'transfer %' THEN 1 ELSE 0 END FROM walk w
    JOIN sp s ON s.source = w.source AND s.node = w.cur)
SELECT source, target, n AS n_transfers FROM walk WHERE cur IS NULL""")
def transit_path_sum(spark, sf_dir):
    """Transfers on the way to each arrival: an attribute of the nodes summed
    along the chosen paths."""
    dist = _transit(spark, sf_dir)
    hubs_ = dist.select("node").distinct().select("node", F.col("node").startswith("transfer ").cast("long").alias("value"))
    return G.path_sums(dist, hubs_, _arrivals(dist)).select("source", "target", F.col("path_sum").alias("n_transfers"))


_MINUTES = [5, 10, 15, 20]


@query(
    "transit_reachable",
    _TRANSIT_SQL + "SELECT sp.source, v.minutes, count(*) FILTER (WHERE sp.cost <= v.minutes) AS n_stations FROM sp CROSS JOIN (VALUES "
    + ", ".join(f"({m})" for m in _MINUTES) + ") v(minutes) WHERE sp.node LIKE 'arrive %' GROUP BY 1, 2",
)
def transit_reachable(spark, sf_dir):
    """Stations within so many minutes of each hub."""
    sp = _transit(spark, sf_dir).where(F.col("node").startswith("arrive "))
    one = sp.groupBy("source").agg(*[F.count_if(F.col("cost") <= x).alias(f"m{x}") for x in _MINUTES])
    return one.select("source", F.inline(F.array(*[F.struct(F.lit(x).alias("minutes"), F.col(f"m{x}").alias("n_stations")) for x in _MINUTES])))


@query(
    "transit_nearest_hub",
    _TRANSIT_SQL + "SELECT node, source AS hub, cost FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, source) AS rn "
    "FROM sp WHERE node LIKE 'arrive %') WHERE rn = 1",
)
def transit_nearest_hub(spark, sf_dir):
    """The hub from which each station is reached soonest."""
    sp = _transit(spark, sf_dir).where(F.col("node").startswith("arrive "))
    return R.argmin_per_group(sp, "node", ["cost", "source"], ["cost", "source"]).select("node", F.col("source").alias("hub"), "cost")


# ------------------------------------------------------------------ centrality / communities
_BFS_SQL = f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM {NEAR_SQL} a UNION ALL
                                                    SELECT dst, src FROM {NEAR_SQL} b){{extra}}),
bfs(source, node, hops) USING KEY (source, node) AS (
  SELECT n_nationkey, n_nationkey, 0 FROM nation
  UNION
  (SELECT c.source, c.node, c.hops FROM (
     SELECT b.source, e.dst AS node, min(b.hops + 1) AS hops FROM bfs b JOIN e ON b.node = e.src GROUP BY ALL) c
   LEFT JOIN recurring.bfs r ON r.source = c.source AND r.node = c.node
   WHERE r.hops IS NULL OR c.hops < r.hops))
"""


@query(
    "harmonic_centrality",
    _BFS_SQL.format(extra="")
    + "SELECT n.n_nationkey AS id, round(coalesce(sum(1.0 / b.hops) FILTER (WHERE b.hops > 0), 0) / "
    "((SELECT count(*) FROM nation) - 1), 6) AS harmonic FROM nation n LEFT JOIN bfs b ON b.source = n.n_nationkey "
    "GROUP BY 1",
)
def harmonic_centrality(spark, sf_dir):
    """Unweighted harmonic closeness on the two-way neighbour graph."""
    t = tables(spark, sf_dir)
    h = G.harmonic_exact(nation_vertices(t), G.two_way(near_edges(t)))
    return h.select(F.col("id").cast("int").alias("id"), F.round("harmonic", 6).alias("harmonic"))


@query("harmonic_hyperball")
def harmonic_hyperball(spark, sf_dir):
    """HyperBall estimate of the same centrality (HLL sketches per vertex)."""
    t = tables(spark, sf_dir)
    return G.harmonic_hyperball(nation_vertices(t), G.two_way(near_edges(t)))


@query(
    "induced_subgraph",
    f"SELECT e.src, e.dst, e.weight, a.n_regionkey AS community FROM {NEAR_SQL} e "
    f"JOIN nation a ON e.src = a.n_nationkey JOIN nation b ON e.dst = b.n_nationkey WHERE a.n_regionkey = b.n_regionkey",
)
def induced_subgraph(spark, sf_dir):
    t = tables(spark, sf_dir)
    m = t.nation.select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return G.induced_subgraph(near_edges(t), m)


@query(
    "community_centers",
    _BFS_SQL.format(extra=" x WHERE (SELECT n_regionkey FROM nation WHERE n_nationkey = x.src) = "
                          "(SELECT n_regionkey FROM nation WHERE n_nationkey = x.dst)")
    + """, h AS (SELECT n.n_nationkey AS id, n.n_regionkey AS community,
        coalesce(sum(1.0 / b.hops) FILTER (WHERE b.hops > 0), 0) /
        greatest((SELECT count(*) FROM nation m WHERE m.n_regionkey = n.n_regionkey) - 1, 1) AS closeness
      FROM nation n LEFT JOIN bfs b ON b.source = n.n_nationkey GROUP BY 1, 2)
SELECT community, id AS center, round(closeness, 6) AS closeness FROM (
  SELECT *, row_number() OVER (PARTITION BY community ORDER BY closeness DESC, id) AS rn FROM h) WHERE rn = 1""",
)
def community_centers(spark, sf_dir):
    """Most central nation of each community (region) on its induced subgraph:
    one harmonic run over all communities at once, then top-1 per community."""
    t = tables(spark, sf_dir)
    m = t.nation.select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    sub = G.induced_subgraph(G.two_way(near_edges(t)), m)
    h = G.harmonic_exact(nation_vertices(t), sub.select("src", "dst", "weight"), group=m)
    top = R.top_k_per_group(h, "community", [F.desc("harmonic"), F.asc("id")], 1)
    return top.select("community", F.col("id").cast("int").alias("center"), F.round("harmonic", 6).alias("closeness"))


@query("louvain")
def louvain(spark, sf_dir):
    """Louvain communities of the neighbour graph (unweighted, as undirected)."""
    t = tables(spark, sf_dir)
    out, _ = G.louvain(nation_vertices(t), near_edges(t))
    return out
