"""Delta-stepping, routes and path sums against Dijkstra on random graphs."""

import heapq
import random

import pytest

from tessera.operators import graph as G


def _graph(seed, n=60, m=250):
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n), r.choice([0, 0, 1, 2, 3, 9])) for _ in range(m)]
    return edges + [(i, i + 1, 1) for i in range(n, n + 16)]  # a long chain of its own


def _dijkstra(edges, source):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    best, heap = {}, [((0.0, 0, -1), source)]
    while heap:
        key, v = heapq.heappop(heap)
        if v in best:
            continue
        best[v] = key
        for b, w in out.get(v, []):
            if b not in best:
                heapq.heappush(heap, ((key[0] + w, key[1] + 1, v), b))
    return best


@pytest.mark.parametrize("delta", [None, 3.0])
def test_shortest_paths(spark, delta):
    edges, sources = _graph(3), [0, 5, 60, 60, 9999]
    d = spark.createDataFrame(edges, "src long, dst long, weight int")
    before = {t.name for t in spark.catalog.listTables()}
    dist = G.shortest_paths(d, spark.createDataFrame([(s,) for s in sources], "id long"), delta)
    got = {(r.source, r.node): (r.cost, r.hops, -1 if r.pred is None else r.pred) for r in dist.collect()}
    want = {(s, v): k for s in set(sources) for v, k in _dijkstra(edges, s).items()}
    assert got == want and dist.count() == len(want)
    assert {t.name for t in spark.catalog.listTables()} == before  # nothing is left in the catalog


def test_routes_and_sums(spark):
    edges = _graph(4)
    d = spark.createDataFrame(edges, "src long, dst long, weight int")
    dist = G.shortest_paths(d, spark.createDataFrame([(0,), (60,)], "id long"))
    best = {s: _dijkstra(edges, s) for s in (0, 60)}

    def walk(s, v):
        nodes = [v]
        while best[s][nodes[0]][2] != -1:
            nodes.insert(0, best[s][nodes[0]][2])
        return nodes

    routes = G.paths_to(dist).collect()
    assert {(r.source, r.target) for r in routes} == {(s, v) for s in best for v in best[s]}
    for r in routes:
        nodes = walk(r.source, r.target)
        assert (r.nodes, r.costs, r.total) == (nodes, [best[r.source][v][0] for v in nodes], best[r.source][r.target][0])
    assert max(len(r.nodes) for r in routes) >= 17
    some = G.paths_to(dist, spark.createDataFrame([(76,), (76,), (777,)], "id long")).collect()
    assert [(r.source, r.target, len(r.nodes)) for r in some] == [(60, 76, 17)]
    values = spark.createDataFrame([(v, v % 5) for v in range(0, 77, 2)], "node long, value long")
    sums = {(r.source, r.target): r.path_sum for r in G.path_sums(dist, values).collect()}
    assert sums == {(s, v): sum(x % 5 for x in walk(s, v) if x % 2 == 0) for s in best for v in best[s]}


def test_odd_graphs(spark):
    none = spark.createDataFrame([], "src long, dst long, weight int")
    one = spark.createDataFrame([(1,)], "id long")
    assert [tuple(r) for r in G.shortest_paths(none, one).collect()] == [(1, 1, 0.0, 0, None)]
    assert G.shortest_paths(none, one.limit(0)).count() == 0
    with pytest.raises(ValueError):
        G.shortest_paths(spark.createDataFrame([(1, 2, -1)], "src long, dst long, weight int"), one)
    zero = spark.createDataFrame([(1, 2, 0), (2, 1, 0), (2, 3, 0)], "src long, dst long, weight int")
    assert sorted(tuple(r) for r in G.shortest_paths(zero, one).collect()) == [(1, 1, 0.0, 0, None), (1, 2, 0.0, 1, 1), (1, 3, 0.0, 2, 2)]


def test_rounds_do_not_shuffle_edges(spark):
    """Joining a frontier with dealt edges moves the frontier alone."""
    b = G._Bucketed(spark.createDataFrame(_graph(5), "src long, dst long, weight int"), "src")
    try:
        frontier = spark.range(1000).withColumnRenamed("id", "node")
        j = frontier.join(b.read().hint("merge"), frontier.node == b.read().src)
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    finally:
        b.drop()


def test_rounds_do_not_sort_and_routes_join_each_row_once(spark):
    """Edges and distances are probed, not sorted, in a round; routes to some
    targets take only the nodes on the way, hop by hop."""
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    plans, add = [], G._Bucketed.add

    def seen(self, df, **options):
        plans.append(plan(df))
        add(self, df, **options)

    edges = _graph(6)
    G._Bucketed.add = seen
    try:
        dist = G.shortest_paths(spark.createDataFrame(edges, "src long, dst long, weight int"), spark.createDataFrame([(0,), (60,)], "id long"))
    finally:
        G._Bucketed.add = add
    rounds = [p for p in plans if "FileScan" in p and "Join" in p]
    assert len(rounds) > 16 and all("SortMergeJoin" not in p and p.count("ShuffledHashJoin") == 2 for p in rounds)
    ends = spark.createDataFrame([(76,), (3,), (777,)], "id long")
    every = {(r.source, r.target): (r.total, r.nodes, r.costs) for r in G.paths_to(dist).collect()}
    some = {(r.source, r.target): (r.total, r.nodes, r.costs) for r in G.paths_to(dist, ends).collect()}
    assert some and some == {k: v for k, v in every.items() if k[1] in (76, 3)}
    ones = dist.select("node").distinct().selectExpr("node", "1 AS value")
    sums = {(r.source, r.target): r.path_sum for r in G.path_sums(dist, ones, ends).collect()}
    assert sums == {k: len(v[1]) for k, v in some.items()}
    assert G.paths_to(dist.limit(0), ends).count() == G.paths_to(dist.limit(0)).count() == 0
