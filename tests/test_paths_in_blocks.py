"""Searches over several blocks, nodes placed by what they share."""


from pyspark.sql import functions as F

from tessera.operators import graph as G
from tests.test_paths import _graph


def _searched(spark, edges, sources, **how):
    """Rows found, and the plans of the rounds."""
    plans, add = [], G._Bucketed.add

    def seen(self, df, *a, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        add(self, df, *a, **options)

    G._Bucketed.add = seen
    try:
        found = G.shortest_paths(spark.createDataFrame(edges, "src string, dst string, weight int"),
                                 spark.createDataFrame([(s,) for s in sources], "id string"), **how).collect()
    finally:
        G._Bucketed.add = add
    return {(r.source, r.node): (r.cost, r.hops, r.pred or "") for r in found}, [p for p in plans if "FileScan" in p and "Join" in p]


def _named(edges):
    """The graph with names as nodes; ties go to the smaller name."""
    return [(str(a), str(b), w) for a, b, w in edges]


def _wanted(edges, sources):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    best = {(s, s): (0.0, 0, "") for s in sources}
    while True:  # to the fixpoint
        new = dict(best)
        for (s, v), (cost, hops, _) in best.items():
            for b, w in out.get(v, []):
                new[s, b] = min(new.get((s, b), (cost + w + 1, 0, "")), (cost + w, hops + 1, v))
        if new == best:
            return best
        best = new


def test_placed_nodes_take_fewer_rounds_and_sources_go_in_turn(spark, monkeypatch):
    """Ways are followed on inside a block: the chain of 17 nodes takes a round
    or two of its own.  Mail alone is shuffled in a round."""
    monkeypatch.setattr(G, "_PART_EDGES", 70)
    monkeypatch.setattr(G, "_SLOTS", 150)
    monkeypatch.setattr(G, "_STEP", 20)
    monkeypatch.setattr(G, "_FOLD", 2)
    edges = _named(_graph(8))
    found, rounds = _searched(spark, edges, ["60"], place=lambda c: c.cast("long") >= 60)
    assert found == _wanted(edges, ["60"]) and len(rounds) <= 2 and all(p.count("Exchange") <= 1 + p.count("AQEShuffleRead") for p in rounds)
    sources = ["0", "5", "60", "61", "nowhere"]
    found, _ = _searched(spark, edges, sources, place=lambda c: F.length(c))
    assert found == _wanted(edges, sources)


def test_nodes_of_one_key_are_told_apart(spark, monkeypatch):
    """Two nodes of one key: the keys are taken anew."""
    key, salts = G._key, []

    def weak(name, salt, parts, place):
        salts.append(salt)
        return key(name, salt, parts, place) if salt else F.length(name).cast("long")

    monkeypatch.setattr(G, "_key", weak)
    edges = _named(_graph(9))
    found, _ = _searched(spark, edges, ["0"])
    assert found == _wanted(edges, ["0"]) and set(salts) == {0, 1}
