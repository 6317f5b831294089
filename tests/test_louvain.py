"""Simultaneous moves raise modularity; planted communities are found."""

import random

from pyspark.sql import functions as F

from tessera.operators import graph as G


def _planted(n, c, seed, inside=4, outside=1):
    r, e = random.Random(seed), set()
    for v in range(n):
        ends = [r.randrange(n // c) * c + v % c for _ in range(inside)] + [r.randrange(n) for _ in range(outside)]
        e |= {(min(u, v), max(u, v)) for u in ends if u != v}
    return sorted(e)


def _quality(edges, comm, two_m):
    k, tot = {}, {}
    for u, v in edges:
        k[u], k[v] = k.get(u, 0) + 1, k.get(v, 0) + 1
    for v, d in k.items():
        tot[comm[v]] = tot.get(comm[v], 0) + d
    return sum(2 for u, v in edges if comm[u] == comm[v]) / two_m - sum((t / two_m) ** 2 for t in tot.values()), k, tot


def test_every_round_raises_modularity(spark):
    for seed in (1, 2):
        r = random.Random(seed)
        edges, comm = _planted(90, 3, seed, 6, 2), {v: r.randrange(4) for v in range(90)}
        two_m = 2.0 * len(edges)
        near = {}
        for u, v in edges:
            near.setdefault(u, []).append(v)
            near.setdefault(v, []).append(u)
        before, k, tot = _quality(edges, comm, two_m)
        rows = []
        for v in range(90):
            links = {c: sum(comm[u] == c for u in near.get(v, [])) for c in set(comm.values())}
            s = {c: links[c] - (tot.get(c, 0) - (k.get(v, 0) if c == comm[v] else 0)) * k.get(v, 0) / two_m for c in links}
            to = max(s, key=lambda c: (s[c], -c))
            rows.append((v, float(k.get(v, 0)), comm[v], to, s[to] - s[comm[v]], to != comm[v] and s[to] - s[comm[v]] > 1e-9))
        g = spark.createDataFrame([(u, v, 1.0) for u, v in edges] + [(v, u, 1.0) for u, v in edges], "src long, dst long, weight double")
        dec = spark.createDataFrame(rows, "id long, k double, c long, to long, rise double, want boolean")
        out = {x.id: x.c for x in G._independent_movers(g, dec, two_m, seed).collect()}
        moved = [v for v in out if out[v] != comm[v]]
        assert len(out) == 90 and moved and _quality(edges, out, two_m)[0] > before
        assert all(out[v] == rows[v][3] and rows[v][5] for v in moved)


def test_planted_communities(spark):
    edges, trace = _planted(240, 6, 5, 6, 1), []
    v, d = spark.range(240), spark.createDataFrame(edges, "src long, dst long")
    out, mods = G.louvain(v, d, trace=trace)
    planted = G.modularity(d, v.select(F.col("id").alias("node"), (F.col("id") % 6).alias("community")))
    assert mods[-1] >= 0.98 * planted and mods == sorted(mods)
    assert len(trace) <= 40 and all(n > 0 for _, _, n in trace)  # no round is taken back
    assert out.count() == 240
