"""Blocks against brute force; the inverted file's coverage and recall."""

import numpy as np
import pytest

from tessera.operators import retrieval as RT
from tessera.operators import vector_index as VI

SCHEMA = "id long, v array<double>"


def _clustered(n, dims, seed, clusters=20):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dims))
    of = r.integers(0, clusters, n)
    of[: n // 3] = 0  # a third lies in one cluster
    return centres[of] + 0.35 * r.normal(size=(n, dims))


def _frame(spark, x, schema=SCHEMA):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], schema)


def _brute(x, q, k, threshold=None):
    u, w = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, q))
    scores = VI.round_half_away(w @ u.T, 4)
    return {(i, int(j), rank) for i, s in enumerate(scores)
            for rank, j in enumerate([j for j in np.lexsort((np.arange(len(x)), -s)) if threshold is None or s[j] >= threshold][:k], 1)}


@pytest.mark.parametrize("block_rows,threshold", [(10000, None), (70, None), (70, 0.4)])
def test_exact_blocks(spark, block_rows, threshold):
    x, q = _clustered(500, 6, 1), _clustered(90, 6, 2)
    x[7:40] = x[7]  # ties go to the smaller id
    got = VI.exact_topk(_frame(spark, x), "id", "v", _frame(spark, q, "q long, v array<double>"), "q", "v", 5, threshold, block_rows=block_rows)
    assert {(r.q, r.id, r["rank"]) for r in got.collect()} == _brute(x, q, 5, threshold)


def test_large_query_sets_are_not_broadcast(spark):
    x, q = _clustered(300, 6, 3), _clustered(60, 6, 4)
    a = (_frame(spark, x), "id", "v", _frame(spark, q, "q long, v array<double>"), "q", "v", 4)
    small, large = RT.topk_similarity(*a), RT.topk_similarity(*a, broadcast_queries=10)
    row = lambda d: sorted((r.q, r.id, r.score, r["rank"]) for r in d.collect())
    assert row(small) == row(large)
    assert RT.topk_similarity(a[0], "id", "v", a[3].limit(0), "q", "v", 4).count() == 0


def test_index_recall_and_pruning(spark):
    x, q = _clustered(3000, 16, 5), _clustered(200, 16, 5)
    d, queries = _frame(spark, x), _frame(spark, q, "q long, v array<double>")
    index = VI.build_index(d, "id", "v", block_rows=200)  # the hot cluster is cut into blocks
    assert index.counts.sum() == 3000
    exact = VI.exact_topk(d, "id", "v", queries, "q", "v", 10)
    probes = VI.probes_for(index, queries, "q", "v", 10)
    assert 1 <= probes <= len(index.centres) // 2
    found = VI.search(index, queries, "q", "v", 10, probes)
    assert VI.recall(found, exact, "q", "id") >= 0.9
    # all cells probed: the exact result, scores and ranks included
    whole = VI.search(index, queries, "q", "v", 10, len(index.centres))
    row = lambda f: sorted((r.q, r.id, r.score, r["rank"]) for r in f.collect())
    assert row(whole) == row(exact)
    # a query reads the folders of its cells alone
    one = VI.search(index, queries.where("q = 3"), "q", "v", 10, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [__cell" in plan


def test_shares_of_a_much_asked_cell(spark, monkeypatch):
    monkeypatch.setattr(VI, "QUERIES_PER_SHARE", 7)
    x, q = _clustered(400, 6, 6), _clustered(80, 6, 6)
    d, queries = _frame(spark, x), _frame(spark, q, "q long, v array<double>")
    index = VI.build_index(d, "id", "v", cells=4, block_rows=50)
    whole = VI.search(index, queries, "q", "v", 5, 4)
    assert {(r.q, r.id, r["rank"]) for r in whole.collect()} == _brute(x, q, 5)


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [None, 1.0]), (4, [0.0, 0.0]), (5, [0.5, 0.5])], SCHEMA)
    q = spark.createDataFrame([(9, [1.0, 1.0]), (8, None)], "q long, v array<double>")
    want = [(9, 5, 1.0, 1), (9, 1, 0.7071, 2), (9, 4, 0.0, 3)]
    for cells in (1, 2):
        index = VI.build_index(d, "id", "v", cells=cells)
        assert [(r.q, r.id, r.score, r["rank"]) for r in VI.search(index, q, "q", "v", 5).orderBy("rank").collect()] == want
    empty = VI.build_index(d.limit(0), "id", "v")
    assert VI.search(empty, q, "q", "v", 3).count() == 0
    assert VI.search(index, q.limit(0), "q", "v", 3).count() == 0


def test_registered_index_recall(spark):
    """Unclustered vectors of the fixture: still 0.9 of the exact neighbours."""
    from tessera.plans.registry import entries
    rows = entries()["retrieve_index_recall"].fn(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.n_found for r in rows) >= 0.9 * sum(r.n_exact for r in rows)


def test_threshold_keeps_every_match_from_0_3(spark, sf_dir):
    from tessera.plans.registry import entries

    sf = sf_dir.replace("sf0.001", "sf0.1")  # some of whose best matches lie between 0.3 and 0.36
    best = {tuple(r) for r in entries()["retrieve_topk"].fn(spark, sf).collect() if r.score >= 0.3}
    got = {tuple(r) for r in entries()["retrieve_threshold"].fn(spark, sf).collect()}
    assert got == best and min(r[2] for r in got) < 0.36
