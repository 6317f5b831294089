"""The threshold algorithm and the mined rows against brute force."""

import random

import numpy as np
import pytest

from tessera.llm import hard_negatives as m


def _first(ids, scores, among, lo, hi, k):
    rows = [(-int(s), int(i)) for i, s, ok in zip(ids, scores, among) if ok and (lo is None or s >= lo) and (hi is None or s <= hi)]
    return sorted(rows)[:k]


@pytest.mark.parametrize("n,dims,spread", [(1, 3, 9), (40, 1, 2), (500, 4, 5), (3000, 8, 300), (200, 6, 2**30), (100, 3, 1)])
def test_search(n, dims, spread):
    r = np.random.default_rng(n)
    x = r.integers(-spread, spread, (n, dims), endpoint=True)
    x[: n // 3] = x[0]  # a third are copies
    ids, labels = r.permutation(n), r.integers(0, 3, n)
    lists = m.SortedLists(ids, labels, x, first_depth=4)
    met = 0
    for a in [*x[:: max(n // 20, 1)], np.zeros(dims, int), -x[0]]:
        scores = [sum(int(p) * int(q) for p, q in zip(a, row)) for row in x]
        among, top = labels != 1, max(scores)
        low, high = [None, top // 3, 0, 5, None], [None, top, top * 9 // 10, 4, 0]
        for (row, score), lo, hi in zip(lists.search(a, among, low, high, 3), low, high):
            got = [(-int(s), int(ids[i])) for i, s in zip(row, score)]
            assert got == _first(ids, scores, among, lo, hi, 3)
            met += len(got)
    assert met


def test_search_stops_early():
    """Sorted access ends as soon as the threshold is below the k-th score."""
    r = np.random.default_rng(2)
    x = np.concatenate([r.integers(0, 10, (5000, 4)), np.full((20, 4), 1000)])
    lists = m.SortedLists(np.arange(len(x)), np.zeros(len(x), int), x, first_depth=8)
    scored = []
    plain = lists._score
    lists._score = lambda rows, a: (scored.append(len(rows)), plain(rows, a))[1]
    ((row, _),) = lists.search(np.array([1, 2, 3, 4]), np.ones(len(x), bool), [None], [None], 10)
    assert row.tolist() == list(range(5000, 5010)) and sum(scored) < 300


def _brute(rows, k_pos=5, k_neg=10, low=30, high=90):
    items = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        items[i] = min(items.get(i, (label, q)), (label, q))
    out = []
    for a, (label, q) in items.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(q, p)) for i, (_, p) in items.items() if i != a}
        pos = sorted((-s, i) for i, s in score.items() if items[i][0] == label)[:k_pos]
        for s, p in pos:
            s = -s
            neg = sorted((-t, i) for i, t in score.items() if items[i][0] != label and low * s <= 100 * t <= high * s)[:k_neg]
            out += [(a, p, r, i, s, -t) for r, (t, i) in enumerate(neg, 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int"


def _rows(n, seed):
    r = random.Random(seed)
    rows = [(i * 10, [r.uniform(-1, 1) for _ in range(6)], r.randrange(3)) for i in range(n)]
    rows += [(i * 10 + 1, rows[7][1], 5) for i in range(n // 2)]  # many copies, a hot label
    nan, inf = float("nan"), float("inf")
    rows += [(-100, None, 1), (-200, [], 1), (-300, [1.0, None], 1), (-400, [nan] * 6, 2), (None, [1.0] * 6, 1), (-500, [inf, 1.0], 1),
             (-600, [0.5, 0.5, 0.5], 1), (-700, [0.0] * 6, 2), (-800, [1.0] * 6, None), (-900, [1.0] * 9, 0), (100, [0.25] * 6, 1), (100, [0.5] * 6, 0),
             (100, [0.5] * 6, 0)]
    return rows


@pytest.mark.parametrize("block_rows", [16384, 100])
def test_mined_rows(spark, block_rows):
    rows = _rows(600, 4)
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS q", "2 AS rank")
    got = sorted(tuple(r) for r in m.mine(d, m.Mining(block_rows=block_rows)).collect())
    want = _brute(rows)
    assert got == want and len(want) > 500
    assert m.mine(d.limit(0)).count() == 0
    assert m.mine(d.where("vec_id = 100")).count() == 0


def test_query_equals_sql(spark, sf_dir, duck):
    from tessera.llm.queries import QUERIES
    got = sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, sf_dir).collect()))
    want = sorted(duck.sql(m.ORACLE_SQL).fetchall())
    assert got == want and want


def test_large_components(spark):
    big = [(100, [4e6, -3e6], 1), (1, [4e6, -3e6], 1), (2, [2e6, -2e6], 2)]
    got = [tuple(r) for r in m.mine(spark.createDataFrame(big, SCHEMA)).collect()]
    assert got == _brute(big) and got
    with pytest.raises(Exception, match="(?i)overflow"):
        m.mine(spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 1)], SCHEMA)).collect()
