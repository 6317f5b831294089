"""Extensions and runs against brute force, digests against the definition."""

import hashlib
import random
import zlib

import numpy as np

from tessera.llm import periodic_runs as m


def _plain_lce(w, i, j):
    k = 0
    while j + k < len(w) and w[i + k] == w[j + k]:
        k += 1
    return k


def _plain_runs(w):
    """Every maximal stretch with period p; smallest p per stretch."""
    n, best = len(w), {}
    for p in range(1, n // 4 + 1):
        x = 0
        while x + p < n:
            if w[x] != w[x + p]:
                x += 1
                continue
            s = x
            while x + p < n and w[x] == w[x + p]:
                x += 1
            length = x - s + p
            if length >= max(6, 4 * p):
                best.setdefault((s, length), p)
    return sorted((s, length, p) for (s, length), p in best.items())


def _texts(r):
    yield from ([], [1], [1] * 5, [1] * 6, [1, 2] * 3, [1, 2] * 4, [1, 2, 3] * 4 + [1], [7] * 500)
    for _ in range(150):
        w = []
        while len(w) < r.randint(1, 300):
            piece = [r.randint(1, r.choice((2, 3, 40))) for _ in range(r.randint(1, 40))]
            w += piece * r.choice((1, 1, 2, 4, 5, 9))
        yield w
    # nested and touching runs, periods beyond the cycle, long texts
    block = [1, 2, 1, 2, 1, 2, 1, 2, 3]
    yield block * 6
    yield [r.randint(1, 50) for _ in range(700)] * 5
    yield [r.randint(1, 2) for _ in range(4000)]


def test_cover_synchronises_every_distance():
    for d in range(m.CYCLE):
        for i in range(m.CYCLE):
            h = (m._SYNC[d] - i) % m.CYCLE
            assert (i + h) % m.CYCLE in m.COVER and (i + d + h) % m.CYCLE in m.COVER


def test_extensions():
    r = random.Random(3)
    for w in _texts(r):
        if len(w) < 2:
            continue
        pairs = [sorted(r.sample(range(len(w)), 2)) for _ in range(200)]
        i, j = np.array(pairs).T
        e = m.Extensions(np.array(w))
        want = [_plain_lce(w, a, b) for a, b in pairs]
        assert e.lce(i, j).tolist() == want
        assert e.lce(np.array([0]), np.array([len(w)])).tolist() == [0]


def test_runs(monkeypatch):
    r = random.Random(4)
    for w in _texts(r):
        assert [tuple(x) for x in m.runs_of(np.array(w, np.int32)).tolist()] == _plain_runs(w), w
    monkeypatch.setattr(m, "GRID_BLOCK", 50)
    w = [r.randint(1, 2) for _ in range(800)]
    assert [tuple(x) for x in m.runs_of(np.array(w, np.int32)).tolist()] == _plain_runs(w)


def _row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = _plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    top = min(((-length, s, p) for s, length, p in runs), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4),
            sha("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)), n)


def test_digests(spark, sf_dir):
    odd = [(None, "a b a b a b a b"), (None, None), (-1, None), (-2, ""), (-3, " \t\n"), (-4, "x " * 4000), (-5, "é é é " * 9),
           (-6, "a a a a a a b b b b b b"), (-6, "a a a a a a b b b b b b")] + [(i, "one two three four five " * 3) for i in range(-200, -100)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 6000").union(
        spark.createDataFrame(odd, "doc_id long, text string"))
    got = [tuple(r) for r in m.run_digests(docs.selectExpr("*", "1 AS runs", "2 AS longest", "3 AS n_words")).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    want = [_row(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[1] for r in got) > 50
    assert m.run_digests(docs.limit(0)).count() == 0


def test_collapsed_text_and_runs(spark):
    d = spark.createDataFrame([(1, "so la la la la la la di\nda di da di da di da end")], "doc_id long, text string")
    r = m.periodic_runs(d).first()
    assert [tuple(x) for x in r.runs] == [(1, 6, 1), (7, 8, 2)]
    assert (r.n_words, r.collapsed) == (16, "so la di da end")
