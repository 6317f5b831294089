"""Components against brute force over all pairs, also through forced extra rounds."""

import random

import numpy as np
import pytest

from tessera.llm import near_dedup as m


def _sets(rows):
    out = []
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        out.append((doc, {tuple(w[i:i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()))
    return out


def _brute(rows):
    sets = _sets(rows)
    comp = list(range(len(sets)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                comp[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            r = root(i)
            least[r] = min(least.get(r, doc), doc)
    out = []
    for i, (doc, s) in enumerate(sets):
        c = least.get(root(i)) if s else doc
        out.append((doc, len(s), c, doc == c))
    return out


def _rows(seed, groups=30):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = r.choices(vocabulary, k=r.choice([3, 8, 15, 40, 120]))
        for _ in range(r.choice([1, 1, 2, 4, 9])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            base = w if r.random() < 0.5 else base  # chains as well as stars
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    return rows


def _got(spark, rows, p=m.Params()):
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, component_id string")
    return [tuple(r) for r in m.near_duplicates(docs, p).collect()]


def _same(a, b):
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(a, key=key) == sorted(b, key=key)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = _rows(seed)
    _same(_got(spark, rows), _brute(rows))


def test_coarse_bands_need_extra_rounds(spark):
    # one value per band: large mixed buckets, so links must be found behind unlike centres
    rows = _rows(3, groups=14)
    _same(_got(spark, rows, m.Params(bins=32, rows=1)), _brute(rows))


def test_odd_rows(spark):
    text = "the Quick brown fox jumps over the lazy dog again and again until it stops"
    rows = [(5, text), (5, text), (3, text.upper()), (None, text), (None, "nobody has this one here"), (None, None), (9, None), (8, ""), (7, " \n\t"),
            (6, "one"), (4, "ONE"), (2, "one two"), (1, "long " * 5000), (11, "long " * 9000), (12, "çé ÇÉ")]
    _same(_got(spark, rows), _brute(rows))
    _same(_got(spark, [(1, "a b c"), (2, "d e f")]), _brute([(1, "a b c"), (2, "d e f")]))
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_densification_keeps_similarity():
    r = random.Random(4)
    s = m.Signature(m.Params())
    for n in (6, 20, 60, 400):
        errors = []
        for _ in range(200):
            union = np.array([r.getrandbits(64) for _ in range(n)], np.uint64)
            k = n // 10 or 1
            a, b = np.unique(union[k:]), np.unique(union[:-k])
            errors.append((s.values(a) == s.values(b)).mean() - (n - 2 * k) / n)
        assert abs(np.mean(errors)) < 0.03, n


def test_fixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    _same([tuple(r) for r in m.near_duplicates(docs).collect()], _brute(rows))
