"""Dictionary tables: ordinals, salted joins, vectors, unseen values and nulls."""

import random

import pytest

from tessera.operators import features as FE


def _rows(seed, n=400):
    r = random.Random(seed)
    return [(i, None if i % 17 == 0 else "hot" if i % 3 == 0 else f"v{r.randrange(60):02d}") for i in range(n)]


@pytest.mark.parametrize("broadcast", [50_000, 5])
def test_ordinals(spark, monkeypatch, broadcast):
    monkeypatch.setattr(FE.Dictionary, "BROADCAST", broadcast)  # 5: the salted join
    train, test = _rows(1), _rows(2) + [(9000, "new"), (9001, "hot"), (9001, "hot")]
    schema = "id long, c string"
    d = FE.Dictionary.fit(spark.createDataFrame(train, schema), "c")
    values = sorted({v for _, v in train if v is not None})
    want = {v: i for i, v in enumerate([*values, None], 1)}
    assert d.size == len(want) and "hot" in d.hot
    coded = d.encode(spark.createDataFrame(test, schema), "o")
    assert sorted((r.id, r.c or "", r.o) for r in coded.collect()) == sorted((i, v or "", want.get(v, 0)) for i, v in test)
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (broadcast > 5)
    bits = FE.binary_encode(spark.createDataFrame(test, schema), d).collect()
    k = len(want).bit_length()
    assert sorted((r.id, sum(r[f"c_{i}"] << (k - 1 - i) for i in range(k))) for r in bits) == sorted((i, want.get(v, 0)) for i, v in test)


def test_vectors_and_names(spark):
    train = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, c string")
    test = spark.createDataFrame([(1, "b"), (2, "z"), (3, None), (4, "a")], "id int, c string")
    rows = FE.one_hot_vector(test, FE.Dictionary.fit(train, "c"), "v").orderBy("id").collect()
    assert [r.v.toArray().tolist() for r in rows] == [[0, 1, 0], [0, 0, 0], [0, 0, 1], [1, 0, 0]]
    named = FE.one_hot(test, FE.Vocabulary.fit(train, "c"), keep_original=True, named=True).orderBy("id")
    assert named.columns == ["id", "c", "c_a", "c_b", "c_nan"]
    assert [tuple(r)[2:] for r in named.collect()] == [(0, 1, 0), (0, 0, 0), (0, 0, 1), (1, 0, 0)]
    empty = FE.Dictionary.fit(train.limit(0), "c")
    assert empty.size == 0 and {r.o for r in empty.encode(test, "o").collect()} == {0}
