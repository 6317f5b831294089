"""Cases that the oracle queries do not reach."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import relational as R
from tessera.operators import stats as ST
from tessera.operators import textscore as TS


def test_box_left_join_gives_one_row_per_empty_box(spark):
    points = spark.createDataFrame([("p", 5.0, 5.0), ("q", 179.5, 0.5), ("r", -179.5, 0.5)], "name string, px double, py double")
    boxes = spark.createDataFrame(
        [(1, 0.0, 25.0, 0.0, 25.0), (2, 40.0, 65.0, 40.0, 65.0), (2, 40.0, 65.0, 40.0, 65.0), (3, 179.0, -179.0, 0.0, 1.0)],
        "box int, x0 double, x1 double, y0 double, y1 double",
    )
    j = R.box_range_join(points, boxes, "px", "py", "x0", "x1", "y0", "y1", cell=10.0, x_wrap=(-180.0, 180.0))
    got = sorted((r.box, r.name) for r in j.where("name IS NOT NULL").collect())
    assert got == [(1, "p"), (3, "q"), (3, "r")]
    assert [r.box for r in j.where("name IS NULL").collect()] == [2, 2]
    flat = R.box_range_join(points, boxes, "px", "py", "x0", "x1", "y0", "y1", cell=10.0, how="inner")
    assert [(r.box, r.name) for r in flat.collect()] == [(1, "p")]


def test_equal_texts_score_one(spark):
    df = spark.createDataFrame([("the the cat", "the the cat"), ("a b", "c d"), ("a b c d", "a b")], "p string, r string")
    got = [round(r[0], 6) for r in df.select(TS.unigram_f1("p", "r")).collect()]
    assert got == [1.0, 0.0, round(2 / 3, 6)]


def test_bleu_with_two_references(spark):
    # clipped unigrams of the textbook case: "the" stands twice in one reference, so 2 of 7 count
    rows = [(1, "the the the the the the the", "The cat is on the mat.", "There is a cat on the mat."),
            (2, "a cat is on the mat", "the cat is on the mat", "there is a cat on the mat"),
            (3, "x", "y z", "w")]
    df = spark.createDataFrame(rows, "k int, p string, r1 string, r2 string")
    one = {r.k: (round(r.bleu, 6), r.pred_len, r.ref_len) for r in TS.bleu(df, "k", "p", ["r1", "r2"], max_n=1).collect()}
    assert one == {1: (round(2 / 7, 6), 7, 7), 2: (1.0, 6, 6), 3: (0.0, 1, 1)}
    # 2: bigrams "a cat", "cat is", "is on", "on the", "the mat" all stand in a reference
    two = {r.k: round(r.bleu, 6) for r in TS.bleu(df, "k", "p", ["r1", "r2"], max_n=2).collect()}
    assert two[2] == 1.0
    single = {r.k: round(r.bleu, 6) for r in TS.bleu(df, "k", "p", "r1", max_n=2).collect()}
    assert single[2] == round((5 / 6 * 4 / 5) ** 0.5, 6)


def test_louvain_on_names(spark):
    names = ["ann", "bob", "cid", "dan", "eve", "fay"]
    v = spark.createDataFrame([(n,) for n in names], "id string")
    pairs = [("ann", "bob"), ("bob", "cid"), ("ann", "cid"), ("dan", "eve"), ("eve", "fay"), ("dan", "fay"), ("cid", "dan")]
    out, mods = G.louvain(v, spark.createDataFrame(pairs, "src string, dst string"))
    got = {r.node: r.community for r in out.collect()}
    assert got == dict.fromkeys(names[:3], "ann") | dict.fromkeys(names[3:], "dan")
    assert mods and mods[-1] > 0.3


def test_incomplete_beta():
    # closed forms: I_x(1, b) = 1 - (1 - x)^b, I_x(a, 1) = x^a, and t with one degree of freedom
    for x in (0.01, 0.3, 0.5, 0.9, 0.999):
        assert math.isclose(ST.betainc_reg(1, 4, x), 1 - (1 - x) ** 4, rel_tol=1e-12)
        assert math.isclose(ST.betainc_reg(3, 1, x), x**3, rel_tol=1e-12)
    for t in (0.1, 1.0, 12.0):
        assert math.isclose(ST.t_two_sided_p(t, 1), 1 - 2 * math.atan(t) / math.pi, rel_tol=1e-10)


def test_rack_words_come_from_all_languages(spark, sf_dir):
    from tessera.plans.auction_plan import words_df
    from tessera.plans.common import tables

    t = tables(spark, sf_dir)
    some = t.documents.where("lang = 'de'").select(F.explode(F.split(F.lower("text"), "[^a-zäöüß]+")).alias("w")).where("w RLIKE '^[a-z]{6,}$'")
    assert some.join(words_df(t), F.col("w") == F.col("word"), "left_anti").isEmpty()
