"""Golden micro-fixtures for operators without a SQL twin (and a few with)."""

from __future__ import annotations

import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as X
from tessera.operators import auction as AU
from tessera.operators import features as FE
from tessera.operators import graph as G
from tessera.operators import relational as R
from tessera.operators import retrieval as RT
from tessera.operators import stats as ST
from tessera.operators import textscore as TS
from tessera.operators import words as WD
from tessera.sources import files as FS
from tessera.sources.html import extract_text


# ------------------------------------------------------------------ tiny_transit
def test_tiny_transit_shortest_paths(spark):
    # line R: A-B-C ; line Y: D-B-E ; F isolated (no line)
    stops = spark.createDataFrame(
        [("R", 1, "A"), ("R", 2, "B"), ("R", 3, "C"), ("Y", 1, "D"), ("Y", 2, "B"), ("Y", 3, "E")],
        "line string, seq int, station string")
    stations = spark.createDataFrame([(s, 5 if s == "B" else 3) for s in "ABCDEF"], "station string, transfer_time int")
    # travel times given one way only
    travel = spark.createDataFrame([("A", "B", 10), ("C", "B", 4), ("B", "D", 7), ("E", "B", 2), ("E", "F", 1)],
                                   "station_1 string, station_2 string, travel_time int")
    edges = G.transit_edges(stops, stations, travel)
    nodes = {r[0] for r in edges.select("src").union(edges.select("dst")).collect()}
    assert "depart F" not in nodes and "arrive F" not in nodes
    srcs = spark.createDataFrame([("depart A",)], "id string")
    d = {r["node"]: r["cost"] for r in G.shortest_paths(edges, srcs).collect()}
    assert d["arrive C"] == 14          # A->B->C on R
    assert d["arrive E"] == 10 + 5 + 2  # transfer at B to Y
    assert d["arrive D"] == 10 + 5 + 7
    assert "arrive F" not in d          # unreachable: no row, never 0
    routes = {r["target"]: r for r in G.paths_to(G.shortest_paths(edges, srcs)).collect()}
    r = routes["arrive E"]
    assert r["nodes"][0] == "depart A" and r["nodes"][-1] == "arrive E"
    assert r["costs"][-1] == 17 and list(r["costs"]) == sorted(r["costs"])


def test_successor_forms_agree(spark):
    stops = spark.createDataFrame([(1, i, 10 + i) for i in range(1, 6)] + [(2, i, 20 + i) for i in range(1, 4)],
                                  "line int, seq int, station int")
    a = sorted(R.successor_join(stops).collect())
    b = sorted(R.successor_lead(stops).collect())
    assert a == b and len(a) == 4 + 2


def test_undirected_join_equals_or_join(spark):
    seg = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (5, 6)], "a int, b int")
    tab = spark.createDataFrame([(1, 2, 7), (4, 3, 9)], "station_1 int, station_2 int, travel_time int")
    fast = sorted(R.undirected_join(seg, tab).collect())
    cond = ((seg.a == tab.station_1) & (seg.b == tab.station_2)) | ((seg.a == tab.station_2) & (seg.b == tab.station_1))
    slow = sorted(seg.join(tab, cond).select("a", "b", "travel_time").collect())
    assert fast == slow


# ------------------------------------------------------------------ tiny_two_clusters
def _two_cliques(spark):
    e = [(a, b) for a in range(1, 5) for b in range(a + 1, 5)] + [(a, b) for a in range(5, 9) for b in range(a + 1, 9)]
    e.append((4, 5))
    edges = spark.createDataFrame([(a, b, 1) for a, b in e], "src int, dst int, weight int")
    verts = spark.createDataFrame([(i,) for i in range(1, 9)], "id int")
    return verts, edges


def test_louvain_two_cliques(spark):
    verts, edges = _two_cliques(spark)
    out, mods = G.louvain(verts, edges)
    comm = {r["node"]: r["community"] for r in out.collect()}
    assert len(set(comm.values())) == 2
    assert {comm[i] for i in range(1, 5)} == {1} and {comm[i] for i in range(5, 9)} == {5}
    assert all(b >= a - 1e-12 for a, b in zip(mods, mods[1:]))
    q = G.modularity(edges, out.select("node", "community"))
    assert q > 0.35


def test_harmonic_by_hand(spark):
    verts, edges = _two_cliques(spark)
    h = {r["id"]: r["harmonic"] for r in G.harmonic_exact(verts, G.two_way(edges)).collect()}
    assert h[1] == pytest.approx((3 + 0.5 + 3 / 3) / 7)
    assert h[4] == pytest.approx((3 + 1 + 3 / 2) / 7)
    hb = {r["id"]: r["harmonic"] for r in G.harmonic_hyperball(verts, G.two_way(edges)).collect()}
    for k in h:
        assert hb[k] == pytest.approx(h[k], rel=0.1)


# ------------------------------------------------------------------ climate_txt
def test_climate_parse(spark):
    d = tempfile.mkdtemp(prefix="tessera-test-")
    os.makedirs(f"{d}/country=Aland")
    lines = [f"% comment {i}" for i in range(1, 54)]
    lines.insert(10, "")  # blank lines do not count
    lines += ["%      Jan  Feb  Mar  Apr  May  Jun  Jul  Aug  Sep  Oct  Nov  Dec",
              "%     -1.5 -0.3 3.5 8.8 13.8 17.5 19.6 19.0 15.2 9.8 4.2 0.0",
              "% +/-  0.2 0.19 0.18 0.19 0.16 0.14 0.13 0.13 0.15 0.15 0.17 0.20",
              "%", "1850  1  -0.5  0.3  NaN NaN NaN NaN NaN NaN NaN NaN",
              "1850  2   NaN  0.3  NaN NaN NaN NaN NaN NaN NaN NaN",
              "1850  3   0.25 0.3  1.0 0.1 NaN NaN NaN NaN NaN NaN"]
    with open(f"{d}/country=Aland/a.txt", "w") as f:
        f.write("\n".join(lines) + "\n")
    an = FS.parse_anomalies(FS.read_dir_lines(spark, d), "country").orderBy("Month").collect()
    assert [(r["Year"], r["Month"], r["Monthly_Anomaly"]) for r in an] == [(1850, 1, -0.5), (1850, 3, 0.25)]
    assert an[1]["Annual_Anomaly"] == 1.0 and an[0]["Annual_Anomaly"] is None  # NaN -> null
    base = FS.parse_baselines(FS.read_dir_files(spark, d), "country").orderBy("month_no").collect()
    assert len(base) == 12
    assert (base[0]["Month"], base[0]["Baseline_Temp"], base[0]["Unc"]) == ("Jan", -1.5, 0.2)
    assert (base[11]["Month"], base[11]["Baseline_Temp"], base[11]["Unc"]) == ("Dec", 0.0, 0.2)


# ------------------------------------------------------------------ pets12
def test_pets_encoders(spark):
    train = spark.createDataFrame(
        [(1, "Mimi", 1, 0), (2, None, 2, 1), (3, "Kitty", 1, 50), (4, "Bo", 2, 51), (5, "Rex", 1, 101),
         (6, "Puppy2", 3, 500), (7, "Al", 1, None), (8, "Tom", 2, 0)], "id int, name string, state int, fee int")
    test = spark.createDataFrame([(9, "Zed", 9, 10), (10, "Lu", 1, 40)], "id int, name string, state int, fee int")
    vocab = FE.Vocabulary.fit(train, "state")
    assert vocab.values == [1, 2, 3]
    oh = FE.one_hot(test, vocab).orderBy("id").collect()
    assert [(r["state_1"], r["state_2"], r["state_3"]) for r in oh] == [(0, 0, 0), (1, 0, 0)]  # unseen -> zeros
    be = FE.binary_encode(test, vocab).orderBy("id").collect()
    assert [(r["state_0"], r["state_1"]) for r in be] == [(0, 0), (0, 1)]
    inv = {r["id"]: r["invalid_name"] for r in FE.invalid_name(train, "name").collect()}
    assert inv[2] == 1 and inv[3] == 1 and inv[6] == 1 and inv[4] == 1 and inv[1] == 0  # null -> "No_Name" (generic)
    with pytest.raises(ValueError):
        FE.invalid_name(train, "nope")
    clipped = {r["id"]: r["c"] for r in train.select("id", X.clip("fee", 0, 100).alias("c")).collect()}
    assert clipped[7] is None and clipped[6] == 100
    rel = {r["id"]: r["state"] for r in FE.relabel(train, "state", {1: 10, 2: 20}).collect()}
    assert rel[6] is None and rel[1] == 10
    z = FE.standardize(train.where("fee is not null"), "fee").select("fee_z").toPandas()["fee_z"]
    assert abs(z.mean()) < 1e-12 and abs(z.std(ddof=0) - 1) < 1e-12
    bins = {r["id"]: r["b"] for r in train.select("id", X.cut("fee", [0, 1, 51, 101, math.inf],
                                                              ["free", "low", "mid", "high"]).alias("b")).collect()}
    assert (bins[1], bins[3], bins[4], bins[5], bins[7]) == ("free", "low", "mid", "high", None)


# ------------------------------------------------------------------ bids20
def test_bids_settlement(spark):
    bids = spark.createDataFrame(
        [(1, "a", 0.5), (2, "a", 1.0), (2, "b", 1.0), (3, "a", 0.2), (3, "b", 0.9), (3, "c", 0.4), (4, "c", 0.1),
         (4, "d", 0.05)], "round_id int, bidder_id string, bid double")
    s = {r["round_id"]: r for r in AU.settle(bids, "round_id", "bidder_id", "bid").collect()}
    assert (s[1]["bidder_id"], s[1]["price"]) == ("a", 0.5)        # single bidder pays own bid
    assert (s[2]["bidder_id"], s[2]["price"]) == ("a", 1.0)        # tie -> smaller id, pays the tie
    assert (s[3]["bidder_id"], s[3]["price"]) == ("b", 0.4)        # second price
    rounds = AU.settle(bids, "round_id", "bidder_id", "bid").select(
        "round_id", F.col("bidder_id").alias("winner"), "price", (F.col("round_id") == 3).alias("clicked"))
    bal = {r["bidder_id"]: r for r in AU.balances(bids, rounds, "round_id", "bidder_id", "winner", "price",
                                                  "clicked").collect()}
    assert bal["d"]["balance"] == 0.0 and bal["d"]["n_wins"] == 0      # never wins
    assert bal["b"]["balance"] == pytest.approx(1 - 0.4)
    assert bal["a"]["balance"] == pytest.approx(-0.5 - 1.0)


def test_bidder_sequence(spark):
    # one bidder, one user: lose, win without click, lose, win with click
    log = spark.createDataFrame([(1, 10.0, False), (2, 60.0, False), (3, 20.0, False), (4, 70.0, True)],
                                "ts int, value double, click boolean").withColumn("k", F.lit(1))
    st = AU.bidder_state(log, ["k"], ["ts"], won=F.col("value") >= 50, price=F.col("value") / 100,
                         clicked=F.col("click"), threshold=F.lit(5.0)).orderBy("ts").collect()
    assert [r["bid"] for r in st] == [0.5, 1.0, 0.5, 0.5]
    assert [r["next_bid"] for r in st] == [1.0, 0.5, 0.5, 0.5]
    assert st[-1]["cost"] == pytest.approx(1.3) and st[-1]["cost_seen"] == pytest.approx(1.6)


# ------------------------------------------------------------------ qa4
def test_text_metrics(spark):
    pairs = spark.createDataFrame(
        [(1, "the cat sat on the mat today", "the cat sat on the mat today"),
         (2, "alpha beta gamma delta", "one two three four"),
         (3, "the cat sat on", "the cat sat on the mat today"),
         (4, "", "x y")], "k int, pred string, ref string")
    b = {r["k"]: r["bleu"] for r in TS.bleu(pairs, "k", "pred", "ref").collect()}
    assert b[1] == pytest.approx(1.0) and b[2] == 0.0 and b[4] == 0.0
    assert b[3] == pytest.approx(math.exp(1 - 7 / 4))  # all precisions 1, brevity penalty only
    assert TS.rouge_lsum_py("a b c\nd e", "a b c\nd e") == pytest.approx(1.0)
    assert TS.rouge_lsum_py("x y", "a b") == 0.0
    r = {row["k"]: row["r"] for row in pairs.select("k", TS.rouge_lsum("pred", "ref").alias("r")).collect()}
    assert r[1] == pytest.approx(1.0) and r[3] == pytest.approx(2 * (4 / 7) / (1 + 4 / 7))


def test_greedy_match(spark):
    cand = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0])], "k int, t int, v array<double>")
    ref = spark.createDataFrame([(1, 3, [1.0, 0.0])], "k int, t int, v array<double>")
    g = TS.greedy_match(cand, ref, "k", "t", "v").first()
    assert g["precision"] == pytest.approx(0.5) and g["recall"] == pytest.approx(1.0)


# ------------------------------------------------------------------ ranks
def _midranks(values):
    order = sorted(values)
    ranks = {}
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and order[j] == order[i]:
            j += 1
        ranks[order[i]] = (i + 1 + j) / 2
        i = j
    return ranks


def test_rank_tests_by_hand(spark):
    x = [1.1, 2.2, 2.2, 3.5, 4.0, 5.0]
    y = [2.2, 3.5, 6.0, 7.1, 7.1]
    df = spark.createDataFrame([(v, 0) for v in x] + [(v, 1) for v in y], "v double, g int")
    r = ST.rank_sum_stats(df, "v", "g", 0).first()
    ranks = _midranks(x + y)
    w = sum(ranks[v] for v in x) - len(x) * (len(x) + 1) / 2
    assert r["w"] == pytest.approx(w) and r["mean_w"] == pytest.approx(15.0)
    ties = 3 ** 3 - 3 + 2 ** 3 - 2 + 2 ** 3 - 2
    assert r["var_w"] == pytest.approx(6 * 5 / 12 * (12 - ties / (11 * 10)))
    hl = ST.hodges_lehmann(df, "v", "g", 0)
    assert hl == pytest.approx(np.median([a - b for a in x for b in y]), abs=1e-9)
    wt = ST.welch_stats(df, "v", "g", 0).first()
    se = math.sqrt(np.var(x, ddof=1) / 6 + np.var(y, ddof=1) / 5)
    assert wt["t"] == pytest.approx((np.mean(x) - np.mean(y)) / se)
    p = ST.t_two_sided_p(2.0, 10)
    assert p == pytest.approx(0.0733880, abs=1e-6)
    assert ST.normal_sf(1.959963985) == pytest.approx(0.025, abs=1e-8)
    pairs = spark.createDataFrame([(1.0, 0.5), (2.0, 2.0), (0.1, 0.4), (3.0, 1.0)], "a double, b double")
    sr = ST.signed_rank_stats(pairs, "a", "b").first()
    assert sr["n"] == 3 and sr["v"] == pytest.approx(2.0 + 3.0)


# ------------------------------------------------------------------ ols10
def test_ols_against_numpy(spark):
    rng = np.random.default_rng(3)
    x1 = rng.normal(size=10)
    x2 = rng.normal(size=10)
    y = 1 + 2 * x1 - x2 + rng.normal(scale=0.3, size=10)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)], "x1 double, x2 double, y double")
    fit = ST.OLSFit(df, F.col("y"), {"x1": F.col("x1"), "x2": F.col("x2")})
    X_ = np.column_stack([np.ones(10), x1, x2])
    beta, *_ = np.linalg.lstsq(X_, y, rcond=None)
    assert np.allclose(fit.coef, beta)
    e = y - X_ @ beta
    inv = np.linalg.inv(X_.T @ X_)
    h = np.einsum("ij,jk,ik->i", X_, inv, X_)
    hc3 = inv @ (X_.T * (e / (1 - h)) ** 2) @ X_ @ inv
    assert np.allclose(fit.robust_se(), np.sqrt(np.diag(hc3)))
    se = np.sqrt(np.diag(inv) * (e @ e) / 7)
    assert np.allclose(fit.se, se)
    diag = fit.diagnostics().toPandas()
    assert np.allclose(sorted(diag["leverage"]), sorted(h))


# ------------------------------------------------------------------ rack
# Worked out by hand for the rack t-e-a-r-i-n-g: letters a wildcard stands for
# (a second t; two more e's; z and b), by the wildcards needed.
RACK_WORDS = {"tea": "", "teat": "t", "eerie": "ee", "great": "", "zebra": "zb", "gratin": "", "tearing": "", "a": ""}


def test_rack(spark):
    df = spark.createDataFrame([(w,) for w in RACK_WORDS], "word string")
    for wild in (0, 1, 2):
        got = {r["word"]: (r["w"], r["s"]) for r in df.where(WD.playable("word", "tearing", wild)).select(
            "word", WD.wildcard_letters("word", "tearing").alias("w"), WD.score("word", "tearing").alias("s")).collect()}
        want = {w: letters for w, letters in RACK_WORDS.items() if len(letters) <= wild}
        assert set(got) == set(want)
        for w, (wl, sc) in got.items():
            assert wl == want[w]
            assert sc == sum(WD.LETTER_VALUES[c] for c in w) - sum(WD.LETTER_VALUES[c] for c in wl)


# ------------------------------------------------------------------ html
def test_html_extract():
    html = ("<html><head><style>p{}</style><script>var x='<p>'</script></head><body><nav>menu</nav>"
            "<article><h1>Title</h1><p>Keep <b>this</b>.</p><div class='ad'>buy</div><script>no()</script></article>"
            "<p>outside</p></body></html>")
    assert extract_text(html) == "Title Keep this ."


def test_recursive_chunks():
    text = "para one is here.\n\npara two is a much longer paragraph " + "word " * 80 + "\nlast line"
    chunks = RT.recursive_split(text, 64, 8)
    assert all(len(c) <= 64 for c in chunks)
    words = [w for w in text.split() if w]
    joined = " ".join(chunks)
    assert all(w in joined for w in set(words))


# ------------------------------------------------------------------ geodesic box
def _vincenty_direct(lat1, lon1, bearing_deg, dist_m):
    """Vincenty (1975) direct problem on WGS-84, degrees in and out."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    phi1, alpha1 = math.radians(lat1), math.radians(bearing_deg)
    tan_u1 = (1 - f) * math.tan(phi1)
    cos_u1 = 1 / math.sqrt(1 + tan_u1 ** 2)
    sin_u1 = tan_u1 * cos_u1
    sigma1 = math.atan2(tan_u1, math.cos(alpha1))
    sin_alpha = cos_u1 * math.sin(alpha1)
    cos2_alpha = 1 - sin_alpha ** 2
    u2 = cos2_alpha * (a * a - b * b) / (b * b)
    big_a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    sigma = dist_m / (b * big_a)
    for _ in range(200):
        two_sm = 2 * sigma1 + sigma
        ds = big_b * math.sin(sigma) * (math.cos(two_sm) + big_b / 4 * (
            math.cos(sigma) * (-1 + 2 * math.cos(two_sm) ** 2)
            - big_b / 6 * math.cos(two_sm) * (-3 + 4 * math.sin(sigma) ** 2) * (-3 + 4 * math.cos(two_sm) ** 2)))
        new = dist_m / (b * big_a) + ds
        if abs(new - sigma) < 1e-14:
            sigma = new
            break
        sigma = new
    two_sm = 2 * sigma1 + sigma
    tmp = sin_u1 * math.sin(sigma) - cos_u1 * math.cos(sigma) * math.cos(alpha1)
    phi2 = math.atan2(sin_u1 * math.cos(sigma) + cos_u1 * math.sin(sigma) * math.cos(alpha1),
                      (1 - f) * math.sqrt(sin_alpha ** 2 + tmp ** 2))
    lam = math.atan2(math.sin(sigma) * math.sin(alpha1),
                     cos_u1 * math.cos(sigma) - sin_u1 * math.sin(sigma) * math.cos(alpha1))
    c = f / 16 * cos2_alpha * (4 + f * (4 - 3 * cos2_alpha))
    big_l = lam - (1 - c) * f * sin_alpha * (sigma + c * math.sin(sigma) * (
        math.cos(two_sm) + c * math.cos(sigma) * (-1 + 2 * math.cos(two_sm) ** 2)))
    return math.degrees(phi2), lon1 + math.degrees(big_l)


def test_geo_box_matches_vincenty(spark):
    pts = spark.createDataFrame([(37.8, -122.27), (-33.9, 151.2), (0.0, 179.99)], "lat double, lon double")
    box = X.geo_box("lat", "lon", 5.0)
    rows = pts.select("lat", "lon", *[v.alias(k) for k, v in box.items()]).collect()
    d = 5.0 * 1609.344
    for r in rows:
        north = _vincenty_direct(r["lat"], r["lon"], 0.0, d)[0]
        east = _vincenty_direct(r["lat"], r["lon"], 90.0, d)[1]
        assert r["lat_max"] == pytest.approx(north, abs=1e-4)
        east = (east + 180.0) % 360.0 - 180.0
        assert r["lon_max"] == pytest.approx(east, abs=1e-4)
    assert rows[2]["lon_max"] < -179.0  # wraps at the antimeridian
