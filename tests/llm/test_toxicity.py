"""Noisy-or against its definition, gradients, held-out accuracy, sentences at fault."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import toxicity as m


def _held(doc):
    return zlib.crc32(str("" if doc is None else doc).encode()) % 3 == 1


def _corpus(n, seed):
    r = random.Random(seed)
    plain = [f"word{i}" for i in range(300)]
    bad = ["vile", "nasty", "grimbleton", "grimblest", "grimblor"]
    docs, labels = [], []
    for i in range(n):
        toxic = int(r.random() < 0.25)
        s = [" ".join(r.choices(plain, k=r.randint(3, 9))) for _ in range(r.randint(1, 25))]
        at = set(r.sample(range(len(s)), min(len(s), r.randint(1, 2)))) if toxic else set()
        s = [f"{x} {r.choice(bad)} {r.choice(plain)}" if k in at else x for k, x in enumerate(s)]
        docs.append((i, ". ".join(s) + ".", at))
        labels.append((i, toxic))
    return docs, labels


def test_learns_sentences_from_document_labels(spark):
    docs, labels = _corpus(900, 1)
    d = spark.createDataFrame([(i, t, 0.5) for i, t, _ in docs], "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in m.toxicity(d, lab).collect()}
    y = dict(labels)
    right = [got[i].predicted == y[i] for i, _, _ in docs if _held(i)]
    assert np.mean(right) > 0.97
    assert all(got[i].held_out == _held(i) for i in got)
    found = exact = 0
    for i, t, at in docs:
        if _held(i) and at:
            spans = m.sentences(t)
            told = {spans.index((s.start, s.end)) for s in got[i].at_fault}
            found += len(at)
            exact += len(told & at)
            assert len(told - at) <= 1
    assert exact > 0.9 * found


def test_labels_of_held_out_rows_do_not_count(spark):
    docs, labels = _corpus(150, 2)
    d = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    one = m.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    other = m.train(d, spark.createDataFrame([(i, 1 - y if _held(i) else y) for i, y in labels], "doc_id long, toxic int"))
    assert one == other and one.weights


def test_score_is_the_noisy_or():
    model = m.Model({"vile": 6.0, "grim-": 3.0, "mild": -1.0}, -4.0)
    text = "All fine here. So vile, mild!\nGrimble vile grimbled  \n\nno more"
    p = 1.0
    for a, b in m.sentences(text):
        words = set(text[a:b].lower().replace(",", " ").replace("!", " ").replace(".", " ").split())
        z = -4 + sum(model.weights.get(f, 0) for w in words for f in m.word_features(w, (4, 5)))
        p *= 1 - 1 / (1 + math.exp(-z))
    score, spans = m.Scorer(model).text(text)
    assert score == pytest.approx(1 - p)
    assert [text[a:b] for a, b, _ in spans] == ["So vile, mild!", "Grimble vile grimbled"]
    assert m.Scorer(model).text("") == (0.0, []) and m.Scorer(m.Model()).text("vile")[0] < 1e-6


def test_fit_reaches_a_stationary_point():
    y, n = [1, 0, 1, 0, 0], [3, 2, 1, 4, 1]
    sent, feat = [[0, 1], [0], [0], [3], []], [[0, 1], [1], [0], [1], []]
    t = m.Training(rounds=4000, l2=0.01, rate=0.02)
    w, b = m.fit_noisy_or(y, n, sent, feat, 2, t)

    def loss(w, b):
        out = t.l2 / 2 * (w @ w)
        for i in range(5):
            a = 0.0
            for s in range(n[i]):
                z = b + sum(w[f] for k, f in zip(sent[i], feat[i]) if k == s)
                a += math.log1p(math.exp(z))
            out += (a if not y[i] else -math.log(-math.expm1(-a))) / 5
        return out

    here = loss(w, b)
    for d in np.eye(3) * 0.03:
        assert loss(w + d[:2], b + d[2]) > here - 1e-6 and loss(w - d[:2], b - d[2]) > here - 1e-6


def test_odd_rows(spark):
    docs, labels = _corpus(120, 3)
    rows = [(i, t) for i, t, _ in docs] + [(None, "vile"), (None, None), (500, None), (501, ""), (502, " \n"), (0, docs[0][1]), (503, "vile " * 30000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (3, None), (5, 7), (9999, 1)] + labels[:5], "doc_id long, toxic int")
    got = m.toxicity(d, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (500, 501, 502))
    assert m.toxicity(d.limit(0), lab).count() == 0
    assert all(r.score < 1e-4 for r in m.toxicity(d, lab.limit(0)).filter("doc_id < 100").collect())


def test_fixture_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = m.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "toxic").collect()
    pos, neg = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    area = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert area > 0.85 and np.mean([q >= 0.7 for q in neg]) < 0.02


def test_weighted_bags_are_repeated_bags():
    y, n = [1, 0, 1, 0, 0], [3, 2, 1, 4, 1]
    sent, feat = [[0, 1], [0], [0], [3], []], [[0, 1], [1], [0], [1], []]
    t, times = m.Training(), [1, 4, 1, 4, 4]
    rep = [[x for x, k in zip(c, times) for _ in range(k)] for c in (y, n, sent, feat)]
    w, b = m.fit_noisy_or(y, n, sent, feat, 2, t, times)
    w2, b2 = m.fit_noisy_or(*rep, 2, t)
    assert w == pytest.approx(w2, abs=1e-3) and b == pytest.approx(b2, abs=1e-3)


def test_class_share_of_the_table_survives_the_sample(spark):
    # nothing tells the labels apart, so the score is the share of toxic rows, however few are sampled
    r = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(r.choices([f"word{k}" for k in range(300)], k=6))) for i in range(1500)], "doc_id long, text string")
    y = [(i, int(r.random() < 0.12)) for i in range(1500)]
    labels = spark.createDataFrame(y, "doc_id long, toxic int")
    true = np.mean([k for i, k in y if not _held(i)])
    for cap in (60, 4000):
        found = m.score(docs, m.train(docs, labels, m.Training(max_docs=cap, min_g=1e9))).agg({"score": "avg"}).first()[0]
        assert found == pytest.approx(true, abs=0.02)


def test_bitmap_keeps_all_labelled_rows(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'x' AS text", "id AS __placed").union(
        spark.createDataFrame([(None, "x", 1)], "doc_id long, text string, __placed long"))
    ids = spark.range(0, 20000, 40).selectExpr("cast(id AS int) AS doc_id")
    got = [r.doc_id for r in m._possible(docs, ids, 16).collect()]
    assert set(range(0, 20000, 40)) <= set(got) and len(got) == len(set(got)) < 900
    assert m._possible(docs, ids, 16).columns == docs.columns
    assert m._possible(docs, ids.limit(0), 16).isEmpty()


def test_more_labels_than_bits(spark):
    """A full bitmap sends every row to the join; the model is the same."""
    docs, labels = _corpus(300, 4)
    d = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    one = m.train(d, lab)
    assert one.weights and one == m.train(d, lab, m.Training(bitmap_bits=6))


def test_rows_left_are_those_not_predicted(spark):
    """Whole rows stay, with columns named like the operator's own, nulls and
    repeated rows; rows of one doc_id are told apart by their texts."""
    docs, labels = _corpus(400, 5)
    bad = next(t for i, t, at in docs if at)
    rows = [(i, t, 0.5, "a", [i]) for i, t, _ in docs] + [(None, None, None, None, None), (-1, "", 1.0, "b", []), (-2, bad, 0.0, "c", [1]), (-2, "word1 word2.", 0.0, "c", [2])]
    d = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, score double, toxic string, at_fault array<long>")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = m.score(d, m.train(d, lab)).select("doc_id", "score").collect()
    got = m.without_toxic(d, lab)
    assert got.schema == d.schema
    left = got.collect()
    assert len(left) == sum(r.score < 0.7 for r in scored) < len(scored)
    assert [tuple(r) for r in left if r.doc_id == -2] == [(-2, "word1 word2.", 0.0, "c", [2])]
    assert {r.doc_id for r in left} >= {None, -1} and m.without_toxic(d.limit(0), lab).isEmpty()


def test_only_telling_words_are_weighed(monkeypatch):
    """Words without a feature cost one look at all of a text's words; breaks are as defined."""
    model = m.Model({"vile": 9.0, "gri-": 5.0, "nice": 4.0, "nic-": -4.0}, -4.0, (3, 5))
    asked, word = [], m.Scorer._word
    monkeypatch.setattr(m.Scorer, "_word", lambda self, w: asked.append(w) or word(self, w))
    r = random.Random(4)
    for plain in (True, False):
        pool = [f"w{c}x" for c in "abcdefgh"] + ["ΣΑΣ", "9", "--"] + ([] if plain else ["Vile,", "grimmer", "nice", "x-vile's"])
        for _ in range(300):
            text = "".join(r.choice(pool) + r.choice([" ", ". ", "! \n", "\n \n", "\t", "  "]) for _ in range(r.randrange(30)))
            text = r.choice(["", " ", "\n", "\x1c."]) + text
            spans, start = [], 0
            for b in re.finditer(r"(?<=[.!?])\s+|\s*\n\s*", text):
                spans.append((start, b.start()))
                start = b.end()
            spans = [(a, b) for a, b in [*spans, (start, len(text))] if text[a:b].strip()]
            assert m.sentences(text) == spans
            ps = [1 / (1 + math.exp(4.0 - sum(word(m.Scorer(model), w) for w in m._sentence_words(text[a:b])))) for a, b in spans]
            want = 1 - math.prod(1 - p for p in ps)
            score, at_fault = m.Scorer(model).text(text)
            assert score == pytest.approx(want, abs=1e-9)
            assert [(a, b) for a, b, _ in at_fault] == [s for s, p in zip(spans, ps) if p >= 0.5]
        assert bool(asked) != plain
