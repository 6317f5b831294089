"""The model against a brute-force one, and its probabilities' sums."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import arrays, kneser_ney as m


def _words(text):
    return (text or "").encode().lower().split()


def _brute(rows):
    """Scores by the definition, with dictionaries."""
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1
    train = [_words(t) + [b"\n"] for d, t in rows if not held(d)]
    one, two, ctx = Counter(), Counter(), Counter()
    for t in train:
        one.update(t)
        two.update(zip([b"^ start"] + t[:-1], t))
        ctx.update([b"^ start"] + t[:-1])
    v, total = len(one), sum(one.values())
    cont, follow = Counter(w for _, w in two), {}
    for (u, _), c in two.items():
        follow.setdefault(u, Counter())[min(c, 3)] += 1
    of = lambda c: m.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
    d2, d1 = of(two), of(cont)
    take = lambda c, d: max(c - (d[min(c, 3) - 1] if c else 0), 0)
    pairs = len(two)
    rest = sum(d * x for d, x in zip(d1, (sum(c == 1 for c in cont.values()), sum(c == 2 for c in cont.values()), sum(c > 2 for c in cont.values())))) / pairs if pairs else 1

    def p1(w):
        return (take(cont[w], d1) / pairs if pairs else 0) + rest / (v + 1)

    def p2(w, u):
        if not ctx[u]:
            return p1(w)
        return take(two[u, w], d2) / ctx[u] + sum(d2[k - 1] * n for k, n in follow[u].items()) / ctx[u] * p1(w)

    out = []
    for d, t in rows:
        w = _words(t) + [b"\n"]
        base = sum(math.log10((one[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w)
        own = sum(math.log10(p2(x, u)) for u, x in zip([b"^ start"] + w[:-1], w))
        out.append((d, held(d), len(w), sum(one[x] > 0 for x in w), total, base, own))
    return out, p2, one, ctx


def _same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r)[:7] for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_fixture(spark, sf_dir, monkeypatch):
    # small segments, so that every level has several
    monkeypatch.setattr(m, "_bits", lambda rows, per_segment=0: 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, *_ = _brute(rows)
    got = m.language_model(docs).collect()
    _same(got, want)
    # a bigram model tells held-out text better than word counts
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_odd_rows(spark):
    rows = [(i, "a b A c d a b " * (i % 3) + "x" * i) for i in range(30)] + [(None, "a b"), (None, None), (31, ""), (31, ""), (32, "é É \x0b\x1c"), (33, "w " * 60000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    _same(m.language_model(docs).collect(), _brute(rows)[0])


def test_nothing_to_learn_from(spark):
    assert m.language_model(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(d for d in range(99) if zlib.crc32(str(d).encode()) % 5 == 1)
    docs = spark.createDataFrame([(held, "some words")], "doc_id long, text string")
    _same(m.language_model(docs).collect(), _brute([(held, "some words")])[0])


def test_probabilities_sum_to_one():
    rows = [(i, "a b c a b d e " * (1 + i % 4) + f"w{i % 7} q{i}") for i in range(40)]
    _, p2, one, ctx = _brute(rows)
    for u in list(ctx) + [b"unseen"]:
        assert sum(p2(w, u) for w in one) + p2(b"unseen word", u) == pytest.approx(1)


def test_mixing_is_a_bijection():
    x = np.array([0, 1, -1, 2**62, -(2**63), 123456789], np.int64)
    assert m.unmix(m.mix(x)).tolist() == x.tolist()
    keys = np.sort(m.mix(np.arange(-500, 500, dtype=np.int64)))
    part = arrays.segment_of(keys, 4)
    assert (np.diff(part) >= 0).all() and set(part) == set(range(16))


def _brute_of(rows, order):
    """Scores of any order by the definition: one start, adjusted counts."""
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1
    start = b"^ start"
    text = lambda t: [start] + _words(t) + [b"\n"]
    raw = [Counter() for _ in range(order + 1)]
    for d, t in rows:
        if not held(d):
            w = text(t)
            for n in range(1, order + 1):
                raw[n].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    v = len(raw[1]) - 1
    total = sum(raw[1].values()) - raw[1][start,]
    a = {order: raw[order]}
    for n in range(order - 1, 0, -1):
        left = Counter(g[1:] for g in raw[n + 1])
        a[n] = {g: raw[n][g] if g[0] == start else left[g] for g in raw[n] if n > 1 or g[0] != start}
    d = {n: m.discounts([sum(x == k for x in a[n].values()) for k in (1, 2, 3, 4)]) for n in a}
    followers, held_back = Counter(), Counter()
    for n in range(1, order + 1):
        for g, c in a[n].items():
            followers[g[:-1]] += c
            held_back[g[:-1]] += d[n][min(c, 3) - 1]
    take = lambda c, n: max(c - (d[n][min(c, 3) - 1] if c else 0), 0)

    def p(w, context):
        lower = p(w, context[1:]) if context else 1 / (v + 1)
        if not followers[context]:
            return lower
        n = len(context) + 1
        return (take(a[n].get((*context, w), 0), n) + held_back[context] * lower) / followers[context]

    out = []
    for doc, t in rows:
        w = text(t)
        base = sum(math.log10((raw[1][x,] + 0.5) / (total + 0.5 * (v + 1))) for x in w[1:])
        own = sum(math.log10(p(w[i], tuple(w[max(0, i - order + 1):i]))) for i in range(1, len(w)))
        out.append((doc, held(doc), len(w) - 1, sum(raw[1][x,] > 0 for x in w[1:]), total, base, own))
    return out, p, [g[0] for g in a[1]], followers


def _mixed_rows():
    r = np.random.default_rng(5)
    return [(i, " ".join(f"w{k}" for k in r.zipf(1.4, 40).clip(0, 60))) for i in range(60)] + [(None, "w1 w2"), (None, None), (99, ""), (98, "w1 new w2 w1")]


@pytest.mark.parametrize("order", [3, 4])
def test_higher_orders(spark, monkeypatch, order):
    monkeypatch.setattr(m, "_bits", lambda rows, per_segment=0: 3)
    monkeypatch.setattr(m, "BLOCK", 64)
    rows = _mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _same(m.language_model(docs, order=order).collect(), _brute_of(rows, order)[0])


def test_query_uses_two_words_of_context(spark, sf_dir):
    from tessera.llm.queries import op5_language_model

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    _same(op5_language_model(spark, sf_dir).collect(), _brute_of(rows, 3)[0])


def test_higher_probabilities_sum_to_one():
    _, p, words, followers = _brute_of(_mixed_rows(), 3)
    for u in list(followers)[:200]:
        assert sum(p(w, u) for w in words) + p(b"unseen word", u) == pytest.approx(1)


def test_packed_numbers():
    for x in ([], [0], [1, 255, 256, 2**40, 2**64 - 1], [7] * 5):
        assert arrays.unpacked(arrays.packed(np.array(x, np.uint64))).tolist() == x
        assert arrays.from_steps(arrays.steps(np.array(x, np.uint64))).tolist() == x
    # near numbers take a byte or two each
    assert len(arrays.steps(np.arange(10**12, 10**12 + 10**5, 100, dtype=np.uint64)[1:] - np.uint64(10**12))) < 1100


def test_rows_of_bytes_hold_any_count(tmp_path):
    rows = np.array([[0, 1], [254, 3], [255, 0], [2, 10**12], [5, 6]], np.int64)
    arrays.write_rows(str(tmp_path), "x", rows)
    got = arrays.Rows(str(tmp_path), "x", 2)
    assert got[np.array([3, 0, 2, 1, 4])].tolist() == rows[[3, 0, 2, 1, 4]].tolist() and got[:].tolist() == rows.tolist()


@pytest.mark.parametrize("bits, width", [(0, 64), (2, 64), (1, 16), (3, 40), (2, 50)])
def test_keys_are_found(tmp_path, bits, width):
    r = np.random.default_rng(width)
    # runs of neighbours: alike in their high bits
    keys = np.unique((r.integers(0, 1 << (width - 3), 300).astype(np.uint64)[:, None] * np.uint64(5) + np.arange(4, dtype=np.uint64)) & np.uint64((1 << width) - 1))
    here = r.random(len(keys)) < 0.5
    kept, rest = keys[here], width - bits
    counts = np.arange(len(kept)) % 400 + 1
    for i in range(1 << bits):
        mine = (kept >> np.uint64(rest)) == i if rest < 64 else np.ones(len(kept), bool)
        if mine.any():
            arrays.Keys.write(str(tmp_path), "k", i, rest, kept[mine] & np.uint64((1 << rest) - 1), counts[mine])
    table = arrays.Keys(str(tmp_path), "k", bits, width)
    place, count = table.find(keys)
    assert place[here].tolist() == list(range(len(kept))) and (place[~here] == -1).all()
    assert count[here].tolist() == counts.tolist() and not count[~here].any()
    assert np.concatenate([table.segment(i)[0] for i in range(1 << bits)]).tolist() == kept.tolist()


@pytest.mark.parametrize("bits", [16, 34, 48, 62])
def test_mixing_keeps_to_its_bits(bits):
    x = np.unique(np.random.default_rng(bits).integers(0, 1 << bits, 5000))
    y = m.mix(x, bits)
    assert m.unmix(y, bits).tolist() == x.tolist() and 0 <= y.min() and y.max() < 1 << bits


def test_model_takes_few_bytes_and_restores_settings(spark):
    from pathlib import Path

    r = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in r.integers(0, 3000, 300))) for i in range(200)], "doc_id long, text string")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    model = m.fit(spark, docs, order=3)
    assert spark.conf.get(name, None) == before
    folder = Path(arrays._local(model.folder))
    # before: 12 bytes an n-gram and 16 for the figures of those below the highest level
    assert sum(f.stat().st_size for f in folder.iterdir()) < 12 * sum(model.grams)


def test_blocks_of_words_grow_in_number_with_the_corpus():
    of = lambda bits: m.Model("", 3, (4, bits, bits), 999_999, 0, 0, (1_000_000, 9_000_000), m.BLOCK)
    assert m._block(of(2), 1) == 1_000_000 and m._block(of(12), 1) == -(-1_000_000 // 512)
    assert m._block(of(4), 2) == m.BLOCK


def test_nothing_to_learn_from_at_higher_orders(spark):
    held = next(d for d in range(99) if zlib.crc32(str(d).encode()) % 5 == 1)
    rows = [(held, "some words of a text")]
    _same(m.language_model(spark.createDataFrame(rows, "doc_id long, text string"), order=3).collect(), _brute(rows)[0])  # all words alike at any order
