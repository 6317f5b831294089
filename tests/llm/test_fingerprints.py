"""Gear hashes against the recurrence, chunking and the edited texts against brute force."""

import hashlib
import random

import numpy as np

from tessera.llm import fingerprints as m


def _recurrence(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(m._GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def _plain_ends(data, c):
    """The definition, byte by byte."""
    h, ends, start = _recurrence(data), [], 0
    for i in range(len(data)):
        n = i + 1 - start
        bits = c.strict_bits if n <= c.normal else c.loose_bits
        if n >= c.greatest or (n >= c.least and h[i] >> (32 - bits) == 0):
            ends.append(i + 1)
            start = i + 1
    return ends + [len(data)] if start < len(data) else ends


def test_hash_and_boundaries():
    r = random.Random(1)
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 500, 5000, 20000):
        data = bytes(r.choices(range(97, 123), k=n))
        assert m.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == _recurrence(data)
        assert m.boundaries(data) == _plain_ends(data, m.Chunking()), n
    same = b"a" * 3000
    assert m.boundaries(same) == _plain_ends(same, m.Chunking())


def test_containment_survives_a_shift():
    r = random.Random(2)
    data = bytes(r.choices(b"abcdefghij klmnop", k=20000))
    a, b = m.chunk_set(data), m.chunk_set(b"inserted words " + data)
    assert m.likeness(a, b) > 0.95
    assert m.likeness(a, m.chunk_set(data[5000:9000])) > 0.85
    assert m.likeness(a, m.chunk_set(bytes(r.choices(b"abcdefghij klmnop", k=20000)))) < 0.05
    assert (m.likeness({}, {}), m.likeness(a, {})) == (1.0, 0.0)
    assert m.from_string(m.as_string(a)) == a


def _expected(rows):
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), (x[1] or "").encode()))
    out = []
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        e = (text[:len(text) - half] + after[:half]).encode()
        own, changed, nxt = m.chunk_set(text.encode()), m.chunk_set(e), m.chunk_set(after.encode())
        out.append((doc, len(text), hashlib.sha256(e).hexdigest(), m.as_string(own), m.as_string(changed), m.likeness(own, changed), m.likeness(own, nxt)))
    return out


def _check(spark, rows, per_range, monkeypatch):
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, part string")
    with monkeypatch.context() as mp:
        mp.setattr(m, "in_order", lambda d, f=m.in_order: f(d, per_range))
        got = [tuple(r)[:7] for r in m.edit_likeness(docs).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(got, key=key) == sorted(_expected(rows), key=key)


def test_edited_texts(spark, monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choices("abc déf ghi\n😀", k=r.choice([0, 1, 2, 7, 300, 4000]))) for _ in range(60)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    for per_range in (5, 17, 1000):
        _check(spark, rows, per_range, monkeypatch)
    odd = rows[:20] + [(6, "again"), (6, "again"), (None, "no id"), (None, None), (9, None), (-4, "negative"), (2**53 + 1, "large")]
    _check(spark, odd, 4, monkeypatch)
    _check(spark, [(1, "alone here")], 4, monkeypatch)
    _check(spark, [(None, None)], 4, monkeypatch)
    _check(spark, [(5, "same")] * 7, 2, monkeypatch)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert m.edit_likeness(empty).count() == 0


def test_equal_texts_have_equal_fingerprints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = m.edit_likeness(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by = {}
    for r in rows:
        assert by.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(rows) == len(texts)
    # half of a text stays and the next one is another text
    long = [r for r in rows if r.n_chars > 1500]
    assert sum(0.3 < r.near_edited < 0.75 for r in long) > 0.85 * len(long)
