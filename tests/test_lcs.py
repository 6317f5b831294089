"""Bit vectors against the table of lengths, matched positions included."""

import random
import time

import numpy as np

from tessera.operators import textscore as TS


def _table(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i, j] = t[i - 1, j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1, j], t[i, j - 1])
    return t


def _indices(a, b):
    t, i, j, out = _table(a, b), len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i - 1, j] >= t[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def test_rows_and_positions():
    r = random.Random(1)
    for _ in range(400):
        letters = "abcdefgh"[: r.randint(1, 8)]
        a, b = r.choices(letters, k=r.randint(0, 90)), r.choices(letters, k=r.randint(0, 90))
        t = _table(a, b)
        rows = TS._lcs_rows(a, b)
        assert [[row >> j & 1 for j in range(len(b))] for row in rows] == np.diff(t, axis=1).tolist()
        assert TS._lcs_indices(a, b) == _indices(a, b)


def test_ten_times_faster_than_a_loop_per_cell():
    r = random.Random(2)
    a, b = (r.choices([f"w{i}" for i in range(300)], k=700) for _ in range(2))
    start = time.perf_counter()
    want = _indices(a, b)
    middle = time.perf_counter()
    assert TS._lcs_indices(a, b) == want
    assert time.perf_counter() - middle < (middle - start) / 10
