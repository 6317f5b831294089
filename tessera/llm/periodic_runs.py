"""Detection of periodic runs: stretches of words that repeat with a period.

Longest common extensions (LCE) come from a difference cover: of every
``CYCLE`` positions only those whose remainder is in ``COVER`` are sampled, and
for any two positions some shift below ``CYCLE`` lands both on samples.  Only
the sampled suffixes are sorted; an LCE compares a few words up to the
synchronised samples and answers the rest by a range-minimum query (sparse
table) over the common prefixes of neighbours in that order.  Backward
extensions use the same structure on the reversed words.

Runs are enumerated on harmonic grids: in a run of period p and at least
``4 p`` words (6 at least), ``3 p`` consecutive words (5 for p = 1) equal the
one p further, so two neighbouring places of the grid of step ``3 p / 2`` (2)
lie among them.  Testing the grids of all p, about 2/3 n log n places, and
extending the places where two neighbours are equal finds every run.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, slices, utf8

# A perfect difference set, every remainder of 31 is a difference of two members.
CYCLE = 31
COVER = (1, 5, 11, 24, 25, 27)

LEAST_WORDS, LEAST_POWER = 6, 4
GRID_BLOCK = 1 << 20  # grid places tested at once: bounds the arrays of a long text


def _sync_table() -> np.ndarray:
    """For a distance d of two positions, a member c of the cover with c + d
    in the cover as well (modulo the cycle)."""
    found = np.zeros(CYCLE, np.int64)
    for c in COVER:
        for e in COVER:
            found[(e - c) % CYCLE] = c
    return found


_SYNC = _sync_table()


class Extensions:
    """Longest common extensions of pairs of positions in a word sequence.

    ``words``: numbers from 1.  The sample order is built at the first query
    that its direct comparisons leave open.
    """

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.w = np.concatenate([np.asarray(words, np.int32), np.zeros(2 * CYCLE + 1, np.int32)])
        self.windows = np.lib.stride_tricks.sliding_window_view(self.w, CYCLE)
        self._built = False

    # -- sampled suffixes
    def _build(self) -> None:
        w, n = self.w, self.n
        at = np.arange(n)
        pos = at[np.isin(at % CYCLE, COVER)]
        m = len(pos)
        self.sample_of = np.full(n + 1, -1, np.int64)
        self.sample_of[pos] = np.arange(m)
        # order of the first CYCLE words, read as numbers of several words each
        digit = max(int(w.max()).bit_length(), 1)
        per_key = min(63 // digit, CYCLE)
        keys = []
        for c in range(0, CYCLE, per_key):
            key = np.zeros(m, np.int64)
            for k in range(c, min(c + per_key, CYCLE)):
                key = key << digit | w[pos + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, bool)
        new[:1] = True
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        # ranks of the first CYCLE * 2^k words; sample + CYCLE * 2^k is a sample, too
        levels, step = [], CYCLE
        while True:
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(new)
            levels.append((rank, step))
            if new.all() or step >= n:
                break
            key = rank * (m + 1) + self._shifted(rank, pos, step)
            order = np.argsort(key, kind="stable")
            new = np.ones(m, bool)
            new[1:] = key[order][1:] != key[order][:-1]
            step *= 2
        self.place = np.empty(m, np.int64)
        self.place[order] = np.arange(m)
        self.table = self._minima(self._neighbours(pos, order, levels))
        self._built = True

    def _shifted(self, rank: np.ndarray, pos: np.ndarray, step: int) -> np.ndarray:
        """Rank at pos + step, 0 beyond the end."""
        to = pos + step
        inside = to < self.n
        out = np.zeros(len(pos), np.int64)
        out[inside] = rank[self.sample_of[to[inside]]]
        return out

    def _neighbours(self, pos, order, levels) -> np.ndarray:
        """Common prefix of each suffix with the one before it in the order."""
        i, j = pos[order[:-1]].copy(), pos[order[1:]].copy()
        common = np.zeros(len(i), np.int64)
        for rank, step in reversed(levels):
            inside = np.flatnonzero((i < self.n) & (j < self.n))
            same = inside[rank[self.sample_of[i[inside]]] == rank[self.sample_of[j[inside]]]]
            common[same] += step
            i[same] += step
            j[same] += step
        return common + self._direct(i, j, CYCLE)

    @staticmethod
    def _minima(row: np.ndarray) -> list[np.ndarray]:
        """Sparse table: minima of spans of 1, 2, 4, ... entries."""
        table = [row]
        while 2 << (len(table) - 1) <= len(row):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def _least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of row[lo:hi], lo < hi."""
        k = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for level in np.unique(k):
            q = k == level
            t = self.table[level]
            out[q] = np.minimum(t[lo[q]], t[hi[q] - (1 << int(level))])
        return out

    # -- queries
    def _direct(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray | int) -> np.ndarray:
        """Words equal from i and j on, up to ``limit``, at most CYCLE each.
        Zeros stand beyond the end, and the later position meets them first."""
        got = np.empty(len(i), np.int64)
        for lo in range(0, len(i), 8192):
            part = slice(lo, lo + 8192)
            unequal = self.windows[i[part]] != self.windows[j[part]]
            first = unequal.argmax(1)
            got[part] = np.where(unequal[np.arange(len(first)), first], first, CYCLE)
        return np.minimum(got, limit)

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on, for arrays of i < j <= n."""
        got = self._direct(i, j, CYCLE)
        left = np.flatnonzero(got == CYCLE)
        if len(left):
            if not self._built:
                self._build()
            i, j = i[left] + CYCLE, j[left] + CYCLE
            shift = (_SYNC[(j - i) % CYCLE] - i) % CYCLE
            more = self._direct(i, j, shift)
            a = np.flatnonzero((more == shift) & (j + shift < self.n))
            p = self.place[self.sample_of[i[a] + shift[a]]]
            q = self.place[self.sample_of[j[a] + shift[a]]]
            more[a] += self._least(np.minimum(p, q), np.maximum(p, q))
            got[left] += more
        return got


def _step(period: np.ndarray) -> np.ndarray:
    """Half of the least count of places at which a run equals itself one period on."""
    return (np.maximum(LEAST_WORDS, LEAST_POWER * period) - period) // 2


def _grids(n: int):
    """Grid places (x, p) with x + p < n, in blocks of periods."""
    top = n // LEAST_POWER if n >= LEAST_WORDS else 0
    periods = np.arange(1, top + 1)
    step = _step(periods)
    places = (n - periods - 1) // step + 1
    ends = np.cumsum(places)
    lo = 0
    while lo < top:
        before = ends[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(ends, before + GRID_BLOCK, side="right")), lo + 1)
        many = places[lo:hi]
        p = np.repeat(periods[lo:hi], many)
        nth = np.arange(len(p)) - np.repeat(ends[lo:hi] - many - before, many)
        yield nth * _step(p), p
        lo = hi


def _extended(behind: Extensions, n: int, x: np.ndarray, p: np.ndarray, forward: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the places whose stretch is long enough."""
    backward = behind.lce(n - (x + p), n - x)  # from x + p - 1 and x - 1 down
    length = forward + backward + p
    keep = length >= np.maximum(LEAST_WORDS, LEAST_POWER * p)
    return np.stack([x - backward, length, p], 1)[keep]


def runs_of(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period.

    A run is a stretch with smallest period q and at least max(6, 4 q) words
    that no neighbouring word extends.  An interval found with period p has its
    smallest period among the divisors of p, for which the grid finds it as
    well, so the least p per interval is the run's period.
    """
    words = np.asarray(words)
    n = len(words)
    ahead = behind = None
    found = []
    for x, p in _grids(n):
        equal = words[x] == words[x + p]
        hit = np.flatnonzero(equal[:-1] & equal[1:] & (p[:-1] == p[1:]))
        if not len(hit):
            continue
        if ahead is None:
            ahead, behind = Extensions(words), Extensions(words[::-1])
        # a chain of neighbouring places is mostly one run: extend its first
        # place, then those that the first one's extension does not cover
        head = np.ones(len(hit), bool)
        head[1:] = (hit[1:] != hit[:-1] + 1) | (p[hit[1:]] != p[hit[:-1]])
        x, p = x[hit], p[hit]
        forward = ahead.lce(x[head], (x + p)[head])
        found.append(_extended(behind, n, x[head], p[head], forward))
        rest = x >= (x[head] + forward)[np.cumsum(head) - 1]
        if rest.any():
            x, p = x[rest], p[rest]
            found.append(_extended(behind, n, x, p, ahead.lce(x, x + p)))
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay if every run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def numbered(words: Sequence[bytes]) -> np.ndarray:
    """Words as numbers from 1, equal words alike."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """Runs of every whole text of ``docs`` (doc_id, text), one row per row:
    doc_id, n_words, runs (array of start, length, period, by start and
    period), collapsed (the words that stay if each run keeps its first period,
    joined by one space).

    ``rewrite(doc_id, n_words)`` may give the places of the words to read in
    place of the text's own.  Null, empty and blank texts have no words, no
    runs and an empty collapsed text; repeated rows and a null doc_id are rows
    like others; other columns are ignored.  Map-only: a text is worked on
    where it is read, in memory a fixed multiple of its length.
    """

    def run(batches):
        for part in slices(batches, "text"):
            ids = part.column("doc_id").to_pylist()
            n_words, lists, collapsed = [], [], []
            for doc_id, text in zip(ids, part.column("text").to_pylist()):
                words = text.split()
                numbers = numbered(words)
                places = rewrite(doc_id, len(words)) if rewrite else None
                if places is not None:
                    numbers = numbers[places]
                rows = runs_of(numbers)
                if len(rows):
                    kept = np.flatnonzero(kept_words(len(numbers), rows))
                    places = kept if places is None else places[kept]
                if places is not None:
                    words = [words[i] for i in places.tolist()]
                n_words.append(len(numbers))
                lists.append([{"start": s, "length": length, "period": p} for s, length, p in rows.tolist()])
                collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(lists, _RUNS), pa.array(collapsed, pa.binary()),
            ], names=["doc_id", "n_words", "runs", "collapsed"])

    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    out = d.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def looped_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words of a text whose tail is a loop: with h the crc32 of
    the decimal doc_id (null: of the empty text) and g = floor(h / 10), where h
    ends in 0, word i >= a = g % n becomes word a + (i - a) % p,
    p = 1 + floor((n - a) / (3 + g % 8)); None where nothing changes."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    i[a:] = a + (i[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return i


def run_digests(docs: DataFrame) -> DataFrame:
    """Runs of every text with planted loops (``looped_tail``): doc_id, n_runs,
    the longest run (ties: smallest start, then period; four nulls without one)
    as start, length, period, exponent_milli, and digests of all runs and of
    the collapsed text."""
    found = periodic_runs(docs, looped_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.floor(F.col("longest.length") * 1000 / -F.col("longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
