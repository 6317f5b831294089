"""Sum-of-squares online packing of token sequences.

Every input split packs its own documents as they come, in one pass and
without a shuffle.  Whole windows of a long document stand alone; the rest, of
length s, goes to the fill level h (0: a new window) that makes the sum over
levels of N(h)^2 smallest, N(h) being the number of partially filled windows
at level h.  The level array has one entry per fill level, so a choice costs
one vector operation.  Full windows leave at once; what a task holds are the
partially filled windows.

At the end of the split the partially filled windows are joined: the fullest
are topped up with pieces cut from the emptiest.  The one window that is then
still open is cut into windows whose lengths are powers of two, which need no
padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, slices
from tessera.llm.word_bpe import shared

END = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class Levels:
    """The level array: counts of partially filled windows by fill level, and
    the windows themselves."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)

    def choose(self, s: int) -> int:
        """Level whose use for a piece of length s (0 < s < size) makes the
        sum of squares smallest; the fullest of equal ones."""
        n, top = self.count, self.size - s
        # a window moving from h to h + s changes the sum by 2(N(h+s) - N(h)) + 2,
        # without the arriving part if it is full then; a new one by 2 N(s) + 1
        change = 2 * (n[s:self.size + 1] - n[:top + 1]) + 2
        change[top] = 1 - 2 * n[top]
        change = np.where(n[:top + 1] > 0, change, np.iinfo(np.int64).max)
        change[0] = 2 * n[s] + 1
        return top - int(np.argmin(change[::-1]))

    def place(self, s: int, piece) -> list | None:
        """Put a piece into a window; the window, if it is full then."""
        h = self.choose(s)
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
        else:
            window = []
        window.append(piece)
        if h + s == self.size:
            return window
        self.open[h + s].append(window)
        self.count[h + s] += 1
        return None

    def rest(self) -> list[tuple[int, list]]:
        """Windows still open, the fullest first."""
        return [(h, w) for h in sorted(self.open, reverse=True) for w in self.open[h]]


def _cut(piece, n: int):
    """A piece (doc, start, bytes, doc_tokens) in two, the first of n ids."""
    doc, start, ids, total = piece
    return (doc, start, ids[:4 * n], total), (doc, start + n, ids[4 * n:], total)


def join_rest(rest: list[tuple[int, list]], size: int):
    """Top up the fullest open windows from the emptiest; the last open one in
    windows of powers of two.  Yields windows."""
    first, last = 0, len(rest) - 1
    while first < last:
        fill, window = rest[first]
        while fill < size and first < last:
            have, donor = rest[last]
            piece = donor.pop()
            n = len(piece[2]) // 4
            if n > size - fill:
                piece, left = _cut(piece, size - fill)
                donor.append(left)
                n = size - fill
            window.append(piece)
            fill += n
            rest[last] = (have - n, donor)
            if not donor:
                last -= 1
        rest[first] = (fill, window)
        if fill == size:
            yield window
            first += 1
    if first == last:
        fill, window = rest[first]
        while fill:
            n = 1 << (fill.bit_length() - 1)
            part, fill = [], fill - n
            while n:
                piece = window.pop()
                m = len(piece[2]) // 4
                if m > n:
                    piece, left = _cut(piece, n)
                    window.append(left)
                    m = n
                part.append(piece)
                n -= m
            yield part


def pack(docs, size: int):
    """Windows (lists of pieces) from an iterator of (doc_id, packed ids)."""
    levels = Levels(size)
    for doc, ids in docs:
        total = len(ids) // 4
        whole = total - total % size
        for start in range(0, whole, size):
            yield [(doc, start, ids[4 * start:4 * (start + size)], total)]
        if whole < total:
            full = levels.place(total - whole, (doc, whole, ids[4 * whole:], total))
            if full:
                yield full
    yield from join_rest(levels.rest(), size)


def _packer(size: int, end: int, path: str | None):
    tail = end.to_bytes(4, "little")

    def run(batches):
        encoder = shared(path)

        def docs():
            for part in slices(batches, "text"):
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.texts(part.column("text").to_pylist())):
                    yield doc, ids + tail
            encoder.clear()

        # sequences of different splits never meet: the split number leads
        sequence, rows = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, []
        for window in pack(docs(), size):
            offset = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset))
                offset += n
            sequence += 1
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_ARROW)

    return run


def pack_documents(docs: DataFrame, size: int = 4096, end: int = END, path: str | None = None) -> DataFrame:
    """One row per piece of a document: where its ids stand in which sequence.

    A null text is empty: its document is the end id alone.  Repeated rows are
    packed each for itself; a null doc_id stays null.
    """
    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(_packer(size, end, path), SCHEMA)
