"""Hard-negative mining by Fagin's threshold algorithm.

Vectors are dealt to blocks by a hash of their id.  In each block every
dimension has its candidates sorted once.  For an anchor the lists are read
from the end its component's sign asks for; every vector met is scored at once
by its integer inner product (random access), and the sum of the anchor's
components times the values last read bounds the score of all vectors not yet
met (the threshold).  A search ends when the threshold lies strictly below the
k-th score of each of the anchor's windows, so ties are never lost.  The best
rows of the blocks are merged per window.

Every anchor meets every block: a stated query set against all rows, in
blocks.  A task holds one block and one batch of anchors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import only
from tessera.session import scratch_path


@dataclass(frozen=True)
class Mining:
    positives: int = 5  # best rows of the anchor's label
    negatives: int = 10  # rows of other labels per positive
    low: int = 30  # window in hundredths of the positive's score
    high: int = 90
    scale: int = 256  # a component x counts floor(scale * x)
    block_rows: int = 16384  # vectors of a block: bounds a task's memory
    first_depth: int = 32  # entries read of each list before the first test


class SortedLists:
    """A block of vectors with its candidates sorted per dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, first_depth: int = Mining.first_depth):
        self.ids, self.labels, self.first_depth = ids, labels, first_depth
        # products and sums stay exact: doubles, longs, or Python's integers
        top = int(np.abs(vectors).max(initial=0)) + 1
        bound = top * top * max(vectors.shape[1], 1)
        self.x = vectors.astype(np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object)
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.x, self.order, axis=0)

    def search(self, anchor: np.ndarray, among: np.ndarray, low: list[int | None], high: list[int | None], k: int):
        """For each window low <= score <= high (None: open) the indices and
        scores of its first k rows where ``among`` holds, by score, then id."""
        n = len(self.ids)
        a = anchor.astype(np.int64)
        if self.x.dtype != np.int64 or int(np.abs(a).max(initial=0)) ** 2 * max(len(a), 1) >= 1 << 53:
            a = a.astype(self.x.dtype)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met, rows, scores = np.zeros(n, bool), [], []
        depth, step = 0, self.first_depth
        while True:
            end = min(depth + step, n)
            now = np.zeros(n, bool)
            if len(up) + len(down):
                now[self.order[n - end:n - depth, up]] = True  # sorted access
                now[self.order[depth:end, down]] = True
                now &= ~met
            else:
                now[:], end = True, n  # a zero anchor scores all rows alike
            met |= now
            new = np.flatnonzero(now & among)
            rows.append(new)
            scores.append(self._score(new, a))  # random access
            depth, step = end, 2 * step
            if depth >= n or met.all():
                break
            unmet = (a[up] * self.values[n - depth, up]).sum() + (a[down] * self.values[depth - 1, down]).sum()
            if self._settled(unmet, scores, low, high, k):
                break
        row, score = np.concatenate(rows), np.concatenate(scores)
        for lo, hi in zip(low, high):
            yield self._first(row, score, lo, hi, k)

    def _score(self, rows: np.ndarray, a: np.ndarray) -> np.ndarray:
        if 4 * len(rows) > len(self.ids):
            return (self.x @ a)[rows]
        return self.x[rows] @ a

    @staticmethod
    def _settled(unmet, scores, low, high, k) -> bool:
        """No row not yet met can be among the first k of any window."""
        if any(hi is not None and unmet >= hi and (lo is None or lo <= hi) for lo, hi in zip(low, high)):
            return False
        score = np.concatenate(scores)
        for lo, hi in zip(low, high):
            if (lo is not None and unmet < lo) or (lo is not None and hi is not None and lo > hi):
                continue
            inside = score[SortedLists._inside(score, lo, hi)]
            if len(inside) < k or unmet >= np.partition(inside, len(inside) - k)[len(inside) - k]:
                return False
        return True

    @staticmethod
    def _inside(score, lo, hi):
        ok = np.ones(len(score), bool)
        if lo is not None:
            ok &= (score >= lo).astype(bool)
        if hi is not None:
            ok &= (score <= hi).astype(bool)
        return ok

    def _first(self, row, score, lo, hi, k):
        ok = np.flatnonzero(self._inside(score, lo, hi))
        if len(ok) > k:
            kth = np.partition(score[ok], len(ok) - k)[len(ok) - k]
            ok = ok[(score[ok] >= kth).astype(bool)]
        ok = ok[np.lexsort((self.ids[row[ok]], -score[ok]))][:k]
        return row[ok], score[ok]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; a shorter one counts as zero beyond its end."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, first_depth: int):
    """(block's lists, batch of its anchors) of a stream sorted by block, rows
    before anchors."""
    block, parts, lists = None, [], None
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        is_anchor = batch.column("is_anchor").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (is_anchor[1:] != is_anchor[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if blocks[lo] != block:
                block, parts, lists = blocks[lo], [], None
            if not is_anchor[lo]:
                parts.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("q"), dims)))
                continue
            if not parts:
                continue
            if lists is None:
                lists = SortedLists(*map(np.concatenate, zip(*parts)), first_depth)
            yield lists, part


def vectors(embeddings: DataFrame, label: Column | None = None, scale: int = Mining.scale) -> DataFrame:
    """vec_id, label, q: the rows that take part, one per vec_id.

    Left out are rows with a null id, label or vector and rows with a null or
    non-finite component.  Components become floor(scale * x), x as double.  If
    a vec_id repeats, its smallest (label, q) stands for it.  A component
    beyond 2^31 after scaling raises.
    """
    e = only(embeddings, "vec_id", "label", "embedding")
    x = F.transform("embedding", lambda c: c.cast("double"))
    e = e.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("int").alias("label"), x.alias("x"))
    fine = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    e = e.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
    e = e.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("int")).alias("q"))
    return e.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("v")).select("vec_id", "v.label", "v.q")


def _met(items: DataFrame, anchors: DataFrame, m: Mining, run, schema: str) -> DataFrame:
    """``run(lists, anchors)`` of every block with all anchors."""
    n, dims = items.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    spread = min(-(-n // 1024), items.sparkSession.sparkContext.defaultParallelism)
    blocks = max(-(-n // m.block_rows), spread, 1)
    none = F.lit(None).cast(anchors.schema["windows"].dataType)
    rows = items.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("is_anchor"),
                        "vec_id", "label", "q", none.alias("windows"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("is_anchor"),
                           "vec_id", "label", "q", "windows")
    parts = min(blocks, 16384)
    dealt = rows.unionByName(asked).repartitionById(parts, F.col("block") % parts).sortWithinPartitions("block", "is_anchor", "vec_id")

    def each(batches):
        for lists, part in _blocks(batches, dims, m.first_depth):
            yield from run(lists, part, _matrix(part.column("q"), dims))

    return dealt.mapInArrow(each, schema)


def hard_negatives(items: DataFrame, anchors: DataFrame, m: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    ``items``: vec_id (unique), label, q (integers), as from ``vectors``;
    ``anchors``: some of its rows.  Positives of an anchor are its first
    ``m.positives`` other rows of its label, by score, then vec_id; for each,
    the first ``m.negatives`` rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score.  An anchor
    without a row of its label, or a positive without a row in its window, has
    no result; a shorter vector counts as zero beyond its end; empty tables
    give an empty result.
    """
    spark = items.sparkSession

    def positives(lists, part, q):
        out = []
        ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
        for anchor, label, vector in zip(ids, labels, q):
            among = (lists.labels == label) & (lists.ids != anchor)
            for row, score in lists.search(vector, among, [None], [None], m.positives):
                out += zip([anchor] * len(row), lists.ids[row], score)
        yield _batch(out, ["anchor_id", "positive_id", "score"])

    def negatives(lists, part, q):
        out = []
        ids, labels, asked = part.column("vec_id").to_numpy(), part.column("label").to_numpy(), part.column("windows").to_pylist()
        for anchor, label, windows, vector in zip(ids, labels, asked, q):
            best = [w["score"] for w in windows]
            low, high = [-(-m.low * s // 100) for s in best], [m.high * s // 100 for s in best]
            for w, (row, score) in zip(windows, lists.search(vector, lists.labels != label, low, high, m.negatives)):
                out += zip([anchor] * len(row), [w["positive_id"]] * len(row), [w["score"]] * len(row), lists.ids[row], score)
        yield _batch(out, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    window_type = "array<struct<score:long,positive_id:long>>"
    asked = anchors.select("vec_id", "label", "q", F.lit(None).cast(window_type).alias("windows"))
    found = _met(items, asked, m, positives, "anchor_id long, positive_id long, score long")
    by = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= m.positives)
    windows = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("score", "positive_id"))).alias("windows"))
    path = scratch_path(spark, "anchors")  # both searches read it; a lost executor does not repeat the first
    anchors.select("vec_id", "label", "q").join(windows, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id").write.parquet(path)
    found = _met(items, spark.read.parquet(path), m, negatives,
                 "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    by = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= m.negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], pa.int64()) for c in columns], names=names)


def mine(embeddings: DataFrame, m: Mining = Mining()) -> DataFrame:
    """Hard negatives of the table with labels moved on by one (modulo 10)
    where vec_id is divisible by 7 and anchors where it is divisible by 100."""
    spark = embeddings.sparkSession
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    path = scratch_path(spark, "vectors")
    vectors(embeddings, moved, m.scale).write.parquet(path)
    items = spark.read.parquet(path)
    return hard_negatives(items, items.where(F.col("vec_id") % 100 == 0), m)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS rn FROM s WHERE same) WHERE rn <= 5)
SELECT anchor_id, positive_id, CAST(rn AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rn
  FROM p JOIN s ON p.anchor_id = s.anchor_id
  WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score) WHERE rn <= 10
"""
