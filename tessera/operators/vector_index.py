"""Nearest-neighbour search over vectors: exact in blocks, or by an inverted
file (coarse cells learnt from a sample, probed per query, re-ranked exactly).

Both meet queries and vectors in blocks: vectors and the queries that ask for
them are dealt to the same key and sorted, vectors first, so that a task holds
one block of vectors (at most ``block_rows``) and one batch of queries,
whatever their numbers.  A block asked by very many queries is dealt several
times, each time with a share of them.  Neither side passes the driver; what it
sees are the cell centres and per-cell counts, at most ``MAX_CELLS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import scratch_path

BLOCK_ROWS = 16384
QUERIES_PER_SHARE = 65536
QUERY_BATCH = 256
MAX_CELLS = 4096


def round_half_away(x: np.ndarray, digits: int) -> np.ndarray:
    f = 10.0 ** digits
    return np.sign(x) * np.floor(np.abs(x) * f + 0.5) / f


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of an Arrow list column as rows of length one (zero vectors stay zero)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def first_k(scores: np.ndarray, ids: np.ndarray, k: int, threshold: float | None) -> np.ndarray:
    """Places of the k best scores (of those at least ``threshold``), ties by id."""
    at = np.arange(len(scores)) if threshold is None else np.flatnonzero(scores >= threshold)
    if len(at) > k:
        kth = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= kth]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _blocks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple]:
    """(ids, unit vectors) of each block with batches of its queries, of a
    stream sorted by block, vectors first."""
    block, parts, ready = None, [], None
    for batch in batches:
        blocks = batch.column(key).to_numpy()
        asks = batch.column("__asks").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if blocks[lo] != block:
                block, parts, ready = blocks[lo], [], None
            if not asks[lo]:
                parts.append((part.column("__id").to_numpy(zero_copy_only=False), unit_rows(part.column("__vec"))))
            elif parts:
                if ready is None:
                    ready = tuple(map(np.concatenate, zip(*parts)))
                for start in range(0, part.num_rows, QUERY_BATCH):
                    yield *ready, part.slice(start, QUERY_BATCH)


def _met(rows: DataFrame, asked: DataFrame, qid: str, id_col: str, k: int, threshold: float | None, digits: int) -> DataFrame:
    """Top-k of every query over the blocks it asks: ``rows`` (__block, __id,
    __vec), ``asked`` (__block, __q, __vec)."""
    id_type, q_type = rows.schema["__id"].dataType, asked.schema["__q"].dataType
    vec = T.ArrayType(T.DoubleType())
    stream = rows.select("__block", F.lit(False).alias("__asks"), "__id", F.lit(None).cast(q_type).alias("__q"), F.col("__vec").cast(vec).alias("__vec")).unionByName(
        asked.select("__block", F.lit(True).alias("__asks"), F.lit(None).cast(id_type).alias("__id"), "__q", F.col("__vec").cast(vec).alias("__vec")))
    stream = stream.repartition("__block").sortWithinPartitions("__block", "__asks")
    schema = T.StructType([T.StructField(qid, q_type), T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())])

    def run(batches):
        for ids, m, queries in _blocks(batches, "__block"):
            scores = round_half_away(unit_rows(queries.column("__vec")) @ m.T, digits)
            found = [first_k(s, ids, k, threshold) for s in scores]
            many = np.array([len(f) for f in found])
            at = np.concatenate(found)
            which = np.repeat(np.arange(len(found)), many)
            yield pa.RecordBatch.from_arrays([
                queries.column("__q").take(pa.array(which)),
                pa.array(ids[at].tolist(), queries.schema.field("__id").type),
                pa.array(scores[which, at], pa.float64()),
            ], names=[qid, id_col, "score"])

    best = Window.partitionBy(qid).orderBy(F.desc("score"), F.asc(id_col))
    return stream.mapInArrow(run, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _usable(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Rows with an id and a vector without null components."""
    return df.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull()))


def exact_topk(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, qid: str, qvec: str, k: int,
               threshold: float | None = None, digits: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top-k by cosine similarity of every query against every vector: (qid,
    id, score, rank).  Scores are rounded half away from zero to ``digits``
    before ranking; ties go to the smaller id.  Every query meets every block.
    """
    c = _usable(corpus, id_col, vec_col).select(F.col(id_col).alias("__id"), F.col(vec_col).alias("__vec"))
    q = _usable(queries, qid, qvec).select(F.col(qid).alias("__q"), F.col(qvec).alias("__vec"))
    n = c.count()
    parallel = min(-(-n // 1024), corpus.sparkSession.sparkContext.defaultParallelism)
    blocks = max(-(-n // block_rows), parallel, 1)
    rows = c.withColumn("__block", F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("long"))
    asked = q.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return _met(rows, asked, qid, id_col, k, threshold, digits)


# ------------------------------------------------------------------ inverted file
@dataclass(frozen=True)
class VectorIndex:
    """Vectors as Parquet, one folder per cell; ``centres`` are the cells'
    unit centres, ``counts`` their numbers of rows."""

    path: str
    id_col: str
    centres: np.ndarray
    counts: np.ndarray
    block_rows: int


def _nearest(df: DataFrame, vec: str, centres: np.ndarray, n: int) -> DataFrame:
    """``df`` with __cells: the n cells whose centres are nearest, in order."""
    sent = df.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*df.schema.fields, T.StructField("__cells", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = unit_rows(batch.column(vec).cast(pa.list_(pa.float64()))) @ sent.value.T
            some = np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)
            offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * some.shape[1])
            cells = pa.ListArray.from_arrays(offsets, pa.array(some.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "__cells"])

    return df.mapInArrow(run, schema)


def build_index(corpus: DataFrame, id_col: str, vec_col: str, cells: int | None = None, sample_rows: int = 65536,
                block_rows: int = BLOCK_ROWS, seed: int = 11) -> VectorIndex:
    """Inverted file over all rows of ``corpus``: centres by k-means (cosine)
    on about ``sample_rows`` rows chosen by a hash of their id, every row filed
    under its nearest centre.  ``cells`` is the square root of the rows unless
    given, at most MAX_CELLS; a cell of any size is cut into blocks."""
    spark = corpus.sparkSession
    c = _usable(corpus, id_col, vec_col).select(F.col(id_col).alias("__id"), F.col(vec_col).cast("array<double>").alias("__vec"))
    n = c.count()
    k = max(1, min(cells or round(n ** 0.5), MAX_CELLS))
    share = min(1.0, sample_rows / max(n, 1))
    sample = c.where(F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    norm = F.sqrt(F.aggregate("__vec", F.lit(0.0), lambda s, x: s + x * x))
    sample = sample.withColumn("__norm", norm).where("__norm > 0").select(array_to_vector("__vec").alias("features"))
    centres = np.zeros((0, 0))
    if n and k > 1 and not sample.isEmpty():
        fit = KMeans(k=k, maxIter=10, initSteps=2, seed=seed, distanceMeasure="cosine").fit(sample)
        centres = np.array(fit.clusterCenters())
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    path = scratch_path(spark, "vector-index")
    filed = _nearest(c, "__vec", centres, 1).withColumn("__cell", F.get("__cells", 0)).drop("__cells") if len(centres) else c.withColumn("__cell", F.lit(0))
    salted = filed.repartition("__cell", F.pmod(F.xxhash64("__id"), F.lit(max(-(-n // (k * block_rows)), 1))))
    salted.write.partitionBy("__cell").parquet(path) if n else filed.withColumn("__cell", F.lit(0)).write.parquet(path)
    counts = np.zeros(max(len(centres), 1), np.int64)
    for cell, many in spark.read.parquet(path).groupBy("__cell").count().collect():
        counts[cell] = many
    return VectorIndex(path, id_col, centres, counts, block_rows)


def search(index: VectorIndex, queries: DataFrame, qid: str, qvec: str, k: int, probes: int = 8,
           threshold: float | None = None, digits: int = 4) -> DataFrame:
    """Top-k of every query among the vectors of its ``probes`` nearest cells,
    ranked as ``exact_topk`` does.  Only probed cells are read."""
    spark = queries.sparkSession
    q = _usable(queries, qid, qvec).select(F.col(qid).alias("__q"), F.col(qvec).cast("array<double>").alias("__vec"))
    if len(index.centres):
        q = _nearest(q, "__vec", index.centres, min(probes, len(index.centres))).select("__q", "__vec", F.explode("__cells").alias("__cell"))
    else:
        q = q.withColumn("__cell", F.lit(0))
    path = scratch_path(spark, "probes")
    q.write.parquet(path)
    q = spark.read.parquet(path)
    asked = {cell: many for cell, many in q.groupBy("__cell").count().collect()}  # at most MAX_CELLS rows
    if not asked:
        asked = {0: 0}
    salts = {c: max(-(-int(index.counts[c]) // index.block_rows), 1) for c in asked}
    shares = {c: max(-(-many // QUERIES_PER_SHARE), 1) for c, many in asked.items()}

    def per_cell(values: dict[int, int]) -> Column:
        if all(v == 1 for v in values.values()):
            return F.lit(1)
        many = F.create_map(*[F.lit(x) for c, v in values.items() if v > 1 for x in (c, v)])
        return F.coalesce(F.try_element_at(many, F.col("__cell")), F.lit(1))

    def block(salt: Column, share: Column) -> Column:
        return F.xxhash64("__cell", salt, share)

    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    rows = spark.read.parquet(index.path).where(F.col("__cell").isin(*asked))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__id"), per_cell(salts)).cast("int")).withColumn("__share", F.explode(up_to(per_cell(shares))))
    q = q.withColumn("__share", F.pmod(F.xxhash64("__q"), per_cell(shares)).cast("int")).withColumn("__salt", F.explode(up_to(per_cell(salts))))
    return _met(rows.withColumn("__block", block(F.col("__salt"), F.col("__share"))), q.withColumn("__block", block(F.col("__salt"), F.col("__share"))),
                qid, index.id_col, k, threshold, digits)


def recall(found: DataFrame, exact: DataFrame, qid: str, id_col: str) -> float:
    """Share of the exact neighbours that were found."""
    hit = exact.select(qid, id_col).join(found.select(qid, id_col, F.lit(1).alias("__hit")), [qid, id_col], "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("__hit", F.lit(0))), F.lit(1.0))).first()[0]


def probes_for(index: VectorIndex, queries: DataFrame, qid: str, qvec: str, k: int, target: float = 0.95, sample_queries: int = 512) -> int:
    """Least number of probed cells that finds ``target`` of the exact top-k
    for about ``sample_queries`` queries, chosen by a hash of their id: the
    cells of their neighbours are ranked by nearness to the query."""
    if len(index.centres) < 2:
        return 1
    spark = queries.sparkSession
    q = _usable(queries, qid, qvec)
    share = min(1.0, sample_queries / max(q.count(), 1))
    some = q.where(F.pmod(F.xxhash64(qid, F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(qid, F.col(qvec).cast("array<double>").alias(qvec))
    rows = spark.read.parquet(index.path)
    best = exact_topk(rows, "__id", "__vec", some, qid, qvec, k)
    near = _nearest(some, qvec, index.centres, len(index.centres)).select(qid, "__cells")
    place = F.array_position("__cells", F.col("__cell")).alias("place")
    ranks = best.join(rows.select("__id", "__cell"), "__id").join(near, qid).select(place).groupBy("place").count().orderBy("place").collect()
    total, seen = sum(r["count"] for r in ranks), 0
    for r in ranks:
        seen += r["count"]
        if seen >= target * total:
            return int(r["place"])
    return 1
