"""Retrieval over documents (R*): chunking, similarity top-k, MMR, prompts.

Chunking is a per-row transformation (native ``sequence``/``substring`` for
fixed windows, ``mapInPandas`` for the recursive splitter).  Similarity search
scores every corpus vector against a small query set inside each partition
with one matrix product (Arrow batches), keeps a partial top-k per query and
partition, and merges the partial lists with a per-query ``row_number``; the
merge sees at most k rows per query per partition.  Large query sets and the
nearest-neighbour index are in ``vector_index``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import vector_index as VI
from tessera.operators.parallel import spread


# ------------------------------------------------------------------ chunking
def chunk_fixed(df: DataFrame, text: str, size: int, overlap: int, keep: Sequence[str] = ()) -> DataFrame:
    """Fixed windows of ``size`` characters starting every ``size - overlap``
    characters; ``split_id`` numbers the chunks of a row from 0.

    The text is cut once into consecutive blocks of ``size - overlap``
    characters (one linear regex pass); chunk i is block i followed by the
    first ``overlap`` characters of block i+1.  Taking a substring of the whole
    text per chunk would rescan the UTF-8 text from its start for every chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), 0)
    ex = spread(df.select(*keep, text)).select(*keep, blocks.alias("__b")).select(
        *keep, "__b", F.posexplode("__b").alias("split_id", "__blk"))
    nxt = F.coalesce(F.try_element_at(F.col("__b"), F.col("split_id") + 2), F.lit(""))
    return ex.select(
        *keep, "split_id", (F.col("split_id") * step).alias("start"),
        F.concat(F.col("__blk"), F.substring(nxt, 1, overlap)).alias("chunk"),
    )


DEFAULT_SEPARATORS = ("\n\n", "\n", " ", "")


def _merge(pieces: list[str], sep: str, size: int, overlap: int) -> list[str]:
    """Greedily pack pieces (joined by ``sep``) into chunks of at most
    ``size`` characters, carrying a tail of at most ``overlap`` characters."""
    out: list[str] = []
    cur: list[str] = []
    total = 0
    for p in pieces:
        add = len(p) + (len(sep) if cur else 0)
        if cur and total + add > size:
            out.append(sep.join(cur))
            while cur and (total > overlap or total + len(p) + (len(sep) if cur else 0) > size):
                total -= len(cur[0]) + (len(sep) if len(cur) > 1 else 0)
                cur.pop(0)
        cur.append(p)
        total = sum(len(x) for x in cur) + len(sep) * (len(cur) - 1)
    if cur:
        out.append(sep.join(cur))
    return [c for c in out if c.strip()]


def recursive_split(text: str, size: int, overlap: int, separators: Sequence[str] = DEFAULT_SEPARATORS) -> list[str]:
    """Split on the first separator present; pieces still longer than
    ``size`` are split again with the next separators, short pieces are
    merged back up to ``size`` with ``overlap``."""
    if text is None:
        return []
    sep = separators[-1]
    rest: Sequence[str] = ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[i + 1:]
            break
    pieces = list(text) if sep == "" else text.split(sep)
    chunks: list[str] = []
    good: list[str] = []
    for p in pieces:
        if len(p) <= size:
            good.append(p)
            continue
        if good:
            chunks += _merge(good, sep, size, overlap)
            good = []
        if rest:
            chunks += recursive_split(p, size, overlap, rest)
        else:
            chunks += [p[i:i + size] for i in range(0, len(p), max(1, size - overlap))]
    if good:
        chunks += _merge(good, sep, size, overlap)
    return chunks


def chunk_recursive(df: DataFrame, id_col: str, text: str, size: int = 256, overlap: int = 16) -> DataFrame:
    """Recursive-separator chunks (doc id, split_id, chunk) via mapInPandas;
    each task handles whole documents of its partition."""
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType),
        T.StructField("split_id", T.IntegerType()),
        T.StructField("chunk", T.StringType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, sids, chunks = [], [], []
            for i, t in zip(b[id_col], b[text]):
                for j, c in enumerate(recursive_split(t, size, overlap)):
                    ids.append(i)
                    sids.append(j)
                    chunks.append(c)
            yield pd.DataFrame({id_col: ids, "split_id": pd.Series(sids, dtype="int32"), "chunk": chunks})

    return spread(df.select(id_col, text)).mapInPandas(run, schema)


# ------------------------------------------------------------------ similarity
def centroids(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean vector per key (element-wise), as array<double>."""
    ex = df.select(key, F.posexplode(vec).alias("pos", "x"))
    m = ex.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return m.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("query_vec"))


def topk_similarity(corpus: DataFrame, id_col: str, vec_col: str, queries: DataFrame, qid: str, qvec: str,
                    k: int, threshold: float | None = None, digits: int = 4, broadcast_queries: int = 1024,
                    q_block: int = 1024) -> DataFrame:
    """Top-k corpus rows by cosine similarity for every query.

    Scores are rounded to ``digits`` (half away from zero) before ranking and
    ties go to the smaller corpus id, so the order is total.  A query set of at
    most ``broadcast_queries`` rows is shipped to the tasks and the corpus is
    not shuffled before the per-partition top-k; a larger one stays a table and
    meets the corpus in blocks (``vector_index.exact_topk``).  For an index in
    place of a full scan see ``vector_index``.
    """
    qrows = queries.select(qid, qvec).limit(broadcast_queries + 1).collect()
    if len(qrows) > broadcast_queries:
        return VI.exact_topk(corpus, id_col, vec_col, queries, qid, qvec, k, threshold, digits)
    if not qrows:
        return VI.exact_topk(corpus.limit(0), id_col, vec_col, queries, qid, qvec, k, threshold, digits)
    qids = [r[0] for r in qrows]
    qmat = np.array([np.asarray(r[1], dtype=np.float64) for r in qrows])
    qn = qmat / np.linalg.norm(qmat, axis=1, keepdims=True)
    spark = corpus.sparkSession
    try:
        bq = spark.sparkContext.broadcast((qids, qn))
        get_q = lambda: bq.value
    except Exception:  # noqa: BLE001 - no SparkContext (remote session): ship with the function
        get_q = lambda: (qids, qn)
    id_type = corpus.schema[id_col].dataType
    q_type = queries.schema[qid].dataType
    schema = T.StructType([T.StructField(qid, q_type), T.StructField(id_col, id_type),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Streaming per-partition top-k: memory is one Arrow batch times a
        block of queries plus k candidates per query, whatever the corpus."""
        ids_q, qm = get_q()
        nq = len(ids_q)
        best_id: list = [None] * nq
        best_sc = [np.empty(0) for _ in range(nq)]
        for b in batches:
            if len(b) == 0:
                continue
            m = np.stack([np.asarray(v, dtype=np.float64) for v in b[vec_col]])
            m = m / np.linalg.norm(m, axis=1, keepdims=True)
            ids = b[id_col].to_numpy()
            for lo in range(0, nq, q_block):
                sc = VI.round_half_away(m @ qm[lo:lo + q_block].T, digits)  # rows x block
                for jj in range(sc.shape[1]):
                    j = lo + jj
                    col = sc[:, jj]
                    keep = np.ones(len(col), dtype=bool) if threshold is None else col >= threshold
                    if len(col) > k:
                        kth = np.partition(col, len(col) - k)[len(col) - k]
                        keep &= col >= kth  # ties at the boundary are kept
                    prev = best_id[j] if best_id[j] is not None else ids[:0]
                    cid = np.concatenate([prev, ids[keep]])
                    csc = np.concatenate([best_sc[j], col[keep]])
                    order = np.lexsort((cid, -csc))[:k]
                    best_id[j], best_sc[j] = cid[order], csc[order]
        out_q, out_id, out_s = [], [], []
        for j, q in enumerate(ids_q):
            if best_id[j] is None:
                continue
            out_q += [q] * len(best_id[j])
            out_id += best_id[j].tolist()
            out_s += best_sc[j].tolist()
        if out_q:
            yield pd.DataFrame({qid: out_q, id_col: out_id, "score": out_s})

    partial = spread(corpus.select(id_col, vec_col)).mapInPandas(run, schema)
    w = Window.partitionBy(qid).orderBy(F.desc("score"), F.asc(id_col))
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mmr_rerank(cands: DataFrame, qid: str, id_col: str, vec_col: str, qvec_col: str, k: int,
               lambda_mult: float = 0.5) -> DataFrame:
    """Maximal marginal relevance (Carbonell & Goldstein 1998) over the
    fetched candidates of each query (a bounded group: fetch_k rows)."""
    out_schema = T.StructType([T.StructField(qid, cands.schema[qid].dataType),
                               T.StructField(id_col, cands.schema[id_col].dataType),
                               T.StructField("mmr_rank", T.IntegerType())])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col).reset_index(drop=True)
        m = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col]])
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        q = np.asarray(pdf[qvec_col].iloc[0], dtype=np.float64)
        q = q / np.linalg.norm(q)
        rel = m @ q
        chosen: list[int] = []
        rest = list(range(len(pdf)))
        while rest and len(chosen) < k:
            if chosen:
                red = (m[rest] @ m[chosen].T).max(axis=1)
            else:
                red = np.zeros(len(rest))
            score = lambda_mult * rel[rest] - (1 - lambda_mult) * red
            i = rest[int(np.argmax(score))]
            chosen.append(i)
            rest.remove(i)
        return pd.DataFrame({qid: pdf[qid].iloc[[c for c in chosen]].to_numpy(),
                             id_col: pdf[id_col].iloc[chosen].to_numpy(),
                             "mmr_rank": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    return cands.groupBy(qid).applyInPandas(pick, out_schema)


def context_of(ranked: DataFrame, qid: str, rank: str, text: str, sep: str = "\n\n") -> DataFrame:
    """Join the retrieved texts of each query in rank order."""
    return ranked.groupBy(qid).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t")))),
                                 lambda s: s["t"]), sep).alias("context"))


def fill(template: str | Column, **slots: Column) -> Column:
    out = F.lit(template) if isinstance(template, str) else template
    for k, v in slots.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out
