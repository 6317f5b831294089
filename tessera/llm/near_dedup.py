"""MinHash near-dedup: one-permutation hashing, bands, star-shaped candidates.

* A document's set is its distinct 2-word shingles as 64-bit hashes.  Documents
  with the same set form one class, known by the set's 128-bit digest; from
  here on classes are compared, so copies cost nothing.
* One permutation: the hashes fall into ``bins`` by their top bits, the least
  of each bin is kept.  An empty bin takes the value of the first filled bin on
  its own pseudo-random way through all bins (optimal densification).
* ``rows`` values make a band key.  In every bucket of a band the classes are
  linked to one class of the bucket only: a star, not all pairs.  Candidate
  links are confirmed on the full sets.
* A star can miss a link between two of its points that are both unlike its
  centre.  Buckets that still hold more than one component are taken up again:
  their members outside the largest component are compared with all others of
  the buckets with the same centre, in blocks.

With 32 bands of 4, two sets of similarity 0.8 share no bucket with
probability 5e-8.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import only, slices, utf8
from tessera.session import scratch_path


@dataclass(frozen=True)
class Params:
    bins: int = 128
    rows: int = 4
    percent: int = 80


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all 64."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingles:
    """Sorted distinct shingle hashes of texts; word hashes are kept up to
    ``limit``."""

    def __init__(self, limit: int = 300_000):
        self.limit, self.cache = limit, {}

    def of(self, data: bytes) -> np.ndarray:
        """Of the A-Z lower-cased words of UTF-8 bytes: distinct 2-word
        shingles; a single word is a shingle by itself; no words, no shingles."""
        words = data.lower().split()
        if len(self.cache) > self.limit:
            self.cache = {}
        for w in set(words).difference(self.cache):
            self.cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
        if len(h) < 2:
            return _mix(h)
        return np.unique(_mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]))


class Signature:
    """Band keys of sorted distinct hashes."""

    def __init__(self, p: Params):
        self.p, self.shift = p, np.uint64(64 - int(math.log2(p.bins)))
        self.starts = np.arange(p.bins, dtype=np.uint64) << self.shift
        rng = np.random.default_rng(20_17)
        # the way of each bin: itself first, then all others in an order of its own
        self.way = np.array([np.concatenate([[i], rng.permutation(np.delete(np.arange(p.bins), i))]) for i in range(p.bins)])
        bands = p.bins // p.rows
        self.seed = _mix(np.arange(1, bands + 1, dtype=np.uint64))

    def values(self, hashes: np.ndarray) -> np.ndarray:
        first = np.searchsorted(hashes, self.starts)
        filled = np.append(first[1:], len(hashes)) > first
        value = hashes[np.minimum(first, len(hashes) - 1)]
        if filled.all():
            return value
        donor = self.way[np.arange(self.p.bins), np.argmax(filled[self.way], axis=1)]
        return value[donor]

    def bands(self, hashes: np.ndarray) -> np.ndarray:
        v = self.values(hashes).reshape(-1, self.p.rows)
        key = self.seed
        for j in range(self.p.rows):
            key = _mix(key ^ v[:, j])
        return key.view(np.int64)


def signatures(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, v (digest of the set, null if empty), bands."""

    def run(batches):
        shingles, signature = Shingles(), Signature(p)
        for part in slices(batches, "text"):
            n, v, bands = [], [], []
            for data in part.column("text").to_pylist():
                s = shingles.of(data)
                n.append(len(s))
                v.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(signature.bands(s) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(v, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "v", "bands"],
            )

    return _bytes(docs).mapInArrow(run, "doc_id long, n_shingles long, v binary, bands array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """v and shingles (sorted distinct hashes) of texts with a word."""

    def run(batches):
        shingles = Shingles()
        for part in slices(batches, "text"):
            sets = [s for s in map(shingles.of, part.column("text").to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["v", "shingles"],
            )

    return _bytes(docs).select("text").mapInArrow(run, "v binary, shingles array<bigint>")


def _bytes(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), utf8(F.col("text")).alias("text"))


def _written(df: DataFrame, spark: SparkSession, base: str, name: str) -> DataFrame:
    """The frame as a table of its own in the shared folder: cuts the lineage,
    and later stages survive the loss of executors."""
    path = f"{base}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(spark: SparkSession, edges: DataFrame, base: str, name: str) -> DataFrame:
    """(v, comp) of the vertices of edges (a, b): comp is the least vertex of
    the component.  Rounds of taking the least label around, then that label's
    own label, until nothing changes."""
    both = _written(edges.select("a", "b").union(edges.select("b", "a")), spark, base, f"{name}-both")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("comp"))
    labels = _written(labels, spark, base, f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both["b"] == labels["v"]).groupBy(F.col("a").alias("u")).agg(F.min("comp").alias("near"))
        spread = labels.join(near, labels["v"] == near["u"]).select("v", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        top = labels.select(F.col("v").alias("w"), F.col("comp").alias("top"))
        new = spread.join(top, spread["comp"] == top["w"], "left").select("v", "old", F.least("comp", F.coalesce("top", "comp")).alias("comp"))
        new = _written(new, spark, base, f"{name}-{step}")
        labels = new.select("v", "comp")
        if new.filter("old <> comp").isEmpty():
            return labels


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) whose full sets reach the similarity."""
    sa = sets.select(F.col("v").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("v").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(sa, "a").join(sb, "b").select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("n")).filter(
        F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent
    ).select("a", "b")


def _able(na: str, nb: str, percent: int):
    """Whether set sizes allow the similarity."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _class_sets(docs: DataFrame, sig: DataFrame, classes: DataFrame) -> DataFrame:
    """(v, shingles) of the given classes, from one text of each."""
    wanted = classes.join(sig.groupBy("v").agg(F.min("doc_id").alias("doc_id"), F.count("doc_id").alias("ids")), "v")
    chosen = only(docs, "doc_id", "text").join(wanted.filter("ids > 0").select("doc_id"), "doc_id", "left_semi")
    if not wanted.filter("ids = 0").isEmpty():  # classes of rows without doc_id only
        chosen = chosen.unionByName(only(docs, "doc_id", "text").filter("doc_id IS NULL"))
    return full_sets(chosen).dropDuplicates(["v"])


def _meet(percent: int):
    """Links between the queries (kind 1) and the members (kind 0) of a block,
    of different components, by counting common shingles through an index."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members, queries = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
        out = []
        if len(members) and len(queries):
            sets = members["shingles"].tolist()
            size = np.array([len(x) for x in sets])
            owner = np.repeat(np.arange(len(sets)), size)
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            v, comp = members["v"].to_numpy(), members["comp"].to_numpy()
            for q, c, x in zip(queries["v"], queries["comp"], queries["shingles"]):
                low, high = np.searchsorted(flat, x), np.searchsorted(flat, x, side="right")
                n = high - low
                # all index entries of the query's shingles in a row
                at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(sets))
                for k in np.flatnonzero(common * 100 >= (size + len(x) - common) * percent):
                    if comp[k] != c:
                        out.append((min(q, v[k]), max(q, v[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    return run


def _behind_centres(members: DataFrame, comps: DataFrame, sets: DataFrame, p: Params, block: int = 2_000_000) -> DataFrame:
    """Links that the stars left open: of two members of a bucket, neither its
    centre, in different components.

    Buckets with one centre form a unit.  The members outside of a unit's
    largest component are compared with all its members, in blocks of about
    ``block`` shingles on either side, so a large unit is many tasks and each
    holds two blocks; only links come out.
    """
    placed = members.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("one"), F.max("comp").alias("two")).filter("one <> two")
    unit = placed.join(mixed.select("bucket"), "bucket").select("cv", "v", "n", "comp").distinct()
    sizes = unit.groupBy("cv", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    largest = sizes.groupBy("cv").agg(F.max(F.struct("k", "comp", "n")).alias("m"), F.sum("n").alias("n")).select(
        "cv", F.col("m.comp").alias("largest"), F.ceil(F.col("n") / block).cast("int").alias("blocks"),
        F.greatest(F.ceil((F.col("n") - F.col("m.n")) / block), F.lit(1)).cast("int").alias("turns"),
    )
    rows = unit.join(largest, "cv")
    # a member stands in its block for every turn, a query in its turn for every block
    as_member = rows.select("cv", "v", "comp", F.pmod(F.xxhash64("v"), "blocks").cast("int").alias("block"),
                            F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(0).alias("kind"))
    queries = rows.filter("comp <> largest")
    as_query = queries.select("cv", "v", "comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                              F.pmod(F.xxhash64("v", F.lit(1)), "turns").cast("int").alias("turn"), F.lit(1).alias("kind"))
    met = as_member.unionByName(as_query).join(sets, "v")
    return met.groupBy("cv", "block", "turn").applyInPandas(_meet(p.percent), "a binary, b binary").distinct()


def similar_classes(spark: SparkSession, docs: DataFrame, sig: DataFrame, base: str, p: Params = Params()) -> DataFrame | None:
    """(v, comp) of the classes that are linked to another one; None if there
    are none."""
    classes = sig.filter("v IS NOT NULL").groupBy("v").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    rows = classes.select("v", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1")
    held = _written(rows.join(shared, "bucket"), spark, base, "held")
    if held.isEmpty():
        return None
    # a bucket's centre is the member whose buckets are the fullest: of a text
    # and its edited copies mostly the text, which is like all of them
    fullness = held.groupBy("v").agg(F.sum("k").alias("full"))
    ranked = held.join(fullness, "v")
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("full", "v", "n")).alias("c"))
    members = _written(
        held.join(centres.select("bucket", F.col("c.v").alias("cv"), F.col("c.n").alias("cn")), "bucket").drop("k"), spark, base, "members"
    )
    sets = _written(_class_sets(docs, sig, members.select("v").distinct()), spark, base, "sets")
    star = _pair(members.filter((F.col("v") != F.col("cv")) & _able("n", "cn", p.percent)), "v", "cv").distinct()
    edges = _written(_linked(star, sets, p.percent), spark, base, "stars")
    comps = components(spark, edges, base, "first")
    more = _written(_behind_centres(members, comps, sets, p), spark, base, "more")
    if more.isEmpty():
        return comps
    return components(spark, edges.unionByName(more), base, "second")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Null, empty and blank texts have no shingles and are linked with nothing.
    Repeated rows are copies of each other; rows without doc_id take part, but
    a component's id is its least doc_id (null if it has none).
    """
    spark = docs.sparkSession
    base = scratch_path(spark, "near-dedup")
    sig = _written(signatures(docs, p), spark, base, "signatures")
    comps = similar_classes(spark, docs, sig, base, p)
    classes = sig.filter("v IS NOT NULL").groupBy("v").agg(F.min("doc_id").alias("least"))
    if comps is not None:
        c = classes.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
        classes = c.join(c.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("v", "component_id")
    else:
        classes = classes.withColumnRenamed("least", "component_id")
    out = sig.select("doc_id", "n_shingles", "v").join(classes, "v", "left")
    comp = F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
