"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes of a text: h <- 2h + G[byte], so h
depends on the last 32 bytes alone and is computed for all positions at once.
A chunk ends where the hash has zeros under a mask: a strict mask up to the
normal size, a loose one beyond (normalised chunking), never before the least
size and always at the greatest.  The fingerprint is the set of chunk digests
with the chunks' lengths; the likeness of two is the length of the chunks they
share over the length of the shorter one's chunks (containment).  Boundaries
follow content, so an insertion changes only the chunks around it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, slices


@dataclass(frozen=True)
class Chunking:
    least: int = 48
    normal: int = 128
    greatest: int = 512
    strict_bits: int = 8
    loose_bits: int = 6


# one pseudo-random 32-bit word per byte value, from a seeded generator
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=0x6EA2) for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum over j < 32 of G[data[i - j]] << j, by doubling the span."""
    h = _GEAR[data]
    span = 1
    while span < 32:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] << np.uint32(span) if len(h) > span else 0
        h = h + shifted
        span *= 2
    return h


def boundaries(data: bytes, c: Chunking = Chunking()) -> list[int]:
    """Ends of the chunks of ``data``, the last one its length."""
    n = len(data)
    if not n:
        return []
    h = gear_hashes(np.frombuffer(data, np.uint8)) >> np.uint32(32 - c.strict_bits)
    strict = np.flatnonzero(h == 0)
    loose = np.flatnonzero(h >> np.uint32(c.strict_bits - c.loose_bits) == 0)
    # next candidate at or behind a place, in plain lists
    s, w, i, j, ends, start = strict.tolist() + [n], loose.tolist() + [n], 0, 0, [], 0
    while n - start > c.least:
        low, mid, high = start + c.least - 1, start + c.normal - 1, min(start + c.greatest, n) - 1
        while s[i] < low:
            i += 1
        if s[i] <= mid:
            end = s[i]
        else:
            while w[j] <= mid:
                j += 1
            end = w[j]
        start = min(end, high) + 1
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_set(data: bytes, c: Chunking = Chunking()) -> dict[int, int]:
    """Length of each distinct chunk by its 64-bit digest."""
    out, start = {}, 0
    for end in boundaries(data, c):
        out[xxhash.xxh3_64_intdigest(data[start:end])] = end - start
        start = end
    return out


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Shared length over the shorter one's; two empty sets are alike (1.0),
    an empty and a filled one are not (0.0)."""
    if not a or not b:
        return float(not a and not b)
    shared = sum(n for d, n in a.items() if d in b)
    return shared / min(sum(a.values()), sum(b.values()))


def as_string(chunks: dict[int, int]) -> str:
    """Sorted digests with their lengths; equal texts give equal strings."""
    return " ".join(f"{d:016x}:{n}" for d, n in sorted(chunks.items()))


def from_string(fingerprint: str) -> dict[int, int]:
    return {int(d, 16): int(n) for d, n in (x.split(":") for x in fingerprint.split())}


def fingerprints(docs: DataFrame, chunking: Chunking = Chunking()) -> DataFrame:
    """doc_id and fingerprint of every row; null and empty texts have ''."""

    def run(batches):
        for part in slices(batches, "text"):
            found = [as_string(chunk_set(t, chunking)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return _bytes(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _bytes(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, next_doc_id long"
)


def in_order(docs: DataFrame, per_range: int = 8192) -> DataFrame:
    """Rows (part, carried, doc_id, text) in ranges of descending doc_id (null
    ids last, equal ids by text); the first row of each range stands again,
    marked ``carried``, behind the range before it, that of the first range
    behind the last.

    One shuffle moves each text once.  The driver sees one cut point and one
    id per range, a fixed fraction (1 / per_range) of the rows' ids.
    """
    spark = docs.sparkSession
    d = _bytes(docs)
    ids = d.select("doc_id")
    ranges = max(1, -(-ids.count() // per_range))
    shares = [k / ranges for k in range(1, ranges)]
    found = ids.stat.approxQuantile("doc_id", shares, 0.1 / ranges) if shares else []
    cuts = np.array(sorted({int(x) for x in found}), np.int64)

    @F.pandas_udf("int")
    def part(doc_id: pd.Series) -> pd.Series:
        null = doc_id.isna().to_numpy()
        at = len(cuts) - np.searchsorted(cuts, doc_id.fillna(0).to_numpy().astype(np.int64), side="right")
        return pd.Series(np.where(null, len(cuts) + 1, at).astype(np.int32))

    heads = sorted((r["part"], r["head"]) for r in ids.groupBy(part("doc_id").alias("part")).agg(F.max("doc_id").alias("head")).collect())
    # one row per range: its size is that of the cut points
    before = [(heads[k][1], heads[k - 1][0]) for k in range(len(heads))]
    carry = F.broadcast(spark.createDataFrame(before, "head long, before int"))
    placed = d.join(carry, d["doc_id"].eqNullSafe(carry["head"]), "left").select(
        "doc_id", "text", F.explode(F.array_compact(F.array(
            F.struct(part("doc_id").alias("part"), F.lit(False).alias("carried")),
            F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(True).alias("carried"))),
        ))).alias("to"),
    ).select("to.part", "to.carried", "doc_id", "text")
    return placed.repartition(len(heads) or 1, "part").sortWithinPartitions("part", "carried", F.desc_nulls_last("doc_id"), "text")


def edit_likeness(docs: DataFrame, chunking: Chunking = Chunking()) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of its
    code points replaced by the first as many of the next document's, by
    descending doc_id, the first one's behind the last.

    Null texts are empty.  Of rows with equal doc_id the next one is that with
    the next text; null doc_ids come last.
    """

    def run(batches):
        def rows():
            for part in slices(batches, "text"):
                yield from zip(*(part.column(c).to_pylist() for c in ("part", "carried", "doc_id", "text")))

        def described():
            for part, carried, doc, data in rows():
                yield part, carried, doc, data.decode(), chunk_set(data, chunking)

        def compared():
            last = None
            for row in described():
                # of several carried rows (equal ids) the first one counts
                if last and last[0] == row[0] and not last[1]:
                    yield last, row
                last = row

        out = []
        for (_, _, doc, text, own), (_, _, next_doc, next_text, following) in compared():
            half = len(text) // 2
            edited = (text[:len(text) - half] + next_text[:half]).encode()
            changed = chunk_set(edited, chunking)
            out.append((
                doc, len(text), hashlib.sha256(edited).hexdigest(), as_string(own), as_string(changed),
                likeness(own, changed), likeness(own, following), next_doc,
            ))
            if len(out) >= 2000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return in_order(docs).mapInArrow(run, SCHEMA)


def _batch(rows) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])
