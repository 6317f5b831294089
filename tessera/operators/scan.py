"""Distributed prefix sums ("scans") without a single-partition window.

A running sum over a key is usually written as a window partitioned by the
key.  That sends a whole key to one task, and a global running sum (no key)
sends the whole table to one task.  Here rows are cut into ordered buckets on
``(keys, order)`` so a hot key is split across many tasks:

1. bucket boundaries are taken from a sample (at most ~64 rows per bucket
   reach the driver), and each row's bucket is a native expression, so every
   branch of the plan assigns the same bucket to a row;
2. rows are hash-partitioned by bucket; a window partitioned by
   ``(bucket, keys)`` gives local running sums with no further shuffle;
3. per-(bucket, key) totals come from a partial aggregate (tiny shuffle), and
   the carry of a key from earlier buckets is a window over those totals.
   Only a key that continues from an earlier bucket needs a carry: at most
   one per bucket, so the carry table is bounded by the bucket count and safe
   to broadcast.

Order columns must be non-null and form a total order within a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BKT = "__scan_bkt"
_SAMPLE_PER_BUCKET = 64


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _bucket_expr(row: Column, bounds: list[Column], lo: int, hi: int) -> Column:
    """Number of boundaries <= row, as a balanced comparison tree over
    ``bounds[lo:hi]`` (log depth)."""
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(row >= bounds[mid], _bucket_expr(row, bounds, mid + 1, hi)).otherwise(
        _bucket_expr(row, bounds, lo, mid)
    )


def ordered_buckets(df: DataFrame, sort_cols: Sequence[str | Column], n: int) -> Column:
    """A column giving each row its bucket 0..n-1 in ``sort_cols`` order."""
    cols = _cols(sort_cols)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])
    keyed = df.select(key.alias("__k"))
    total = keyed.count()
    if total == 0 or n <= 1:
        return F.lit(0)
    frac = min(1.0, _SAMPLE_PER_BUCKET * n / total)
    sample = keyed.sample(withReplacement=False, fraction=frac, seed=17) if frac < 1.0 else keyed
    rows = [r["__k"] for r in sample.orderBy("__k").collect()]
    if not rows:
        return F.lit(0)
    picks = []
    for i in range(1, n):
        r = rows[min(len(rows) - 1, (i * len(rows)) // n)]
        if not picks or tuple(r) != tuple(picks[-1]):
            picks.append(r)
    dtype = keyed.schema["__k"].dataType
    bounds = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, dtype.fields)]) for r in picks
    ]
    return _bucket_expr(key, bounds, 0, len(bounds))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, str | Column],
    num_partitions: int | None = None,
) -> DataFrame:
    """Add inclusive running sums ``out = sum(expr)`` per key in ``order``."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tmp = {f"__scan_v{i}": (F.col(e) if isinstance(e, str) else e) for i, e in enumerate(sums.values())}
    base = df.select("*", *[c.alias(k) for k, c in tmp.items()])
    bucketed = base.withColumn(_BKT, ordered_buckets(base, [*keys, *order], n))

    w = (
        Window.partitionBy(_BKT, *keys)
        .orderBy(*_cols(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = bucketed.repartition(n, _BKT).select("*", *[F.sum(k).over(w).alias(k + "_loc") for k in tmp])

    totals = bucketed.groupBy(_BKT, *keys).agg(*[F.sum(k).alias(k + "_tot") for k in tmp])
    kw = Window.partitionBy(*keys).orderBy(_BKT) if keys else Window.orderBy(_BKT)
    carry = totals.select(
        _BKT,
        *keys,
        *[
            F.coalesce(F.sum(k + "_tot").over(kw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(
                k + "_carry"
            )
            for k in tmp
        ],
        F.row_number().over(kw).alias("__scan_nth"),
    ).where(F.col("__scan_nth") > 1)
    # a key continues from an earlier bucket at most once per bucket
    joined = local.join(F.broadcast(carry.drop("__scan_nth")), [_BKT, *keys], "left")
    return joined.select(
        *df.columns,
        *[
            (F.col(k + "_loc") + F.coalesce(F.col(k + "_carry"), F.lit(0))).alias(name)
            for name, k in zip(sums.keys(), tmp)
        ],
    )


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """1-based row number in a total ``order`` over the whole frame."""
    return running_sums(df, [], order, {name: F.lit(1).cast("long")})


def midranks(hist: DataFrame, value: str, count: str = "n", name: str = "midrank") -> DataFrame:
    """Mid-ranks of a distinct-value histogram ``(value, n)``: rows with equal
    values share the average of the ranks they occupy."""
    cum = running_sums(hist, [], [value], {"__cum": F.col(count)})
    return cum.select(
        *hist.columns,
        (F.col("__cum") - (F.col(count) - F.lit(1)) / F.lit(2.0)).alias(name),
    )
