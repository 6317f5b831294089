"""Exact quantiles of many columns without a sort of the table or a map of all
distinct values in one task.

A column of few distinct values is counted per value.  For others approximate
quantiles (a bounded sketch) bracket each wanted rank; one
aggregate counts the rows below and inside the brackets, which also proves
them; brackets that still hold many rows are narrowed the same way; the values
inside are counted per value and the rank is read from their running sum.
Two passes for few values, four for others up to about 10^9 rows, more beyond.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

_ACCURACY = 1000  # of the sketch: a bracket holds about 4 / _ACCURACY of the rows
_FEW_VALUES = 20_000  # distinct values up to which a whole column is counted per value
_BRACKET_ROWS = 4_000_000  # rows of a bracket that are counted per value


class _Wanted:
    """Ranks low and high (0-based) of one column, bracketed by values."""

    def __init__(self, name: str, column: Column, low: int, high: int, least: float, most: float):
        self.name, self.v, self.low, self.high = name, column, low, high
        self.whole = self.bracket = (least, most)
        self.below, self.inside = 0, None

    def has(self) -> Column:
        return self.v.between(F.lit(self.bracket[0]), F.lit(self.bracket[1]))

    def pivots(self) -> Column:
        n = self.inside
        at = [min(max((r - self.below + 0.5) / n + s * 2 / _ACCURACY, 0.0), 1.0) for r, s in ((self.low, -1), (self.high, 1))]
        return F.percentile_approx(F.when(self.has(), self.v), at, _ACCURACY)


def _counted(df: DataFrame, wanted: list[_Wanted]) -> None:
    """Rows below and inside each bracket; one that misses its ranks is opened again."""
    aggs = [c for i, w in enumerate(wanted) for c in (
        F.count_if(w.v < F.lit(w.bracket[0])).alias(f"b{i}"), F.count_if(w.has()).alias(f"i{i}"))]
    row = df.agg(*aggs).first()
    missed = []
    for i, w in enumerate(wanted):
        w.below, w.inside = row[f"b{i}"], row[f"i{i}"]
        if not w.below <= w.low <= w.high < w.below + w.inside:
            w.bracket = w.whole
            missed.append(w)
    if missed:
        _counted(df, missed)


def exact_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of the non-null values of each column."""
    return quantiles_and(df, cols, qs, [])[0]


def quantiles_and(df: DataFrame, cols: Sequence[str], qs: Sequence[float], also: Sequence[Column]) -> tuple[dict[str, list[float | None]], Row]:
    """``exact_quantiles`` and a row with further named aggregates, which the
    first pass computes along."""
    v = {c: F.col(f"`{c}`").cast("double") for c in cols}
    eps = 2 / _ACCURACY
    ends = [min(max(q + s * eps, 0.0), 1.0) for q in qs for s in (-1, 1)]
    # plain aggregates run in generated code as long as no sketch is among them
    first = df.agg(*[a for i, c in enumerate(cols) for a in (
        F.count(v[c]).alias(f"n{i}"), F.min(v[c]).alias(f"min{i}"), F.max(v[c]).alias(f"max{i}"),
        F.approx_count_distinct(v[c]).alias(f"distinct{i}"))], *also).first()
    many = [i for i in range(len(cols)) if first[f"distinct{i}"] > _FEW_VALUES]
    if many:
        pivots = df.agg(*[F.percentile_approx(v[cols[i]], ends, _ACCURACY).alias(f"p{i}") for i in many]).first()
    wanted: dict[tuple[str, int], _Wanted] = {}
    todo = []
    for i, c in enumerate(cols):
        for j, q in enumerate(qs):
            if first[f"n{i}"]:
                at = (first[f"n{i}"] - 1) * q
                w = _Wanted(c, v[c], math.floor(at), math.ceil(at), first[f"min{i}"], first[f"max{i}"])
                wanted[c, j] = w
                if i in many:
                    w.bracket = (pivots[f"p{i}"][2 * j], pivots[f"p{i}"][2 * j + 1])
                    todo.append(w)
    if todo:
        _counted(df, todo)
    while todo := [w for w in todo if w.inside > _BRACKET_ROWS and w.bracket[0] < w.bracket[1]]:
        rows = df.agg(*[w.pivots().alias(f"p{i}") for i, w in enumerate(todo)]).first()
        before = [w.inside for w in todo]
        for i, w in enumerate(todo):
            w.bracket = tuple(rows[f"p{i}"])
        _counted(df, todo)
        todo = [w for w, n in zip(todo, before) if w.inside <= n / 2]  # a value of great weight is counted as it is
    found = _ranked(df, list(wanted.items()))
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = []
        for j, q in enumerate(qs):
            if not first[f"n{i}"]:
                out[c].append(None)
                continue
            low, high = found[c, j]
            at = (first[f"n{i}"] - 1) * q
            out[c].append(low + (high - low) * (at - math.floor(at)))
    return out, first


def _ranked(df: DataFrame, wanted: list[tuple]) -> dict:
    """The values at the wanted ranks, from counts per value in the brackets."""
    found = {key: (w.bracket[0],) * 2 for key, w in wanted if w.bracket[0] == w.bracket[1]}
    rest = [(key, w) for key, w in wanted if key not in found]
    if not rest:
        return found
    # one count per value and bracket, whatever the number of ranks in it
    groups: dict[tuple, list] = {}
    for i, (_, w) in enumerate(rest):
        groups.setdefault((w.name, w.bracket), []).append((i, w))
    counts = None
    for k, g in enumerate(groups.values()):  # a scan each, with the bracket as its filter
        w = g[0][1]
        part = df.where(w.has()).groupBy(w.v.alias("v")).count().withColumn("id", F.lit(k))
        counts = part if counts is None else counts.unionByName(part)
    upto = Window.partitionBy("id").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = F.create_map(*[x for k, g in enumerate(groups.values()) for x in (F.lit(k), F.array(*[
        F.struct(F.lit(i).alias("key"), F.lit(w.low - w.below).cast("long").alias("low"), F.lit(w.high - w.below).cast("long").alias("high")) for i, w in g]))])
    cum = counts.withColumn("cum", F.sum("count").over(upto)).select("v", "cum", F.inline(ranks[F.col("id")]))
    rows = cum.groupBy("key").agg(F.min(F.when(F.col("cum") > F.col("low"), F.col("v"))).alias("a"),
                                  F.min(F.when(F.col("cum") > F.col("high"), F.col("v"))).alias("b")).collect()
    return found | {rest[r.key][0]: (r.a, r.b) for r in rows}
