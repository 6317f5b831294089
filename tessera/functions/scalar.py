"""Column expressions (X1-X21).  All are native Catalyst expressions, so they
stay inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Case-insensitive any-of-words contains
def contains_any(col: str | Column, words: Iterable[str]) -> Column:
    import re

    pattern = "(?i)(" + "|".join(re.escape(w) for w in words) + ")"
    return _c(col).rlike(pattern)


# Value recode with a fallback (unmapped values keep their value unless
# ``default`` is given)
def recode(col: str | Column, mapping: Mapping, default: Column | None = None) -> Column:
    c = _c(col)
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == F.lit(k), F.lit(v))) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    if expr is None:
        return c if default is None else default
    return expr.otherwise(c if default is None else default)


# Dictionary lookup, unmapped -> null
def map_lookup(col: str | Column, mapping: Mapping) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*items), _c(col))


# Clip that keeps null (least/greatest alone would turn null into a bound)
def clip(col: str | Column, lo=None, hi=None) -> Column:
    c = _c(col)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


# X5
def binarize(cond: Column) -> Column:
    return cond.cast("int")


# Left-closed bins [b0,b1) [b1,b2) ... with labels; the last edge may be inf
def cut(col: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    if len(labels) != len(edges) - 1:
        raise ValueError("need len(edges)-1 labels")
    c = _c(col)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = c >= F.lit(lo)
        if not math.isinf(hi):
            cond = cond & (c < F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


# X7
def multiple_of(col: str | Column, k: int, lo: int, hi: int) -> Column:
    c = _c(col)
    return ((c % F.lit(k)) == 0) & c.between(lo, hi)


# Any of several columns equals a code
def any_equals(cols: Sequence[str | Column], code) -> Column:
    return F.array_contains(F.array(*[_c(x) for x in cols]), F.lit(code))


# All columns in a set (or zero)
def all_in(cols: Sequence[str | Column], allowed: Sequence, or_zero: bool = True) -> Column:
    allowed_arr = F.array(*[F.lit(a) for a in allowed])
    return F.forall(
        F.array(*[_c(x) for x in cols]),
        lambda x: F.array_contains(allowed_arr, x) | ((x == 0) if or_zero else F.lit(False)),
    )


# Row-wise sum; pandas skips missing (skip_null=True), R propagates it
def row_sum(cols: Sequence[str | Column], skip_null: bool = True) -> Column:
    parts = [F.coalesce(_c(x), F.lit(0)) if skip_null else _c(x) for x in cols]
    return reduce(lambda a, b: a + b, parts)


# OR-any / AND-all over indicator conditions
def any_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


# Difference that is null when either side is missing or a guard fails
def guarded_diff(a: str | Column, b: str | Column, cond: Column | None = None) -> Column:
    d = _c(a) - _c(b)
    return d if cond is None else F.when(cond, d)


# X11
def normalise_name(col: str | Column, strip_suffix: str = "", prefix: str = "") -> Column:
    c = F.lower(F.trim(_c(col)))
    if strip_suffix:
        c = F.regexp_replace(c, _escape(strip_suffix) + "$", "")
    if prefix:
        c = F.concat(F.lit(prefix), c)
    return c


def _escape(s: str) -> str:
    import re

    return re.escape(s)


# X13
def seconds_to_minutes(col: str | Column) -> Column:
    return F.floor(_c(col)) / F.lit(60.0)


def miles_to_meters(col: str | Column) -> Column:
    return _c(col) * F.lit(1609.34)


# WGS-84 box (destination points at bearing 0/90/180/270) using the
# meridional (M) and prime-vertical (N) radii of curvature at the latitude.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563


def geo_box(lat_deg: str | Column, lon_deg: str | Column, miles: float) -> dict[str, Column]:
    a = F.lit(WGS84_A)
    e2 = WGS84_F * (2 - WGS84_F)
    phi = F.radians(_c(lat_deg))
    s2 = F.pow(F.sin(phi), 2)
    w = F.sqrt(F.lit(1.0) - F.lit(e2) * s2)
    m_rad = a * F.lit(1 - e2) / F.pow(w, 3)
    n_rad = a / w
    d = F.lit(miles * 1609.344)
    dlat = F.degrees(d / m_rad)
    dlon = F.degrees(d / (n_rad * F.cos(phi)))
    lon = _c(lon_deg)
    wrap = lambda x: F.pmod(x + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)
    return {
        "lat_min": _c(lat_deg) - dlat,
        "lat_max": _c(lat_deg) + dlat,
        "lon_min": wrap(lon - dlon),
        "lon_max": wrap(lon + dlon),
    }


# X15
def elasticity_pct(coef: str | Column, rise: float = 0.10) -> Column:
    """Percent change of y for a ``rise`` relative change of x in a log-log fit."""
    return F.pow(F.lit(1.0 + rise), _c(coef)) - F.lit(1.0)


def semi_elasticity_pct(coef: str | Column) -> Column:
    """Percent change of y for a one-unit change of x (dummy) in a log-level fit."""
    return F.exp(_c(coef)) - F.lit(1.0)


# Ordered collection helpers
def ordered_list(order: str | Column, value: str | Column) -> Column:
    """collect_list in a deterministic order (aggregate expression)."""
    return F.transform(
        F.array_sort(F.collect_list(F.struct(_c(order).alias("o"), _c(value).alias("v")))),
        lambda s: s["v"],
    )


def array_total(arr: str | Column) -> Column:
    return F.aggregate(_c(arr), F.lit(0).cast("double"), lambda acc, x: acc + x)


def join_texts(texts: str | Column, sep: str = "\n\n") -> Column:
    return F.array_join(_c(texts), sep)


# X20
def fill_template(template: str | Column, **slots: str | Column) -> Column:
    out = _c(template)
    for k, v in slots.items():
        out = F.replace(out, F.lit("{" + k + "}"), _c(v))
    return out


# Python's round() is half-to-even
def round_half_even(col: str | Column, digits: int = 3) -> Column:
    return F.bround(_c(col), digits)


# K6/K7: letter counts of a lower-case word
def letter_count(word: str | Column, letter: str) -> Column:
    w = _c(word)
    return F.length(w) - F.length(F.replace(w, F.lit(letter), F.lit("")))
