"""Relational operators: projections, filters, joins, aggregations, windows,
set operations (P*, J*, A*, W*, U* of the inventory).

Every function takes and returns DataFrames and only composes Catalyst
operators; physical choices (broadcast vs sort-merge, skew splitting) are left
to the optimizer and AQE unless a side has a proven size bound.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.quantiles import quantiles_and
from tessera.operators.scan import global_row_number, midranks


def _c(x):
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- P / S
def rename_project(df: DataFrame, renames: Mapping[str, str] = (), drop: Sequence[str] = ()) -> DataFrame:
    out = df.drop(*drop)
    for a, b in dict(renames).items():
        out = out.withColumnRenamed(a, b)
    return out


def dict_projection(df: DataFrame, dictionary: DataFrame, var_col="variable", title_col="title") -> DataFrame:
    """Select and rename columns as listed in a (variable, title) dictionary
    table.  The dictionary has one row per column, so collecting it is bounded
    by the schema width, not by the data."""
    pairs = dictionary.select(var_col, title_col).collect()
    if len(pairs) > 10_000:
        raise ValueError("dictionary larger than any sane schema")
    return df.select(*[F.col(r[0]).alias(r[1]) for r in pairs])


def not_in_keep_null(col: str | Column, values: Sequence) -> Column:
    """R's ``!x %in% v`` keeps missing rows; SQL NOT IN would drop them."""
    c = _c(col)
    return c.isNull() | ~c.isin(*values)


def threshold_counts(df: DataFrame, col: str, thresholds: Sequence, name="threshold", out="n_rows") -> DataFrame:
    """Counts of ``col <= t`` for a family of thresholds in one scan."""
    aggs = [F.count_if(F.col(col) <= F.lit(t)).alias(f"__t{i}") for i, t in enumerate(thresholds)]
    one = df.agg(*aggs)
    return one.select(
        F.inline(
            F.array(*[F.struct(F.lit(t).alias(name), F.col(f"__t{i}").alias(out)) for i, t in enumerate(thresholds)])
        )
    )


# ---------------------------------------------------------------- H
def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent (1 decimal) per column, only columns with gaps,
    most missing first.  One aggregate pass, then a tiny unpivot."""
    cols = list(cols or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = agg.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col(c).alias("n_missing"),
                        F.round(F.lit(100.0) * F.col(c) / F.col("__n"), 1).alias("pct_missing"),
                    )
                    for c in cols
                ]
            )
        )
    )
    return rows.where(F.col("n_missing") > 0).orderBy(F.desc("n_missing"), "column_name")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left and removed after each cumulative predicate, one pass."""
    conds: list[Column] = []
    aggs = [F.count(F.lit(1)).alias("__c0")]
    acc = None
    for i, (_, cond) in enumerate(steps, start=1):
        acc = cond if acc is None else acc & cond
        aggs.append(F.count_if(acc).alias(f"__c{i}"))
        conds.append(acc)
    one = df.agg(*aggs)
    names = ["all rows"] + [n for n, _ in steps]
    structs = []
    for i, nm in enumerate(names):
        removed = F.lit(0).cast("long") if i == 0 else F.col(f"__c{i - 1}") - F.col(f"__c{i}")
        structs.append(
            F.struct(
                F.lit(i).alias("step"),
                F.lit(nm).alias("step_name"),
                F.col(f"__c{i}").alias("rows_left"),
                removed.alias("rows_removed"),
            )
        )
    return one.select(F.inline(F.array(*structs)))


def assert_implies(df: DataFrame, premise: Column, conclusion: Column, by: Sequence[str] = ()) -> DataFrame:
    holds = F.bool_and(~premise | conclusion).alias("holds")
    return df.groupBy(*by).agg(holds) if by else df.agg(holds)


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


# ---------------------------------------------------------------- joins
def transfer_links(stops: DataFrame, stations: DataFrame, station="station", line="line",
                   transfer="transfer_time") -> DataFrame:
    """Transfers at stations served by two or more lines, in hub form: one row
    per (station, line) with the station's transfer time.  The pairwise form
    (every ordered pair of lines at a station) is quadratic in the lines per
    station; the hub form gives the same shortest paths with linear size."""
    served = stops.select(station, line).distinct()
    multi = served.groupBy(station).agg(F.count(F.lit(1)).alias("__n_lines")).where("__n_lines >= 2")
    return served.join(multi.select(station), station).join(stations.select(station, transfer), station)


def successor_join(stops: DataFrame, line="line", seq="seq", station="station") -> DataFrame:
    """Next stop on the same line: every pair of its stops at seq and seq + 1,
    as an equi join on (line, seq + 1) gives them, from a window over the line,
    so that stops dealt by their line are not dealt again."""
    known = stops.where(F.col(line).isNotNull() & F.col(seq).isNotNull())
    after = Window.partitionBy(line).orderBy(seq).rangeBetween(1, 1)
    pairs = known.select(
        F.col(line).alias("line"), F.col(seq).alias("from_seq"), F.col(station).alias("from_station"),
        F.collect_list(F.struct(F.col(station).alias("to_station"))).over(after).alias("__next"))
    return pairs.select("line", "from_seq", "from_station", F.inline("__next"))


def successor_lead(stops: DataFrame, line="line", seq="seq", station="station") -> DataFrame:
    """Same as :func:`successor_join` when sequences have no gaps."""
    w = Window.partitionBy(line).orderBy(seq)
    nxt = stops.select(
        F.col(line).alias("line"),
        F.col(seq).alias("from_seq"),
        F.col(station).alias("from_station"),
        F.lead(station).over(w).alias("to_station"),
        F.lead(seq).over(w).alias("__next_seq"),
    )
    return nxt.where(F.col("__next_seq") == F.col("from_seq") + 1).drop("__next_seq")


def undirected_join(segments: DataFrame, table: DataFrame, a="a", b="b", s1="station_1", s2="station_2") -> DataFrame:
    """``(a=s1 and b=s2) or (a=s2 and b=s1)`` rewritten as an equi join on the
    unordered pair, so the planner can hash/sort-merge instead of a cartesian
    product."""
    left = segments.withColumn("__lo", F.least(a, b)).withColumn("__hi", F.greatest(a, b))
    right = table.withColumn("__lo", F.least(s1, s2)).withColumn("__hi", F.greatest(s1, s2)).drop(s1, s2)
    return left.join(right, ["__lo", "__hi"]).drop("__lo", "__hi")


def box_range_join(points: DataFrame, boxes: DataFrame, px: str, py: str, bx_lo: str, bx_hi: str,
                   by_lo: str, by_hi: str, cell: float, how: str = "left",
                   x_wrap: tuple[float, float] | None = None, y_wrap: tuple[float, float] | None = None) -> DataFrame:
    """2-D inclusive box join by grid bucketing: each box is exploded into the
    grid cells it touches (<= 4 when ``cell`` >= box side), points carry their
    own cell, equi join on the cell, then the exact predicate.  A point lies in
    exactly one cell, so no duplicate pairs arise.  A hot cell is handled by
    AQE's skew-join split of the point side.

    With ``how='left'`` a box without a point gives one row with null point
    columns.  ``x_wrap`` / ``y_wrap`` are the ends of a circular axis (such as
    longitude): a box with low > high then reaches over them.
    """
    c = F.lit(float(cell))

    def ranges(lo, hi, wrap):
        whole = F.array(F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi")))
        kind = boxes.schema[lo].dataType
        if wrap:
            ends = [F.lit(w).cast(kind) for w in wrap]
            over = F.array(F.struct(F.col(lo).alias("lo"), ends[1].alias("hi")), F.struct(ends[0].alias("lo"), F.col(hi).alias("hi")))
            whole = F.when(F.col(lo) > F.col(hi), over).otherwise(whole)
        return F.explode(F.filter(whole, lambda r: r["lo"] <= r["hi"]))

    bx = boxes.select("*", ranges(bx_lo, bx_hi, x_wrap).alias("__rx")).select("*", ranges(by_lo, by_hi, y_wrap).alias("__ry"))
    for grid, r in (("__gx", "__rx"), ("__gy", "__ry")):
        bx = bx.select("*", F.explode(F.sequence(F.floor(F.col(f"{r}.lo") / c), F.floor(F.col(f"{r}.hi") / c))).alias(grid))
    pt = points.select("*", F.floor(F.col(px) / c).alias("__gx"), F.floor(F.col(py) / c).alias("__gy"))
    cond = (
        (bx["__gx"] == pt["__gx"])
        & (bx["__gy"] == pt["__gy"])
        & pt[px].between(bx["__rx.lo"], bx["__rx.hi"])
        & pt[py].between(bx["__ry.lo"], bx["__ry.hi"])
    )
    found = bx.join(pt, cond).drop("__gx", "__gy", "__rx", "__ry")
    if how == "inner":
        return found
    if how != "left":
        raise ValueError(f"how is 'inner' or 'left', not {how!r}")
    hit = found.select(*[F.col(f"`{b}`").alias(f"__hit_{i}") for i, b in enumerate(boxes.columns)]).distinct()
    same = [F.col(f"`{b}`").eqNullSafe(F.col(f"__hit_{i}")) for i, b in enumerate(boxes.columns)]
    on = same[0]
    for one in same[1:]:
        on = on & one
    empty = boxes.join(hit, on, "left_anti")
    return found.unionByName(empty.select("*", *[F.lit(None).cast(points.schema[p].dataType).alias(p) for p in points.columns]))


def max_rows(df: DataFrame) -> int | None:
    """Upper bound on the row count that the optimizer can prove (a LIMIT,
    a global aggregate, a literal table), or None."""
    try:
        opt = df._jdf.queryExecution().optimizedPlan().maxRows()
        return int(opt.get()) if opt.isDefined() else None
    except Exception:  # noqa: BLE001 - no JVM plan access (remote session)
        return None


def bounded_broadcast(df: DataFrame, bound: int) -> DataFrame:
    """Broadcast hint only when the plan proves at most ``bound`` rows;
    otherwise leave the join strategy to the optimizer and AQE."""
    n = max_rows(df)
    return F.broadcast(df) if n is not None and n <= bound else df


def membership_flag(df: DataFrame, keys: DataFrame, on: str, name: str, bound: int) -> DataFrame:
    """0/1 flag for rows whose key is in ``keys`` (e.g. a top-N list).  The
    key list is broadcast when its plan proves at most ``bound`` rows."""
    flag = keys.select(on).distinct().withColumn(name, F.lit(1))
    return df.join(bounded_broadcast(flag, bound), on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def tiered_resolve(names: DataFrame, dim: DataFrame, name_col: str, dim_name: str, dim_key: str,
                   overrides: Mapping[str, str]) -> DataFrame:
    """Resolve free names to a dimension: manual override, then exact, then
    normalised (``_`` -> space, lower case), else null; reports the tier."""
    norm = lambda c: F.lower(F.regexp_replace(c, "_", " "))
    d = dim.select(F.col(dim_key).alias("__key"), F.col(dim_name).alias("__dname"))
    exact = d.select(F.col("__dname").alias("__exact_name"), F.col("__key").alias("__k_exact"))
    normd = d.select(norm(F.col("__dname")).alias("__norm_name"), F.col("__key").alias("__k_norm"))
    ov = [(k, v) for k, v in overrides.items()]
    spark = names.sparkSession
    ovdf = spark.createDataFrame(ov or [("", "")], "__ov_from string, __ov_to string")
    ovk = ovdf.join(d, ovdf.__ov_to == d.__dname).select("__ov_from", F.col("__key").alias("__k_manual"))
    out = (
        names.join(F.broadcast(ovk), names[name_col] == ovk.__ov_from, "left")
        .join(exact, names[name_col] == exact.__exact_name, "left")
        .join(normd, norm(names[name_col]) == normd.__norm_name, "left")
    )
    key = F.coalesce("__k_manual", "__k_exact", "__k_norm")
    tier = (
        F.when(F.col("__k_manual").isNotNull(), "manual")
        .when(F.col("__k_exact").isNotNull(), "exact")
        .when(F.col("__k_norm").isNotNull(), "normalised")
    )
    return out.select(F.col(name_col), key.alias(dim_key), tier.alias("tier"))


# ---------------------------------------------------------------- aggregates
def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def value_share(df: DataFrame, col: str, digits: int = 6) -> DataFrame:
    """Share of each value; the total is a scalar subquery, not a global window."""
    counts = value_counts(df, col)
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(col, "n", F.round(F.col("n") / total, digits).alias("share"))


def share_per_row(df: DataFrame, col: str, digits: int = 6) -> DataFrame:
    """Attach the share of the row's value (aggregate + join back)."""
    shares = value_share(df, col, digits).select(col, "share")
    return df.join(shares, col, "left")


def top_n_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """Most frequent keys, ties broken by key (partial top-k per partition)."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(n)
    )


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).fillna(0, subset=list(values))


def describe(df: DataFrame, cols: Sequence[str], exact: bool = True, digits: int = 6) -> DataFrame:
    """count, mean, sd, min, quartiles, max per column, long format; quartiles
    are exact (``quantiles``) or, with ``exact=False``, from a sketch."""
    qs = [0.25, 0.5, 0.75]
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"__n{i}"), F.avg(c).alias(f"__mean{i}"), F.stddev_samp(c).alias(f"__sd{i}"),
                 F.min(c).cast("double").alias(f"__min{i}"), F.max(c).cast("double").alias(f"__max{i}")]
    if exact:
        quartiles, row = quantiles_and(df, cols, qs, aggs)
    else:
        row = df.agg(*aggs, *[F.percentile_approx(F.col(c).cast("double"), qs, 10000).alias(f"__q{i}") for i, c in enumerate(cols)]).first()
        quartiles = {c: row[f"__q{i}"] or [None] * len(qs) for i, c in enumerate(cols)}
    rows = []
    for i, c in enumerate(cols):
        numbers = {"mean": row[f"__mean{i}"], "sd": row[f"__sd{i}"], "min": row[f"__min{i}"],
                   **dict(zip(("q25", "q50", "q75"), quartiles[c])), "max": row[f"__max{i}"]}
        rounded = [F.round(F.lit(x).cast("double"), digits).alias(name) for name, x in numbers.items()]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(row[f"__n{i}"]).cast("long").alias("n"), *rounded))
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def fixed_histogram(df: DataFrame, col: str, width: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(col) / F.lit(width)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def coverage_with_gaps(df: DataFrame, period: str, key: str) -> DataFrame:
    """Distinct keys per period, with 0 for periods inside the range that
    have no row (periods generated by ``sequence`` from one min/max row)."""
    per = df.groupBy(period).agg(F.countDistinct(key).alias("n_keys"))
    rng = df.agg(F.min(period).alias("lo"), F.max(period).alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias(period)
    )
    return rng.join(per, period, "left").select(period, F.coalesce("n_keys", F.lit(0)).alias("n_keys"))


def pick_at(df: DataFrame, key: str, cond: Column, value: str | Column, name: str) -> Column:  # noqa: ARG001
    """Conditional pick: value where cond holds (null when absent)."""
    return F.max(F.when(cond, _c(value))).alias(name)


def unpivot_counts(df: DataFrame, group: Sequence[str], indicators: Mapping[str, Column],
                   name="indicator", out="n_on") -> DataFrame:
    """Counts of each 0/1 indicator per group (unpivot + sum)."""
    agg = df.groupBy(*group).agg(*[F.count_if(c).alias(f"__i{i}") for i, c in enumerate(indicators.values())])
    arr = F.array(*[F.struct(F.lit(k).alias(name), F.col(f"__i{i}").alias(out)) for i, k in enumerate(indicators)])
    return agg.select(*group, F.inline(arr))


# ---------------------------------------------------------------- windows / ranking
def argmin_per_group(df: DataFrame, group: str, by: Sequence[str], pick: Sequence[str]) -> DataFrame:
    """Row with the smallest ``by`` tuple per group (the tuple must be a total
    order).  A struct min is a plain aggregate: partial aggregation keeps a hot
    group from landing whole in one task."""
    st = F.min(F.struct(*[F.col(b) for b in by], *[F.col(p).alias(f"__p_{p}") for p in pick])).alias("__m")
    g = df.groupBy(group).agg(st)
    return g.select(group, *[F.col("__m")[b].alias(b) for b in by if b not in pick],
                    *[F.col("__m")[f"__p_{p}"].alias(p) for p in pick])


def top_k_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int, name="rank") -> DataFrame:
    """Top-k rows per group by ``row_number``; Spark plans a WindowGroupLimit
    before the shuffle so at most k rows per group per task travel."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def split_by_rank(df: DataFrame, order: Sequence[str], bounds: Mapping[str, int], name="split") -> DataFrame:
    """First-n-by-key split: rank rows by ``order`` (distributed), then label
    consecutive rank ranges; the last label takes the rest."""
    ranked = global_row_number(df, order, "rn")
    expr = None
    lo = 0
    labels = list(bounds.items())
    for lab, size in labels[:-1]:
        cond = F.col("rn") <= lo + size
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
        lo += size
    expr = expr.otherwise(labels[-1][0]) if expr is not None else F.lit(labels[-1][0])
    return ranked.withColumn(name, expr)


def value_midranks(df: DataFrame, col: str) -> DataFrame:
    hist = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return midranks(hist, col, "n", "midrank")


# ---------------------------------------------------------------- scalar / schema
def narrow_integral(df: DataFrame) -> DataFrame:
    """Cast every floating column whose non-null values are all integral to
    bigint; one aggregate decides for all columns."""
    fl = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    if not fl:
        return df
    flags = df.agg(*[F.bool_and(F.col(c).isNull() | (F.col(c) == F.floor(F.col(c)))).alias(c) for c in fl]).first()
    narrow = {c for c in fl if flags[c]}
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in narrow else F.col(c) for c in df.columns])


def schema_table(df: DataFrame) -> DataFrame:
    """Schema as rows (name, type, nullable, non-null count); the counts come
    from one aggregate pass."""
    counts = df.agg(*[F.count(F.col(f.name)).alias(f"__c{i}") for i, f in enumerate(df.schema.fields)])
    arr = F.array(
        *[
            F.struct(
                F.lit(i).cast("int").alias("position"), F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("nullable"),
                F.col(f"__c{i}").alias("non_null"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counts.select(F.inline(arr))


def is_finite(x: float) -> bool:
    return not (math.isnan(x) or math.isinf(x))
