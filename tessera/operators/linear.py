"""Least squares by tall-skinny QR, with robust errors, diagnostics and
(generalised) variance inflation factors.

Each task reduces its rows to one upper triangle R by QR of [X y], batch by
batch; triangles are merged tree-wise on the executors until a few are left,
and the last merge gives coefficients by back substitution.  No sums of
squares are formed and columns are moved by their means first, so means far
from zero do not cancel; a term costs one column, not p expressions.  Leverages are row norms of X R^-1,
a block product per batch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.scan import global_row_number

_MERGE = 32  # triangles merged by one task


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _triangle(blocks) -> np.ndarray | None:
    """R of the rows of all blocks, one block in memory at a time."""
    r = None
    for m in blocks:
        r = np.linalg.qr(m if r is None else np.vstack([r, m]), mode="r")
    return r


def tall_skinny_r(rows: DataFrame, column: str) -> np.ndarray | None:
    """The triangle R of all rows of an array<double> column (None: no row)."""
    def reduce(batches):
        r = _triangle(_matrix(b.column(0)) for b in batches if b.num_rows)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], names=["r"])

    found = rows.select(F.col(column).alias("r")).mapInArrow(reduce, "r array<double>")
    parts = rows.rdd.getNumPartitions()
    while parts > _MERGE:
        parts = -(-parts // _MERGE)
        found = found.repartition(parts).mapInArrow(reduce, "r array<double>")
    last = [np.array(x.r) for x in found.collect()]  # at most _MERGE triangles of p + 1 rows
    return np.linalg.qr(np.array(last), mode="r") if last else None


class OLSFit:
    """Least squares of ``y`` on named terms; rows with a null are left out.

    ``factors`` (name -> column of labels) enter as one dummy per label but the
    first, named ``name[label]``.  ``keep``: columns that ``diagnostics``
    returns with each row, such as its id.
    """

    def __init__(self, df: DataFrame, y: Column, terms: dict[str, Column], intercept: bool = True,
                 factors: dict[str, Column] | None = None, keep: Sequence[str] = ()):
        columns, self.blocks = dict(terms), {t: [t] for t in terms}
        for name, column in (factors or {}).items():
            labels = [r[0] for r in df.select(column.cast("string").alias("f")).where("f IS NOT NULL").distinct().orderBy("f").collect()]
            dummies = {f"{name}[{label}]": (column.cast("string") == F.lit(label)).cast("double") for label in labels[1:]}
            columns |= dummies
            self.blocks[name] = list(dummies)
        self.intercept, self.keep = intercept, list(keep)
        self.terms = (["(Intercept)"] if intercept else []) + list(columns)
        xs = ([F.lit(1.0)] if intercept else []) + [c.cast("double") for c in columns.values()]
        row = F.array(*xs, y.cast("double"))
        self.data = df.select(*self.keep, row.alias("row")).where(F.forall("row", lambda v: v.isNotNull()))
        self.p = p = len(xs)
        means = [F.avg(F.col("row")[i]) for i in range(p)] if intercept else []
        n, self._sst, *means = self.data.agg(F.count(F.lit(1)), F.var_pop(F.element_at("row", -1)), *means).first()
        self.n = int(n)
        if self.n <= p:
            raise ValueError("fewer rows than terms")
        # with an intercept the columns are moved by about their means and the fit is moved back
        self.shift = np.array([0.0, *means[1:]]) if intercept else np.zeros(p)
        moved = F.transform("row", lambda v, i: v - F.get(F.array(*[F.lit(float(m)) for m in [*self.shift, 0.0]]), i))
        r = tall_skinny_r(self.data.select(moved.alias("row")) if intercept else self.data, "row")
        self.r = r[:p, :p]
        scale = np.linalg.norm(self.r, axis=0)
        if len(r) < p or (np.abs(np.diag(self.r)) <= 1e-11 * np.maximum(scale, 1e-300)).any():
            raise ValueError("the terms are linearly dependent")
        back = np.eye(p)
        back[0] -= self.shift
        self._coef, self._r_inv = np.linalg.solve(self.r, r[:p, p]), np.linalg.solve(self.r, np.eye(p))
        self.coef = back @ self._coef
        self._back = back
        self.xtx_inv = back @ self._r_inv @ self._r_inv.T @ back.T
        ssr = float(r[p, p] ** 2) if len(r) > p else 0.0
        sst = self._sst * self.n
        self.df_resid = self.n - p
        self.sigma2 = ssr / self.df_resid
        self.se = np.sqrt(np.diag(self.xtx_inv) * self.sigma2)
        self.r2 = 1 - ssr / sst if sst else float("nan")
        self.adj_r2 = 1 - (1 - self.r2) * (self.n - 1) / self.df_resid
        self._hc3 = None

    def _per_row(self, name: str, kind: T.DataType, of, extra: Sequence[str] = ()) -> DataFrame:
        """``data`` with a column ``name`` = of(moved X, y, fitted, leverage), batch by batch."""
        coef, r_inv, shift, p = self._coef, self._r_inv, self.shift, self.p
        schema = T.StructType([*[f for f in self.data.schema.fields if f.name in extra], T.StructField(name, kind)])
        arrow = {"array": pa.list_(pa.float64())}

        def run(batches):
            for b in batches:
                if b.num_rows:
                    m = _matrix(b.column("row"))
                    x, y = m[:, :p] - shift, m[:, p]
                    values = of(x, y, x @ coef, ((x @ r_inv) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*[b.column(c) for c in extra], pa.array(list(values), arrow["array"])], names=[*extra, name])

        return self.data.select(*extra, "row").mapInArrow(run, schema)

    def hc3(self) -> np.ndarray:
        if self._hc3 is None:
            scaled = self._per_row("s", T.ArrayType(T.DoubleType()), lambda x, y, fit, h: x * ((y - fit) / (1 - h))[:, None])
            m = tall_skinny_r(scaled, "s")
            half = self._back @ self._r_inv @ self._r_inv.T @ m.T
            self._hc3 = half @ half.T
        return self._hc3

    def robust_se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.hc3()))

    def summary_rows(self) -> list[tuple]:
        from tessera.operators.stats import t_two_sided_p

        rse = self.robust_se()
        return [(term, float(b), float(se), float(b / se), float(t_two_sided_p(b / se, self.df_resid)), float(rs))
                for term, b, se, rs in zip(self.terms, self.coef, self.se, rse)]

    def diagnostics(self) -> DataFrame:
        """Kept columns, fitted, residual, standardised residual, leverage and
        Cook's D of every row."""
        s, p = math.sqrt(self.sigma2), self.p

        def of(x, y, fit, h):
            e = y - fit
            std = e / (s * np.sqrt(1 - h))
            return np.stack([fit, e, std, h, std**2 / p * h / (1 - h)], 1)

        d = self._per_row("__d", T.ArrayType(T.DoubleType()), of, self.keep)
        names = ["fitted", "residual", "std_residual", "leverage", "cooks_d"]
        return d.select(*self.keep, *[F.col("__d")[i].alias(c) for i, c in enumerate(names)])

    def qq_pairs(self) -> DataFrame:
        """``diagnostics`` with the rank of the standardised residual and the
        normal quantile that it meets in a QQ plot, (rank - a) / (n + 1 - 2 a)
        with a = 3/8 up to ten rows and 1/2 beyond; ties by the kept columns."""
        ranked = global_row_number(self.diagnostics(), ["std_residual", *self.keep], "qq_rank")
        a = 0.375 if self.n <= 10 else 0.5
        return ranked.withColumn("theoretical", normal_quantile((F.col("qq_rank") - F.lit(a)) / F.lit(self.n + 1 - 2 * a)))

    def correlations(self) -> np.ndarray:
        """Correlations of the terms without the intercept, from R."""
        if not self.intercept:
            raise ValueError("needs a fit with an intercept")
        centred = self.r[1:, 1:]  # the intercept's row took the means away
        unit = centred / np.linalg.norm(centred, axis=0)
        return unit.T @ unit

    def gvif(self) -> list[tuple[str, float, int, float]]:
        """(term, generalised VIF, df, GVIF^(1 / (2 df))) of every term or
        factor: det(own block) det(other block) / det(all) of the correlations
        (Fox and Monette 1992); for one column the usual VIF."""
        c = self.correlations()
        place = {t: i for i, t in enumerate(self.terms[1:])}
        out = []
        for name, block in self.blocks.items():
            own = [place[t] for t in block]
            if not own:  # a factor with one label
                continue
            other = [i for i in range(len(c)) if i not in own]
            logs = [np.linalg.slogdet(c[np.ix_(b, b)])[1] if b else 0.0 for b in (own, other, list(range(len(c))))]
            g = math.exp(logs[0] + logs[1] - logs[2])
            out.append((name, g, len(own), g ** (1 / (2 * len(own)))))
        return out


# Rational approximations of the normal quantile (algorithm AS 241, PPND16).
_CENTRE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
            4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
           (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
            2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
_SIDE = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
          1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
         (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
          1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
_TAIL = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
          2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
         (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
          7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def _ratio(at: Column, coefficients) -> Column:
    top, bottom = (F.lit(0.0), F.lit(0.0))
    for a, b in zip(reversed(coefficients[0]), reversed(coefficients[1])):
        top, bottom = top * at + F.lit(a), bottom * at + F.lit(b)
    return top / bottom


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, null outside (0, 1)."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1.0 - p)))
    outer = F.signum(q) * F.when(r <= 5.0, _ratio(r - 1.6, _SIDE)).otherwise(_ratio(r - 5.0, _TAIL))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, _CENTRE)).otherwise(outer))


def vif(df: DataFrame, cols: Sequence[str]) -> list[tuple[str, float]]:
    """Variance inflation factors of numeric columns (rows without a null)."""
    fit = OLSFit(df, F.lit(0.0), {c: F.col(f"`{c}`") for c in cols})
    return [(name, g) for name, g, _, _ in fit.gvif()]
