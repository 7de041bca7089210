"""Embedding whitening (operator 13): covariance by one aggregation over generated column pairs, LAPACK, projection.

Vectors become integers x = floor(256 * c), so that sums over them are exact. Every different x counts once: the
fit list. Two aggregations over it follow, one of the sums S of all dimensions, and one of the products
(x_i - S_i / n) * (x_j - S_j / n) of every pair i <= j: keyed by i, with an expression for each j (one for each pair, all
in one row, would be too many for generated code). Both have partial sums, so all that is shuffled is a row, or one for
each i, from each task. The driver gets dimensions ** 2 / 2 numbers, whatever the rows, and their
eigenvectors go back into the plan as constants. A last aggregation over the fit list measures how far the
covariance of what came out is from the identity.

Defined results: rows whose vector is null or empty, or holds null or non-finite entries, are left out, and so
are those of another length than the most common one (of equally common ones the longest); repeated rows, ids and
null ids come out row by row; with fewer dimensions than `components` there are as many components as
dimensions. A component without variance (an eigenvalue at or under EDGE of the largest) has null in `whitened`,
and is left out of identity_error; with no variance at all (one vector, say) `explained` and identity_error are
null too. A deviation beyond a long is null. An empty table gives an empty result. Columns other than those named
take no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseframe.llm.common import materialize, release

SCALE = 256
#: Eigenvalues up to this share of the largest are rounding, not variance.
EDGE = 1e-12


def _numbers(values: np.ndarray, kind: str) -> str:
    """A constant array in SQL; doubles by their shortest exact form."""
    return "array(" + ", ".join(f"{int(v)}L" if kind == "long" else f"{float(v)!r}D" for v in values) + ")"


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, x of the rows that take part; x: long integers."""
    fine = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = fine.where("v is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    found = fine.select("id", F.expr(f"transform(v, c -> cast(floor({SCALE} * c) as bigint) + 0L)").alias("x"))
    width = found.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return found.where(F.size("x") == (width["width"] if width else 0))


class Fit:
    """n vectors with sums S per dimension, and eigenvalues (falling) and eigenvectors (columns) of their covariance."""

    def __init__(self, n: int, sums: np.ndarray, covariance: np.ndarray) -> None:
        self.n, self.sums, self.covariance = n, sums, covariance
        values, vectors = np.linalg.eigh(covariance) if len(sums) else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(-values, kind="stable")
        self.values, self.vectors = np.maximum(values[order], 0), vectors[:, order]

    @property
    def live(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > EDGE * max(self.values.max(initial=0), np.finfo(float).tiny)

    def projected(self, component: int) -> str:
        """SQL of x's coordinate on a component, in units of its deviation."""
        if not self.live[component]:
            return "cast(null as double)"
        means, weights = self.sums / self.n, self.vectors[:, component] / np.sqrt(self.values[component])
        return f"aggregate(zip_with(zip_with(x, {_numbers(means, 'double')}, (a, m) -> a - m), {_numbers(weights, 'double')}, (a, w) -> a * w), 0D, (s, a) -> s + a)"


def pair_sums(rows: DataFrame) -> np.ndarray:
    """Sums of the products of every pair of columns, in one aggregation over the upper triangle; a symmetric matrix."""
    columns = rows.columns
    keyed = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("first_of_pair"))
    keyed = keyed.select("*", F.element_at(F.array(*columns), F.col("first_of_pair") + 1).alias("value_of_first"))
    sums = [F.expr(f"sum(if(first_of_pair <= {j}, value_of_first * {c}, 0D)) AS s{j}") for j, c in enumerate(columns)]
    out = np.zeros((len(columns), len(columns)))
    for r in keyed.groupBy("first_of_pair").agg(*sums).collect():  # one row for each column
        out[r["first_of_pair"]] = r[1:]
    return np.triu(out) + np.triu(out, 1).T


def fit(distinct: DataFrame) -> Fit:
    """Of a table of different vectors x of one length."""
    first = distinct.select(F.size("x").alias("width")).first()
    width = first["width"] if first else 0
    if not width:
        return Fit(0, np.zeros(0, object), np.zeros((0, 0)))
    # exact beyond a long: sums of longs as decimals
    n, *sums = distinct.agg(F.count("*"), *(F.expr(f"sum(cast(x[{k}] as decimal(20, 0)))") for k in range(width))).first()
    means = [float(int(s) / n) for s in sums]
    centred = distinct.selectExpr(*(f"x[{k}] - {m!r}D AS d{k}" for k, m in enumerate(means)))
    return Fit(n, np.array([int(s) for s in sums], object), pair_sums(centred) / n)


def identity_error(distinct: DataFrame, model: Fit, components: int) -> float | None:
    """Largest absolute entry of (covariance of the whitened fit list - identity), measured on its rows."""
    live = [k for k in range(min(components, len(model.values))) if model.live[k]]
    if not live:
        return None
    names = [f"w{k}" for k in live]
    rows = distinct.selectExpr(*(f"{model.projected(k)} AS w{k}" for k in live))
    found = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in names)).first()
    # centred before multiplying, as in fit()
    centred = rows.selectExpr(*(f"{c} - {m!r}D AS {c}" for c, m in zip(names, found, strict=True)))
    return float(np.abs(pair_sums(centred) / model.n - np.eye(len(live))).max())


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows = integers(vectors, id_col, vector_col)
    distinct = materialize(rows.select("x").distinct())
    model = fit(distinct)
    spread = float(np.trace(model.covariance))
    error = identity_error(distinct, model, components)
    release(distinct)
    number = lambda v: "cast(null as double)" if v is None else f"{float(v)!r}D"
    apart = f"aggregate(zip_with(x, {_numbers(model.sums, 'long')}, (a, s) -> try_subtract(try_multiply({model.n}L, a), s)), 0L, (t, a) -> try_add(t, try_multiply(a, a)))"
    parts = [
        f"struct({k + 1} AS component, {model.projected(k)} AS whitened, {number(model.values[k] / spread if spread > 0 else None)} AS explained)"
        for k in range(min(components, len(model.values)))
    ]
    if not parts:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    each = rows.select(F.col("id").alias("vec_id"), F.expr(apart).alias("deviation"), F.explode(F.expr(f"array({', '.join(parts)})")).alias("p"))
    return each.select("vec_id", "p.component", F.lit(model.n).cast("long").alias("n"), "deviation", "p.whitened", "p.explained", F.expr(number(error)).alias("identity_error"))
