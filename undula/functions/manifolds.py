"""Exponential and logarithm maps of the sphere and the Poincare ball, as expressions on arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _scale(a: Column, c: Column) -> Column:
    return F.transform(a, lambda x: x * c)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sphere_exp(anchor: Column, v: Column, eps: float = EPS) -> Column:
    """The point that the tangent part of ``v`` at ``anchor`` leads to."""

    def along(tangent, n):
        return F.zip_with(anchor, tangent, lambda a, t: a * F.cos(n) + t * (F.sin(n) / n))

    tangent = let(dot(anchor, v), lambda c: F.zip_with(v, anchor, lambda x, a: x - a * c))
    return let(tangent, lambda t: let(F.greatest(norm(t), F.lit(eps)), lambda n: along(t, n)))


def sphere_log(anchor: Column, y: Column, eps: float = EPS) -> Column:
    """The tangent vector at ``anchor`` that leads to ``y``, taken to the sphere first."""

    def at(unit, c):
        u = F.zip_with(unit, anchor, lambda a, b: a - b * c)
        return let(u, lambda t: let(F.acos(c) / F.greatest(norm(t), F.lit(eps)), lambda k: _scale(t, k)))

    unit = let(1 / F.greatest(norm(y), F.lit(eps)), lambda k: _scale(y, k))
    return let(unit, lambda u: let(F.greatest(F.least(dot(anchor, u), F.lit(1 - 1e-7)), F.lit(-1 + 1e-7)), lambda c: at(u, c)))


def poincare_exp0(v: Column, eps: float = EPS) -> Column:
    return let(F.greatest(norm(v), F.lit(eps)), lambda n: _scale(v, F.tanh(n) / n))


def poincare_log0(y: Column, eps: float = EPS) -> Column:
    return let(F.greatest(F.least(norm(y), F.lit(1 - 1e-6)), F.lit(eps)), lambda n: _scale(y, F.atanh(n) / n))


def readout(vectors: Column, kind: str | None, anchor: Column | None = None) -> Column:
    """Tangent vectors to points: ``sphere`` (at the anchor, the first axis if none), ``poincare``, or as they are."""
    if kind is None or kind == "euclidean":
        return vectors
    if kind == "sphere":
        return sphere_exp(anchor if anchor is not None else default_anchor(vectors), vectors)
    if kind == "poincare":
        return poincare_exp0(vectors)
    raise ValueError(f"unknown manifold {kind!r}")


def to_tangent(points: Column, kind: str | None, anchor: Column | None = None) -> Column:
    """The inverse of ``readout``."""
    if kind is None or kind == "euclidean":
        return points
    if kind == "sphere":
        return sphere_log(anchor if anchor is not None else default_anchor(points), points)
    if kind == "poincare":
        return poincare_log0(points)
    raise ValueError(f"unknown manifold {kind!r}")


def default_anchor(like: Column) -> Column:
    return F.transform(like, lambda _, i: F.when(i == 0, 1.0).otherwise(0.0))


def fit_anchor(df: DataFrame, column: str, steps: int = 50) -> list[float]:
    """The Karcher mean on the sphere: steps to the mean logarithm; stops once still.

    The vectors are kept, and a step sums them as arrays within each task, so it moves one array a task.
    """
    data = df.select(F.col(column).alias("y")).persist()

    def mean(vectors: DataFrame) -> np.ndarray:
        def run(batches):
            total, n = None, 0
            for b in batches:
                if b.num_rows:
                    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    total, n = x.sum(0) + (0 if total is None else total), n + len(x)
            if n:
                yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["s", "n"])

        rows = vectors.mapInArrow(run, "s array<double>, n long").collect()  # a row a task
        return np.sum([r.s for r in rows], axis=0) / sum(r.n for r in rows)

    a = mean(data)
    a = a / max(np.linalg.norm(a), EPS)
    for _ in range(steps):
        v = mean(data.select(sphere_log(F.array(*(F.lit(float(x)) for x in a)), F.col("y")).alias("v")))
        n = np.linalg.norm(v)
        if n < 1e-10:
            break
        a = np.cos(n) * a + np.sin(n) * v / n
        a /= np.linalg.norm(a)
    data.unpersist()
    return a.tolist()
