"""Embedding whitening: moments of partitions merged pairwise, principal axes by one eigendecomposition.

Entries become integers, ``floor(1024 c) + 100000``, so counts and sums are exact. Every task turns its batches into
(count, sum, centred scatter) and merges them by Chan's formula; the tasks' moments meet in ``treeReduce``, a few to a
task, so the driver gets a handful of dimensions x dimensions matrices however many partitions there are. ``eigh`` of
that one matrix runs on the driver. A second pass gathers the moments of the whitened rows in the same way and holds
their covariance against the identity.

Within a batch, integers are centred at the rounded mean before they are multiplied, so products and their sums are
whole numbers below 2**53 and the scatter has no cancellation; only merges round.

Defined results: rows whose vector is null or empty, or holds a null, NaN or infinite entry, are dropped, and so are
rows whose length isn't the commonest one (the greater among equals); a null id stays; repeated rows count each time;
``1024 c`` beyond 2**62 is held at that bound; a deviation beyond the range of a long is null; an axis without variance
(below 1e-13 of the largest) has whitened value 0 and explains what its eigenvalue says; an empty table gives an empty
table; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from undula.llm._arrow import release

SCALE, SHIFT = 1024, 100_000
#: Axes that are kept.
COMPONENTS = 8
#: Steps in which the tasks' moments meet.
DEPTH = 3
_BOUND = 2.0**62


@dataclass
class Moments:
    n: int
    total: np.ndarray  # whole numbers as Python integers, or doubles
    scatter: np.ndarray


@dataclass
class Model:
    n: int
    total: list[int]
    axes: np.ndarray  # dimensions x components
    values: np.ndarray  # eigenvalues, falling
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) if self.trace > 0 else 0.0 for v in self.values]


def whole(c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c), -_BOUND, _BOUND).astype(np.int64) + SHIFT


def _sum(x: np.ndarray) -> np.ndarray:
    small = len(x) * (int(np.abs(x).max()) + 1) < 2**62
    return np.array([int(v) for v in (x if small else x.astype(object)).sum(0)], object)


def moments(x: np.ndarray) -> Moments:
    """Of whole numbers, rows x dimensions."""
    n, total = len(x), _sum(x)
    middle = np.array([int(t) // n for t in total], np.int64)
    d = (x - middle).astype(float)
    rest = (total - n * middle.astype(object)).astype(float)
    return Moments(n, total, d.T @ d - np.outer(rest, rest) / n)


def moments_of_doubles(y: np.ndarray) -> Moments:
    d = y - y.mean(0)
    return Moments(len(y), y.sum(0), d.T @ d)


def merge(a: Moments, b: Moments) -> Moments:
    """Chan's formula for two disjoint sets of rows."""
    apart = ((b.total * a.n - a.total * b.n) / (a.n * b.n)).astype(float)
    return Moments(a.n + b.n, a.total + b.total, a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / (a.n + b.n)))


def _clean(vector: str) -> Column:
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))


def _entries(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, size)


def _gathered(rows: DataFrame, of) -> Moments | None:
    """Moments of the frame's one column of vectors: ``of`` gives those of a batch."""

    def run(batches: Iterator[pa.RecordBatch]):
        release()
        own = None
        for batch in batches:
            if batch.num_rows:
                now = of(batch.column(0))
                own = now if own is None else merge(own, now)
        if own is not None:
            yield pa.record_batch([pa.array([pickle.dumps(own)], pa.binary())], ["moments"])

    either = lambda a, b: b if a is None else a if b is None else merge(a, b)
    return rows.mapInArrow(run, "moments binary").rdd.map(lambda r: pickle.loads(bytes(r[0]))).treeAggregate(None, either, either, DEPTH)


def _rows(df: DataFrame, vector: str, size: int) -> DataFrame:
    return df.filter(_clean(vector) & (F.size(vector) == size))


def fit(df: DataFrame, vector: str, components: int = COMPONENTS) -> Model:
    """The mean and the leading principal axes of all clean rows; ``n`` is 0 if there is none."""
    lengths = df.filter(_clean(vector)).groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("size")).first()  # a row a length meets in counts
    if top is None:
        return Model(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    size = top["size"]
    m = _gathered(_rows(df, vector, size).select(vector), lambda c: moments(whole(_entries(c, size))))
    values, axes = np.linalg.eigh(m.scatter / m.n)
    order = np.argsort(-values, kind="stable")[:components]
    return Model(m.n, [int(t) for t in m.total], axes[:, order], np.maximum(values[order], 0), float(np.trace(m.scatter) / m.n))


def project(model: Model, x: np.ndarray) -> np.ndarray:
    """Whitened rows of whole numbers: (x - S/n) on each axis, over the root of its eigenvalue."""
    middle = np.array([t // model.n for t in model.total], np.int64)
    part = np.array([(t - model.n * int(k)) / model.n for t, k in zip(model.total, middle)])
    live = model.values > 1e-13 * max(model.values.max(initial=0), 0)
    scale = np.where(live, 1 / np.sqrt(np.where(live, model.values, 1)), 0)
    return ((x - middle).astype(float) - part) @ model.axes * scale


def deviation(model: Model, x: np.ndarray) -> list[int | None]:
    """The exact sum over dimensions of (n x - S)^2."""
    middle = np.array([t // model.n for t in model.total], np.int64)
    rest = np.array([t - model.n * int(k) for t, k in zip(model.total, middle)], object)
    d = x - middle
    most = model.n * (int(np.abs(d).max(initial=0)) + 1)
    kind = np.int64 if most * most * x.shape[1] < 2**63 else object
    d = model.n * d.astype(kind) - rest.astype(kind)
    return [int(v) if v < 2**63 else None for v in (d * d).sum(1)]


def identity_error(df: DataFrame, model: Model, vector: str) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, by a pass of its own; 0 without a live axis."""
    if not model.n:
        return 0.0
    size = len(model.total)
    m = _gathered(_rows(df, vector, size).select(vector), lambda c: moments_of_doubles(project(model, whole(_entries(c, size)))))
    live = np.flatnonzero(model.values > 1e-13 * model.values.max())
    return float(np.abs((m.scatter / m.n)[np.ix_(live, live)] - np.eye(len(live))).max(initial=0))


def whiten(df: DataFrame, model: Model, key: str, vector: str) -> DataFrame:
    """(key, deviation long, whitened array<double>) of every clean row."""
    size, kind = len(model.total), df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]):
        release()
        for batch in batches:
            if batch.num_rows:
                x = whole(_entries(batch.column(1), size))
                y = project(model, x)
                flat = pa.array(y.ravel())
                at = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
                yield pa.record_batch([batch.column(0).cast(to_arrow_type(kind)), pa.array(deviation(model, x), pa.int64()), pa.ListArray.from_arrays(at, flat)], ["key", "deviation", "whitened"])

    return _rows(df, vector, size).select(key, vector).mapInArrow(run, f"key {kind.simpleString()}, deviation long, whitened array<double>").withColumnRenamed("key", key)
