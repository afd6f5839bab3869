"""Synthetic manifold curves: each sample from its own seeded generator, in parallel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAVITY = 9.81


def cluster_of(i: int, n: int, k: int) -> int:
    return min(i * k // n, k - 1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=0)


# Each set draws a start for a sample, from which its path follows. ``t`` steps, ``c`` the sample's cluster of ``k``.


def start_hypersphere(rng, c: int, p: int, t: int, k: int) -> np.ndarray:
    """The angle of a step, then an orthonormal frame of two vectors: faster in later clusters."""
    a = _unit(rng.normal(size=p))
    b = rng.normal(size=p)
    return np.concatenate(([(c + 1) * 2 * np.pi / t], a, _unit(b - (b @ a) * a)))


def path_hypersphere(start: np.ndarray, t: int) -> np.ndarray:
    """A great circle: cos of the angle along the first vector, sin along the second."""
    a, b = start[1:].reshape(2, -1)
    angle = np.arange(t) * start[0]
    return np.outer(a, np.cos(angle)) + np.outer(b, np.sin(angle))


def start_hyperbolic(rng, c: int, p: int, t: int, k: int) -> np.ndarray:
    """The horizon, longer in later clusters, then a direction."""
    return np.concatenate(([np.linspace(1, 2, k)[c]], _unit(rng.normal(size=p))))


def path_hyperbolic(start: np.ndarray, t: int) -> np.ndarray:
    """A ray of the Poincare ball, kept inside it."""
    s = np.linspace(0, start[0], t)
    x = np.outer(start[1:], np.sinh(s) / (1 + np.cosh(s)))
    norm = np.linalg.norm(x, axis=0)
    return np.where(norm >= 1, x / np.maximum(norm, 1e-12) * 0.999, x)


def start_swiss_roll(rng, c: int, p: int, t: int, k: int) -> np.ndarray:
    """A height in the cluster's band of 0 to 10, then the first angle."""
    band = np.linspace(0, 10, k + 1)
    return np.array([rng.uniform(band[c], band[c + 1]), rng.uniform(1.5 * np.pi, 3 * np.pi)])


def path_swiss_roll(start: np.ndarray, t: int) -> np.ndarray:
    """A sweep of three quarters of a turn over the roll."""
    s = np.linspace(start[1], start[1] + 1.5 * np.pi, t)
    return np.stack([s * np.cos(s), np.full(t, start[0]), s * np.sin(s)])


def start_lorenz(rng, c: int, p: int, t: int, k: int) -> np.ndarray:
    """rho of the cluster, then a state."""
    return np.concatenate(([np.linspace(14, 28, k)[c]], rng.uniform(-10, 10, 3)))


def path_lorenz(start: np.ndarray, t: int) -> np.ndarray:
    """Explicit Euler steps of the Lorenz system, recorded before each step."""
    rho, x = start[0], start[1:]
    out = np.empty((3, t))
    for i in range(t):
        out[:, i] = x
        x = x + 0.01 * np.array([10 * (x[1] - x[0]), x[0] * (rho - x[2]) - x[1], x[0] * x[1] - 8 / 3 * x[2]])
    return out


def start_pendulum(rng, c: int, p: int, t: int, k: int) -> np.ndarray:
    """An angle, and a speed that is higher in later clusters."""
    return np.array([rng.uniform(-0.5, 0.5), rng.uniform(-0.5 + 2 * c, 0.5 + 2 * c)])


def path_pendulum(start: np.ndarray, t: int) -> np.ndarray:
    """cos, sin and speed by explicit Euler steps: angle and speed both move by the state before the step."""
    angle, speed = start
    out = np.empty((3, t))
    for i in range(t):
        out[:, i] = np.cos(angle), np.sin(angle), speed
        angle, speed = angle + 0.02 * speed, speed - 0.02 * GRAVITY * np.sin(angle)
        angle += -2 * np.pi if angle > np.pi else 2 * np.pi if angle < -np.pi else 0
    return out


def features(x: np.ndarray, p: int) -> np.ndarray:
    """The first p rows, zeros where there are fewer."""
    out = np.zeros((p, x.shape[1]))
    out[: min(p, len(x))] = x[:p]
    return out


KINDS: dict[str, tuple[Callable, Callable]] = {
    "hypersphere": (start_hypersphere, path_hypersphere),
    "hyperbolic": (start_hyperbolic, path_hyperbolic),
    "swiss_roll": (start_swiss_roll, path_swiss_roll),
    "lorenz": (start_lorenz, path_lorenz),
    "pendulum": (start_pendulum, path_pendulum),
}
#: samples, features, steps, clusters and readout of the built-in sets (fixed values).
CATALOG = {
    "hypersphere": (100, 3, 100, 2, "sphere"),
    "hyperbolic": (200, 2, 50, 2, "poincare"),
    "swiss_roll": (300, 2, 200, 4, None),
    "lorenz": (100, 3, 100, 3, None),
    "pendulum": (200, 2, 100, 4, None),
}


def sample(kind: str, rng, c: int, p: int, t: int, k: int, noise: float = 0.0) -> np.ndarray:
    """(p, t): one sample; ``noise`` shakes the points of the hypersphere, more in later clusters."""
    start, path = KINDS[kind]
    x = features(path(start(rng, c, p, t, k), t), p)
    return _unit(x + noise * c * rng.normal(size=x.shape)) if noise * c and kind == "hypersphere" else x


def generate(spark: SparkSession, kind: str, samples: int | None = None, features: int | None = None, steps: int | None = None, clusters: int | None = None, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(sample_id, feature, values, label) of a set of ``KINDS``; sizes default to the catalog's."""
    if kind not in KINDS:
        raise ValueError(f"unknown set {kind!r}; one of {sorted(KINDS)}")
    n, p, t, k = (a if a is not None else b for a, b in zip((samples, features, steps, clusters), CATALOG[kind]))

    def run(batches):
        for batch in batches:
            rows = [(i, f, v, c) for i in batch.column(0).to_pylist() for c in [cluster_of(i, n, k)] for f, v in enumerate(sample(kind, np.random.default_rng([seed, i]), c, p, t, k, noise))]
            if rows:
                ids, fs, vs, cs = zip(*rows)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(fs, pa.int32()), pa.array(list(vs), pa.list_(pa.float64())), pa.array(cs, pa.int32())], ["sample_id", "feature", "values", "label"])

    return spark.range(n).mapInArrow(run, "sample_id long, feature int, values array<double>, label int")


def trajectories(starts: DataFrame, kind: str, steps: int) -> DataFrame:
    """(sample_id, feature, values): the paths from given starts (sample_id, start array<double>), laid out as the set's own."""
    path = KINDS[kind][1]

    def run(batches):
        for batch in batches:
            rows = [(i, f, v) for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f, v in enumerate(path(np.array(s, float), steps))]
            if rows:
                ids, fs, vs = zip(*rows)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(fs, pa.int32()), pa.array(list(vs), pa.list_(pa.float64()))], ["sample_id", "feature", "values"])

    return starts.select(F.col("sample_id").cast("long"), "start").mapInArrow(run, "sample_id long, feature int, values array<double>")


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in CATALOG.items()], "name string, samples int, features int, steps int, clusters int, manifold string")
