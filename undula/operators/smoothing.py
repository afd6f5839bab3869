"""Basis expansions of curves: B-splines, Fourier series, wavelets, and their choice by generalised cross-validation.

A linear smoother depends on the grid alone: its small matrix is made once, sent as one row, and applied to each
curve by array expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.functions import normalise
from undula.sources.curves import check_dense

TERMS = (6, 8, 10, 12, 15, 20, 25, 30)
#: Analysis low-pass filters (fixed values).
LOW = {
    "haar": (2**-0.5, 2**-0.5),
    "db4": (-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523),
}


# --- bases ----------------------------------------------------------------------------------------------------


def bspline_design(x: np.ndarray, k: int, degree: int = 3) -> np.ndarray:
    """(len(x), k): clamped uniform B-splines on [0, 1] by the Cox-de Boor recurrence."""
    if k <= degree:
        raise ValueError("a basis needs more terms than its degree")
    knots = np.concatenate((np.zeros(degree), np.linspace(0, 1, k - degree + 1), np.ones(degree)))
    x = np.asarray(x, float)
    b = ((knots[:-1] <= x[:, None]) & (x[:, None] < knots[1:])).astype(float)
    b[x >= 1, k - 1] = 1
    for d in range(1, degree + 1):
        left, right = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
        up = np.where(left > 0, (x[:, None] - knots[: -d - 1]) / np.where(left > 0, left, 1), 0)
        down = np.where(right > 0, (knots[d + 1 :] - x[:, None]) / np.where(right > 0, right, 1), 0)
        b = up * b[:, :-1] + down * b[:, 1:]
    return b


def fourier_design(x: np.ndarray, n: int) -> np.ndarray:
    """1, then cos and sin of each of n frequencies."""
    return np.column_stack([np.ones(len(x)), *(f(2 * np.pi * k * np.asarray(x)) for k in range(1, n + 1) for f in (np.cos, np.sin))])


def fourier_basis(x: np.ndarray, count: int) -> np.ndarray:
    """``count`` functions: 1, then sin before cos of each frequency."""
    return np.column_stack([np.ones(len(x)), *(f(2 * np.pi * k * np.asarray(x)) for k in range(1, count // 2 + 1) for f in (np.sin, np.cos))])[:, :count]


def orthogonal_basis(kind: str, n: int, steps: int) -> np.ndarray:
    """(steps, n): clamped cubic B-splines on [0, 1], Legendre polynomials on [-1, 1], or scaled sines and cosines on [0, 1]."""
    if kind == "bspline":
        return bspline_design(np.linspace(0, 1, steps), n)
    if kind == "legendre":
        return np.polynomial.legendre.legvander(np.linspace(-1, 1, steps), n - 1)
    if kind == "fourier":
        t = np.linspace(0, 1, steps)
        return np.column_stack([np.ones(steps), *(np.sqrt(2) * (np.sin((i + 1) * np.pi * t) if i % 2 else np.cos(i * np.pi * t)) for i in range(1, n))])
    raise NotImplementedError(kind)


def gram(phi: np.ndarray) -> np.ndarray:
    return phi.T @ phi / (len(phi) - 1)


def difference_penalty(k: int, order: int = 2) -> np.ndarray:
    d = np.diff(np.eye(k), order, axis=0)
    return d.T @ d


def fourier_penalty(n: int, m: int = 2) -> np.ndarray:
    w = [(2 * np.pi * k) ** (2 * m) for k in range(1, n + 1) for _ in (0, 1)]
    return np.diag([0.0, *w])


def projector(x: np.ndarray, penalty: np.ndarray | None = None, lam: float = 0.0) -> np.ndarray:
    """Values to coefficients: (X'X + lam P)^-1 X', the pseudo-inverse without a penalty."""
    return np.linalg.pinv(x) if penalty is None or lam == 0 else np.linalg.solve(x.T @ x + lam * penalty, x.T)


# --- linear smoothers over curves -------------------------------------------------------------------------------


def _sent(df: DataFrame, matrix: np.ndarray, name: str = "__m") -> DataFrame:
    one = df.sparkSession.createDataFrame([([list(map(float, r)) for r in matrix],)], f"{name} array<array<double>>")
    return df.crossJoin(F.broadcast(one))  # one row of a fixed size


def _times(matrix: str, values: str) -> Column:
    return F.transform(matrix, lambda row: F.aggregate(F.zip_with(row, values, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def apply_matrix(curves: DataFrame, matrix: np.ndarray, out: str = "c", values: str = "values") -> DataFrame:
    """(sample_id, feature, out): the matrix times each curve."""
    return _sent(curves, matrix).select("sample_id", "feature", _times("__m", values).alias(out))


def bspline_coefficients(curves: DataFrame, m: int, lam: float = 0.0) -> DataFrame:
    """(sample_id, feature, c): least squares on m clamped uniform B-splines, with a difference penalty if lam > 0."""
    x = bspline_design(np.linspace(0, 1, check_dense(curves)), m)
    return apply_matrix(curves, projector(x, difference_penalty(m), lam))


def evaluate(coefs: DataFrame, phi: np.ndarray, out: str = "fit") -> DataFrame:
    """(sample_id, feature, fit): coefficients on a basis given by its values (steps, terms)."""
    return _sent(coefs, phi).select("sample_id", "feature", _times("__m", "c").alias(out))


def fourier_coefficients(curves: DataFrame, n: int) -> DataFrame:
    """(sample_id, feature, c): a0, a1, b1, ... by discrete Fourier sums over the grid as one period."""
    steps = check_dense(curves)
    if not 1 <= n <= steps // 2 - 1:
        raise ValueError(f"a grid of {steps} has {steps // 2 - 1} frequencies")
    t = 2 * np.pi * np.arange(steps) / steps
    return apply_matrix(curves, np.stack([np.ones(steps) / steps, *(2 / steps * f(k * t) for k in range(1, n + 1) for f in (np.cos, np.sin))]))


def fourier_series(coefs: DataFrame, steps: int) -> DataFrame:
    n = coefs.select(F.max(F.size("c"))).first()[0]
    return evaluate(coefs, fourier_design(np.linspace(0, 1, steps), (n - 1) // 2))


def project(curves: DataFrame, kind: str, n: int) -> DataFrame:
    """(sample_id, feature, c): least squares on an orthogonal basis."""
    return apply_matrix(curves, np.linalg.pinv(orthogonal_basis(kind, n, check_dense(curves))))


def second_stage(curves: DataFrame, m: int, grid: int) -> DataFrame:
    """(sample_id, feature, fit): the spline fit of m terms on a grid of another size."""
    return evaluate(bspline_coefficients(curves, m), bspline_design(np.linspace(0, 1, grid), m))


def spline_at(c: str, x: str) -> Column:
    """The clamped uniform cubic B-spline with the coefficients ``c`` at ``x`` in [0, 1], by de Boor's steps; null outside."""
    spans = F.size(c) - 3
    at = F.col(x) * spans
    span = F.greatest(F.lit(0), F.least(F.floor(at).cast("int"), spans - 1))
    knot = lambda j: F.greatest(F.lit(0), F.least(span + j, spans))
    d = [F.element_at(c, span + j + 1) for j in range(4)]
    for r in range(1, 4):
        for j in range(3, r - 1, -1):
            low, high = knot(j - 3), knot(j + 1 - r)
            share = (at - low) / (high - low)
            d[j] = (1 - share) * d[j - 1] + share * d[j]
    return F.when(F.col(x).between(0, 1), d[3])


def series_at(c: str, x: str) -> Column:
    """The Fourier series with the coefficients a0, a1, b1, ... at ``x``, of period 1."""
    each = F.transform(c, lambda v, k: F.when(k == 0, v).when(k % 2 == 1, v * F.cos(np.pi * (k + 1) * F.col(x))).otherwise(v * F.sin(np.pi * k * F.col(x))))
    return F.aggregate(each, F.lit(0.0), lambda a, v: a + v)


def fits_at(coefs: DataFrame, places: DataFrame, kind: str = "bspline", out: str = "fit") -> DataFrame:
    """``places`` (sample_id, feature, x, ...) with the fitted curve's value at x of each row, null where there is no curve.

    Every row may ask at a place of its own. Each curve is one row of coefficients, so a sample with many places is dealt
    as a skewed join deals it.
    """
    value = (spline_at if kind == "bspline" else series_at)("c", "x")
    return places.join(coefs.select("sample_id", "feature", "c"), ["sample_id", "feature"], "left").select(*places.columns, value.alias(out))


def fit_of_each_label(curves: DataFrame, fits: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, sample_id, feature, values, fit) of the first sample of each label (sample_id, label)."""
    first = labels.groupBy("label").agg(F.min("sample_id").alias("sample_id"))
    return curves.join(first, "sample_id").join(fits, ["sample_id", "feature"]).select("label", "sample_id", "feature", "values", "fit")


# --- generalised cross-validation -------------------------------------------------------------------------------


def bspline_grid(steps: int, base: float = 0.3) -> list[tuple[int, float, np.ndarray]]:
    """(terms, lam, smoother): values to fitted values."""
    lams = sorted({*np.logspace(-6, 2, 20), *(base * 10.0**e for e in np.linspace(-3, 3, 13))})
    x = {k: bspline_design(np.linspace(0, 1, steps), k) for k in sorted({min(max(k, 4), steps - 1) for k in TERMS})}
    return [(k, lam, d @ projector(d, difference_penalty(k), lam)) for k, d in x.items() for lam in lams]


def fourier_grid(steps: int, base: float = 0.3) -> list[tuple[int, float, np.ndarray]]:
    n = min(50, (steps - 1) // 2)
    d = fourier_design(np.linspace(0, 1, steps), n)
    lams = sorted({*np.logspace(-10, 2, 25), *(base * 10.0**e for e in np.linspace(-4, 4, 17))})
    return [(n, lam, d @ projector(d, fourier_penalty(n), lam)) for lam in lams]


def gcv_scores(curves: DataFrame, grid: list[tuple[int, float, np.ndarray]]) -> DataFrame:
    """(terms, lam, df, gcv): the mean of n RSS / (n - df)^2 over curves; tasks send one sum a grid point."""
    residual = [np.eye(len(s)) - s for _, _, s in grid]

    def run(batches):
        total, count = np.zeros(len(grid)), 0
        for batch in batches:
            y = _matrix(batch.column(0))
            total += [((y @ r.T) ** 2).sum() for r in residual]
            count += len(y)
        if count:
            yield pa.record_batch([pa.array(range(len(grid)), pa.int32()), pa.array(total), pa.array([count] * len(grid), pa.int64())], ["g", "rss", "n"])

    sums = curves.select("values").mapInArrow(run, "g int, rss double, n long").groupBy("g").agg((F.sum("rss") / F.sum("n")).alias("rss"))
    rows = [(g, int(k), float(lam), float(np.trace(s)), len(s)) for g, (k, lam, s) in enumerate(grid)]
    spec = curves.sparkSession.createDataFrame(rows, "g int, terms int, lam double, df double, steps int")
    score = F.col("steps") * F.col("rss") / F.pow(F.greatest(F.lit(1e-12), F.col("steps") - F.col("df")), F.lit(2))
    return spec.join(sums, "g").select("terms", "lam", "df", score.alias("gcv"))


def best(scores: DataFrame) -> tuple[int, float]:
    r = scores.orderBy("gcv", "terms", "lam").first()
    return r["terms"], r["lam"]


# --- wavelets -------------------------------------------------------------------------------------------------


def _filters(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = np.array(LOW[name])
    high = low[::-1] * (-1.0) ** (np.arange(len(low)) + 1)
    return low, high, low[::-1], high[::-1]


def _convolve(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Full convolution along the last axis."""
    out = np.zeros((*x.shape[:-1], x.shape[-1] + len(taps) - 1))
    for k, c in enumerate(taps):
        out[..., k : k + x.shape[-1]] += c * x
    return out


def analyse(x: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """One level of each curve (..., steps): (approximation, detail), the signal mirrored at its ends."""
    low, high, _, _ = _filters(name)
    n, w = x.shape[-1], len(low) - 1
    place = np.arange(-w, n + w) % (2 * n)
    ext = x[..., np.where(place < n, place, 2 * n - 1 - place)]
    valid = slice(w, w + n + w)
    return _convolve(ext, low)[..., valid][..., 1::2], _convolve(ext, high)[..., valid][..., 1::2]


def synthesise(a: np.ndarray, d: np.ndarray, name: str) -> np.ndarray:
    _, _, low, high = _filters(name)
    up = np.zeros((2, *d.shape[:-1], 2 * d.shape[-1]))
    up[0, ..., ::2], up[1, ..., ::2] = a[..., : d.shape[-1]], d
    return (_convolve(up[0], low) + _convolve(up[1], high))[..., len(low) - 2 : 2 * d.shape[-1]]


def greatest_level(steps: int, name: str) -> int:
    """No level beyond what the filter's length allows."""
    width = len(LOW[name])
    return max(0, int(np.log2(steps / (width - 1)))) if steps >= width else 0


def decompose(x: np.ndarray, name: str = "db4", level: int = 4) -> list[np.ndarray]:
    """Approximation, then details from coarse to fine, of curves (..., steps)."""
    out = []
    for _ in range(max(0, min(level, greatest_level(x.shape[-1], name)))):
        x, d = analyse(x, name)
        out.append(d)
    return [x, *out[::-1]]


def recompose(parts: list[np.ndarray], name: str = "db4") -> np.ndarray:
    x = parts[0]
    for d in parts[1:]:
        x = synthesise(x, d, name)
    return x


def mad(d: np.ndarray) -> np.ndarray:
    return np.median(np.abs(d - np.median(d, axis=-1, keepdims=True)), axis=-1) / 0.6745 + 1e-12


def soft(parts: list[np.ndarray], tau) -> list[np.ndarray]:
    """All levels, the approximation too, shrunk towards 0 by ``tau``, a number or one a curve."""
    tau = np.asarray(tau)[..., None]
    return [np.sign(c) * np.maximum(np.abs(c) - tau, 0) for c in parts]


def nonzero(parts: list[np.ndarray]) -> np.ndarray:
    return sum(np.count_nonzero(c, axis=-1) for c in parts)


def denoise(x: np.ndarray, name: str = "db4", level: int = 4, tau: float | None = None) -> np.ndarray:
    parts = decompose(x, name, level)
    return recompose(soft(parts, 2 * mad(parts[-1]) if tau is None else tau), name)[..., : x.shape[-1]]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _arrays(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def wavelet_denoise(curves: DataFrame, name: str = "db4", level: int = 4, tau: float | None = None) -> DataFrame:
    """(sample_id, feature, fit) of curves on one grid, a batch at a time."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column(0), b.column(1), _arrays(denoise(_matrix(b.column(2)), name, level, tau))], ["sample_id", "feature", "fit"])

    kinds = dict(curves.dtypes)
    return curves.select("sample_id", "feature", "values").mapInArrow(run, f"sample_id {kinds['sample_id']}, feature {kinds['feature']}, fit array<double>")


def wavelet_scores(curves: DataFrame, name: str = "db4", most: int = 6) -> DataFrame:
    """(level, tau, gcv): the mean over curves; tau in eight steps of the noise scale of the first curve.

    Levels end with the greatest that the grid allows; a curve keeps as many terms as coefficients that aren't 0.
    """
    first = np.array(curves.orderBy("sample_id", "feature").select("values").first()[0], float)
    sigma = float(mad(decompose(first, name, 1)[-1]))
    grid = [(lv, float(t)) for lv in range(1, min(most, greatest_level(len(first), name)) + 1) for t in np.linspace(0.5, 3.5, 8) * sigma]

    def run(batches):
        total, n = np.zeros(len(grid)), 0
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0))
            parts = {lv: decompose(x, name, lv) for lv in {lv for lv, _ in grid}}
            for g, (lv, t) in enumerate(grid):
                cut = soft(parts[lv], t)
                rss = ((x - recompose(cut, name)[:, : x.shape[1]]) ** 2).sum(1)
                total[g] += (x.shape[1] * rss / np.maximum(1e-12, x.shape[1] - nonzero(cut)) ** 2).sum()
            n += len(x)
        if n:
            yield pa.record_batch([pa.array([g[0] for g in grid], pa.int32()), pa.array([g[1] for g in grid]), pa.array(total), pa.array([n] * len(grid), pa.int64())], ["level", "tau", "s", "n"])

    return curves.select("values").mapInArrow(run, "level int, tau double, s double, n long").groupBy("level", "tau").agg((F.sum("s") / F.sum("n")).alias("gcv"))


# --- the entry point --------------------------------------------------------------------------------------------


def smoothing_features(curves: DataFrame, m: int | None = 20, grid: int = 600, fit: str = "bspline", level: int | None = None, standardize: bool = False) -> tuple[DataFrame, np.ndarray]:
    """((sample_id, feature, c), basis on the grid (terms, grid)); all features share one basis.

    m None chooses terms and penalty by cross-validation over all curves; Fourier takes (m - 1) // 2 frequencies;
    wavelet curves are denoised and then projected on m splines.
    """
    curves = normalise.standardize(curves) if standardize else curves
    x = np.linspace(0, 1, grid)
    if fit == "bspline":
        lam = 0.0
        if m is None:
            m, lam = best(gcv_scores(curves, bspline_grid(check_dense(curves))))
        return bspline_coefficients(curves, m, lam), bspline_design(x, m).T
    if fit == "fourier":
        steps = check_dense(curves)
        if m is None:
            n, lam = best(gcv_scores(curves, fourier_grid(steps)))
            d = fourier_design(np.linspace(0, 1, steps), n)
            return apply_matrix(curves, projector(d, fourier_penalty(n), lam)), fourier_design(x, n).T
        n = max(1, (m - 1) // 2)
        return fourier_coefficients(curves, n), fourier_design(x, n).T
    if fit == "wavelet":
        tau = None
        if level is None:
            r = wavelet_scores(curves).orderBy("gcv", "level", "tau").first()
            level, tau = r["level"], r["tau"]
        m = 20 if m is None else m
        return bspline_coefficients(wavelet_denoise(curves, level=level, tau=tau).withColumnRenamed("fit", "values"), m), bspline_design(x, m).T
    raise ValueError(f"unknown fit {fit!r}")
