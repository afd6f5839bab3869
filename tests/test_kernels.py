"""Kernels against slow definitions and their invariants."""

import numpy as np
import pytest

from undula.operators import cluster, distance, smoothing
from undula.operators.autoencoder import Network, train
from undula.operators.tape import backward


def velocities(x):
    g = np.gradient(x, 1 / (x.shape[-1] - 1), axis=-1)
    return g / np.sqrt(np.linalg.norm(g, axis=-2, keepdims=True) + 1e-16)


def bumps(t, bend, shift=0.0):
    """A plane curve with three bumps, run through at a speed that ``bend`` changes."""
    s = np.linspace(0, 1, t)
    u = s + bend * s * (1 - s)
    return velocities(np.stack([np.exp(-40 * (u - 0.3 - shift) ** 2) - u**2, u * np.cos(5 * u + 9 * shift)]))


def slow_elastic(a, b, band=-1):
    f, t = a.shape
    e = np.full((t, t), np.inf)
    e[0, 0] = 0
    for i in range(1, t):
        for j in range(1, t):
            for di, dj in distance.MOVES:
                k, m = i - di, j - dj
                if k < 0 or m < 0 or not np.isfinite(e[k, m]) or 0 <= band < abs(i - j):
                    continue
                s = dj / di
                v = [((a[:, k + x] - np.sqrt(s) * np.array([np.interp(m + x * s, np.arange(t), c) for c in b])) ** 2).sum() for x in range(di + 1)]
                e[i, j] = min(e[i, j], e[k, m] + sum((v[x] + v[x + 1]) / 2 for x in range(di)) / (t - 1))
    return np.sqrt(e[-1, -1])


@pytest.mark.parametrize("band", [-1, 4])
def test_elastic_equals_definition(band):
    r = np.random.default_rng(0)
    a, b = r.normal(size=(3, 2, 16)), r.normal(size=(3, 2, 16))
    assert np.allclose(distance.elastic(a, b, band), [slow_elastic(x, y, band) for x, y in zip(a, b)], atol=1e-10)


def test_elastic_ignores_speed():
    base, slowed, other = bumps(70, 0), bumps(70, 0.6), bumps(70, 0, 0.35)
    near, far = distance.elastic(np.stack([base, base]), np.stack([slowed, other]))
    plain = np.sqrt(((base - slowed) ** 2).sum() / 69)
    assert near < far / 4 and near < plain / 2


@pytest.mark.parametrize("t,band", [(18, 1), (23, 5), (45, 11), (64, 40)])
def test_banded_equals_definition(t, band):
    r = np.random.default_rng(t)
    a, b = r.normal(size=(2, 2, 3, t)).cumsum(-1)
    want = np.array([slow_elastic(x, y, band) for x, y in zip(a, b)])
    got = distance.banded(a, b, band)
    assert np.allclose(got, np.where(np.isfinite(want), want, -1), atol=1e-9)


def test_a_narrow_band_falls_back():
    a, b = bumps(40, 0)[None], bumps(40, 0.5)[None]
    center = np.where(np.arange(40) < 20, 0, 2)[None]  # a band that misses the corner
    assert distance.banded(a, b, 3, center)[0] == -1
    assert distance.elastic(a, b, 3, center)[0] == pytest.approx(distance.elastic(a, b)[0], abs=1e-12)


def test_band_around_a_path_equals_the_whole_lattice_there():
    a, b = bumps(50, 0)[None], bumps(50, 0.8)[None]
    whole, taken = distance.elastic_lattice(a, b, track=True)
    path = np.array(distance.alignment_path(taken[0]))
    center = np.rint(np.interp(np.arange(50), path[:, 0], path[:, 1])).astype(int)[None]
    assert distance.banded(a, b, 4, center)[0] == pytest.approx(whole[0], abs=1e-12)
    assert (path[1:] - path[:-1] >= 1).all() and tuple(path[0]) == (0, 0) and tuple(path[-1]) == (49, 49)
    assert len({tuple(x) for x in path[1:] - path[:-1]} - set(distance.MOVES)) == 0


def test_two_passes_are_never_below_the_full_search():
    base = bumps(160, 0)
    for x in (bumps(160, 0.5), bumps(160, -0.4), bumps(160, 0.2, 0.1)):
        full, fast = distance.elastic(base[None], x[None])[0], distance.elastic_fast(base[None], x[None])[0]
        assert full <= fast + 1e-12  # how far above: tests/test_fixtures.py


def slow_dtw(a, b, lo=None, hi=None):
    """(distance, path) cell by cell."""
    ta, tb = len(a), len(b)
    d = np.full((ta + 1, tb + 1), np.inf)
    d[0, 0] = 0
    for i in range(ta):
        for j in range(0 if lo is None else lo[i], tb if hi is None else hi[i] + 1):
            d[i + 1, j + 1] = np.linalg.norm(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    path, i, j = [], ta, tb
    while i and j:
        path.append((i - 1, j - 1))
        step = int(np.argmin([d[i - 1, j - 1], d[i - 1, j], d[i, j - 1]]))
        i, j = i - (step < 2), j - (step != 1)
    return d[ta, tb], path


def slow_fast_dtw(a, b, radius, least=16):
    if min(len(a), len(b)) <= least:
        return slow_dtw(a, b)
    half = lambda x: np.array([(x[2 * k] + x[2 * k + 1]) / 2 for k in range(len(x) // 2)])
    cells = {(2 * i + p + x, 2 * j + q + y) for i, j in slow_fast_dtw(half(a), half(b), radius, least)[1] for p in (0, 1) for q in (0, 1) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1)}
    lo, hi = [len(b)] * len(a), [-1] * len(a)
    for i, j in cells:
        if 0 <= i < len(a):
            lo[i], hi[i] = min(lo[i], max(j, 0)), max(hi[i], min(j, len(b) - 1))
    return slow_dtw(a, b, lo, hi)


def test_warping_family():
    r = np.random.default_rng(1)
    a, b = r.normal(size=(2, 5, 30, 2))
    want = [slow_dtw(x, y) for x, y in zip(a, b)]
    full, rows, cols = distance.dtw_path(a, b)
    assert np.allclose(full, [w[0] for w in want]) and np.allclose(distance.dtw(a, b), full)
    assert [[c for c in zip(x, y) if c[0] >= 0] for x, y in zip(rows.tolist(), cols.tolist())] == [w[1] for w in want]
    lo, hi = zip(*[(max(0, i - 5), min(29, i + 5)) for i in range(30)])
    assert np.allclose(distance.dtw(a, b, 5), [slow_dtw(x, y, lo, hi)[0] for x, y in zip(a, b)])
    assert np.allclose(distance.fast_dtw(a, b, 40)[0], full)


@pytest.mark.parametrize("t,radius", [(17, 1), (40, 2), (75, 1), (75, 5)])
def test_resolutions_equal_definition(t, radius):
    a, b = np.random.default_rng(t).integers(0, 3, (2, 6, t, 2)).astype(float)  # with many ties
    want = [slow_fast_dtw(x, y, radius) for x, y in zip(a, b)]
    got, rows, cols = distance.fast_dtw(a, b, radius)
    assert np.allclose(got, [w[0] for w in want])
    assert [[c for c in zip(x, y) if c[0] >= 0] for x, y in zip(rows.tolist(), cols.tolist())] == [w[1] for w in want]


def test_alignment_path_of_equal_curves_is_the_diagonal():
    base = bumps(40, 0)
    taken = distance.elastic_lattice(base[None], base[None], track=True)[1][0]
    assert all(i == j for i, j in distance.alignment_path(taken))


def test_splines_sum_to_one_and_reproduce_cubics():
    x = np.linspace(0, 1, 50)
    b = smoothing.bspline_design(x, 9)
    assert np.allclose(b.sum(1), 1)
    y = 1 - 2 * x + 3 * x**3
    assert np.allclose(b @ smoothing.projector(b) @ y, y)


@pytest.mark.parametrize("name", ["haar", "db4"])
@pytest.mark.parametrize("n", [16, 30, 37])
def test_wavelets_reconstruct(name, n):
    x = np.random.default_rng(2).normal(size=n)
    assert np.allclose(smoothing.recompose(smoothing.decompose(x, name, 3), name)[:n], x)


def heaps(seed, sizes, spread=0.2):
    """Points around the corners of a polygon, as many at each as ``sizes`` says."""
    r, turn = np.random.default_rng(seed), 2 * np.pi / len(sizes)
    return np.vstack([r.uniform(-spread, spread, (n, 2)) + 5 * np.array([np.cos(k * turn), np.sin(k * turn)]) for k, n in enumerate(sizes)])


def knn_edges(x, m):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    pairs = {(min(i, j), max(i, j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable") if j != i and j in np.argsort(d[i], kind="stable")[: m + 1]}
    i, j = np.array(sorted(pairs)).T
    return i, j, np.exp(-d[i, j])


@pytest.mark.parametrize("criterion", ["silhouette", "davies_bouldin"])
def test_homotopy_finds_heaps(criterion):
    sizes = (9, 7, 8)
    labels = cluster.convex_clusters(heaps(5, sizes), *knn_edges(heaps(5, sizes), 5), criterion)
    assert labels.tolist() == np.repeat(labels[[0, 9, 16]], sizes).tolist() and len(set(labels)) == 3


def test_silhouettes_of_a_path_equal_those_of_its_partitions():
    x = heaps(3, (10, 12))
    _, path = cluster.homotopy(x, *knn_edges(x, 5))
    some = [p for p in path if 2 <= p.max() + 1 < len(x)]
    assert np.allclose(cluster.silhouettes(x, some), [cluster.silhouette(x, p) for p in some])


def test_silhouette_equals_definition_in_bounded_memory():
    import tracemalloc

    r = np.random.default_rng(4)
    x, labels = r.normal(3, 1, (601, 64)), np.append(r.integers(0, 9, 600), 9)
    tracemalloc.start()
    got = cluster.silhouette(x, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(x) ** 2 * 64  # an eighth of the array of all differences
    each = []
    for k, v in enumerate(x):
        d = np.linalg.norm(x - v, axis=1)
        means = {c: d[(labels == c) & (np.arange(len(x)) != k)].mean() for c in range(10) if ((labels == c) & (np.arange(len(x)) != k)).any()}
        a, b = means.pop(labels[k], None), min(v for c, v in means.items() if c != labels[k])
        each.append(0.0 if a is None else (b - a) / max(a, b))
    assert np.isclose(got, np.mean(each))


def test_fista_cannot_be_improved():
    x = heaps(1, (6, 5))
    e = knn_edges(x, 4)
    u = cluster.fista(x, *e, 0.3, steps=4000, tol=1e-12)
    best = cluster.objective(x, u, *e, 0.3)
    r = np.random.default_rng(3)
    assert all(cluster.objective(x, u + r.normal(0, s, u.shape), *e, 0.3) >= best - 1e-9 for s in (1e-3, 1e-2, 0.1) for _ in range(50))
    assert np.array_equal(cluster.fista(x, *e, 0.0), x)


@pytest.mark.parametrize("manifold", [None, "sphere", "poincare"])
def test_gradients(manifold):
    r = np.random.default_rng(0)
    grid = np.linspace(0, 1, 36)
    net = Network(2, [6, 5, 3, 5, 6, 4, 4], smoothing.bspline_design(grid, 8).T, smoothing.bspline_design(grid, 6).T, manifold=manifold)
    x = r.normal(size=(10, 2, 8))
    z = net.encode(x)
    args = (np.arange(10) % 2, np.stack([z[::2].mean(0), z[1::2].mean(0)]), z.mean(0))

    def loss():
        kept = dict(net.stats)
        v = net.variables()
        out = net.loss(v, x, *args, np.random.default_rng(1))
        net.stats = kept
        return v, out

    v, out = loss()
    backward(out)
    for k, p in net.params.items():
        at = tuple(r.integers(s) for s in p.shape)
        old, ends = p[at], []
        for h in (1e-6, -1e-6):
            p[at] = old + h
            ends.append(float(loss()[1].value))
        p[at] = old
        assert abs((ends[0] - ends[1]) / 2e-6 - v[k].grad[at]) < 1e-4


def test_network_learns():
    r = np.random.default_rng(0)
    grid = np.linspace(0, 1, 36)
    phi = smoothing.bspline_design(grid, 8).T
    y = np.arange(20) % 2
    t = np.stack([np.stack([np.sin(2 * np.pi * (1 + k) * grid + p), np.cos(2 * np.pi * (1 + k) * grid + p)]) for k, p in zip(y, r.uniform(0, 1, 20))])
    x = np.einsum("bpt,tm->bpm", t, np.linalg.pinv(phi).copy())
    net = Network(2, [12, 8, 3, 8, 12, 12, 12], phi, smoothing.bspline_design(grid, 6).T)
    i, j = np.triu_indices(20, 1)
    losses = train(net, x, (i, j, np.ones(len(i))), 40, 0.05, 8, pretrain=40)
    assert losses[-1] < losses[0]
    assert net.encode(x).shape == (20, 3) and net.reconstruct(x).shape == (20, 2, 36)


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_sums_by_end_are_those_of_reduceat(monkeypatch, few):
    monkeypatch.setattr(cluster, "FEW_ENTRIES", few)
    monkeypatch.setattr(cluster, "AT_ONCE", 32)
    r = np.random.default_rng(8)
    ends = np.concatenate((r.integers(0, 150, 400), np.full(300, 7), np.full(9, 160), np.full(8, 161), [199]))
    rows, move = r.normal(size=(len(ends), 5)), r.normal(size=(200, 5))
    order = np.argsort(ends, kind="stable")
    first = np.flatnonzero(np.diff(ends[order], prepend=-1))
    for add in (np.add, np.subtract):
        want = move.copy()
        want[ends[order][first]] = add(want[ends[order][first]], np.add.reduceat(rows[order], first, axis=0))
        got = move.copy()
        cluster._add_ends(rows, ends, got, add, np.empty((2, 32, 5)))
        assert (got == want).all()


def test_path_does_not_hang_on_how_sums_are_taken(monkeypatch):
    x = heaps(5, (40, 30, 20))
    e = knn_edges(x, 6)
    want = cluster.merges(x, *e)
    monkeypatch.setattr(cluster, "FEW_ENTRIES", 0)
    monkeypatch.setattr(cluster, "AT_ONCE", 16)
    got = cluster.merges(x, *e)
    assert len(want[0]) > 0 and all((a == b).all() for a, b in zip(got, want))
