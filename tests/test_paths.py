"""Merge logs, their labels and scores, forests and dual steps as Spark jobs against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import cluster, evaluate, graph


def heaps(seed, sizes, axes=3):
    r = np.random.default_rng(seed)
    return np.vstack([r.normal(6 * k, 0.5, (n, axes)) for k, n in enumerate(sizes)])


def frames(spark, x, m, ids=None):
    ids = np.arange(len(x)) if ids is None else np.asarray(ids)
    p = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "sample_id long, z array<double>")
    return p, graph.edges(graph.nearest_points(p, m))


def arrays(ids, e):
    rows = sorted((r.i, r.j, r.w) for r in e.collect())
    i, j = (np.searchsorted(ids, [r[k] for r in rows]) for k in (0, 1))
    return i, j, np.array([r[2] for r in rows])


def log_of(path):
    return [(r.step, getattr(r, "lambda"), r.kept, r.absorbed, r.kept_size, r.absorbed_size, r.kept_since, r.absorbed_since) for r in path.orderBy("step").collect()]


@pytest.mark.parametrize("m", [12, 3])
def test_log_is_each_components_own_path(spark, m):
    x = heaps(4, (14, 9, 1, 11))
    ids = np.arange(len(x)) * 3 + 5
    p, e = frames(spark, x, m, ids)
    parts = {r.sample_id: r.component for r in graph.components(e).collect()}
    i, j, w = arrays(ids, e)
    want = []
    for c in sorted(set(parts.values())):
        own = np.flatnonzero([parts.get(k) == c for k in ids])
        among = np.isin(i, own)
        lams, kept, absorbed = cluster.merges(x[own], np.searchsorted(own, i[among]), np.searchsorted(own, j[among]), w[among], of=len(x))
        want += [(lam, c, n, ids[own[a]], ids[own[b]]) for n, (lam, a, b) in enumerate(zip(lams, kept, absorbed))]
    path = cluster.homotopy_path(p, e)
    got = log_of(path)
    assert path.count() == len(x) - len(set(parts.values())) - (len(x) - len(parts))
    assert np.allclose([g[1] for g in got], [v[0] for v in sorted(want)], rtol=1e-12) and [g[2:4] for g in got] == [v[3:] for v in sorted(want)]
    size, since = {k: 1 for k in ids}, {k: 0 for k in ids}
    for step, _, a, b, sa, sb, ta, tb in got:
        assert (sa, sb, ta, tb) == (size[a], size[b], since[a], since[b])
        size[a], since[a] = size[a] + size.pop(b), step
    if len(set(parts.values())) == 1:  # then it is the path on one clock
        assert np.allclose([g[1] for g in got], cluster.homotopy(x, i, j, w)[0], rtol=1e-9)


@pytest.mark.parametrize("seed,sizes,m", [(1, (8, 9, 7), 9), (3, (6, 1, 6), 3)])
def test_labels_and_valid_partitions_of_every_step(spark, seed, sizes, m):
    x = heaps(seed, sizes)
    p, e = frames(spark, x, m)
    path = cluster.homotopy_path(p, e)
    at, want, labels = np.arange(len(x)), {}, {}
    for step, _, a, b, *_ in log_of(path):
        at = np.where(at == b, a, at)
        count = np.unique(at, return_counts=True)[1]
        labels[step] = at
        if 2 <= len(count) < len(x) and count.min() >= 2:
            want[step] = (len(count), count.min())
    assert {r.step: (r.clusters, r.least) for r in cluster.valid_partitions(path, len(x)).collect()} == want
    for step in [0, 1, len(labels) // 2, len(labels)]:
        got = {r.sample_id: r.label for r in cluster.labels_at(p, path, step).collect()}
        assert [got[k] for k in range(len(x))] == (labels[step] if step else np.arange(len(x))).tolist()


@pytest.mark.parametrize("criterion", ["silhouette", "davies_bouldin"])
@pytest.mark.parametrize("seed,sizes,m", [(6, (20, 30), 22)])
def test_scores_of_steps_equal_those_of_partitions(spark, criterion, seed, sizes, m):
    x = heaps(seed, sizes)
    p, e = frames(spark, x, m)
    path = cluster.homotopy_path(p, e)
    first, last = cluster.first_valid(path, len(x))
    steps = (cluster.silhouette_steps if criterion == "silhouette" else cluster.davies_bouldin_steps)(p, path, first, last)
    got = {r.step: r.score for r in steps.collect()}
    assert sorted(got) == list(range(first, last + 1))
    score = cluster.silhouette if criterion == "silhouette" else lambda x, c: -cluster.davies_bouldin(x, c)
    at = np.arange(len(x))
    for step, _, a, b, *_ in log_of(path):
        at = np.where(at == b, a, at)
        if step in got:
            assert got[step] == pytest.approx(score(x, np.unique(at, return_inverse=True)[1]), rel=1e-9)
    best = {r.sample_id: r.cluster for r in cluster.convex_clustering(p, e, criterion).collect()}
    if len(set(r.component for r in graph.components(e).collect())) == 1:
        assert [best[k] for k in range(len(x))] == cluster.convex_clusters(x, *arrays(np.arange(len(x)), e), criterion).tolist()


def test_a_path_without_choice_gives_its_last_partition(spark):
    p, e = frames(spark, np.array([[0.0], [1.0], [1.5]]), 2)
    rows = cluster.convex_clustering(p, e).collect()
    assert {r.cluster for r in rows} == {0} and not any(r.valid for r in rows)
    none = cluster.convex_clustering(p, e.filter("i > 99")).collect()
    assert sorted(r.cluster for r in none) == [0, 1, 2] and not any(r.valid for r in none)


def test_dual_steps_by_blocks_equal_those_of_one_task(spark, monkeypatch):
    tol = 1e-6
    x = np.vstack((heaps(1, (12, 9)), [[50.0, 50, 50]]))
    p, e = frames(spark, x, 4, np.arange(len(x)) * 2)
    star = spark.createDataFrame([(0, 2 * k, 0.3) for k in range(5, 20)], "i long, j long, w double")  # a node with many edges
    e = e.unionByName(star).dropDuplicates(["i", "j"])
    for lam in (0.0, 0.4):
        got = {r.sample_id: r.u for r in cluster.fista_solve(p, e, lam, tol=tol).collect()}
        want = cluster.fista(x, *arrays(np.arange(len(x)) * 2, e), lam, tol=tol)
        assert np.abs(np.array([got[2 * k] for k in range(len(x))]) - want).max() < 1e-9
    monkeypatch.setattr(cluster, "ROUNDS", 3)
    stopped = {r.sample_id: r.u for r in cluster.fista_solve(p, e, 0.4, steps=7).collect()}
    assert np.allclose([stopped[2 * k] for k in range(len(x))], cluster.fista(x, *arrays(np.arange(len(x)) * 2, e), 0.4, steps=7))
    assert np.array_equal(sorted(r.u[0] for r in cluster.fista_solve(p, e.filter("i < 0"), 0.4).collect()), sorted(x[:, 0]))


@pytest.mark.parametrize("few", [0, 3])
def test_forests_by_rounds_equal_those_of_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    monkeypatch.setattr(graph, "_reduced", lambda e: e)  # so that rounds have all edges
    r = np.random.default_rng(8)
    pairs = sorted({tuple(sorted(p)) for p in r.integers(0, 70, (90, 2)).tolist() if p[0] != p[1]} | {(100 + k, 101 + k) for k in range(20)} | {(200, k) for k in range(201, 230)})
    rows = [(a, b, float(r.integers(1, 5))) for a, b in pairs]
    tree, names = graph.spanning(spark.createDataFrame(rows, "a long, b long, m double"))
    plain, root = graph._forest([(m, a, b, a, b) for a, b, m in rows])
    assert sorted((t.m, t.a, t.b) for t in tree.collect()) == sorted(t[:3] for t in plain)
    assert {n.sample_id: n.component for n in names.collect()} == root
    empty = spark.createDataFrame([], "a long, b long, m double")
    assert graph.spanning(empty)[0].count() == 0 and graph.spanning(empty)[1].count() == 0


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(1).alias("c")).repartition(7)
    assert [r.v for r in graph.numbered(df, ["v"], "n").orderBy("n").collect()] == list(range(1000))
    assert [r.n for r in graph.numbered(df, ["v"], "n").orderBy("v").collect()] == list(range(1, 1001))


def test_block_sums_of_odd_labels(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_POINTS", 4)
    monkeypatch.setattr(graph.over_blocks, "__defaults__", (None, 4))
    r = np.random.default_rng(2)
    x, labels = r.normal(size=(19, 2)), [None, "one", *["a", "b"] * 8, None]
    p = spark.createDataFrame([(k, v.tolist(), c) for k, (v, c) in enumerate(zip(x, labels))], "sample_id long, z array<double>, label string")
    got = {q.sample_id: q.s for q in evaluate.silhouette_samples(p).collect()}
    pairs = {q.sample_id: q.s for q in evaluate.silhouette_samples(p, graph.euclidean_pairs(p)).collect()}
    d = np.linalg.norm(x[:, None] - x, axis=2)
    names = np.array([str(c) for c in labels])
    for k in range(19):
        own = (names == names[k]) & (np.arange(19) != k)
        a = d[k][own].mean() if own.any() and labels[k] is not None else None
        b = min(d[k][names == c].mean() for c in ("one", "a", "b") if c != names[k])
        want = 0.0 if a is None else (b - a) / max(a, b)
        assert got[k] == pytest.approx(want) and pairs[k] == pytest.approx(want)
    known = np.array([c is not None for c in labels])
    same, up = names[:, None] == names, np.triu(known[:, None] & known, 1)
    r = graph.class_distances(p).first()
    assert (r.intra, r.inter) == pytest.approx((d[same & up].mean(), d[~same & up].mean()))
