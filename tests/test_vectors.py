"""Blocks of vectors: few copies of a point move, and results are those of plain differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import evaluate, graph


def _points(spark, x, labels=None):
    return spark.createDataFrame([(int(i), v.tolist(), None if labels is None else labels[i]) for i, v in enumerate(x)], "sample_id long, z array<double>, label string")


def _odd(n=61):
    """Copies, near copies, large and tiny vectors."""
    r = np.random.default_rng(5)
    x = r.normal(size=(n, 4))
    x[10:14] = x[3]
    x[14] = x[3] + 1e-9
    x[15] *= 1e6
    x[16], x[17] = x[15], x[15] + 1e-3
    return x


def test_a_point_is_sent_to_a_bounded_number_of_blocks(spark):
    p = spark.range(4000).select(F.col("id").alias("sample_id"), F.array(F.col("id").cast("double")).alias("z"))
    block = graph.block_of(4000)
    assert graph._block_pairs_of(p, "sample_id", ["z"], 4000, block)._df.count() <= 12 * 4000
    assert graph.block_of(600_000) == graph.BLOCK_VECTORS and -(-600_000 // graph.block_of(600_000)) < 40


@pytest.mark.parametrize("block", [7, 100])
def test_vectors_equal_plain_differences(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "block_of", lambda n: block)
    monkeypatch.setattr(graph, "_TILE", (8, 16))
    monkeypatch.setattr(graph, "BOUND_POINTS", 20)
    x = _odd()
    n, p = len(x), _points(spark, x, ["a", "b", "c"] * 20 + ["one"])
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    got = {(q.i, q["rank"]): (q.j, q.dist) for q in graph.nearest_points(p, 3).collect()}
    for i in range(n):
        for k, (dist, j) in enumerate(sorted((d[i, j], j) for j in range(n) if j != i)[:3]):
            assert got[i, k + 1] == (j, dist)
    pairs = sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    near, far = graph.extreme_of_points(p).first(), graph.extreme_of_points(p, far=True).first()
    assert (near.dist, near.i, near.j) == pairs[0]
    assert (-far.dist, far.i, far.j) == min((-v, i, j) for v, i, j in pairs)
    assert {(q.i, q.j): q.dist for q in graph.euclidean_pairs(p).collect()} == pytest.approx({(i, j): v for v, i, j in pairs}, rel=1e-9, abs=0)
    total = {q.i: (q.n, q.total) for q in graph.distance_totals(p).collect()}
    assert all(total[i] == (n - 1, pytest.approx(d[i].sum())) for i in range(n))
    names = np.array(["a", "b", "c"] * 20 + ["one"])
    for q in evaluate.silhouette_samples(p).collect():
        own = (names == names[q.sample_id]) & (np.arange(n) != q.sample_id)
        a, b = (d[q.sample_id][own].mean() if own.any() else None), min(d[q.sample_id][names == c].mean() for c in set(names) - {names[q.sample_id]})
        assert q.s == pytest.approx(0.0 if a is None else (b - a) / max(a, b), abs=1e-9)


def test_vectors_that_are_no_numbers(spark):
    x = np.random.default_rng(1).normal(size=(12, 3))
    x[4, 1], x[7, 0] = np.nan, 1e200
    p = _points(spark, x)
    near = {(q.i, q.j) for q in graph.nearest_points(p, 2).collect()}
    assert not any(4 in pair for pair in near) and {i for i, _ in near} == set(range(12)) - {4, 7}
    assert np.isnan(graph.extreme_of_points(p, far=True).first().dist)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    low = min((d[i, j], i, j) for i in range(12) for j in range(i + 1, 12) if 4 not in (i, j))
    got = graph.extreme_of_points(p).first()
    assert (got.dist, got.i, got.j) == low


def test_means_by_rank_and_class_order_without_rows_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "STRIPES", 3)
    x = _odd(37)
    p = _points(spark, x, ["b", "a", "c"] * 12 + ["b"])
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :-1].mean(0)
    for most in (None, 5):
        got = {q.m: q.avg_dist for q in graph.mean_by_rank(p, most).collect()}
        assert sorted(got) == list(range(1, (most or 36) + 1)) and np.allclose([got[m] for m in sorted(got)], want[: most or 36])
    assert graph.optimal_m_of_points(p) == graph.optimal_m(graph.euclidean_pairs(p), "avg_distance")
    pairs = graph.reorder_by_class(graph.euclidean_pairs(p), p.select("sample_id", "label"))
    key = lambda f: sorted((q.row, q.col, round(q.dist, 6)) for q in f.collect())
    assert key(graph.points_by_class(p)) == key(pairs)


def test_few_candidates_lie_within_the_bounds(spark, monkeypatch):
    """Parts grow with m and n: some m x n / part others are within a point's bound, where parts of 2,048 left many more."""
    n, m = 24_000, 96
    x = np.random.default_rng(4).normal(size=(n, 3))
    points = spark.createDataFrame(list(enumerate(x.tolist())), "sample_id long, z array<double>")
    rows = graph._bounded(graph._flat(points, "sample_id", "z"), m, n, "sample_id", "z").select("sample_id", "bound").collect()
    assert sorted(r.sample_id for r in rows) == list(range(n))
    some = [r for r in rows if r.sample_id % 200 == 0]
    within = [int((((x - x[r.sample_id]) ** 2).sum(1) <= r.bound).sum()) for r in some]
    assert min(within) > m and np.mean(within) < 4 * m
