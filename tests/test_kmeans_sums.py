import numpy as np

from undula.operators import cluster


def test_sums_of_clusters_without_scattered_additions(spark, monkeypatch):
    """Rounds equal plain ones; what is no number stays in its own cluster."""
    x = np.random.default_rng(4).normal(size=(60, 5)) + 6 * (np.arange(60) % 3)[:, None]
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, z array<double>")
    centres, costs = cluster.lloyd(p, [x[:3]], rounds=5)
    at = ((x[:, None] - centres[0]) ** 2).sum(2).argmin(1)
    assert np.allclose(centres[0], [x[at == k].mean(0) for k in range(3)])
    assert np.isclose(costs[0], ((x - centres[0][at]) ** 2).sum())
    x[7, 2] = np.nan
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, z array<double>")
    odd = cluster.lloyd(q, [x[:3]], rounds=1)[0][0]
    assert np.isnan(odd).any(1).sum() == 1


def test_a_scan_meets_the_centres_of_all_runs_in_one_product(spark, monkeypatch):
    """Runs of several numbers of clusters have the assignments and costs that each has alone; files of one row group are dealt out."""
    x = np.random.default_rng(6).normal(size=(70, 4)) + 5 * (np.arange(70) % 4)[:, None]
    runs = [x[:2], x[5:8], x[9:14], x[20:21]]
    ends = np.cumsum([len(c) for c in runs])
    starts = ends - [len(c) for c in runs]
    at = cluster._assigned_of_all(x, np.concatenate(runs), starts, ends)
    assert all(np.array_equal(one - s, cluster._assigned(x, c)) for one, s, c in zip(at, starts, runs))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, z array<double>").coalesce(1)
    centres, costs = cluster.lloyd(p, runs, rounds=4, tol=-1.0)
    for c, cost, first in zip(centres, costs, runs):
        alone, own = cluster.lloyd(p, [first], rounds=4, tol=-1.0)
        assert np.allclose(c, alone[0]) and np.isclose(cost, own[0])
    seen = []
    monkeypatch.setattr(cluster, "LEAST_ROWS", 20)
    monkeypatch.setattr(cluster, "lloyd", lambda points, centres, *a: seen.append(points.rdd.getNumPartitions()) or (centres, [0.0] * len(centres)))
    cluster.kmeans_all(p, [2], 1)
    assert seen[0] > 1
