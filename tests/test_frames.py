"""DataFrame operators: sources and sinks, graphs, manifolds, experiments, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.functions import manifolds, normalise
from undula.operators import autoencoder, cluster, distance, evaluate, graph
from undula.plans import runner
from undula.sources import curves, generators
from undula.streaming import ingest


def frame(spark, x):
    return spark.createDataFrame([(i, f, [float(v) for v in c]) for i, s in enumerate(x) for f, c in enumerate(s)], "sample_id long, feature int, values array<double>")


def test_wide_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(7, 2, 5))
    labels = spark.createDataFrame([(i, i % 3) for i in range(7)], "sample_id long, label int")
    curves.save_wide(frame(spark, x), labels, str(tmp_path / "w"))
    back, lab = curves.load_wide(spark, str(tmp_path / "w"), 2, 5)
    got = {(r.sample_id, r.feature): r["values"] for r in back.collect()}
    assert np.allclose([[got[i, f] for f in range(2)] for i in range(7)], x)
    assert [int(r.label) for r in lab.orderBy("sample_id").collect()] == [i % 3 for i in range(7)]


def test_arff_and_ts(spark, tmp_path):
    (tmp_path / "a.arff").write_text("% c\n@relation r\n@attribute x numeric\n@data\n1,2,3,b\n4,5,7,a\n")
    c, lab = curves.load_arff(spark, str(tmp_path / "a.arff"))
    got = {r.sample_id: r["values"] for r in c.collect()}
    assert got[min(got)][0] == -1 and got[max(got)][2] == 1
    assert [r.label for r in lab.orderBy("sample_id").collect()] == [0, 1]
    (tmp_path / "m.arff").write_text("@relation r\n@attribute series relational\n@data\n'1,2,3\\n10,20,30',up\n'3,2,1\\n30,10,20',down\n")
    c, lab = curves.load_arff(spark, str(tmp_path / "m.arff"))
    assert c.count() == 4 and c.agg(F.min(F.array_min("values"))).first()[0] == -1
    (tmp_path / "t.ts").write_text("@problemName p\n@data\n1,2,3:4,5,6:x\n7,8,9:1,1,1:y\n")
    c, lab = curves.load_ts(spark, str(tmp_path / "t.ts"))
    assert c.count() == 4 and {r.label for r in lab.collect()} == {"x", "y"}


def test_ragged_curves_are_refused(spark):
    bad = spark.createDataFrame([(0, 0, [1.0, 2.0]), (1, 0, [1.0])], "sample_id long, feature int, values array<double>")
    with pytest.raises(ValueError):
        curves.check_dense(bad)


def test_standardised_moments(spark):
    r, t = np.random.default_rng(0), np.linspace(0, 1, 50)
    x = np.stack([2 + 3 * np.sin(2 * np.pi * t) + 0.1 * r.normal(size=(30, 50)), -1 + 0.5 * np.cos(2 * np.pi * t) + 0.1 * r.normal(size=(30, 50))], 1)
    s = normalise.standard_stats(normalise.standardize(frame(spark, x))).agg(F.max(F.abs("mean")), F.max(F.abs(F.col("std") - 1))).first()
    assert s[0] < 1e-5 and s[1] < 1e-2


def test_pairs_equal_definition_whatever_the_blocks(spark):
    x = np.random.default_rng(1).normal(size=(23, 3))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, z array<double>")
    got = {(r.i, r.j): r.dist for r in graph.block_pairs(p, "sample_id", ["z"], lambda a, b, s: np.sqrt(((np.array([r[0] for r in a])[:, None] - np.array([r[0] for r in b])[None]) ** 2).sum(2)), block=4).collect()}
    assert len(got) == 23 * 22 // 2 and all(np.isclose(d, np.linalg.norm(x[i] - x[j])) for (i, j), d in got.items())
    assert graph.check_pairs(graph.euclidean_pairs(p)) == 23
    with pytest.raises(ValueError):
        graph.check_pairs(graph.euclidean_pairs(p).filter("i > 0 or j > 1"))


def test_components_for_every_m(spark):
    x = np.vstack([np.random.default_rng(2).normal(c, 0.3, (8, 2)) for c in (0, 5, 10)])
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, z array<double>")
    knn = graph.neighbours(graph.euclidean_pairs(p))
    got = {r.m: r.components for r in graph.components_by_m(knn).collect()}
    rows = knn.collect()
    for m in (1, 2, 5, 8, 12, 23):
        up = list(range(24))

        def find(a):
            while up[a] != a:
                a = up[a]
            return a

        for r in rows:
            if r["rank"] <= m:
                up[find(r.i)] = find(r.j)
        assert got[m] == len({find(i) for i in range(24)})
    assert graph.optimal_m(graph.euclidean_pairs(p)) == min(m for m, c in got.items() if c == 1)
    with pytest.raises(ValueError):
        graph.optimal_m(graph.euclidean_pairs(p), "other")


@pytest.mark.parametrize("kind", ["sphere", "poincare"])
def test_maps_invert(spark, kind):
    x = np.random.default_rng(3).normal(size=(10, 3))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if kind == "sphere" else 0.6 * x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "y array<double>")
    back = df.select("y", manifolds.to_tangent(F.col("y"), kind).alias("v")).select("y", manifolds.readout(F.col("v"), kind).alias("b")).collect()
    assert max(np.abs(np.array(r.y) - np.array(r.b)).max() for r in back) < 1e-4
    with pytest.raises(ValueError):
        manifolds.readout(F.col("y"), "torus")


def test_euclidean_readout_is_identity(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "y array<double>")
    assert df.select(manifolds.readout(F.col("y"), None)).first()[0] == [1.0, 2.0]


def test_karcher_mean(spark):
    v = np.array([[1, 0.2, 0], [1, -0.2, 0], [1, 0, 0.2], [1, 0, -0.2]], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(x.tolist(),) for x in v], "y array<double>")
    assert np.allclose(manifolds.fit_anchor(df, "y"), [1, 0, 0], atol=1e-6)


def test_anchor_query_sees_every_axis(spark, sf):
    from undula.plans import catalog

    got = np.array([r.x for r in catalog.karcher_anchor(spark, sf).orderBy("k").collect()])
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], float) / 10
    assert len(got) == x.shape[1]
    x[:, 0] = 0
    n = np.linalg.norm(x, axis=1, keepdims=True)
    y = np.sin(n) / n * x
    y[:, 0] = np.cos(n[:, 0])
    angle = np.arccos(np.clip(y @ got, -1, 1))[:, None]
    assert np.abs((angle / np.sin(angle) * (y - np.cos(angle) * got)).mean(0)).max() < 1e-5  # no pull is left at the mean


def test_generators_keep_to_their_manifolds(spark):
    for kind, test in (("hypersphere", lambda n: np.allclose(n, 1)), ("hyperbolic", lambda n: (n < 1).all())):
        x = np.array([r["values"] for r in generators.generate(spark, kind, samples=6).orderBy("sample_id", "feature").collect()]).reshape(6, -1, generators.CATALOG[kind][2])
        assert test(np.linalg.norm(x, axis=1))
    with pytest.raises(ValueError):
        generators.generate(spark, "klein")


def test_metrics_need_a_name(spark, sf):
    with pytest.raises(ValueError):
        distance.pairwise(curves.from_events(spark, sf), "cosine")


def test_scores_of_equal_partitions(spark):
    df = spark.createDataFrame([(i, i % 3, (i % 3) * 7) for i in range(30)], "id long, a int, b int")
    assert evaluate.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(1)
    assert evaluate.adjusted_mutual_information(df, "a", "b").first()[0] == pytest.approx(1)


def test_homotopy_frames(spark):
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(0, 0.25, (12, 2)), r.normal(6, 0.25, (12, 2))])
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, z array<double>")
    e = graph.edges(graph.neighbours(graph.euclidean_pairs(p), 4))
    got = {q.sample_id: q.cluster for q in cluster.convex_clustering(p, e).collect()}
    assert len({got[i] for i in range(12)}) == 1 and got[0] != got[12]
    path = cluster.homotopy_path(p, e)
    assert {q.step for q in cluster.valid_partitions(path, 24).collect()} and cluster.labels_at(p, path, 0).select("label").distinct().count() == 24


def test_path_queries_see_every_axis(spark, sf):
    from undula.plans import catalog

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(min(a, b), max(a, b)) for a in range(len(x)) for b in np.argsort(d[a], kind="stable")[: catalog.M]}
    e = catalog._groups(spark, sf)[1].collect()
    assert {(ids.index(r.i), ids.index(r.j)) for r in e} == want
    assert catalog.fista_solve(spark, sf).groupBy("sample_id").count().agg(F.min("count")).first()[0] == x.shape[1]


def test_experiment(spark):
    r = runner.run_experiment(spark, "pendulum", fast=True, samples=24)
    row = r["result"].first()
    assert 1 <= row.n_pred <= 24 and row.n_true == 4 and r["log"].count() == 20


def test_experiment_queries_run_all_event_curves_at_the_defaults(spark, sf, monkeypatch):
    from undula.plans import catalog

    seen = {}
    row = spark.createDataFrame([("given", 4, 1.0, 1.0, 4)], "dataset string, n_true int, ari double, ami double, n_pred int")
    study = spark.createDataFrame([(0, 1.0)], "trial int, value double")
    monkeypatch.setattr(runner, "run_experiment", lambda _, x, **k: seen.update(k, x=x.select("sample_id").distinct().count()) or {"result": row, "release": lambda: None})
    monkeypatch.setattr(runner, "optimize", lambda _, coefs, *a, **k: seen.update(k, n=coefs.select("sample_id").distinct().count()) or ({}, study))
    catalog.run_experiment(spark, sf), catalog.tune(spark, sf)
    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    assert seen == {"x": users, "n": users}


def test_every_query_reads_its_folder(spark, tmp_path):
    from undula.plans import catalog

    for name, run in catalog.QUERIES.items():
        with pytest.raises(Exception):
            run(spark, str(tmp_path)).count()


def test_stream_of_points_equals_batch(spark, tmp_path):
    rows = [(s, f, f"2024-01-{d:02d} 00:00:00", float(d)) for s in (1, 2) for f in ("a", "b") for d in range(1, 29)]
    df = spark.createDataFrame(rows, "sample_id long, feature string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.windowed_curves(ingest.read_points(spark, str(tmp_path / "in"), files=10))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = df.groupBy(F.window("ts", "7 days").alias("window"), "sample_id", "feature").agg(F.sum("value").alias("value"))
    assert spark.table("w").agg(F.sum("value"), F.count("*")).first()[:] == batch.agg(F.sum("value"), F.count("*")).first()[:]


def test_cells_outside_a_given_grid_raise(spark, sf):
    with pytest.raises(Exception, match="outside the grid"):
        curves.from_events(spark, sf, days=10).collect()
    with pytest.raises(Exception, match="outside the grid"):
        curves.from_lineitem(spark, sf, months=20).collect()
    assert curves.check_dense(curves.from_events(spark, sf)) == 30


def test_rows_are_numbered_in_the_order_of_many_files(spark, tmp_path):
    sizes = (3, 400, 0, 1, 90)
    for n, size in enumerate(sizes):
        (tmp_path / f"part-{n}.txt").write_text("".join(f"{n}:{i}\n" for i in range(size)))
    got = [r.value for r in curves.numbered(spark.read.text(str(tmp_path))).orderBy("sample_id").collect()]
    ids = [r.sample_id for r in curves.numbered(spark.read.text(str(tmp_path))).orderBy("sample_id").collect()]
    assert got == [f"{n}:{i}" for n, size in enumerate(sizes) for i in range(size)] and ids == list(range(len(got)))


def test_nearest_points_and_components_equal_brute_force(spark, monkeypatch):
    x = np.random.default_rng(3).integers(0, 4, (41, 2)).astype(float)  # with many ties
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, z array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    near = {i: sorted((d[i, j], j) for j in range(41) if j != i) for i in range(41)}
    directed = graph.ranked(graph.block_pairs(points, "sample_id", ["z"], graph._exact, block=9, nearest=7), 7)
    for out in (directed, graph.nearest_points(points, 7)):
        got = {(r.i, r["rank"]): (r.dist, r.j) for r in out.collect()}
        assert got == {(i, k + 1): near[i][k] for i in range(41) for k in range(7)}
    comps = {r.m: r.components for r in graph.components_of_points(points, first=2).collect()}
    for m in range(1, 41):
        up = list(range(41))
        for _ in range(41):
            for i in range(41):
                for _, j in near[i][:m]:
                    up[i] = up[j] = min(up[i], up[j])
        assert comps[m] == len(set(up))


def test_batches_hold_each_row_once(spark):
    got = autoencoder.minibatches(spark.range(1000).withColumnRenamed("id", "sample_id"), 64, seed=3).toPandas().sort_values(["batch", "place"])
    assert got.batch.value_counts().sort_index().tolist() == [64] * 15 + [40] and sorted(got.sample_id) == list(range(1000))
    assert not (got.sample_id.diff().dropna() > 0).all()
    other = autoencoder.minibatches(spark.range(1000).withColumnRenamed("id", "sample_id"), 64, seed=4).toPandas().sort_values(["batch", "place"])
    assert got.sample_id.tolist() != other.sample_id.tolist()


def test_mutual_information_of_many_rows_equals_the_whole_sum(spark):
    from math import exp, lgamma, log

    r = np.random.default_rng(0)
    a, b = r.integers(0, 3, 3000), np.minimum(r.integers(0, 40, 3000), 5)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a int, b int")
    t = np.array([[((a == i) & (b == j)).sum() for j in range(6)] for i in range(3)])
    n, ra, rb = 3000, t.sum(1), t.sum(0)
    mi = sum(v / n * log(n * v / (ra[i] * rb[j])) for (i, j), v in np.ndenumerate(t) if v)
    lf = lambda v: lgamma(v + 1)
    emi = sum(k / n * log(n * k / (x * y)) * exp(lf(x) + lf(y) + lf(n - x) + lf(n - y) - lf(n) - lf(k) - lf(x - k) - lf(y - k) - lf(n - x - y + k)) for x in ra for y in rb for k in range(max(1, x + y - n), min(x, y) + 1))
    h = [-sum(v / n * log(v / n) for v in s) for s in (ra, rb)]
    assert evaluate.adjusted_mutual_information(df, "a", "b").first()[0] == pytest.approx((mi - emi) / (sum(h) / 2 - emi), abs=1e-9)
