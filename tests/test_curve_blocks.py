"""All pairs of curves by blocks of distinct ones: kernels over blocks, and copies that are warped once."""

import numpy as np
import pytest

from undula.operators import distance


def _curves(spark, x, ids):
    return spark.createDataFrame([(int(s), f, v.tolist()) for s, c in zip(ids, x) for f, v in enumerate(c)], "sample_id long, feature int, values array<double>")


@pytest.mark.parametrize("t,band", [(30, 12), (30, -1), (40, 5), (9, 2)])
def test_blocks_equal_pairs(t, band):
    r = np.random.default_rng(t)
    a, b = r.normal(size=(5, 2, t)), r.normal(size=(7, 2, t))
    u, v = (k.ravel() for k in np.indices((5, 7)))
    assert np.allclose(distance.elastic_block(a, b, band).ravel(), distance.elastic(a[u], b[v], band), atol=1e-12)
    radius = None if band < 0 else band
    assert np.allclose(distance.dtw_block(a, b, radius).ravel(), distance.dtw(a[u].transpose(0, 2, 1), b[v].transpose(0, 2, 1), radius), atol=1e-12)


@pytest.mark.parametrize("t,radius,least", [(30, 2, 16), (31, 1, 4), (64, 2, 16), (40, 3, 5), (16, 1, 16), (9, 1, 2)])
def test_resolutions_of_blocks_equal_pairs(t, radius, least):
    """Windows by blocks are those of each pair, bit for bit, with equal ways (levels and copies) and values that are no numbers."""
    r = np.random.default_rng(t)
    a, b = r.normal(size=(6, 3, t)).cumsum(2), r.normal(size=(8, 3, t)).cumsum(2)
    a[0], a[1, :, 3:], b[0], b[1, :, : t // 2], b[2], b[3, 1, t // 2] = 0, 1, 0, 1, a[2], np.nan
    u, v = (k.ravel() for k in np.indices((6, 8)))
    want = distance.fast_dtw(a[u].transpose(0, 2, 1), b[v].transpose(0, 2, 1), radius, least)[0]
    assert np.array_equal(distance.fast_dtw_block(a, b, radius, least).ravel(), want, equal_nan=True)


def test_ultrafast_of_short_curves_goes_by_blocks(monkeypatch):
    """No pair of a tile is warped by itself."""
    r = np.random.default_rng(2)
    p, q = r.normal(size=(2, 5, 2, 30)).cumsum(3)
    u, v = (k.ravel() for k in np.indices((5, 5)))
    want = distance.aligned(p[u], q[v], "ultrafast").reshape(5, 5)
    monkeypatch.setattr(distance, "aligned", None)
    assert np.array_equal(distance._kernel("ultrafast", None, 2)(p, q), want)


@pytest.mark.parametrize("metric", distance.METRICS)
def test_copies_take_part_in_all_pairs(spark, monkeypatch, metric):
    """Copies lie on both sides of other curves; each pair's lesser id is held, and no curve is warped more than once."""
    r = np.random.default_rng(5)
    made = r.normal(size=(9, 2, 20)).cumsum(2)
    of = np.array([0, 1, 2, 0, 3, 4, 1, 5, 0, 6, 7, 8, 2, 0])
    ids = r.permutation(len(of)) * 3 + 1
    c = _curves(spark, made[of], ids)
    monkeypatch.setattr(distance, "COPIES", 3)
    rows = distance.pairwise(c, metric).collect()
    got = {(q.i, q.j): q.dist for q in rows}
    assert len(rows) == len(got) == len(of) * (len(of) - 1) // 2
    x = {q.sample_id: np.array(q.x) for q in distance.prepared(c, metric).collect()}
    pairs = sorted(got)
    want = distance.aligned(np.array([x[i] for i, _ in pairs]), np.array([x[j] for _, j in pairs]), metric)
    assert np.allclose([got[p] for p in pairs], want, atol=1e-9)
    assert distance.distinct(distance.prepared(c, metric)).count() == 10  # four copies of one curve, three at most a row


def test_extremes_meet_all_pairs_once(spark, monkeypatch):
    """Both pairs come from one pass over the pairs; of equal distances the lesser ids win, copies included."""
    from undula.operators import graph

    r = np.random.default_rng(8)
    made = np.concatenate([r.normal(size=(11, 2, 16)), np.zeros((1, 2, 16)), 9 + np.zeros((1, 2, 16))])
    of = np.array([12, 0, 1, 2, 3, 11, 4, 5, 6, 11, 7, 8, 12, 9, 10])
    c = _curves(spark, made[of], np.arange(len(of)) * 2)
    pairs = distance.pairwise(c, "fastdtw")
    near, far = (f(pairs).first() for f in (graph.most_similar, graph.most_different))
    monkeypatch.setattr(distance, "pairwise", None)
    got = {q.which: (q.i, q.j, round(q.dist, 9)) for q in distance.extreme_pairs(c).collect()}
    assert got == {"similar": (near.i, near.j, round(near.dist, 9)), "different": (far.i, far.j, round(far.dist, 9))}
    assert got["similar"] == (0, 24, 0.0)
    shown = graph.curves_of(distance.extreme_pairs(c), c).select("which", "sample_id").distinct().collect()
    assert {(q.which, q.sample_id) for q in shown} == {(w, s) for w, v in got.items() for s in v[:2]}


@pytest.mark.parametrize("m", [2, 5])
def test_copies_are_neighbours_without_being_warped(spark, m):
    from undula.operators import graph, nearest

    r = np.random.default_rng(m)
    made = r.normal(size=(12, 2, 16)).cumsum(2)
    of = np.concatenate([np.arange(12), [3] * 7, [4] * 2, [5]])
    ids = r.permutation(len(of)) * 2
    c = _curves(spark, made[of], ids)
    got = {(q.i, q["rank"]): (q.j, round(q.dist, 9)) for q in nearest.of_curves(c, m, block=4).collect()}
    want = {(q.i, q["rank"]): (q.j, round(q.dist, 9)) for q in graph.neighbours(distance.pairwise(c, "fastdtw"), m).collect()}
    assert got == want
    warped = nearest._candidates(distance.distinct(distance.prepared(c, "fastdtw")).select("rep", "x").withColumnRenamed("rep", "sample_id"), m, None, 4).agg({"warped": "sum"}).first()[0]
    assert warped <= 12 * 11 // 2
