"""FISTA by axes: no exchange a round, and the rounds and rule of one task."""

import numpy as np
import pytest

from test_paths import arrays, frames, heaps
from undula.operators import cluster


@pytest.mark.parametrize("first", [3, 256])
def test_axes_go_through_all_rounds_without_an_exchange(spark, monkeypatch, first):
    def no_blocks(*_):
        raise AssertionError("a round is exchanged")

    x = np.vstack((heaps(1, (12, 9)), [[50.0, 50, 50]]))
    p, e = frames(spark, x, 4, np.arange(len(x)) * 2)
    monkeypatch.setattr(cluster, "_Block", no_blocks)
    monkeypatch.setattr(cluster, "FIRST_ROUNDS", first)
    for steps, tol in ((500, 1e-6), (7, 1e-7)):
        got = {r.sample_id: r.u for r in cluster.fista_solve(p, e, 0.4, steps=steps, tol=tol).collect()}
        want = cluster.fista(x, *arrays(np.arange(len(x)) * 2, e), 0.4, steps=steps, tol=tol)
        assert np.abs(np.array([got[2 * k] for k in range(len(x))]) - want).max() < 1e-9


def test_blocks_of_nodes_still_hold_where_edges_are_many(spark, monkeypatch):
    monkeypatch.setattr(cluster, "AXIS_EDGES", 0)
    x = heaps(1, (12, 9))
    p, e = frames(spark, x, 4, np.arange(len(x)) * 2)
    got = {r.sample_id: r.u for r in cluster.fista_solve(p, e, 0.4, tol=1e-6).collect()}
    want = cluster.fista(x, *arrays(np.arange(len(x)) * 2, e), 0.4, tol=1e-6)
    assert np.abs(np.array([got[2 * k] for k in range(len(x))]) - want).max() < 1e-9
