"""Training over several tasks against training in one."""

import threading

import numpy as np
import pytest

from undula.operators import autoencoder, graph, smoothing, training


def samples(n=20, steps=36, m=8):
    """Curves at frequency 1 or 2 with random phases, as coefficients."""
    r = np.random.default_rng(0)
    t = np.linspace(0, 1, steps)
    x = np.stack([[np.sin(2 * np.pi * (1 + k % 2) * t + p) + r.normal(0, 0.03, steps), np.cos(2 * np.pi * (1 + k % 2) * t + p) + r.normal(0, 0.03, steps)] for k in range(n) for p in [r.uniform(0, 1)]])
    return np.einsum("npt,mt->npm", x, smoothing.projector(smoothing.bspline_design(t, m)))


def network(keep=0.9, manifold=None):
    grid = np.linspace(0, 1, 30)
    return autoencoder.Network(2, [12, 8, 3, 8, 12, 12, 12], smoothing.bspline_design(grid, 8).T, smoothing.bspline_design(grid, 6).T, keep=keep, manifold=manifold)


class Meeting:
    """allGather for threads."""

    def __init__(self, parts):
        self.said, self.barrier = [""] * parts, threading.Barrier(parts)

    def gather(self, part):
        def go(text):
            self.said[part] = text
            self.barrier.wait()
            out = list(self.said)
            self.barrier.wait()
            return out

        return go


@pytest.mark.parametrize("parts,batch", [(1, 8), (3, 7), (4, 20)])
def test_tasks_in_step_equal_one_task(parts, batch):
    x, labels = samples(), np.arange(20) % 3
    means, mean = np.random.default_rng(1).normal(size=(3, 3)), np.zeros(3)
    rng, one = np.random.default_rng(0), network()
    speed, want = {k: np.zeros_like(p) for k, p in one.params.items()}, []
    for _ in range(3):
        order, losses = rng.permutation(20), []
        for a in range(0, 20, batch):
            v = one.variables()
            loss = one.loss(v, x[order[a : a + batch]], labels[order[a : a + batch]], means, mean, rng)
            training.backward(loss)
            for k, p in v.items():
                speed[k] = 0.9 * speed[k] + 0.1 * p.grad
                one.params[k] = one.params[k] - 1e-2 * speed[k]
            losses.append(float(loss.value))
        want.append(np.mean(losses))
    meeting, nets, got = Meeting(parts), [network() for _ in range(parts)], {}

    def task(p):
        idx = np.arange(20)[np.arange(20) * 7 % 20 % parts == p] if parts < 4 else np.arange(20)[(np.arange(20) % 3) == p]  # with four, one has no rows
        got[p] = training.steps(nets[p], idx, x[idx], labels[idx], 20, meeting.gather(p), p == 0, np.random.default_rng(0), {k: np.zeros_like(q) for k, q in nets[p].params.items()}, 3, 1e-2, batch, 0.9, means, mean)

    threads = [threading.Thread(target=task, args=(p,)) for p in range(parts)]
    [t.start() for t in threads], [t.join(60) for t in threads]
    for p in range(parts):
        assert np.allclose(got[p], want, rtol=1e-10)
        assert all(np.abs(nets[p].params[k] - one.params[k]).max() < 1e-9 for k in one.params) and all(np.abs(nets[p].stats[k] - one.stats[k]).max() < 1e-9 for k in one.stats)


def test_a_barrier_stage_equals_one_task(spark):
    x = samples()
    coefs = spark.createDataFrame([(3 * k + 1, f, c.tolist()) for k, s in enumerate(x) for f, c in enumerate(s)], "sample_id long, feature int, c array<double>")
    flat = spark.createDataFrame([(3 * k + 1, s.ravel().tolist()) for k, s in enumerate(x)], "sample_id long, z array<double>")
    e = graph.edges(graph.nearest_points(flat, 12))
    rows = sorted((r.i // 3, r.j // 3, r.w) for r in e.collect())
    i, j, w = (np.array(c) for c in zip(*rows))
    one, many = network(), network()
    want = autoencoder.train(one, x, (i, j, w), 2, 1e-2, 20, 0.9, 1)
    got = training.train(coefs, e, many, 2, 1e-2, 20, 0.9, 1, parts=2)
    assert np.allclose(got, want, rtol=1e-9) and all(np.abs(many.params[k] - one.params[k]).max() < 1e-9 for k in one.params)
