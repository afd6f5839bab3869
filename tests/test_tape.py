"""Products of the tape as matrix products, and partitions between epochs, against plain versions."""

import numpy as np
import pytest

from undula.operators import cluster, tape


@pytest.mark.parametrize("spec", ["bpl,qpl->bq", "bi,io->bo", "bq,qzm->bzm", "bzm,mt->bzt", "zym,mt->zyt", "bzt,zyt->byt", "byt,ypt->bpt", "qpk,rpk->qr", "km,mpf->kpf", "bptk,kpf->btf", "btf,tfs->bs"])
def test_products_and_gradients_without_a_search_for_a_path(monkeypatch, spec):
    r = np.random.default_rng(len(spec))
    size = {k: n for n, k in enumerate(sorted(set(spec) - set(",->")), 2)}
    a, b = (tape.Var(r.normal(size=[size[k] for k in part])) for part in spec.split("->")[0].split(","))
    want = np.einsum(spec, a.value, b.value)
    g = r.normal(size=want.shape)
    (ia, ib), out = spec.split("->")[0].split(","), spec.split("->")[1]
    grads = np.einsum(f"{out},{ib}->{ia}", g, b.value), np.einsum(f"{out},{ia}->{ib}", g, a.value)
    monkeypatch.setattr(np, "einsum", None)
    made = tape.einsum(spec, a, b)
    tape.backward((made * g).sum())
    assert np.allclose(made.value, want, rtol=1e-12, atol=1e-12)
    assert all(np.allclose(v.grad, k, rtol=1e-12, atol=1e-12) for v, k in zip((a, b), grads))


def test_nothing_goes_back_to_constants():
    v = tape.Var(np.arange(6.0).reshape(2, 3))
    loss = ((v * np.ones((2, 3)) - 0.5) / 2.0).square().mean()
    tape.backward(loss)
    assert np.allclose(v.grad, (v.value - 0.5) / 2 / 6)
    assert len((v * 2.0).parents) == 1 and tape.einsum("ij,jk->ik", v, np.eye(3)).parents[0][0] is v


def heaps(seed, axes, sizes=(14, 9, 11)):
    r = np.random.default_rng(seed)
    x = np.vstack([r.normal(6 * k, 0.5, (n, axes)) for k, n in enumerate(sizes)])
    d = np.linalg.norm(x[:, None] - x, axis=2)
    i, j = np.nonzero(np.triu(d < np.sort(d, 1)[:, 13, None], 1))
    return x, i, j, np.exp(-d[i, j])


@pytest.mark.parametrize("axes", [1, 3, 8])
def test_a_step_by_axes_is_that_by_rows(monkeypatch, axes):
    g = heaps(axes, axes)
    got = cluster.merges(*g)
    monkeypatch.setattr(cluster, "FEW_AXES", 0)
    want = cluster.merges(*g)
    assert len(got[0]) == len(want[0]) >= 31
    first = slice(0, 12)  # later merges hang on the last bits of sums
    assert np.allclose(got[0][first], want[0][first], rtol=1e-9) and all(np.array_equal(a[first], b[first]) for a, b in zip(got[1:], want[1:]))


@pytest.mark.parametrize("criterion", ["silhouette", "davies_bouldin"])
@pytest.mark.parametrize("sizes", [(14, 9, 11), (14, 1, 11)])
def test_partitions_that_may_not_be_chosen_are_not_made(monkeypatch, criterion, sizes):
    g = heaps(4, 3, sizes)
    lams, path = cluster.homotopy(*g)
    want, _, valid = cluster.select(g[0], lams, path, criterion)
    some = [p for p in path if 2 <= p.max() + 1 < len(g[0]) and np.bincount(p).min() >= 2]
    made, select = [], cluster.select
    monkeypatch.setattr(cluster, "select", lambda x, lams, path, criterion: made.extend(path) or select(x, lams, path, criterion))
    assert np.array_equal(cluster.convex_clusters(*g, criterion), want)
    assert len(made) <= len(some) + 2 and valid == bool(some)
