"""Convex clustering: FISTA on the dual, the agglomerative homotopy path as a log of merges, and k-means sweeps.

A merge path is sequential within a component of the graph and nothing else: components pull on themselves alone, so
each is one group, and all run side by side. Directions are taken anew at a component's own merges, so a component's
path is the one it has by itself, whatever else is in the table; the pull strengths order the merges of all of them.
The path is a row a merge, not a row a point and step: labels, sizes and scores of any step are derived from that log.

FISTA goes by axes, which share nothing but the stopping rule. Where the edges are too many for a task, it goes by blocks
of nodes: a block holds the edges of its nodes, and every round sends the sums of its border nodes to the blocks that
share an edge with them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.functions import normalise
from undula.operators import graph
from undula.sources.shared import dropped, written

#: Rows of the distance matrix that a silhouette holds at a time.
ROWS = 256


def fista(x: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, lam: float, n: int | None = None, steps: int = 500, tol: float = 1e-7) -> np.ndarray:
    """U of the least (1/n) |X - U|^2 + lam sum w |u_i - u_j|_1, by accelerated projected steps on the dual."""
    if not len(i) or lam == 0:
        return x.copy()
    n = len(x) if n is None else n
    forward = lambda u: u[i] - u[j]

    def back(z):
        out = np.zeros_like(x)
        np.add.at(out, i, z)
        np.subtract.at(out, j, z)
        return out

    degree = np.bincount(np.concatenate((i, j)))
    step, box = 1 / (n / 2 * (degree[i] + degree[j]).max()), (lam * w)[:, None]
    z = np.zeros((len(i), x.shape[1]))
    y, t = z, 1.0
    for _ in range(steps):
        new = np.clip(y + step * forward(x - n / 2 * back(y)), -box, box)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - z)
        still = np.linalg.norm(new - z) <= tol * (np.linalg.norm(z) + 1e-12)
        z, t = new, t_new
        if still:
            break
    return x - n / 2 * back(z)


def objective(x: np.ndarray, u: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, lam: float) -> float:
    return float(((x - u) ** 2).sum() / len(x) + lam * (w[:, None] * np.abs(u[i] - u[j])).sum())


#: Rows that are worked on at a time, so that they stay in a core's cache.
AT_ONCE = 2048
#: Ends of a node that are added rank by rank, and entries up to which all of them are left to ``reduceat``.
FEW_ENDS, FEW_ENTRIES = 8, 1 << 17
#: Axes up to which a step goes through each of them over all edges.
FEW_AXES = 8


def _parts(size: int, by: int) -> list[slice]:
    return [slice(at, min(at + by, size)) for at in range(0, size, by)]


def _add_ends(rows: np.ndarray, ends: np.ndarray, move: np.ndarray, add: np.ufunc, space: np.ndarray) -> None:
    """move[e] = add(move[e], sum of the rows with end e), with the sums that ``np.add.reduceat`` gives of rows sorted by end.

    That works through each node and column by itself, which is slow where nodes have few rows: those are added rank by
    rank, the first rows of some nodes, then the second ones, in the same order of additions.
    """
    order = np.argsort(ends.astype(np.uint16) if len(move) <= 1 << 16 else ends, kind="stable")
    sorted_ = ends[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    if rows.size <= FEW_ENTRIES:
        node = sorted_[first]
        move[node] = add(move[node], np.add.reduceat(rows[order], first, axis=0))
        return
    many = np.diff(first, append=len(order))
    by_size = np.argsort(-np.minimum(many, FEW_ENDS + 1), kind="stable")
    first, many = first[by_size], many[by_size]
    node, hubs = sorted_[first], int((many > FEW_ENDS).sum())
    for part in _parts(hubs, AT_ONCE // 16):
        at, size = first[part], many[part]
        begin = np.cumsum(size) - size
        within = np.arange(size.sum()) - np.repeat(begin - at, size)
        move[node[part]] = add(move[node[part]], np.add.reduceat(rows[order[within]], begin, axis=0))
    first, many, node = first[hubs:], many[hubs:], node[hubs:]
    for part in _parts(len(first), AT_ONCE):
        at, size = first[part], many[part]
        sums, there = space[0, : len(at)], space[1]
        for rank in (*range(1, int(size[0])), 0):
            have = int((size > rank).sum())
            np.take(rows, order[at[:have] + rank], axis=0, out=there[:have], mode="clip")
            before = 0 if rank == 1 else have if rank else int((size > 1).sum())
            np.add(there[:before], sums[:before], out=sums[:before])
            sums[before:have] = there[before:have]
        move[node[part]] = add(np.take(move, node[part], axis=0, out=there[: len(at)], mode="clip"), sums, out=sums)


def _step_by_axes(kk: np.ndarray, vv: np.ndarray, d: np.ndarray, db: np.ndarray, move: np.ndarray, pull: Callable, rate: np.ndarray, step: float, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(squares, lengths of differences d, squares of their moves db, products of both) after ``step``, all (axes, edges) or (axes, nodes).

    Rows of a few numbers cost as much to reach as to add; along an axis, ends are sums by node.
    """
    if step:
        d += np.multiply(db, step, out=room)
    square = np.multiply(d, d, out=room).sum(0)
    length = np.sqrt(square)
    np.multiply(d, pull(slice(None), length), out=db)
    for a in range(len(d)):
        np.subtract(np.bincount(vv, db[a], len(rate)), np.bincount(kk, db[a], len(rate)), out=move[a])
        move[a] *= rate
        np.take(move[a], kk, out=db[a], mode="clip")
        db[a] -= np.take(move[a], vv, out=room[a], mode="clip")
    den = np.multiply(db, db, out=room).sum(0)
    return square, length, den, np.multiply(d, db, out=room).sum(0)


def merges(x: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, directed: set[tuple[int, int]] | None = None, of: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pull strength, kept, absorbed) of each merge: a cluster is named by its least member. ``of`` is the number of all points.

    Affinities of clusters are kept as sorted arrays of edges and merged along with the clusters; differences of
    centres move along lines between two merges, so they are stepped, not gathered, in arrays that stay, ``AT_ONCE`` rows
    at a time. Places of absorbed clusters are given up once half are. ``directed`` (i, j) restricts, between two clusters,
    to the listed neighbours of the smaller one, the first of equals; without it every edge counts.
    """
    n = len(x) if of is None else of
    weight = {(min(a, b), max(a, b)): float(s) for a, b, s in zip(i, j, w)}
    members = {k: [k] for k in range(len(x))}
    table: dict[tuple[int, int], float] = dict(weight)

    def listed(k, v):
        small, large = (members[k], members[v]) if len(members[k]) <= len(members[v]) else (members[v], members[k])
        inside = set(large)
        return sum(weight.get((min(a, b), max(a, b)), 0.0) for a in small for b in inside if (a, b) in directed)

    few = x.shape[1] <= FEW_AXES
    laid = np.asfortranarray if few else np.ascontiguousarray  # an axis, or a row, lies together
    center, size, log, lam = laid(np.array(x, float)), np.ones(len(x)), [], 0.0
    name, left = np.arange(len(x)), len(x)  # the cluster at each place; places are in the order of names
    move = np.empty_like(center)
    k, v = np.array(sorted(table)).reshape(-1, 2).T.copy()
    aff = np.array([table[p] for p in zip(k.tolist(), v.tolist())])
    d0, count = laid(center[k] - center[v]), len(k)
    db, step = np.empty_like(d0), 0.0  # the last step is yet to be taken by ``d0``
    space = np.empty((2, AT_ONCE, d0.shape[1]))
    room = np.empty_like(d0.T) if few else None
    while left > 1 and count:
        kk, vv, d, db_ = k[:count], v[:count], d0[:count], db[:count]
        if directed is not None:
            now = np.array([listed(*p) for p in zip(name[kk].tolist(), name[vv].tolist())])
            pulls = now > 0
        else:
            now, pulls = aff[:count], np.ones(count, bool)
        if not pulls.any():
            break
        pull = lambda e, length: np.where(pulls[e] & (length > 1e-12), now[e] / np.maximum(length, 1e-12), 0)
        if few:
            square, length, den, num = _step_by_axes(kk, vv, d.T, db_.T, move.T, pull, n / (2 * size), step, room[:, :count])
        else:
            square, den, num = np.empty(count), np.empty(count), np.empty(count)
            for e in _parts(count, AT_ONCE):
                if step:
                    d[e] += np.multiply(db_[e], step, out=space[0, : e.stop - e.start])
                np.einsum("ij,ij->i", d[e], d[e], out=square[e])
                np.multiply(d[e], pull(e, np.sqrt(square[e]))[:, None], out=db_[e])
            length = np.sqrt(square)
            move[:] = 0
            _add_ends(db_, kk, move, np.subtract, space)
            _add_ends(db_, vv, move, np.add, space)
            move *= (n / (2 * size))[:, None]
            for e in _parts(count, AT_ONCE):
                mine = np.take(move, kk[e], axis=0, out=db_[e], mode="clip")
                mine -= np.take(move, vv[e], axis=0, out=space[0, : len(mine)], mode="clip")
                np.einsum("ij,ij->i", mine, mine, out=den[e])
                np.einsum("ij,ij->i", d[e], mine, out=num[e])
        tau = np.where(pulls & (den >= 1e-18), -num / np.maximum(den, 1e-18), -1)
        ok = tau > 1e-12
        exact = ok & (np.sqrt(np.maximum(square - num * num / np.maximum(den, 1e-18), 0)) < 1e-6 * (length + 1e-9))
        among = np.flatnonzero(exact if exact.any() else ok)
        if not len(among):
            break
        least = among[tau[among] == tau[among].min()]
        hit = least[np.lexsort((vv[least], kk[least]))[0]]
        step, a, b = float(tau[hit]), int(kk[hit]), int(vv[hit])
        lam += step
        center += np.multiply(move, step, out=move)
        center[a] = (size[a] * center[a] + size[b] * center[b]) / (size[a] + size[b])
        size[a] += size[b]
        log.append((lam, int(name[a]), int(name[b])))
        if directed is not None:
            members[name[a]] = members[name[a]] + members.pop(name[b])
        left -= 1
        # the edges of both become edges of ``a``, sums where both had one, in the places of those they replace
        touched = np.flatnonzero((kk == a) | (vv == a) | (kk == b) | (vv == b))
        far = np.where((kk[touched] == a) | (kk[touched] == b), vv[touched], kk[touched])
        inner = (far == a) | (far == b)
        others, place = np.unique(far[~inner], return_inverse=True)
        sums = np.bincount(place, aff[touched][~inner], len(others))
        put, free = touched[: len(others)], touched[len(others) :]
        k[put], v[put], aff[put] = np.minimum(a, others), np.maximum(a, others), sums
        d0[put], db[put] = center[k[put]] - center[v[put]], 0
        last = count - len(free)
        empty, full = free[free < last], np.setdiff1d(np.arange(last, count), free)
        for c in (k, v, aff, d0, db):
            c[empty] = c[full]
        count, name[b] = last, -1
        if 2 * left < len(name):
            live = name >= 0
            to = np.cumsum(live) - 1
            k[:count], v[:count] = to[k[:count]], to[v[:count]]
            center, size, name = laid(center[live]), size[live], name[live]
            move = np.empty_like(center)
    lams, kept, absorbed = zip(*log) if log else ((), (), ())
    return np.array(lams, float), np.array(kept, int), np.array(absorbed, int)


def homotopy(x: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, directed: set[tuple[int, int]] | None = None) -> tuple[list[float], list[np.ndarray]]:
    """(pull strengths of the merges, labels before the first and after each), all on one clock."""
    lams, kept, absorbed = merges(x, i, j, w, directed)
    at, path = np.arange(len(x)), [np.arange(len(x))]
    for a, b in zip(kept, absorbed):
        at = np.where(at == b, a, at)
        path.append(np.unique(at, return_inverse=True)[1])
    return lams.tolist(), path




def silhouettes(x: np.ndarray, partitions: list[np.ndarray]) -> np.ndarray:
    """The mean silhouette of each of the partitions, of which each joins clusters of the one before.

    Distances come once, as rows of ``ROWS`` by Gram products, so memory grows with n, whatever the number of axes;
    a row's sums over the clusters of a partition are sums of those of the one before.
    """
    x = x - x.mean(0)
    norm, total = (x * x).sum(1), np.zeros(len(partitions))
    coded = [np.unique(p, return_inverse=True, return_counts=True)[1:] for p in partitions]
    joins, before = [], np.arange(len(x))  # of each partition: the order of the clusters before it, and where each new one begins
    for labels, _ in coded:
        first = np.unique(before, return_index=True)[1]
        into = labels[first]
        order = np.argsort(into, kind="stable")
        joins.append((order, np.searchsorted(into[order], np.arange(labels.max() + 1))))
        before = labels
    for lo in range(0, len(x), ROWS):
        at = np.arange(lo, min(lo + ROWS, len(x)))
        here = np.arange(len(at))
        sums = np.sqrt(np.maximum(norm[at, None] + norm - 2 * x[at] @ x.T, 0))
        sums[here, at] = 0
        for n, ((labels, count), (order, first)) in enumerate(zip(coded, joins)):
            sums = np.add.reduceat(sums[:, order], first, axis=1)
            own = count[labels[at]]
            a = sums[here, labels[at]] / np.maximum(own - 1, 1)
            means = sums / count
            means[here, labels[at]] = np.inf
            b = means.min(1)
            total[n] += float(np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).sum())
    return total / len(x)


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    return float(silhouettes(x, [labels])[0])


def davies_bouldin(x: np.ndarray, labels: np.ndarray) -> float:
    k = labels.max() + 1
    c = np.stack([x[labels == g].mean(0) for g in range(k)])
    s = np.array([np.linalg.norm(x[labels == g] - c[g], axis=1).mean() for g in range(k)])
    m = np.linalg.norm(c[:, None] - c[None], axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(m > 0, (s[:, None] + s[None]) / m, 0)
    return float(r.max(1).mean())


def select(x: np.ndarray, lams: list[float], path: list[np.ndarray], criterion: str = "silhouette") -> tuple[np.ndarray, float, bool]:
    """(labels, strength, valid) of the best partition of 2 to n - 1 clusters of two or more; the last one if there is none."""
    steps = [n for n, labels in enumerate(path) if 2 <= labels.max() + 1 < len(x) and np.bincount(labels).min() >= 2]
    if not steps:
        return path[-1], lams[-1] if lams else 0.0, False
    some = [path[n] for n in steps]
    scores = [-davies_bouldin(x, labels) for labels in some] if criterion == "davies_bouldin" else silhouettes(x, some)
    best = steps[int(np.argmax(scores))]
    return path[best], lams[best - 1] if best else 0.0, True


def convex_clusters(x: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, criterion: str = "silhouette", directed: set | None = None) -> np.ndarray:
    """What ``select`` finds on the whole path; labels are made of the steps that may be chosen alone."""
    x = x[:, None] if x.ndim == 1 else x
    lams, kept, absorbed = merges(x, i, j, w, directed)
    size, single = np.ones(len(x), int), []
    for step, (a, b) in enumerate(zip(kept.tolist(), absorbed.tolist()), 1):
        single += [step] * (int(size[a] == 1) + int(size[b] == 1))
        size[a] += size[b]
    first = single[-1] if len(single) == len(x) else len(lams)  # before it there is a cluster of one
    at, path = np.arange(len(x)), []
    for a, b in zip(kept[:first][::-1].tolist(), absorbed[:first][::-1].tolist()):  # later merges first: the root of the one that keeps is known
        at[b] = at[a]
    path.append(np.unique(at, return_inverse=True)[1].astype(np.int32))
    for a, b in zip(kept[first:].tolist(), absorbed[first:].tolist()):
        at[at == b] = a
        path.append(np.unique(at, return_inverse=True)[1].astype(np.int32))
    return select(x, [0.0] * (len(path) - 1), path, criterion)[0]


#: Clusters of the first partition that may be chosen: merges beyond it are sent to every task.
MOST_CLUSTERS = 1 << 20
#: Bytes of centres that are sent to every task.
MOST_BYTES = 256 << 20


def homotopy_path(points: DataFrame, edges: DataFrame, held: list | None = None) -> DataFrame:
    """(step, lambda, component, kept, absorbed, kept_size, absorbed_size, kept_since, absorbed_since): a row a merge.

    ``points`` are (sample_id, z), ``edges`` (i, j, w), i < j, each once. Clusters are named by their least member;
    ``since`` is the step that made the merged cluster, 0 for a single point. Points without an edge never merge.
    Written; ``held`` gets the tables to drop when the path is no longer read.
    """
    own: list = []
    n = points.count()
    edges = written(edges.select("i", "j", "w"), "edges")
    parts = written(graph.components(edges, own), "components")
    own.append(parts)
    of = lambda c: parts.select(F.col("sample_id").alias(c), F.col("component").alias("component"))
    e, p = edges.join(of("i"), "i"), points.select("sample_id", "z").join(of("sample_id"), "sample_id")

    def run(left, right):
        rows = sorted(zip(left["sample_id"].to_pylist(), left["z"].to_pylist()))
        ids = np.array([s for s, _ in rows])
        i, j = (np.searchsorted(ids, right[c].to_numpy()) for c in ("i", "j"))
        lams, kept, absorbed = merges(np.array([z for _, z in rows], float), i, j, right["w"].to_numpy(), of=n)
        size, since = np.ones(len(ids), int), np.zeros(len(ids), int)
        facts = np.zeros((len(lams), 4), int)
        for k, (a, b) in enumerate(zip(kept, absorbed)):
            facts[k] = size[a], size[b], since[a], since[b]
            size[a] += size[b]
            since[a] = k + 1
        whole = lambda v: pa.array(v, pa.int64())
        return pa.table(
            {"component": whole(np.full(len(lams), left["component"][0].as_py() if len(lams) else 0)), "nth": whole(np.arange(1, len(lams) + 1)), "lambda": pa.array(lams), "kept": whole(ids[kept]), "absorbed": whole(ids[absorbed]),
             "kept_size": whole(facts[:, 0]), "absorbed_size": whole(facts[:, 1]), "kept_nth": whole(facts[:, 2]), "absorbed_nth": whole(facts[:, 3])}
        )

    schema = "component long, nth long, lambda double, kept long, absorbed long, kept_size long, absorbed_size long, kept_nth long, absorbed_nth long"
    log = p.groupBy("component").cogroup(e.groupBy("component")).applyInArrow(run, schema)
    log = graph.numbered(log, ["lambda", "component", "nth"], "step")
    step = log.select("component", "nth", "step")
    for c in ("kept", "absorbed"):
        log = log.join(step.select("component", F.col("nth").alias(f"{c}_nth"), F.col("step").alias(f"{c}_since")), ["component", f"{c}_nth"], "left")
    path = written(log.select("step", "lambda", "component", "kept", "absorbed", "kept_size", "absorbed_size", *(F.coalesce(f"{c}_since", F.lit(0)).alias(f"{c}_since") for c in ("kept", "absorbed"))), "path")
    dropped(edges, step, *own)
    if held is not None:
        held.append(path)
    return path


def labels_at(points: DataFrame, path: DataFrame, step: int) -> DataFrame:
    """(sample_id, label): each point's cluster after ``step`` merges, named by its least member; components go side by side."""

    def run(table):
        rows = sorted(zip(*(table[c].to_pylist() for c in ("step", "kept", "absorbed"))), reverse=True)
        root: dict = {}
        for _, a, b in rows:  # later merges first: the root of the one that keeps is known
            root[b] = root.get(a, a)
        return pa.table({"sample_id": pa.array(list(root), pa.int64()), "label": pa.array(list(root.values()), pa.int64())})

    moved = path.filter(F.col("step") <= step).select("component", "step", "kept", "absorbed").groupBy("component").applyInArrow(run, "sample_id long, label long")
    return points.select("sample_id").join(moved, "sample_id", "left").select("sample_id", F.coalesce("label", "sample_id").alias("label"))


def first_valid(path: DataFrame, n: int) -> tuple[int, int] | None:
    """(first, last) step of the partitions of 2 to n - 1 clusters of two or more, which are all in between; None if there are none."""
    single = F.when(F.col("kept_size") == 1, 1).otherwise(0) + F.when(F.col("absorbed_size") == 1, 1).otherwise(0)
    r = path.agg(F.sum(single).alias("singles"), F.max(F.when(single > 0, F.col("step"))).alias("first"), F.max("step").alias("last")).first()
    last = min(r["last"] or 0, n - 2)
    return (r["first"], last) if r["singles"] == n and r["first"] <= last else None


def valid_partitions(path: DataFrame, n: int) -> DataFrame:
    """(step, clusters, least) of the partitions that may be chosen: 2 to n - 1 clusters of two members or more.

    A cluster lives from the step that made it to the one that merges it. Its life is cut into the blocks of a binary
    tree over the steps, two a level at most; blocks keep their least size, and a step looks at the blocks above it:
    n log n rows where clusters by steps would be n^2.
    """
    spark = path.sparkSession
    span = first_valid(path, n)
    if span is None:
        return spark.createDataFrame([], "step long, clusters long, least long")
    first, last = span
    end = last + 1
    ended = path.select(F.explode(F.array(*(F.struct(F.col(f"{c}_since").alias("born"), F.col("step").alias("dead"), F.col(f"{c}_size").alias("size")) for c in ("kept", "absorbed")))).alias("l")).select("l.*")
    since = path.select(F.explode(F.array("kept_since", "absorbed_since")).alias("step")).filter("step > 0")
    alive = path.join(since, "step", "left_anti").select(F.col("step").alias("born"), F.lit(end).cast("long").alias("dead"), (F.col("kept_size") + F.col("absorbed_size")).alias("size"))
    life = ended.unionByName(alive).select(F.greatest("born", F.lit(first)).alias("b"), F.least("dead", F.lit(end)).alias("d"), "size").filter("b < d")
    levels = F.sequence(F.lit(0), F.lit(max(1, end.bit_length())))
    ends = F.transform(levels, lambda l: F.struct(l.alias("level"), F.ceil(F.col("b") / F.pow(F.lit(2.0), l)).cast("long").alias("lo"), F.floor(F.col("d") / F.pow(F.lit(2.0), l)).cast("long").alias("hi")))
    blocks = F.flatten(F.transform(F.filter(ends, lambda e: e["lo"] < e["hi"]), lambda e: F.concat(
        F.when(e["lo"] % 2 == 1, F.array(F.struct(e["level"].alias("level"), e["lo"].alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>")),
        F.when(e["hi"] % 2 == 1, F.array(F.struct(e["level"].alias("level"), (e["hi"] - 1).alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>")),
    )))
    least = life.select(F.explode(blocks).alias("k"), "size").groupBy("k.level", "k.block").agg(F.min("size").alias("least"))
    steps = spark.range(first, end).select(F.col("id").alias("step"), F.explode(F.transform(levels, lambda l: F.struct(l.alias("level"), F.floor(F.col("id") / F.pow(F.lit(2.0), l)).cast("long").alias("block")))).alias("k"))
    found = steps.select("step", "k.level", "k.block").join(least, ["level", "block"]).groupBy("step").agg(F.min("least").alias("least"))
    return found.select("step", (F.lit(n) - F.col("step")).alias("clusters"), "least")


def _later(path: DataFrame, first: int, last: int) -> list:
    """(kept, absorbed) of the merges that follow the first partition that may be chosen."""
    if last - first > MOST_CLUSTERS:
        raise ValueError("too many partitions of clusters of two or more to score them")
    rows = path.filter(F.col("step").between(first + 1, last)).orderBy("step").select("kept", "absorbed").collect()  # MOST_CLUSTERS at most
    return [(r["kept"], r["absorbed"]) for r in rows]


def silhouette_steps(points: DataFrame, path: DataFrame, first: int, last: int) -> DataFrame:
    """(step, score): mean silhouettes of the partitions from ``first`` to ``last``.

    Distances are summed once, by point and cluster of the first one, within pairs of blocks; later sums are sums of
    those, merged in the order of the log, some hundred points at a time.
    """
    later = _later(path, first, last)
    base = written(points.select("sample_id", "z").join(labels_at(points, path, first), "sample_id"), "base")
    size = {r["label"]: r["n"] for r in base.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cluster
    names = np.array(sorted(size))
    counts = np.array([size[c] for c in names], float)
    pairs = np.searchsorted(names, np.array(later, int).reshape(-1, 2))
    each = graph.label_sums(base).groupBy("i", "label").agg(F.sum("sum").alias("sum"), F.max("own").alias("own"))
    rows = each.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("label", "sum"))).alias("s"), F.max(F.when(F.col("own"), F.col("label"))).alias("own"))

    def run(batches):
        total, seen = np.zeros(len(pairs) + 1), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                s = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).copy()
                own, n = np.searchsorted(names, part.column(1).to_numpy()), counts.copy()
                here = np.arange(part.num_rows)
                means = s / n
                for k in range(len(pairs) + 1):
                    if k:
                        a, b = pairs[k - 1]
                        s[:, a] += s[:, b]
                        n[a] += n[b]
                        own[own == b] = a
                        means[:, a], means[:, b] = s[:, a] / n[a], np.inf
                    inner = s[here, own] / (n[own] - 1)
                    mine = means[here, own]
                    means[here, own] = np.inf
                    outer = means.min(1)
                    means[here, own] = mine
                    total[k] += ((outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300)).sum()
                seen += part.num_rows
        if seen:
            yield pa.record_batch([pa.array(np.arange(len(total)) + first, pa.int64()), pa.array(total), pa.array(np.full(len(total), seen), pa.int64())], ["step", "s", "n"])

    sums = rows.select(F.transform("s", lambda x: x["sum"]).alias("s"), "own").mapInArrow(run, "step long, s double, n long")
    return sums.groupBy("step").agg((F.sum("s") / F.sum("n")).alias("score"))


def davies_bouldin_steps(points: DataFrame, path: DataFrame, first: int, last: int) -> DataFrame:
    """(step, score): minus the Davies-Bouldin index of the partitions from ``first`` to ``last``.

    A cluster that a merge makes keeps its centre and spread while it lives: both are summed once a cluster, a point
    going to every cluster that will hold it; then each step is a row of its own.
    """
    spark = points.sparkSession
    later = _later(path, first, last)
    base = written(points.select("sample_id", "z").join(labels_at(points, path, first), "sample_id"), "base")
    if (base.select("label").distinct().count() + len(later)) * len(points.select("z").first()["z"]) * 8 > MOST_BYTES:
        raise ValueError("too many clusters of too many axes to score them by Davies-Bouldin")
    sums = base.select("label", F.posexplode("z").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    rows = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("v"), F.first("n").alias("n")).orderBy("label").collect()  # MOST_BYTES at most
    place = {r["label"]: k for k, r in enumerate(rows)}
    total, size = [np.array(r["v"]) for r in rows], [r["n"] for r in rows]
    now, up, lives = dict(place), {}, {k: [0, len(later) + 1] for k in place.values()}
    for step, (a, b) in enumerate(later, 1):
        x, y, new = now[a], now.pop(b), len(total)
        total.append(total[x] + total[y])
        size.append(size[x] + size[y])
        for old in (x, y):
            up[old] = new
            lives[old][1] = step
        lives[new] = [step, len(later) + 1]
        now[a] = new
    centre = np.array(total) / np.array(size)[:, None]
    born, dead = np.array([lives[k] for k in range(len(total))]).T

    def spread(batches):
        far, n = np.zeros(len(centre)), np.zeros(len(centre), np.int64)
        for batch in batches:
            z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            at = np.array([place[v] for v in batch.column(1).to_pylist()], int)
            rest = np.arange(len(at))
            while len(rest):
                np.add.at(far, at[rest], np.linalg.norm(z[rest] - centre[at[rest]], axis=1))
                np.add.at(n, at[rest], 1)
                rest = rest[[int(a) in up for a in at[rest]]]
                at[rest] = [up[int(a)] for a in at[rest]]
        live = np.flatnonzero(n)
        yield pa.record_batch([pa.array(live), pa.array(far[live]), pa.array(n[live])], ["c", "far", "n"])

    got = base.select("z", "label").mapInArrow(spread, "c long, far double, n long").groupBy("c").agg((F.sum("far") / F.sum("n")).alias("s")).orderBy("c").collect()  # a row a cluster
    s = np.array([r["s"] for r in got])

    def score(batches):
        for batch in batches:
            out = []
            for step in batch.column(0).to_pylist():
                k = np.flatnonzero((born <= step - first) & (dead > step - first))
                worst = np.zeros(len(k))
                for at in range(0, len(k), ROWS):
                    m = np.linalg.norm(centre[k[at : at + ROWS], None] - centre[None, k], axis=2)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        worst[at : at + ROWS] = np.where(m > 0, (s[k[at : at + ROWS], None] + s[k]) / m, 0).max(1)
                out.append(-worst.mean())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.float64())], ["step", "score"])

    parts = max(1, min(last - first + 1, spark.sparkContext.defaultParallelism))
    return spark.range(first, last + 1, numPartitions=parts).withColumnRenamed("id", "step").mapInArrow(score, "step long, score double")


def convex_clustering(points: DataFrame, edges: DataFrame, criterion: str = "silhouette") -> DataFrame:
    """(sample_id, cluster, lambda, valid) of the best partition of the path, the first of equals; the last one if none may be chosen."""
    held: list = []
    path = homotopy_path(points, edges, held)
    n = points.count()
    span = first_valid(path, n)
    if span:
        scores = (davies_bouldin_steps if criterion == "davies_bouldin" else silhouette_steps)(points, path, *span)
        step = scores.orderBy(F.desc("score"), "step").first()["step"]
    else:
        step = path.agg(F.max("step")).first()[0] or 0
    lam = path.filter(F.col("step") == step).select("lambda").first()
    labels = written(normalise.encode_sorted(labels_at(points, path, step), "label", "cluster"), "clusters")
    dropped(*held)
    return labels.select("sample_id", "cluster", F.lit(lam[0] if lam else 0.0).alias("lambda"), F.lit(bool(span)).alias("valid"))


class _Block:
    """The edges of a block's nodes, with dual values and momentum; an edge between two blocks is in both."""

    def __init__(self, own: int, i, j, bi, bj, cap, dx):
        self.own, self.cap, self.dx = own, cap, dx
        self.nodes, place = np.unique(np.concatenate((i, j)), return_inverse=True)
        self.i, self.j = place[: len(i)], place[len(i) :]
        block = np.empty(len(self.nodes), int)
        block[self.i], block[self.j] = bi, bj
        self.inner = block == own
        self.mine = bi == own  # edges counted here
        self.send = {int(c): np.unique(np.concatenate((self.i[(bi == own) & (bj == c)], self.j[(bj == own) & (bi == c)]))) for c in set(bi) | set(bj) if c != own}
        self.take = {int(c): np.flatnonzero(block == c) for c in self.send}
        self.z, self.y, self.t, self.trace = np.zeros_like(dx), np.zeros_like(dx), 1.0, []
        self.g = self.sums(self.y)

    def sums(self, v: np.ndarray) -> np.ndarray:
        """Dual values summed onto nodes; whole for the block's own ones."""
        at = lambda ends: (ends[:, None] * v.shape[1] + np.arange(v.shape[1])).ravel()
        size = len(self.nodes) * v.shape[1]
        return (np.bincount(at(self.i), v.ravel(), size) - np.bincount(at(self.j), v.ravel(), size)).reshape(len(self.nodes), -1)

    def advance(self, half: float, step: float) -> None:
        new = np.clip(self.y + step * (self.dx - half * (self.g[self.i] - self.g[self.j])), -self.cap, self.cap)
        t = (1 + np.sqrt(1 + 4 * self.t**2)) / 2
        moved = new - self.z
        self.trace.append((float((moved[self.mine] ** 2).sum()), float((self.z[self.mine] ** 2).sum())))
        self.y = new + (self.t - 1) / t * moved
        self.z, self.t = new, t
        self.g = self.sums(self.y)

    def rows(self) -> pa.Table:
        out = [(self.own, -1, pickle.dumps(self)), *((c, self.own, self.g[at].tobytes()) for c, at in self.send.items())]
        block, source, data = zip(*out)
        return pa.table({"block": pa.array(block, pa.int32()), "source": pa.array(source, pa.int32()), "data": pa.array(data, pa.binary())})


#: Edges of a block of nodes, about; and FISTA's rounds between two looks at the stopping rule.
BLOCK_EDGES, ROUNDS = 20_000, 16
_STATE = "block int, source int, data binary"
#: Edges that a task may hold with some axes of their ends, and the rounds after which the stopping rule is first looked at.
AXIS_EDGES, FIRST_ROUNDS = 1 << 23, 256


def _axis_rounds(i: np.ndarray, j: np.ndarray, nodes: int, cap: np.ndarray, dx: np.ndarray, half: float, step: float, rounds: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(dual values summed onto nodes of each axis, (squares of moves, squares of the values before) of each round)."""
    out, trace = [], np.zeros((rounds, 2))
    low, p, q = -cap, np.empty(len(i)), np.empty(len(i))
    sums = lambda v: np.bincount(i, v, nodes) - np.bincount(j, v, nodes)
    for d in dx:
        z, y, g, t = np.zeros(len(i)), np.zeros(len(i)), np.zeros(nodes), 1.0
        for k in range(rounds):
            np.take(g, i, out=p, mode="clip")
            np.take(g, j, out=q, mode="clip")
            p -= q
            p *= half
            np.subtract(d, p, out=p)
            p *= step
            p += y
            np.clip(p, low, cap, out=p)
            np.subtract(p, z, out=q)
            trace[k] += q @ q, z @ z
            t, last = (1 + np.sqrt(1 + 4 * t**2)) / 2, t
            np.multiply(q, (last - 1) / t, out=y)
            y += p
            z, p = p, z
            g = sums(y)
        out.append(sums(z))
    return out, trace


def _fista_by_axes(points: DataFrame, ends: DataFrame, half: float, step: float, steps: int, tol: float) -> DataFrame:
    """(sample_id, g): the dual values after FISTA's rounds, summed onto nodes.

    The penalty is a sum over axes, so axes share nothing but the stopping rule: a task takes some axes of all edges
    through all rounds without an exchange and tells its moves. Those of all tasks, added up, give the round at which
    the rule was met; the tasks then go that far.
    """
    spark = points.sparkSession
    axes = len(points.first()["z"])
    per = max(1, -(-axes // (2 * spark.sparkContext.defaultParallelism)))
    groups = -(-axes // per)

    def packed(batches):
        for b in batches:
            if b.num_rows:
                i, j, cap = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
                d = np.asarray(b.column(3).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1).T
                same = [pa.array([np.ascontiguousarray(v, kind).tobytes()] * groups, pa.binary()) for v, kind in ((i, np.int64), (j, np.int64), (cap, float))]
                own = pa.array([np.ascontiguousarray(d[g * per : (g + 1) * per]).tobytes() for g in range(groups)], pa.binary())
                yield pa.record_batch([pa.array(np.arange(groups), pa.int32()), *same, own], ["g", "i", "j", "cap", "d"])

    dealt = written(ends.select("i", "j", "cap", "d").mapInArrow(packed, "g int, i binary, j binary, cap binary, d binary"), "axes")

    def task(rounds: int, told: bool):
        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(*(np.frombuffer(x, kind) for x, kind in zip(r[:3], (np.int64, np.int64, float))), np.frombuffer(r[3])) for b in batches for r in zip(*(b[c].to_pylist() for c in ("i", "j", "cap", "d")))]
            i, j, cap = (np.concatenate([q[c] for q in parts]) for c in range(3))
            dx = np.concatenate([q[3].reshape(-1, len(q[0])) for q in parts], axis=1)
            parts.clear()
            order = np.lexsort((j, i))
            ids, place = np.unique(np.concatenate((i[order], j[order])), return_inverse=True)
            out, trace = _axis_rounds(place[: len(i)], place[len(i) :], len(ids), cap[order], dx[:, order], half, step, rounds)
            if told:
                yield pa.record_batch([pa.array(np.arange(rounds), pa.int32()), pa.array(trace[:, 0]), pa.array(trace[:, 1])], ["k", "m", "z"])
                return
            g, own = np.stack(out, 1), key[0].as_py()
            for at in range(0, len(ids), 1 << 16):
                some = g[at : at + (1 << 16)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, some.size + 1, some.shape[1], dtype=np.int32)), pa.array(some.ravel()))
                yield pa.record_batch([pa.array(ids[at : at + len(some)]), pa.array(np.full(len(some), own), pa.int32()), lists], ["sample_id", "part", "g"])

        schema = "k int, m double, z double" if told else "sample_id long, part int, g array<double>"
        return dealt.repartition(groups, "g").groupBy("g").applyInArrow(run, schema)

    for most in sorted({min(FIRST_ROUNDS, steps), steps}):
        norms = task(most, True).groupBy("k").agg(F.sum("m").alias("m"), F.sum("z").alias("z")).collect()  # a row a round
        met = sorted(r["k"] for r in norms if np.sqrt(r["m"]) <= tol * (np.sqrt(r["z"]) + 1e-12))
        if met:
            break
    each = task(met[0] + 1 if met else steps, False).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("part", "g"))).alias("g"))
    sums = written(each.select("sample_id", F.flatten(F.transform("g", lambda s: s["g"])).alias("g")), "sums")
    dropped(dealt)
    return sums


def fista_solve(points: DataFrame, edges: DataFrame, lam: float, steps: int = 500, tol: float = 1e-7) -> DataFrame:
    """(sample_id, u array<double>): the least (1/n) |X - U|^2 + lam sum w |u_i - u_j|_1, as ``fista`` gives it.

    Up to ``AXIS_EDGES`` edges, tasks take some axes of all edges each through all rounds (``_fista_by_axes``). Beyond,
    nodes are dealt to blocks by hash. A round is one exchange: each block takes the sums of its neighbours' border
    nodes, moves the dual values of its edges and sends its own border on. ``ROUNDS`` rounds are one job, whose state is
    written; the moves of all blocks are then added up round by round, and if the rule was met between two looks, the
    job is done again up to that round. The step comes from the largest sum of two neighbours' degrees, a bound of the
    graph's norm. A block holds all edges of its nodes, so one node's edges must fit a task.
    """
    spark = points.sparkSession
    points = points.select("sample_id", "z")
    edges = written(edges.select("i", "j", "w"), "edges")
    n, count = points.count(), edges.count()
    if not count or lam == 0:
        dropped(edges)
        return points.select("sample_id", F.transform("z", lambda v: v.cast("double")).alias("u"))
    degree = edges.select(F.explode(F.array("i", "j")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    top = edges.join(degree.withColumnRenamed("v", "i").withColumnRenamed("d", "di"), "i").join(degree.withColumnRenamed("v", "j").withColumnRenamed("d", "dj"), "j").agg(F.max(F.col("di") + F.col("dj"))).first()[0]
    half, step = n / 2, 1 / (n / 2 * top)
    solved = lambda sums: written(points.join(sums, "sample_id", "left").select("sample_id", F.when(F.col("g").isNull(), F.transform("z", lambda v: v.cast("double"))).otherwise(F.zip_with("z", "g", lambda x, g: x - half * g)).alias("u")), "u")
    if count <= AXIS_EDGES:
        ends = graph.difference(edges, points.select("sample_id", F.col("z").cast("array<double>").alias("z"))).select("i", "j", (F.lit(float(lam)) * F.col("w")).alias("cap"), "d")
        sums = _fista_by_axes(points, ends, half, step, steps, tol)
        out = solved(sums)
        dropped(sums, edges)
        return out
    blocks = max(1, min(-(-count // BLOCK_EDGES), 4096)) if count > BLOCK_EDGES else min(count, spark.sparkContext.defaultParallelism)
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    ends = graph.difference(edges, points).select("i", "j", (F.lit(float(lam)) * F.col("w")).alias("cap"), "d", at("i").alias("bi"), at("j").alias("bj"))
    dealt = ends.withColumn("block", F.explode(F.array_distinct(F.array("bi", "bj")))).repartition(blocks, "block")

    def begin(table):
        t = table.sort_by([("i", "ascending"), ("j", "ascending")])
        i, j, bi, bj, cap = (t[c].to_numpy() for c in ("i", "j", "bi", "bj", "cap"))
        d = np.array(t["d"].to_pylist(), float)
        return _Block(t["block"][0].as_py(), i, j, bi, bj, cap[:, None], d).rows()

    def go(table):
        held = {s: v for s, v in zip(table["source"].to_pylist(), table["data"].to_pylist())}
        b: _Block = pickle.loads(held[-1])
        for c, where in b.take.items():
            b.g[where] = np.frombuffer(held[c]).reshape(len(where), -1)
        b.advance(half, step)
        return b.rows()

    def rounds(state: DataFrame, k: int) -> DataFrame:
        for _ in range(k):
            state = state.repartition(blocks, "block").groupBy("block").applyInArrow(go, _STATE)
        return written(state, "fista")

    def traces(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                trace = pickle.loads(data).trace
                yield pa.record_batch([pa.array(range(len(trace)), pa.int32()), pa.array([m for m, _ in trace], pa.float64()), pa.array([z for _, z in trace], pa.float64())], ["k", "m", "z"])

    state, done = written(dealt.groupBy("block").applyInArrow(begin, _STATE), "fista"), 0
    while done < steps:
        more = min(ROUNDS, steps - done)
        new = rounds(state, more)
        norms = new.filter("source = -1").select("data").mapInArrow(traces, "k int, m double, z double").filter(F.col("k") >= done).groupBy("k").agg(F.sum("m").alias("m"), F.sum("z").alias("z")).collect()  # ROUNDS rows
        met = sorted(r["k"] for r in norms if np.sqrt(r["m"]) <= tol * (np.sqrt(r["z"]) + 1e-12))
        if met and met[0] + 1 < done + more:
            dropped(new)
            new = rounds(state, met[0] + 1 - done)
        dropped(state)
        state, done = new, done + more
        if met:
            break

    def finish(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                k: _Block = pickle.loads(data)
                g = k.sums(k.z)[k.inner]
                yield pa.record_batch([pa.array(k.nodes[k.inner]), pa.array(list(g), pa.list_(pa.float64()))], ["sample_id", "g"])

    sums = state.filter("source = -1").select("data").mapInArrow(finish, "sample_id long, g array<double>")
    out = solved(sums)
    dropped(state, edges)
    return out


#: Rows, those with the least hash, among which k-means looks for its first centres.
FIRST_ROWS = 4096


def first_centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of ``x``, each drawn by its squared distance to the nearest one before."""
    r = np.random.default_rng(seed)
    at = [int(r.integers(len(x)))]
    near = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < k:
        p = near / near.sum() if near.sum() > 0 else np.full(len(x), 1 / len(x))
        at.append(int(r.choice(len(x), p=p)))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def _assigned(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * z @ centres.T).argmin(1)


#: Rows of a batch that meet all centres at once, and the fewest rows of a task that scans points round after round.
SCANNED, LEAST_ROWS = 2048, 2048


def _assigned_of_all(z: np.ndarray, centres: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(runs, rows): the place in ``centres`` of each row's nearest one among those of each run, by one matrix product."""
    near = (centres @ z.T) * -2
    near += (centres**2).sum(1)[:, None]
    if not np.isfinite(near).all():
        return np.stack([near[s:e].argmin(0) + s for s, e in zip(starts, ends)])
    at = np.empty((len(starts), len(z)), np.int64)
    less = np.empty(len(z), bool)
    for own, s, e in zip(at, starts, ends):
        best = near[s]
        own[:] = s
        for c in range(s + 1, e):
            np.less(near[c], best, out=less)
            np.copyto(best, near[c], where=less)
            own[less] = c
    return at


def lloyd(points: DataFrame, centres: list[np.ndarray], rounds: int = 300, tol: float = 1e-4) -> tuple[list[np.ndarray], list[float]]:
    """(centres, costs) of all runs after Lloyd rounds from the given centres, one scan of (sample_id, z) a round for all.

    Centres go out with the tasks (``MOST_BYTES`` at most) and meet the points in one product for all runs; a task sends
    back sums by run and cluster, which meet in ``treeReduce``; costs are taken in the last scan alone. A run ends when its centres move by less than ``tol`` of the mean variance, or after ``rounds``. A
    cluster that loses all its points keeps its centre.
    """
    if sum(c.nbytes for c in centres) > MOST_BYTES:
        raise ValueError("too many centres of too many axes to send them to every task")
    centres, costs = [np.array(c, float) for c in centres], [np.inf] * len(centres)
    spread = points.select(F.posexplode("z").alias("k", "v")).groupBy("k").agg(F.var_pop("v").alias("v")).agg(F.avg("v")).first()[0] or 0.0

    def scan(runs: list[int], costs: bool = False) -> list[tuple]:
        now = np.concatenate([centres[r] for r in runs])
        ends = np.cumsum([len(centres[r]) for r in runs])
        starts = ends - [len(centres[r]) for r in runs]

        def run(batches):
            total, n, cost = np.zeros_like(now), np.zeros(len(now)), np.zeros(len(runs))
            for b in batches:
                whole = np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
                for k in range(0, len(whole), SCANNED):
                    z = whole[k : k + SCANNED]
                    at = _assigned_of_all(z, now, starts, ends)
                    member = np.zeros((len(now), len(z)))
                    member[at, np.arange(len(z))] = 1
                    if np.isfinite(z).all():
                        total += member @ z
                    else:  # what is no number stays in its own cluster
                        for one in at:
                            np.add.at(total, one, z)
                    n += member.sum(1)
                    if costs:
                        for r, one in enumerate(at):
                            off = z - now[one]
                            cost[r] += float(np.vdot(off, off))
            yield pa.record_batch([pa.array([pickle.dumps((total, n, cost))], pa.binary())], ["sums"])

        add = lambda x, y: tuple(p + q for p, q in zip(x, y))
        total, n, cost = points.select("z").mapInArrow(run, "sums binary").rdd.map(lambda r: pickle.loads(bytes(r[0]))).treeReduce(add, 3)
        return [(total[s:e], n[s:e], float(c)) for s, e, c in zip(starts, ends, cost)]

    active = list(range(len(centres)))
    for _ in range(rounds):
        left = []
        for r, (sums, n, _) in zip(active, scan(active)):
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[r])
            moved, centres[r] = float(((new - centres[r]) ** 2).sum()), new
            if moved > tol * spread:
                left.append(r)
        active = left
        if not active:
            break
    for r, (_, _, cost) in zip(range(len(centres)), scan(list(range(len(centres))), True)):
        costs[r] = cost
    return centres, costs


def nearest_of(points: DataFrame, centres: list[np.ndarray], name: str = "clusters") -> DataFrame:
    """``points`` with an array: the nearest centre's number for each of several sets of centres, the first of equals."""

    def run(batches):
        for b in batches:
            z = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
            at = np.stack([_assigned(z, c) for c in centres], 1).astype(np.int32)
            yield pa.record_batch([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32)), pa.array(at.ravel()))], [*b.schema.names, name])

    kind = points.schema["sample_id"].dataType.simpleString()
    return points.select("sample_id", F.col("z").cast("array<double>").alias("z")).mapInArrow(run, f"sample_id {kind}, z array<double>, `{name}` array<int>")


def kmeans_all(points: DataFrame, ks: list[int], starts: int = 10, seed: int = 0, rounds: int = 300) -> DataFrame:
    """(sample_id, z, clusters array<int>): for every k the start with the least cost, all k and starts in the same scans."""
    points = points.select("sample_id", F.col("z").cast("array<double>").alias("z"))
    some = points.orderBy(F.xxhash64("sample_id"), "sample_id").limit(FIRST_ROWS).collect()
    x = np.array([r["z"] for r in some])
    runs = [(k, s) for k in ks for s in range(starts)]
    # a file of one row group is one task's: dealt once, every scan is even
    parts = max(1, min(points.sparkSession.sparkContext.defaultParallelism, points.count() // LEAST_ROWS))
    dealt = written(points.repartition(parts, "sample_id"), "points")
    centres, costs = lloyd(dealt, [first_centres(x, min(k, len(x)), seed + s) for k, s in runs], rounds)
    dropped(dealt)
    best = [min((n for n, (own, _) in enumerate(runs) if own == k), key=lambda n: costs[n]) for k in ks]
    return nearest_of(points, [centres[n] for n in best])


def kmeans(points: DataFrame, k: int, starts: int = 10, seed: int = 0) -> DataFrame:
    """(sample_id, cluster): the start with the least cost of several."""
    return kmeans_all(points, [k], starts, seed).select("sample_id", F.col("clusters")[0].alias("cluster"))


def kmeans_sweep(points: DataFrame, low: int = 2, high: int = 10, starts: int = 10, labels: DataFrame | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((k, clusters, silhouette[, ami, ari]) for k from low to high - 1, (sample_id, z, clusters) of them all).

    Silhouettes of all k share the distances; ``labels`` (sample_id, label) give the other two, from one contingency
    table by k.
    """
    from undula.operators import evaluate

    spark = points.sparkSession
    ks = list(range(low, max(low + 1, min(high, points.count()))))
    all_ = written(kmeans_all(points, ks, starts, seed), "kmeans")
    silhouette = {r["part"]: r["silhouette"] for r in evaluate.silhouettes_of(all_, "clusters").collect()}  # a row a k
    each = all_.select("sample_id", F.posexplode("clusters").alias("part", "b"))
    found = {r["part"]: r["n"] for r in each.groupBy("part").agg(F.count_distinct("b").alias("n")).collect()}
    rows, schema = [(k, found[p], silhouette[p]) for p, k in enumerate(ks)], "k int, clusters long, silhouette double"
    if labels is not None:
        table = written(each.join(labels.select("sample_id", F.col("label").alias("a")), "sample_id").groupBy("part", "a", "b").agg(F.count(F.lit(1)).alias("n")), "contingency")
        own = lambda p: table.filter(F.col("part") == p).select("a", "b", "n")
        rows = [(*r, evaluate.mutual_information_of(own(p)).first()[0], evaluate.rand_of(own(p)).first()[0]) for p, r in enumerate(rows)]
        schema += ", ami double, ari double"
        dropped(table)
    return spark.createDataFrame(rows, schema), all_
