"""Phase-tolerant distances between all pairs of curves: elastic (square-root velocity) and dynamic time warping.

Curves are normalised, and taken to square-root velocities, once, by column expressions; pairs are dealt in blocks.
The elastic kernel works on a batch of pairs at a time: the cost of a move depends on the move and its end alone, so
all costs are matrix products, and a row of the lattice needs earlier rows only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from undula.functions import normalise
from undula.operators.graph import LEAST_BLOCKS, _block_pairs_of, _chunk, numbered

#: Moves (rows, columns) of the elastic lattice, in the order in which ties are decided (fixed values).
MOVES = ((1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2), (1, 4), (4, 1), (3, 4), (4, 3))
METRICS = ("elastic", "elastic-fast", "fastdtw", "ultrafast")
#: Lattice cells of a batch of pairs, and rows of the lattice whose costs are one product.
BATCH_CELLS = 400_000
ROWS = 20


def default_band(steps: int) -> int:
    return max(12, steps // 4)


def _interpolate(q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The last axis of ``q`` at fractional places, held within the axis."""
    lo = np.clip(np.floor(at).astype(int), 0, q.shape[-1] - 2)
    w = np.clip(at - lo, 0, 1)
    return q[..., lo] * (1 - w) + q[..., lo + 1] * w


def _roots(t: int, di: int) -> np.ndarray:
    """Roots of the weights of a move's places in its integral."""
    share = np.full(di + 1, 1 / (t - 1))
    share[[0, -1]] *= 0.5
    return np.sqrt(share)


def _held(q: np.ndarray, di: int) -> np.ndarray:
    """(curves, K, T - di): the held curve's part of the cost of a move of ``di`` rows."""
    t, root = q.shape[2], _roots(q.shape[2], di)
    held = np.concatenate([q[:, :, s : t - di + s] * root[s] for s in range(di + 1)], axis=1)
    return np.concatenate([held, (held**2).sum(1, keepdims=True), np.ones((len(q), 1, t - di))], axis=1)


def _warped(q: np.ndarray, di: int, dj: int) -> np.ndarray:
    """(curves, K, T - dj): the warped curve's part of the cost of a move."""
    t, root, slope = q.shape[2], _roots(q.shape[2], di), dj / di
    warped = np.concatenate([_interpolate(q, np.arange(t) - dj + s * slope) * (np.sqrt(slope) * root[s]) for s in range(di + 1)], axis=1)[:, :, dj:]
    return np.concatenate([-2 * warped, np.ones((len(q), 1, t - dj)), (warped**2).sum(1, keepdims=True)], axis=1)


def _factors(q1: np.ndarray, q2: np.ndarray, di: int, dj: int) -> tuple[np.ndarray, np.ndarray]:
    """(held (pairs, T - di, K), warped (pairs, K, T - dj)), whose product is the cost of a move by the cell it ends in.

    The cost is the integral of |q1 - sqrt(slope) q2(warped)|^2 over the move: its squares are two of the K terms.
    """
    return _held(q1, di).transpose(0, 2, 1), _warped(q2, di, dj)


def move_costs(q1: np.ndarray, q2: np.ndarray, di: int, dj: int) -> np.ndarray:
    """(pairs, T, T): the cost of the move that ends in each cell, infinite where it would start outside."""
    t = q1.shape[2]
    out = np.full((len(q1), t, t), np.inf)
    np.maximum(np.matmul(*_factors(q1, q2, di, dj)), 0, out=out[:, di:, dj:])
    return out


def band_costs(q1: np.ndarray, q2: np.ndarray, di: int, dj: int, band: int, center: np.ndarray | None) -> np.ndarray:
    """(T, pairs, 2 band + 1): ``move_costs`` of the cells from column ``center - band`` on (the diagonal's without a center)."""
    n, _, t = q1.shape
    width = 2 * band + 1
    held, warped = _factors(q1, q2, di, dj)
    out = np.full((t, n, width), np.inf)
    if center is not None:
        j = center[:, di:, None] - band + np.arange(width) - dj
        near = warped.transpose(0, 2, 1)[np.arange(n)[:, None, None], np.clip(j, 0, t - dj - 1)]
        cost = np.matmul(near, held[:, :, :, None])[..., 0]
        out[di:] = np.where((j >= 0) & (j < t - dj), np.maximum(cost, 0), np.inf).transpose(1, 0, 2)
        return out
    for lo in range(di, t, ROWS):
        hi = min(lo + ROWS, t)
        a, b = max(lo - band - dj, 0), min(hi + band - dj, t - dj)
        if a >= b:
            continue
        block = np.full((n, hi - lo, hi - lo + width), np.inf)  # its column 0 is column lo - band
        at = a + dj - (lo - band)
        np.maximum(np.matmul(held[:, lo - di : hi - di], warped[:, :, a:b]), 0, out=block[:, :, at : at + b - a])
        x, y, z = block.strides
        out[lo:hi] = np.lib.stride_tricks.as_strided(block, (hi - lo, n, width), (y + z, x, z))
    return out


def banded(q1: np.ndarray, q2: np.ndarray, band: int, center: np.ndarray | None = None) -> np.ndarray:
    """Distance of each pair, -1 where the corner isn't reached, over the cells within ``band`` columns of the center alone."""
    n, _, t = q1.shape
    width = 2 * band + 1
    center = None if center is None else np.concatenate([np.zeros((n, 1), int), center[:, 1:].astype(int)], axis=1)
    costs = [band_costs(q1, q2, di, dj, band, center) for di, dj in MOVES]
    e = np.full((t, n, width), np.inf)
    e[0, :, band] = 0
    o = np.arange(width)
    for i in range(1, t):
        best = e[i]
        for m, (di, dj) in enumerate(MOVES):
            if di > i:
                continue
            if center is None:
                shift = di - dj
                own, past = slice(max(0, -shift), width - max(0, shift)), slice(max(0, shift), width + min(0, shift))
                if own.start < own.stop:
                    np.minimum(best[:, own], e[i - di][:, past] + costs[m][i][:, own], out=best[:, own])
            else:
                at = o + (center[:, i] - center[:, i - di] - dj)[:, None]
                value = np.take_along_axis(e[i - di], np.clip(at, 0, width - 1), 1) + costs[m][i]
                np.minimum(best, np.where((at >= 0) & (at < width), value, np.inf), out=best)
        j = (i if center is None else center[:, i, None]) - band + o
        best[np.broadcast_to((j < 1) | (j >= t), best.shape)] = np.inf
    at = np.full(n, band) if center is None else t - 1 - center[:, -1] + band
    last = np.where((at >= 0) & (at < width), e[-1][np.arange(n), np.clip(at, 0, width - 1)], np.inf)
    return np.where(np.isfinite(last), np.sqrt(np.where(np.isfinite(last), last, 0)), -1.0)


def elastic_lattice(q1: np.ndarray, q2: np.ndarray, track: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(distance of each pair, moves taken) over all cells, for q1, q2 (pairs, features, T)."""
    n, _, t = q1.shape
    costs = [move_costs(q1, q2, di, dj) for di, dj in MOVES]
    e = np.full((n, t, t), np.inf)
    e[:, 0, 0] = 0
    taken = np.full((n, t, t), -1, np.int8) if track else None
    for i in range(1, t):
        best, which = np.full((n, t), np.inf), np.full((n, t), -1, np.int8) if track else None
        for m, (di, dj) in enumerate(MOVES):
            if di > i:
                continue
            value = e[:, i - di, : t - dj] + costs[m][:, i, dj:]
            if track:
                which[:, dj:][value < best[:, dj:]] = m
            np.minimum(best[:, dj:], value, out=best[:, dj:])
        best[:, 0] = np.inf
        e[:, i] = best
        if track:
            taken[:, i] = which
    last = e[:, -1, -1]
    return np.where(np.isfinite(last), np.sqrt(np.maximum(np.where(np.isfinite(last), last, 0), 0)), -1.0), taken


def elastic(q1: np.ndarray, q2: np.ndarray, band: int = -1, center: np.ndarray | None = None) -> np.ndarray:
    """Distances; pairs whose corner the band cuts off are tried in a wider band, then without one."""
    t = q1.shape[2]
    if band < 0 or (center is None and 2 * band + 1 >= t):
        return elastic_lattice(q1, q2)[0]
    out = banded(q1, q2, band, center)
    for wider in (max(2 * band, t // 4), -1):
        again = np.flatnonzero(out < 0)
        if not len(again):
            break
        c = None if center is None else center[again]
        out[again] = elastic_lattice(q1[again], q2[again])[0] if wider < 0 else banded(q1[again], q2[again], wider, c)
    return out


def elastic_block(q1: np.ndarray, q2: np.ndarray, band: int = -1) -> np.ndarray:
    """(curves of q1, curves of q2): ``elastic`` of all to all, q1 held.

    A curve's part of the costs is made once, not once a pair, and a row's costs of a move are one product for all pairs;
    of the lattice's rows the last five are kept.
    """
    n, _, t = q1.shape
    m = len(q2)
    reach = t if band < 0 or 2 * band + 1 >= t else band
    moves = [(di, dj, np.ascontiguousarray(_held(q1, di).transpose(2, 0, 1)), np.ascontiguousarray(_warped(q2, di, dj).transpose(1, 2, 0))) for di, dj in MOVES if max(di, dj) < t]
    rows, room = np.full((5, n, t, m), np.inf), np.empty(n * t * m)
    rows[0, :, 0] = 0
    span = lambda i: (max(1, i - reach), min(t - 1, i + reach)) if i else (0, 0)
    for i in range(1, t):
        best = rows[i % 5]
        best.fill(np.inf)
        low, high = span(i)
        for di, dj, held, warped in moves:
            if di > i:
                continue
            past = span(i - di)
            a, b = max(low, past[0] + dj), min(high, past[1] + dj) + 1
            if a >= b:
                continue
            value = room[: n * (b - a) * m].reshape(n, -1)
            np.matmul(held[i - di], warped[:, a - dj : b - dj].reshape(warped.shape[0], -1), out=value)
            np.maximum(value, 0, out=value)
            value = value.reshape(n, b - a, m)
            value += rows[(i - di) % 5, :, a - dj : b - dj]
            np.minimum(best[:, a:b], value, out=best[:, a:b])
    last = rows[(t - 1) % 5, :, -1].copy()
    u, v = np.nonzero(~np.isfinite(last))
    out = np.sqrt(last)
    if len(u):
        out[u, v] = elastic(q1[u], q2[v], band)
    return out


def alignment_path(taken: np.ndarray) -> list[tuple[int, int]]:
    """Cells from the corner back along the moves taken, in order from the start; ends where no move is known."""
    i = j = len(taken) - 1
    path = [(i, j)]
    while (i or j) and taken[i, j] >= 0:
        di, dj = MOVES[taken[i, j]]
        i, j = i - di, j - dj
        path.append((i, j))
    return path[::-1]


def elastic_fast(q1: np.ndarray, q2: np.ndarray, factor: int = 2, radius: int = 12) -> np.ndarray:
    """Two passes: the whole lattice of shortened curves, then a band around its path. Never less than ``elastic``."""
    n, _, t = q1.shape
    short = max(16, t // max(1, factor))
    if short >= t or t <= 64:
        return elastic(q1, q2, max(12, t // 8))
    at = np.linspace(0, t - 1, short)
    taken = elastic_lattice(_interpolate(q1, at), _interpolate(q2, at), track=True)[1]
    scale, center = (t - 1) / (short - 1), np.empty((n, t))
    for k in range(n):
        path = np.array(alignment_path(taken[k]), float) * scale
        _, first = np.unique(path[:, 0], return_index=True)
        center[k] = np.interp(np.arange(t), path[first, 0], path[first, 1])
    return elastic(q1, q2, radius, center)


def dtw(a: np.ndarray, b: np.ndarray, radius: int | None = None) -> np.ndarray:
    """Time warping of each pair (pairs, T, features) with the distance of points as cost, in a band of ``radius`` if given.

    Within a row, the least way along it is a running minimum over prefix sums of the row's costs.
    """
    n, ta, tb = len(a), a.shape[1], b.shape[1]
    row = np.full((n, tb + 1), np.inf)
    row[:, 0] = 0
    for i in range(1, ta + 1):
        lo, hi = 1, tb
        if radius is not None:
            mid = round((i - 1) * (tb / max(1, ta)))
            lo, hi = max(1, mid - radius + 1), min(tb, mid + radius + 1)
        new = np.full((n, tb + 1), np.inf)
        if lo <= hi:
            c = np.sqrt(((a[:, i - 1, None] - b[:, lo - 1 : hi]) ** 2).sum(2))
            s = np.cumsum(c, axis=1)
            enter = np.minimum(row[:, lo : hi + 1], row[:, lo - 1 : hi]) - (s - c)
            new[:, lo : hi + 1] = np.minimum.accumulate(enter, axis=1) + s
        row = new
    return row[:, tb]


def dtw_block(a: np.ndarray, b: np.ndarray, radius: int | None = None) -> np.ndarray:
    """(curves of a, curves of b): ``dtw`` of all to all, for a, b (curves, features, T) of as many steps, all pairs a cell at a time."""
    n, t, m = len(a), a.shape[2], len(b)
    x, y = np.ascontiguousarray(a.transpose(2, 1, 0)), np.ascontiguousarray(b.transpose(2, 1, 0))
    row, new = np.full((2, t + 1, n, m), np.inf)  # column j is at j + 1
    row[0] = 0
    cost, part = np.empty((2, t, n, m))
    for i in range(t):
        lo, hi = (0, t) if radius is None else (max(0, i - radius), min(t, i + radius + 1))
        c, p = cost[: hi - lo], part[: hi - lo]
        for f in range(x.shape[1]):
            into = p if f else c
            np.subtract(x[i, f][:, None], y[lo:hi, f][:, None], out=into)
            np.multiply(into, into, out=into)
            if f:
                c += p
        np.sqrt(c, out=c)
        np.minimum(row[lo + 1 : hi + 1], row[lo:hi], out=p)
        new.fill(np.inf)
        for j in range(hi - lo):
            np.minimum(p[j], new[lo + j], out=p[j])
            np.add(p[j], c[j], out=new[lo + j + 1])
        row, new = new, row
    return row[t]


def dtw_path(a: np.ndarray, b: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance of each pair (pairs, T, features), rows, columns of its path from the end, -1 behind its start).

    ``lo`` and ``hi`` (pairs, rows) are each row's first and last column; all without them. Cells are visited by row and
    offset, all pairs at once; equal ways go diagonally, then up.
    """
    n, ta, tb = len(a), a.shape[1], b.shape[1]
    if lo is None:
        lo, hi = np.zeros((n, ta), int), np.full((n, ta), tb - 1)
    width = int((hi - lo).max()) + 1
    at = np.arange(n)
    d = np.full((ta + 1, n, width + 2), np.inf)  # column lo + o is at o + 1; row 0 stands for the start
    start = np.concatenate([lo[:, :1], lo], axis=1).T
    begin = -start[0]  # the start is the cell before column 0
    d[0, at, np.clip(begin, 0, width + 1)] = np.where(begin >= 0, 0.0, np.inf)
    for i in range(ta):
        up, own = d[i], d[i + 1]
        shift = start[i + 1] - start[i]
        size = hi[:, i] - lo[:, i] + 1
        some = np.argsort(-size, kind="stable")
        left = np.searchsorted(-size[some], -np.arange(1, size.max(initial=0) + 1), "right")  # pairs that have an offset
        for o, live in enumerate(left.tolist()):
            k = some[:live]
            cost = np.sqrt(((a[k, i] - b[k, lo[k, i] + o]) ** 2).sum(1))
            p = o + 1 + shift[k]  # the place of the column in the row above
            above = np.where(p < width + 2, up[k, np.minimum(p, width + 1)], np.inf)
            across = np.where((p >= 1) & (p <= width + 2), up[k, np.clip(p - 1, 0, width + 1)], np.inf)
            own[k, o + 1] = cost + np.minimum(np.minimum(np.where(p >= 0, above, np.inf), own[k, o]), across)

    def cell(i, j):  # the sum at row i and column j, of the grid with a border
        p = j - 1 - start[i, at] + 1
        return np.where((p >= 0) & (p < width + 2), d[i, at, np.clip(p, 0, width + 1)], np.inf)

    i, j = np.full(n, ta), np.full(n, tb)
    total = cell(i, j)
    rows, cols = [], []
    while (live := (i > 0) & (j > 0)).any():
        rows.append(np.where(live, i - 1, -1)), cols.append(np.where(live, j - 1, -1))
        back, up = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        step = np.argmin([cell(back, up), cell(back, j), cell(i, up)], axis=0)
        i, j = np.where(live & (step < 2), i - 1, i), np.where(live & (step != 1), j - 1, j)
    return total, np.array(rows).T, np.array(cols).T


def dilate(rows: np.ndarray, cols: np.ndarray, ta: int, tb: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last column of each row of a grid of ta x tb) of paths on the halved grid, widened by ``radius``; no column: tb, -1."""
    lo, hi = np.full((len(rows), ta), tb), np.full((len(rows), ta), -1)
    at = np.broadcast_to(np.arange(len(rows))[:, None], rows.shape)
    for off in range(-radius, 2 + radius):
        r = 2 * rows + off
        ok = (rows >= 0) & (r >= 0) & (r < ta)
        np.minimum.at(lo, (at[ok], r[ok]), np.maximum(0, 2 * cols[ok] - radius))
        np.maximum.at(hi, (at[ok], r[ok]), np.minimum(tb - 1, 2 * cols[ok] + 1 + radius))
    return lo, hi


def fast_dtw(a: np.ndarray, b: np.ndarray, radius: int = 1, least: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``dtw_path`` by resolutions: the paths of the halved curves, widened by ``radius``, bound the search."""
    if min(a.shape[1], b.shape[1]) <= least:
        return dtw_path(a, b)
    half = lambda x: x[:, : x.shape[1] // 2 * 2].reshape(len(x), x.shape[1] // 2, 2, -1).mean(2)
    _, rows, cols = fast_dtw(half(a), half(b), radius, least)
    return dtw_path(a, b, *dilate(rows, cols, a.shape[1], b.shape[1], radius))


def _sums(x: np.ndarray, y: np.ndarray, lo: np.ndarray | None, hi: np.ndarray | None, keep: bool) -> np.ndarray:
    """(rows + 1, columns + 1, curves, curves) sums of the least ways from the start to every cell, for x, y (T, features, curves).

    ``lo`` and ``hi`` (rows, pairs) are each row's first and last column. Without ``keep`` there are two rows, and the last one is first.
    """
    ta, tb, n, m = len(x), len(y), x.shape[2], y.shape[2]
    d = np.full((ta + 1 if keep else 2, tb + 1, n, m), np.inf)  # row and column 0 stand for the start
    d[0, 0] = 0
    cost, part = np.empty((2, tb, n, m))
    for i in range(ta):
        up, own = d[i if keep else i % 2], d[i + 1 if keep else (i + 1) % 2]
        own.fill(np.inf)
        first, last = (0, tb) if lo is None else (int(lo[i].min()), int(hi[i].max()) + 1)
        if first >= last:
            continue
        c, p = cost[: last - first], part[: last - first]
        for f in range(x.shape[1]):
            into = p if f else c
            np.subtract(x[i, f][:, None], y[first:last, f][:, None], out=into)
            np.multiply(into, into, out=into)
            if f:
                c += p
        np.sqrt(c, out=c)
        np.minimum(up[first + 1 : last + 1], up[first:last], out=p)
        for j in range(first, last):
            np.minimum(p[j - first], own[j], out=p[j - first])
            np.add(p[j - first], c[j - first], out=own[j + 1])
            if lo is not None:
                np.copyto(own[j + 1], np.inf, where=((lo[i] > j) | (hi[i] < j)).reshape(n, m))
    return d if keep else d[ta % 2][None]


def _ways(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last column of each row (rows, pairs)) of the least ways back through ``_sums``; equal ways go diagonally, then up."""
    ta, tb, pairs = d.shape[0] - 1, d.shape[1] - 1, d.shape[2] * d.shape[3]
    if np.isnan(d[-1, -1]).any():  # what is no number is least
        d = np.where(np.isnan(d), -1.0, d)
    flat, at = d.ravel(), np.arange(pairs)
    lo, hi = np.full((ta, pairs), tb), np.full((ta, pairs), -1)
    i, j = np.full(pairs, ta), np.full(pairs, tb)
    while len(at):
        lo[i - 1, at] = np.minimum(lo[i - 1, at], j - 1)
        hi[i - 1, at] = np.maximum(hi[i - 1, at], j - 1)
        back = ((i - 1) * (tb + 1) + j - 1) * pairs + at
        across, up, along = flat[back], flat[back + pairs], flat[back + (tb + 1) * pairs]
        sideways = (along < across) & (along < up)
        upward = (up < across) & ~sideways
        i, j = i - ~sideways, j - ~upward
        live = (i > 0) & (j > 0)
        if not live.all():
            i, j, at = i[live], j[live], at[live]
    return lo, hi


def fast_dtw_block(a: np.ndarray, b: np.ndarray, radius: int = 1, least: int = 16) -> np.ndarray:
    """(curves of a, curves of b): ``fast_dtw`` of all to all, for a, b (curves, features, T), all pairs a cell at a time.

    Curves are halved once, not once a pair. Rows are computed from the least first to the largest last column of any
    pair's window, which pays while curves are short.
    """
    kept = lambda x: np.ascontiguousarray(x.transpose(2, 1, 0))

    def windows(x, y):
        """The bounds of each row of the ways of the curves x and y, whose resolution is halved while they are long."""
        return _ways(_sums(x, y, *bounds(x, y), True))

    def bounds(x, y):
        if min(len(x), len(y)) <= least:
            return None, None
        half = lambda u: u[: len(u) // 2 * 2].reshape(len(u) // 2, 2, *u.shape[1:]).mean(1)
        lo, hi = windows(half(x), half(y))
        first, last = np.full((len(x), lo.shape[1]), len(y)), np.full((len(x), lo.shape[1]), -1)
        for k in range(len(lo)):
            some = hi[k] >= 0
            begin, end = np.where(some, np.maximum(0, 2 * lo[k] - radius), len(y)), np.where(some, np.minimum(len(y) - 1, 2 * hi[k] + 1 + radius), -1)
            for r in range(max(0, 2 * k - radius), min(len(x), 2 * k + 2 + radius)):
                np.minimum(first[r], begin, out=first[r])
                np.maximum(last[r], end, out=last[r])
        return first, last

    x, y = kept(a), kept(b)
    return _sums(x, y, *bounds(x, y), False)[-1, -1].copy()


def prepared(curves: DataFrame, metric: str) -> DataFrame:
    """(sample_id, x array<array<double>>): z-scored curves by feature, as square-root velocities for elastic metrics."""
    z = normalise.zscore(curves)
    z = normalise.srvf(z) if metric.startswith("elastic") else z
    return z.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "values"))), lambda f: f["values"]).alias("x"))


#: Curves of a block of distinct ones, ids that one of them carries, curves of a tile by its shorter side, and pairs given at once.
BLOCK_CURVES, COPIES, TILE, GIVEN = 2048, 1024, 64, 1 << 19
#: Steps up to which windows of a tile's pairs are computed as one grid; longer curves go by each pair's own windows.
SHORT = 64


def distinct(x: DataFrame) -> DataFrame:
    """(rep, x, ids) of prepared curves: equal ones are one row, ``COPIES`` at most, named by the least of its ids."""
    ids = x.groupBy(F.xxhash64("x").alias("h"), "x").agg(F.array_sort(F.collect_list("sample_id")).alias("ids"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / COPIES)), lambda k: F.slice("ids", (k * COPIES + 1).cast("int"), F.lit(COPIES)))
    return ids.select("x", F.explode(parts).alias("ids")).select(F.col("ids")[0].alias("rep"), "x", "ids")


class _Side:
    """One block of distinct curves in the order of their least ids: x (curves, features, T), and the ids of each."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("place").combine_chunks()
        x, ids = (_chunk(table[c]) for c in ("x", "ids"))
        n = len(table)
        features = len(x[0])
        self.x = np.asarray(x.flatten().flatten().to_numpy(zero_copy_only=False), float).reshape(n, features, -1)
        self.count = np.asarray(pc.list_value_length(ids))
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.ids = ids.flatten().to_numpy(zero_copy_only=False)

    def slices(self, size: int) -> list[slice]:
        return [slice(k, min(k + size, len(self.x))) for k in range(0, len(self.x), size)]

    def of(self, r: slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids, which of the slice's curves each belongs to)."""
        return self.ids[self.first[r.start] : self.first[r.stop]], np.repeat(np.arange(r.stop - r.start), self.count[r])


def _tile_pairs(a: _Side, b: _Side, r: slice, c: slice, kernel: Callable, one_sided: bool, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, dist), i < j, of the curves of two slices and their copies; ``same`` for a slice with itself."""
    (i, u), (j, v) = a.of(r), b.of(c)
    there = kernel(a.x[r], b.x[c])
    if same and not one_sided:  # one direction for both ways round
        there = np.triu(there) + np.triu(there, 1).T
    # the lesser id's curve is held: copies of either may lie on both sides of the other's
    mixed = not same and bool(i.max() > j.min())
    back = None if not mixed else kernel(b.x[c], a.x[r]).T if one_sided else there
    size = max(1, GIVEN // len(j))
    for k in range(0, len(i), size):
        own, at = i[k : k + size], u[k : k + size]
        if same:
            p, q = np.nonzero(own[:, None] < j)
            yield own[p], j[q], there[at[p], v[q]]
            continue
        dist, left, right = there[at][:, v].ravel(), np.repeat(own, len(j)), np.tile(j, len(own))
        if mixed:
            swap = left > right
            dist = np.where(swap, back[at][:, v].ravel(), dist)
            left, right = np.where(swap, right, left), np.where(swap, left, right)
        yield left, right, dist


def _kernel(metric: str, band: int | None, factor: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances (curves of p, curves of q) of all p to all q, both (curves, features, T), p held."""

    def run(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        t = p.shape[2]
        r = default_band(t) if band is None else band
        if metric == "elastic":
            return elastic_block(p, q, r)
        if metric == "elastic-fast" and (t <= 64 or max(16, t // max(1, factor)) >= t):
            return elastic_block(p, q, max(12, t // 8))
        if metric == "fastdtw":
            return dtw_block(p, q, max(1, r))
        if metric == "ultrafast" and t <= SHORT:
            return fast_dtw_block(p, q, max(1, max(1, r) // 6))
        u, v = (k.ravel() for k in np.indices((len(p), len(q))))
        return aligned(p[u], q[v], metric, band, factor).reshape(len(p), len(q))

    return run


def _over_distinct(curves: DataFrame, metric: str, band: int | None, factor: int, only: DataFrame | None, give: Callable, schema: str) -> DataFrame:
    """Rows of ``schema`` from ``give(tiles)`` over every pair of blocks of distinct curves, tiles being (i, j, dist) with i < j.

    Equal curves have equal distances, so each is warped once and its copies only take part in the rows. Blocks go by
    ranges of numbers in the order of ids: the lesser id's curve is the one held, without a choice for each pair.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    x = prepared(curves, metric)
    held = numbered(distinct(x if only is None else x.join(only, "sample_id", "left_semi")), ["rep"], "place")
    n = held.count()
    block = max(4, min(BLOCK_CURVES, -(-n // LEAST_BLOCKS)))
    kernel = _kernel(metric, band, factor)

    def each(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [k.as_py() for k in key]
        table = pa.Table.from_batches(batches)
        a, b = (_Side(t) if len(t) else None for t in (table.filter(pc.equal(table["__b"], pa.scalar(k, pa.int32()))) for k in at))
        same = at[0] == at[1]

        def tiles():
            for r in a.slices(TILE):
                for c in b.slices(TILE):
                    if not same or r.start <= c.start:
                        yield from _tile_pairs(a, b, r, c, kernel, metric != "fastdtw", same and r.start == c.start)

        if a is not None and b is not None:
            yield from give(tiles())

    placed = held.select((F.col("place") - 1).alias("place"), "x", "ids")
    return _block_pairs_of(placed, "place", ["x", "ids"], n, block, True).applyInArrow(each, schema)


def pairwise(curves: DataFrame, metric: str = "elastic", band: int | None = None, factor: int = 2, only: DataFrame | None = None) -> DataFrame:
    """(i, j, dist) with i < j; the lesser id's curve is held and the other one warped, as elastic lattices are one-sided.

    All curves give the scale; ``only`` (sample_id) names those whose pairs are wanted.
    """
    kind = curves.schema["sample_id"].dataType
    own = to_arrow_type(kind)

    def give(tiles):
        for i, j, dist in tiles:
            if len(i):
                yield pa.record_batch([pa.array(i, own), pa.array(j, own), pa.array(dist)], ["i", "j", "dist"])

    return _over_distinct(curves, metric, band, factor, only, give, f"i {kind.simpleString()}, j {kind.simpleString()}, dist double")


def _first(i: np.ndarray, j: np.ndarray, dist: np.ndarray, far: bool) -> int:
    """The place of the nearest pair, or of the farthest one, lesser ids first among equals; what is no number is larger than all."""
    odd = np.isnan(dist)
    best = odd if odd.all() or (far and odd.any()) else dist == (np.max(dist) if far else np.nanmin(dist))
    at = np.flatnonzero(best)
    return int(at[np.lexsort((j[at], i[at]))[0]])


def extreme_pairs(curves: DataFrame, metric: str = "fastdtw", band: int | None = None, factor: int = 2) -> DataFrame:
    """(which, i, j, dist) of the nearest and of the farthest pair; all pairs are met once, and a pair of blocks gives two rows."""
    kind = curves.schema["sample_id"].dataType
    own, names = to_arrow_type(kind), ("similar", "different")

    def give(tiles):
        best: list = [[], []]
        for i, j, dist in tiles:
            for far, rows in enumerate(best):
                if len(i):
                    at = _first(i, j, dist, bool(far))
                    rows.append((i[at], j[at], dist[at]))
        for far, rows in enumerate(best):
            if rows:
                i, j, dist = (np.array(c) for c in zip(*rows))
                at = _first(i, j, dist, bool(far))
                yield pa.record_batch([pa.array([names[far]]), pa.array(i[at : at + 1], own), pa.array(j[at : at + 1], own), pa.array(dist[at : at + 1])], ["which", "i", "j", "dist"])

    each = _over_distinct(curves, metric, band, factor, None, give, f"which string, i {kind.simpleString()}, j {kind.simpleString()}, dist double")
    # what is no number counts as the largest distance, as Spark sorts it
    order = F.struct(F.when(F.col("which") == "different", ~F.isnan("dist")).otherwise(F.isnan("dist")).alias("late"), F.when(F.col("which") == "different", -F.col("dist")).otherwise(F.col("dist")).alias("by"), "i", "j", "dist")
    return each.groupBy("which").agg(F.min(order).alias("p")).select("which", "p.i", "p.j", "p.dist")


def aligned(p: np.ndarray, q: np.ndarray, metric: str, band: int | None = None, factor: int = 2) -> np.ndarray:
    """Distances of p[k] to q[k], both (pairs, features, T) as ``prepared`` gives them."""
    t = p.shape[2]
    r = default_band(t) if band is None else band
    size = max(1, BATCH_CELLS // (t * t)) if metric.startswith("elastic") else 1024
    out = np.empty(len(p))
    for k in range(0, len(p), size):
        a, b = p[k : k + size], q[k : k + size]
        if metric == "elastic":
            out[k : k + size] = elastic(a, b, r)
        elif metric == "elastic-fast":
            out[k : k + size] = elastic_fast(a, b, factor, max(1, r))
        elif metric == "ultrafast":
            out[k : k + size] = fast_dtw(a.transpose(0, 2, 1), b.transpose(0, 2, 1), max(1, max(1, r) // 6))[0]
        else:
            out[k : k + size] = dtw(a.transpose(0, 2, 1), b.transpose(0, 2, 1), max(1, r))
    return out


def alignment(curves: DataFrame, i: int, j: int) -> DataFrame:
    """(step, i, j): the elastic alignment of two curves, computed by one task over two rows."""
    two = prepared(curves, "elastic").filter(F.col("sample_id").isin(i, j)).withColumn("g", F.lit(0))

    def run(table):
        rows = {r["sample_id"]: np.array(r["x"], float)[None] for r in table.to_pylist()}
        path = alignment_path(elastic_lattice(rows[i], rows[j], track=True)[1][0])
        return pa.table({"step": pa.array(range(len(path)), pa.int32()), "i": pa.array([p[0] for p in path], pa.int32()), "j": pa.array([p[1] for p in path], pa.int32())})

    return two.groupBy("g").applyInArrow(run, "step int, i int, j int")
