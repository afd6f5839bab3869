"""Pairwise distances of points, neighbour graphs and similarity edges.

Pairs are (i, j, dist) with i < j. ``block_pairs`` deals points to block pairs, so every task gets the same number of
pairs and no task more than two blocks of points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType

from undula.sources.shared import dropped, written

#: Points in a block of the pairwise join.
BLOCK_POINTS = 256
#: Points in a block of vectors at most, and the number of blocks that fewer points are still dealt to.
BLOCK_VECTORS, LEAST_BLOCKS = 16_384, 12


def euclidean(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _block_pairs_of(df: DataFrame, key: str, columns: list[str], n: int | None, block: int, ranges: bool = False):
    """``df`` dealt to pairs (__x, __y) of blocks of about ``block`` rows, grouped by them; ``__b`` is a row's own block.

    Blocks go by hash, or by ``ranges`` of keys that are numbers from 0 to n - 1.
    """
    n = df.count() if n is None else n
    blocks = max(1, -(-n // block))
    b = (F.floor(F.col(key) / F.lit(block)) if ranges else F.pmod(F.xxhash64(key), F.lit(blocks))).cast("int")
    dealt = df.withColumn("__b", b).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, "__b").alias("x"), F.greatest(o, "__b").alias("y")))).alias("__g"), "__b", key, *columns
    )
    # few bytes can mean much work: a count of its own keeps the groups from being put into one task
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks * (blocks + 1) // 2, 8 * spark.sparkContext.defaultParallelism))
    dealt = dealt.select(F.col("__g.x").alias("__x"), F.col("__g.y").alias("__y"), "__b", key, *columns).repartition(parts, "__x", "__y")
    return dealt.groupBy("__x", "__y")


def over_blocks(df: DataFrame, key: str, columns: list[str], run: Callable[[list, list, bool], pa.Table], schema: str, n: int | None = None, block: int = BLOCK_POINTS) -> DataFrame:
    """Rows of ``schema`` from ``run(left rows, right rows, same)`` over every pair of blocks, rows being dicts sorted by key.

    A point is sent to the ``blocks`` pairs of blocks that hold its block; each pair is one group.
    """

    def each(key_, table):
        x, y = (k.as_py() for k in key_)
        rows = table.to_pylist()
        left = sorted((r for r in rows if r["__b"] == x), key=lambda r: r[key])
        return run(left, left if x == y else sorted((r for r in rows if r["__b"] == y), key=lambda r: r[key]), x == y)

    return _block_pairs_of(df, key, columns, n, block).applyInArrow(each, schema)


def block_pairs(df: DataFrame, key: str, columns: list[str], kernel: Callable[[list, list, bool], np.ndarray], n: int | None = None, block: int = BLOCK_POINTS, nearest: int | None = None) -> DataFrame:
    """(i, j, dist) with i < j by a kernel over two blocks: ``kernel(left rows, right rows, same)`` gives a matrix.

    With ``nearest`` a group gives, for each of its points, the rows (point, other, dist) of so many nearest others in
    the other block.
    """
    kind = df.schema[key].dataType

    def run(left, right, same):
        own = to_arrow_type(kind)
        if not left or not right:
            return pa.table({"i": pa.array([], own), "j": pa.array([], own), "dist": pa.array([], pa.float64())})
        d = kernel([[r[c] for c in columns] for r in left], [[r[c] for c in columns] for r in right], same)
        a, b = np.indices(d.shape)
        keep = a < b if same else np.ones(d.shape, bool)
        ids_l, ids_r = np.array([r[key] for r in left]), np.array([r[key] for r in right])
        if nearest is not None:
            if same:
                d = np.where(keep, d, d.T)
                np.fill_diagonal(d, np.inf)
            i, j, dist = (np.concatenate(c) for c in zip(_nearest(d, ids_l, ids_r, nearest), *([_nearest(d.T, ids_r, ids_l, nearest)] if not same else [])))
            return pa.table({"i": i, "j": j, "dist": dist})
        i, j = ids_l[a[keep]], ids_r[b[keep]]
        return pa.table({"i": np.minimum(i, j), "j": np.maximum(i, j), "dist": d[keep]})

    return over_blocks(df, key, columns, run, f"i {kind.simpleString()}, j {kind.simpleString()}, dist double", n, block)


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a mask with few true entries: eight at a time where its width allows."""
    if mask.shape[1] % 8 or not mask.flags.c_contiguous:
        return np.nonzero(mask)
    eight = np.flatnonzero(mask.view(np.uint64))
    k, place = np.nonzero(mask.reshape(-1, 8)[eight])
    return np.divmod(eight[k] * 8 + place, mask.shape[1])


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


class Vectors:
    """One block of vectors, sorted by key: ``_TILE`` parts of two blocks give squared distances as one matrix product.

    A product's rounding is below ``_ROOM`` x (largest squared norms); what lies that near to a decision is taken again
    from the differences.
    """

    def __init__(self, table: pa.Table, key: str, vector: str):
        self.table = table.sort_by(key).combine_chunks()
        self.keys, column = (_chunk(self.table[c]) for c in (key, vector))
        self.z = np.ascontiguousarray(np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)) if len(column) else np.zeros((0, 0))
        with np.errstate(all="ignore"):
            self.sq = (self.z * self.z).sum(1)
            one = np.ones(len(self.z))
            self.a, self.b = np.column_stack((-2 * self.z, self.sq, one)), np.column_stack((self.z, one, self.sq))
        finite = np.isfinite(self.sq)
        self.top = float(self.sq[finite].max()) if finite.any() else 0.0
        #: Finite vectors whose square is not: only differences tell their distances.
        self.wide = ~finite & np.isfinite(self.z).all(1)

    def __len__(self) -> int:
        return len(self.z)

    def ids(self, at=None) -> pa.Array:
        return self.keys if at is None else self.keys.take(pa.array(at))

    def part(self, at: np.ndarray) -> Vectors:
        """These rows alone."""
        out = object.__new__(Vectors)
        out.z, out.sq, out.a, out.b, out.top, out.wide = self.z[at], self.sq[at], self.a[at], self.b[at], self.top, self.wide[at]
        return out

    def slices(self, size: int):
        return [slice(k, min(k + size, len(self))) for k in range(0, len(self), size)]


#: Rows and columns of a tile of distances, and pairs whose differences are held at once.
_TILE, _SOME = (256, 2048), 1 << 15
#: Room for the rounding of a product, and the share of the squared norms below which distances lose digits to it.
_ROOM, _LOSS = 1e-12, 1e-6


def _apart(x: Vectors, y: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of x[i] to y[j] from the differences."""
    out = np.empty(len(i))
    for k in range(0, len(i), _SOME):
        out[k : k + _SOME] = np.sqrt(((x.z[i[k : k + _SOME]] - y.z[j[k : k + _SOME]]) ** 2).sum(1))
    return out


def _squares(x: Vectors, y: Vectors, r: slice, c: slice) -> np.ndarray:
    with np.errstate(all="ignore"):
        return x.a[r] @ y.b[c].T


def _distances(x: Vectors, y: Vectors, r: slice, c: slice) -> np.ndarray:
    """A tile of distances, to double precision: small or odd ones from the differences."""
    d = _squares(x, y, r, c)
    with np.errstate(all="ignore"):
        i, j = _where(~(d >= _LOSS * (x.top + y.top)))
        lost = ~(d[i, j] >= _LOSS * (x.sq[r][i] + y.sq[c][j]))
        i, j = i[lost], j[lost]
        np.sqrt(d, out=d)
        if len(i):
            d[i, j] = _apart(x, y, i + r.start, j + c.start)
        if not np.isfinite(d[0, 0] + d[-1, -1]) or x.wide.any() or y.wide.any():
            i, j = np.nonzero(~np.isfinite(d))
            d[i, j] = _apart(x, y, i + r.start, j + c.start)
    return d


def block_of(n: int) -> int:
    """Points in a block of vectors: as many blocks as give tasks enough, of no more points than ``BLOCK_VECTORS``."""
    return max(BLOCK_POINTS, min(BLOCK_VECTORS, -(-n // LEAST_BLOCKS)))


def over_vectors(df: DataFrame, key: str, vector: str, columns: list[str], run: Callable, schema: str, n: int | None = None, block: int | None = None, ranges: bool = False) -> DataFrame:
    """Rows of ``schema`` from the record batches of ``run(left, right, same)``, ``Vectors`` each, over every pair of blocks.

    Blocks hold up to ``BLOCK_VECTORS`` points, so that few copies of a point move; a task works through tiles of them.
    """
    n = df.count() if n is None else n

    def each(key_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = (k.as_py() for k in key_)
        table = pa.Table.from_batches(batches)
        side = lambda b: Vectors(table.filter(pc.equal(table["__b"], pa.scalar(b, pa.int32()))).select([key, vector, *(c for c in columns if c != vector)]), key, vector)
        left = side(x)
        right = left if x == y else side(y)
        del table
        if len(left) and len(right):
            yield from run(left, right, x == y)

    return _block_pairs_of(df, key, [vector, *columns], n, block or block_of(n), ranges).applyInArrow(each, schema)


def _flat(points: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    return points.select(key, F.col(vector).cast("array<double>").alias(vector), *more)


#: Labels for which blocks may be large, and the points of a block where there are more, since a task sums by point and label.
FEW_LABELS, MANY_BLOCK = 64, 1024


def label_sums(points: DataFrame, label: str = "label", key: str = "sample_id", vector: str = "z") -> DataFrame:
    """(i, label, own, sum, n): each point's distances to the members of each cluster, itself left out, summed by block.

    Blocks send on a row for each point and cluster they hold, not for each pair; the rows of a point and cluster are
    still to be added up. ``own`` marks the point's own cluster, for which there is always a row; members without a
    label belong to none, and have no rows but that. If ``label`` is an array, its entries are labels of as many
    partitions, which share the distances: rows then begin with ``part``, the place in the array.
    """
    kinds = [points.schema[c].dataType for c in (key, label)]
    many = isinstance(kinds[1], ArrayType)
    name_type = kinds[1].elementType if many else kinds[1]
    arrow = to_arrow_type(name_type)

    def coded(side: Vectors):
        """(names, code of each row, first column) of every partition, and the rows' memberships side by side."""
        column, out, at = _chunk(side.table[label]), [], 0
        for p in range(len(column[0]) if many else 1):
            own = (pc.list_element(column, p) if many else column).dictionary_encode(null_encoding="encode")
            out.append((own.dictionary.to_pylist(), own.indices.to_numpy(), at))
            at += len(own.dictionary)
        member = np.zeros((len(side), at))
        for _, codes, first in out:
            member[np.arange(len(side)), first + codes] = 1
        return out, member

    def given(side: Vectors, mine, others, member, sums, same):
        for p, ((names, codes, _), (theirs, _, first)) in enumerate(zip(mine, others)):
            place = {v: k for k, v in enumerate(names)}
            for c, name in enumerate(theirs):
                own = codes == place.get(name, -1)
                if name is not None:
                    at, total = np.arange(len(side)), sums[:, first + c]
                    n = int(member[:, first + c].sum()) - (own if same else np.zeros(len(side), bool)).astype(np.int64)
                elif same:
                    at = np.flatnonzero(own)
                    own, total, n = own[at], np.zeros(len(at)), np.zeros(len(at), np.int64)
                else:
                    continue
                columns = [side.ids(at), pa.array([name], arrow).take(pa.array(np.zeros(len(at), np.int64))), pa.array(own), pa.array(total), pa.array(n)]
                yield pa.record_batch(([pa.array(np.full(len(at), p, np.int32))] if many else []) + columns, (["part"] if many else []) + ["i", "label", "own", "sum", "n"])

    def run(left: Vectors, right: Vectors, same: bool):
        (own_l, ml), (own_r, mr) = coded(left), coded(right)
        sl, sr = np.zeros((len(left), mr.shape[1])), np.zeros((len(right), ml.shape[1]))
        for r in left.slices(_TILE[0]):
            for c in right.slices(_TILE[1]):
                d = _distances(left, right, r, c)
                sl[r] += d @ mr[c]
                if not same:
                    sr[c] += d.T @ ml[r]
        yield from given(left, own_l, own_r, mr, sl, same)
        if not same:
            yield from given(right, own_r, own_l, ml, sr, same)

    schema = f"{'part int, ' if many else ''}i {kinds[0].simpleString()}, label {name_type.simpleString()}, own boolean, sum double, n long"
    n = points.count()
    each = points.select(F.posexplode(label)) if many else points.select(label)
    few = each.distinct().limit(FEW_LABELS + 1).count() <= FEW_LABELS
    return over_vectors(_flat(points, key, vector, label), key, vector, [label], run, schema, n, block_of(n) if few else min(block_of(n), MANY_BLOCK))


def _distance_sums(points: DataFrame, key: str, vector: str) -> DataFrame:
    """(i, sum, n): each point's distances to all others, summed by block; rows of a point are still to be added up."""

    def run(left: Vectors, right: Vectors, same: bool):
        sl, sr = np.zeros(len(left)), np.zeros(len(right))
        for r in left.slices(_TILE[0]):
            for c in right.slices(_TILE[1]):
                d = _distances(left, right, r, c)
                sl[r] += d.sum(1)
                if not same:
                    sr[c] += d.sum(0)
        for side, sums, n in [(left, sl, len(right) - same)] + ([] if same else [(right, sr, len(left))]):
            yield pa.record_batch([side.ids(), pa.array(sums), pa.array(np.full(len(side), n))], ["i", "sum", "n"])

    return over_vectors(_flat(points, key, vector), key, vector, [], run, f"i {points.schema[key].dataType.simpleString()}, sum double, n long")


def distance_totals(points: DataFrame, key: str = "sample_id", vector: str = "z") -> DataFrame:
    """(i, n, total): how many others each point has, and the sum of its distances to them."""
    sums = _distance_sums(points, key, vector).groupBy("i").agg(F.sum("n").alias("n"), F.sum("sum").alias("total"))
    return sums.filter("n > 0")


def _nearest(d: np.ndarray, own: np.ndarray, other: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, other, dist) of the m least finite entries of each row, the lesser other first; ``other`` ascends."""
    at = np.argsort(d, axis=1, kind="stable")[:, :m]
    dist = np.take_along_axis(d, at, 1)
    good = np.isfinite(dist)
    return np.repeat(own, at.shape[1])[good.ravel()], other[at][good], dist[good]


def _exact(left, right, same):
    """Distances from exact differences, some rows at a time."""
    a, b = (np.array([r[0] for r in side], float) for side in (left, right))
    return np.concatenate([np.sqrt(((a[k : k + 32, None] - b[None]) ** 2).sum(2)) for k in range(0, len(a), 32)])


def _pair_tiles(left: Vectors, right: Vectors, same: bool, r: slice) -> Iterator[pa.RecordBatch]:
    """(i, j, dist), i < j, of the rows ``r`` of a block and all of another, tile by tile."""
    own, other = left.ids(), right.ids()
    for c in right.slices(_TILE[1]):
        if same and c.stop <= r.start + 1:
            continue
        d = _distances(left, right, r, c)
        i, j = (np.repeat(np.arange(r.start, r.stop), d.shape[1]), np.tile(np.arange(c.start, c.stop), d.shape[0]))
        d = d.ravel()
        if same and c.start < r.stop:
            above = i < j
            i, j, d = i[above], j[above], d[above]
        i, j = own.take(pa.array(i)), other.take(pa.array(j))
        if not same:
            i, j = pc.min_element_wise(i, j), pc.max_element_wise(i, j)
        yield pa.record_batch([i, j, pa.array(d)], ["i", "j", "dist"])


def euclidean_pairs(points: DataFrame, key: str = "sample_id", vector: str = "z") -> DataFrame:
    """All pairs by blocks; a task gives them tile by tile."""

    def run(left: Vectors, right: Vectors, same: bool):
        for r in left.slices(_TILE[0]):
            yield from _pair_tiles(left, right, same, r)

    kind = points.schema[key].dataType.simpleString()
    return over_vectors(_flat(points, key, vector), key, vector, [], run, f"i {kind}, j {kind}, dist double")


def _runs(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, lo, hi): the pairs (i, j) as runs of j from lo to hi - 1; a pair that is there again begins a run of its own."""
    if (np.diff(i) < 0).any() or ((np.diff(j) < 0) & (np.diff(i) == 0)).any():
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
    new = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1] + 1)))) if len(i) else np.zeros(0, int)
    last = np.append(new[1:], len(i)) - 1
    return i[new], j[new], j[last] + 1


def check_points(points: DataFrame, key: str = "sample_id", vector: str = "z") -> int:
    """``check_pairs`` of ``euclidean_pairs`` of points, without a row for each pair in a shuffle.

    Points are numbered and dealt by ranges of their numbers. A task makes its pairs tile by tile and sends on, for each
    point, the runs of others that it was paired with: few rows for each point and block. The runs of a point must follow
    on each other from the point to the last one.
    """
    spark, n = points.sparkSession, points.count()
    if n < 2 or points.select(key).distinct().count() != n:
        raise ValueError("the pairs are not a full distance matrix")
    held = numbered(_flat(points, key, vector), [key], "place")

    def run(left: Vectors, right: Vectors, same: bool):
        for r in left.slices(_TILE[0]):
            found = [_runs(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in _pair_tiles(left, right, same, r)]
            if not found:
                continue
            i, lo, hi = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((lo, i))
            i, lo, hi = i[order], lo[order], hi[order]
            new = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (lo[1:] != hi[:-1])))) if len(i) else np.zeros(0, int)
            yield pa.record_batch([pa.array(i[new]), pa.array(lo[new]), pa.array(hi[np.append(new[1:], len(i)) - 1])], ["i", "lo", "hi"])

    placed = held.select((F.col("place") - 1).alias("place"), vector)
    runs = over_vectors(placed, "place", vector, [], run, "i long, lo long, hi long", n, None, True)
    r = whole_runs(runs).agg(F.count(F.lit(1)).alias("points"), F.sum("length").alias("pairs"), F.min("follows").alias("follows")).first()
    dropped(held)
    if not r.follows or r.points != n - 1 or r.pairs != n * (n - 1) // 2:
        raise ValueError("the pairs are not a full distance matrix")
    return n


def whole_runs(runs: DataFrame) -> DataFrame:
    """(i, length, follows): how many others the runs (i, lo, hi) of a point hold, and whether they follow on each other from i + 1."""
    w = Window.partitionBy("i").orderBy("lo", "hi")
    each = runs.withColumn("before", F.lag("hi", 1).over(w))
    return each.groupBy("i").agg(F.sum(F.col("hi") - F.col("lo")).alias("length"), F.min(F.col("lo") == F.coalesce("before", F.col("i") + 1)).alias("follows"))


class _Near:
    """The m nearest of each row of a block among those seen: (row, place of the other, distance), cut when there are many."""

    def __init__(self, m: int):
        self.m, self.parts, self.size, self.kept = m, [], 0, 0

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        good = np.isfinite(d)
        self.parts.append((i[good], j[good], d[good]))
        self.size += int(good.sum())
        if self.size > 2 * self.kept + (1 << 20):
            self.parts = [self.cut()]
            self.size = self.kept = len(self.parts[0][0])

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, d = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        order = np.lexsort((j, d, i))  # rows of a block are in the order of their keys
        i, j, d = i[order], j[order], d[order]
        new = np.flatnonzero(np.diff(i, prepend=-1))
        place = np.arange(len(i)) - np.repeat(new, np.diff(new, append=len(i)))
        return i[place < self.m], j[place < self.m], d[place < self.m]


#: Points, about, among which a first bound of each one's m-th distance is looked for: at least, at most.
BOUND_POINTS, MOST_BOUND = 2048, 1 << 16
#: A pair that is sent on costs about as much as so many distances within a part, and entries of them held at once.
_PAIR_COST, _ENTRIES = 128, 1 << 20


def _bounded(points: DataFrame, m: int, n: int, key: str, vector: str) -> DataFrame:
    """``points`` with ``bound``: the square of a distance within which each has m others, from a part of them; null for none.

    Some m x n / (points of a part) pairs of each point are within it, so parts grow with m and n; where they are fewer
    than the cores can take, tasks share a part, each with a stripe of its points.
    """
    parts = max(1, n // min(MOST_BOUND, max(BOUND_POINTS, 4 * m, isqrt(_PAIR_COST * m * n))))
    stripes = max(1, min(-(-2 * points.sparkSession.sparkContext.defaultParallelism // parts), n // parts // 1024))

    def run(key_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = Vectors(table.select([key, vector, "__o"]), key, vector)
        own = np.flatnonzero(x.table["__o"].to_numpy() == key_[1].as_py())
        bound = np.full(len(own), np.inf)
        if len(x) > m:
            some = max(1, _ENTRIES // len(x))
            for k in range(0, len(own), some):
                with np.errstate(all="ignore"):
                    d = x.a[own[k : k + some]] @ x.b.T
                d.partition(m, axis=1)
                bound[k : k + some] = d[:, m] + 4 * _ROOM * x.top  # the point itself is among them
        bound[~np.isfinite(bound) | x.wide[own]] = np.inf
        return x.table.select([key, vector]).take(pa.array(own)).append_column("bound", pa.array(bound))

    place = lambda seed, of: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(of)).cast("int")
    dealt = points.withColumn("__p", place(1, parts)).withColumn("__o", place(2, stripes)).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    return dealt.repartition(parts * stripes, "__p", "__s").groupBy("__p", "__s").applyInArrow(run, f"`{key}` {points.schema[key].dataType.simpleString()}, `{vector}` array<double>, bound double")


def nearest_points(points: DataFrame, m: int, key: str = "sample_id", vector: str = "z", block: int | None = None) -> DataFrame:
    """(i, rank, j, dist) of the m nearest others of each point; blocks send on m candidates a point, not all pairs.

    A part of the points bounds each one's m-th distance. Pairs of blocks are matrix products; pairs within the bound of
    either end are taken again from their differences, so ties and digits are those of the differences.
    """
    n = points.count()
    kind = points.schema[key].dataType

    def run(left: Vectors, right: Vectors, same: bool):
        room = 4 * _ROOM * (left.top + right.top)
        lb, rb = left.table["bound"].to_numpy() + room, right.table["bound"].to_numpy() + room
        near = [(_Near(m), left, right)] if same else [(_Near(m), left, right), (_Near(m), right, left)]
        for r in left.slices(_TILE[0]):
            for c in right.slices(_TILE[1]):
                d = _squares(left, right, r, c)
                within = d <= lb[r, None]
                if not same:
                    within |= d <= rb[c]
                within[left.wide[r]] = True
                within[:, right.wide[c]] = True
                i, j = _where(within)
                square = d[i, j]
                i, j = i + r.start, j + c.start
                if same:
                    i, j, square = i[i != j], j[i != j], square[i != j]
                dist = _apart(left, right, i, j)
                odd = left.wide[i] | right.wide[j]
                own = (square <= lb[i]) | odd
                near[0][0].add(i[own], j[own], dist[own])
                if not same:
                    own = (square <= rb[j]) | odd
                    near[1][0].add(j[own], i[own], dist[own])
        for best, a, b in near:
            i, j, dist = best.cut()
            if len(i):
                yield pa.record_batch([a.ids(i), b.ids(j), pa.array(dist)], ["i", "j", "dist"])

    found = over_vectors(_bounded(_flat(points, key, vector), m, n, key, vector), key, vector, ["bound"], run, f"i {kind.simpleString()}, j {kind.simpleString()}, dist double", n, block)
    return ranked(found, m)


def extreme_of_points(points: DataFrame, far: bool = False, key: str = "sample_id", vector: str = "z", block: int | None = None) -> DataFrame:
    """(i, j, dist) of the nearest pair, or of the farthest one, lesser ids first among equals; a pair of blocks gives its own."""
    sign, kind = -1 if far else 1, points.schema[key].dataType.simpleString()

    def least(own, other, dist):
        """(dist, i, j) of the first pair, distances that are no numbers being larger than all others."""
        odd = np.isnan(dist)
        at = odd if odd.all() or (far and odd.any()) else dist == (np.max(dist) if far else np.nanmin(dist))
        lo, hi = np.minimum(own[at], other[at]), np.maximum(own[at], other[at])
        return dist[at][0], lo.min(), hi[lo == lo.min()].min()

    def run(left: Vectors, right: Vectors, same: bool):
        room, best, found = 4 * _ROOM * (left.top + right.top), np.inf, []
        own, other = left.ids().to_numpy(zero_copy_only=False), right.ids().to_numpy(zero_copy_only=False)
        for r in left.slices(_TILE[0]):
            for c in right.slices(_TILE[1]):
                if same and c.stop <= r.start + 1:
                    continue
                d = sign * _squares(left, right, r, c)
                if same and c.start < r.stop:
                    d[np.arange(r.start, r.stop)[:, None] >= np.arange(c.start, c.stop)] = np.inf
                low = d.min()
                if np.isfinite(low):
                    if low > best + room:
                        continue
                    best = min(best, low)
                    i, j = _where(d <= best + room)
                else:  # vectors that are not finite, or whose squares are not
                    i, j = np.indices(d.shape).reshape(2, -1)
                i, j = i + r.start, j + c.start
                if same:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    found.append(least(own[i], other[j], _apart(left, right, i, j)))
        if found:
            dist, i, j = (np.array(v) for v in zip(*found))
            dist, i, j = least(i, j, dist)
            yield pa.record_batch([pa.array([i]).cast(left.ids().type), pa.array([j]).cast(left.ids().type), pa.array([dist], pa.float64())], ["i", "j", "dist"])

    each = over_vectors(_flat(points, key, vector), key, vector, [], run, f"i {kind}, j {kind}, dist double", None, block)
    return most_different(each) if far else most_similar(each)


def ranked(directed: DataFrame, m: int | None) -> DataFrame:
    """(i, rank, j, dist): the m nearest of each i, the lesser id first among equals; all with None."""
    w = Window.partitionBy("i").orderBy("dist", "j")
    out = directed.withColumn("rank", F.row_number().over(w))
    return (out if m is None else out.filter(F.col("rank") <= m)).select("i", "rank", "j", "dist")


def both_ways(edge: DataFrame, *columns: str) -> DataFrame:
    """(i, j, columns) of every row and of its swap, in one pass over the input."""
    way = lambda a, b: F.struct(F.col(a).alias("i"), F.col(b).alias("j"))
    return edge.select(F.explode(F.array(way("i", "j"), way("j", "i"))).alias("__w"), *columns).select("__w.i", "__w.j", *columns)


def symmetric(pairs: DataFrame) -> DataFrame:
    return both_ways(pairs, "dist")


def check_pairs(pairs: DataFrame) -> int:
    """The number of points; raises ``ValueError`` unless each pair i < j is there once."""
    r = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("i", "j").alias("d"), F.min(F.col("i") < F.col("j")).alias("ok")).first()
    ids = pairs.select("i").union(pairs.select("j")).distinct().count()
    if not r.ok or r.n != r.d or r.n != ids * (ids - 1) // 2:
        raise ValueError("the pairs are not a full distance matrix")
    return ids


def most_similar(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy("dist", "i", "j").limit(1)


def most_different(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("dist"), "i", "j").limit(1)


def extremes(pairs: DataFrame, curves: DataFrame) -> DataFrame:
    """The curves of the nearest and of the farthest pair: (which, sample_id, feature, values)."""
    return curves_of(most_similar(pairs).withColumn("which", F.lit("similar")).unionByName(most_different(pairs).withColumn("which", F.lit("different"))), curves)


def curves_of(both: DataFrame, curves: DataFrame) -> DataFrame:
    """(which, sample_id, feature, values) of the curves of two pairs (which, i, j)."""
    ids = both.select("which", F.explode(F.array("i", "j")).alias("sample_id"))
    return curves.join(F.broadcast(ids), "sample_id").select("which", "sample_id", "feature", "values")  # four rows


def neighbours(pairs: DataFrame, m: int | None = None) -> DataFrame:
    """(i, rank, j, dist): the m nearest others of each point, the lesser id first among equals; all with None."""
    return ranked(symmetric(pairs), m)


def nearest_neighbours(pairs: DataFrame, m: int | None = None) -> DataFrame:
    """``neighbours`` with m chosen behind the largest jump of the mean distance where it isn't given."""
    return neighbours(pairs, optimal_m(pairs, "avg_distance") if m is None else m)


def class_places(labels: DataFrame) -> DataFrame:
    """(sample_id, place): numbers from 0 in the order of (label, sample_id), by counts of labels and a numbering within each."""
    w = Window.partitionBy("label").orderBy("sample_id")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.alias("a").join(F.broadcast(sizes).alias("b"), F.col("b.label") < F.col("a.label"), "left")  # a row a class
    offset = before.groupBy(F.col("a.label").alias("label")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("offset"))
    return labels.join(F.broadcast(offset), "label").select("sample_id", (F.col("offset") + F.row_number().over(w) - 1).cast("int").alias("place"))


def _with_diagonal(off: DataFrame, place: DataFrame) -> DataFrame:
    return off.unionByName(place.select(F.col("place").alias("row"), F.col("place").alias("col"), F.lit(0.0).alias("dist")))


def reorder_by_class(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, col, dist): the full matrix with samples in the order of (label, sample_id), zeros on its diagonal."""
    place = class_places(labels)
    x, y = (place.select(F.col("sample_id").alias(c), F.col("place").alias(name)) for c, name in (("i", "row"), ("j", "col")))
    return _with_diagonal(symmetric(pairs).join(x, "i").join(y, "j").select("row", "col", "dist"), place)


def points_by_class(points: DataFrame, key: str = "sample_id", vector: str = "z") -> DataFrame:
    """``reorder_by_class`` of points: they take their places before they are paired, so no pair is shuffled."""
    place = class_places(points.select(F.col(key).alias("sample_id"), "label"))
    placed = points.select(F.col(key).alias("sample_id"), vector).join(place, "sample_id").select("place", vector)
    return _with_diagonal(symmetric(euclidean_pairs(placed, "place", vector)).select(F.col("i").alias("row"), F.col("j").alias("col"), "dist"), place)


def average_mth_distance(knn: DataFrame, max_m: int | None = None) -> DataFrame:
    """(m, avg_dist): the mean distance to the m-th nearest other."""
    k = knn if max_m is None else knn.filter(F.col("rank") <= max_m)
    return k.groupBy(F.col("rank").alias("m")).agg(F.avg("dist").alias("avg_dist"))


def jumps(n: int) -> int:
    """How many steps of the mean distance are compared."""
    return max(2, n // 4)


def largest_jump(curve: DataFrame, n: int) -> int:
    """The m behind the largest relative step of (m, avg_dist), among the first max(2, min(count - 1, n // 4)) steps."""
    rows = curve.orderBy("m").collect()
    d = np.array([r["avg_dist"] for r in rows])
    if len(d) < 2:
        return int(rows[0]["m"])
    steps = (np.diff(d) / (d[:-1] + 1e-12))[: max(2, min(len(d) - 1, n // 4))]
    return int(rows[int(steps.argmax()) + 1]["m"])


#: Edges between components that one task may finish; above, rounds over the whole table contract them first.
FEW_EDGES = 200_000
_EDGE = "x long, y long, m double, a long, b long"


def _forest(rows: list[tuple]) -> tuple[list[tuple], dict[int, int]]:
    """The edges (m, a, b, x, y) of a least spanning forest of the components x, y, and the least name that meets each."""
    up: dict[int, int] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for r in sorted(rows):
        x, y = find(r[3]), find(r[4])
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append(r)
    return out, {x: find(x) for x in up}


def _lists(batches) -> list[tuple]:
    return [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 0, 1)))]


def _reduced(edge: DataFrame) -> DataFrame:
    """Each task's edges without those that close a circle within the task: they are in no least forest."""

    def run(batches):
        best: list = []
        size = 0
        for b in batches:
            best += _lists([b])
            if len(best) > max(2 * size, FEW_EDGES):  # as many new edges as old ones: each is sorted a few times only
                best = _forest(best)[0]
                size = len(best)
        if best:
            m, a, b, x, y = zip(*_forest(best)[0])
            yield pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(m, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["x", "y", "m", "a", "b"])

    return edge.mapInArrow(run, _EDGE)


def _contracted(edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A Boruvka round over (x, y, m, a, b): (each component's least edge, (c, root) of the components it joins).

    Least edges by partial aggregation; (m, a, b) orders all edges, so picks make circles of two only. Roots come by
    doubling: every step looks up the parent's parent, so their number is the logarithm of the longest chain.
    """
    ends = edge.select(F.explode(F.array(F.struct(F.col("x").alias("c"), F.col("y").alias("o")), F.struct(F.col("y").alias("c"), F.col("x").alias("o")))).alias("e"), "m", "a", "b")
    pick = ends.select("e.c", F.struct("m", "a", "b", F.col("e.o").alias("o")).alias("p")).groupBy("c").agg(F.min("p").alias("p")).select("c", "p.*")
    pick = written(pick, "picks")
    back = pick.select(F.col("c").alias("o"), F.col("o").alias("oo"))
    up = written(pick.join(back, "o").select("c", F.when((F.col("oo") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("root")), "roots")
    while True:
        above = up.select(F.col("c").alias("root"), F.col("root").alias("top"))
        more = written(up.join(above, "root").select("c", F.col("top").alias("root"), (F.col("root") != F.col("top")).alias("moved")), "roots")
        still = more.filter("moved").isEmpty()
        dropped(up)
        up = more.select("c", "root")
        up._undula_path = more._undula_path
        if still:
            return pick, up


def spanning(edge: DataFrame, labels: bool = True, held: list | None = None) -> tuple[DataFrame, DataFrame | None]:
    """((a, b, m) of a least spanning forest of the edges (a, b, m), (sample_id, component) of their nodes).

    Tasks drop edges that close a circle in their own part; while more than ``FEW_EDGES`` remain, Boruvka rounds halve
    the components at least; what remains is one small task's work. A component is named by its least node. ``held`` gets
    the written tables that both frames read.
    """
    held = [] if held is None else held
    left = written(_reduced(edge.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("m").cast("double").alias("m"), "a", "b")), "edges")
    picked: list[DataFrame] = []
    name = None
    while left.count() > FEW_EDGES:
        pick, up = _contracted(left)
        held.append(pick)
        picked.append(pick.select("a", "b", "m").distinct())
        if labels:
            old = left.select(F.explode(F.array("x", "y")).alias("sample_id")).distinct().select("sample_id", F.col("sample_id").alias("c")) if name is None else name
            new = written(old.join(up, "c", "left").select("sample_id", F.coalesce("root", "c").alias("c")), "names")
            dropped(name)
            name = new
        x, y = (up.select(F.col("c").alias(c), F.col("root").alias(f"{c}r")) for c in ("x", "y"))
        moved = left.join(x, "x", "left").join(y, "y", "left").select(F.coalesce("xr", "x").alias("x"), F.coalesce("yr", "y").alias("y"), "m", "a", "b").filter("x <> y")
        shorter = written(_reduced(moved), "edges")
        dropped(left, up)
        left = shorter

    def run(batches):
        tree, root = _forest(_lists(batches))
        rows = [(a, b, m, None) for m, a, b, _, _ in tree] + [(x, None, None, r) for x, r in root.items()]
        if rows:
            a, b, m, r = zip(*rows)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.float64()), pa.array(r, pa.int64())], ["a", "b", "m", "r"])

    last = written(left.coalesce(1).mapInArrow(run, "a long, b long, m double, r long"), "forest")  # FEW_EDGES at most
    dropped(left)
    held += [last, name]
    tree = last.filter("r is null").select("a", "b", "m")
    for p in picked:
        tree = tree.unionByName(p)
    if not labels:
        return tree, None
    root = last.filter("r is not null").select(F.col("a").alias("c"), F.col("r").alias("root"))
    if name is None:
        return tree, root.select(F.col("c").alias("sample_id"), F.col("root").alias("component"))
    whole = name.join(root, "c", "left").select("sample_id", F.coalesce("root", "c").alias("c"))
    least = whole.groupBy("c").agg(F.min("sample_id").alias("component"))
    return tree, whole.join(least, "c").select("sample_id", "component")


def components(edge: DataFrame, held: list | None = None) -> DataFrame:
    """(sample_id, component) of the nodes of the edges (i, j): the least node that can be reached."""
    return spanning(edge.select(F.col("i").alias("a"), F.col("j").alias("b"), F.lit(0.0).alias("m")), True, held)[1]


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the order of columns that no two rows share, written.

    Rows are dealt by ranges and numbered within each; a row a range says how many come before it.
    """
    part = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    dealt = written(part.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order))), name)
    sizes = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__s"))  # a row a range
    before = sizes.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    out = dealt.join(F.broadcast(before), "__p").withColumn(name, (F.col("__b") + F.col("__n")).cast("long")).drop("__p", "__n", "__b")
    out._undula_path = dealt._undula_path
    return out


def components_by_m(knn: DataFrame, max_m: int | None = None, held: list | None = None) -> DataFrame:
    """(m, components) of the undirected graph of the m nearest, for every m.

    An edge is there from the lesser of its two ranks on, so the ranks of a least spanning forest count the components
    for all m at once.
    """
    spark = knn.sparkSession
    k = knn if max_m is None else knn.filter(F.col("rank") <= max_m)
    edge = k.select(F.least("i", "j").cast("long").alias("a"), F.greatest("i", "j").cast("long").alias("b"), "rank").groupBy("a", "b").agg(F.min("rank").alias("m"))
    counts = spanning(edge, False, held)[0].groupBy(F.col("m").cast("int").alias("m")).agg(F.count(F.lit(1)).alias("joins"))
    size = k.agg(F.count_distinct("i").alias("n"), F.max("rank").alias("top")).first()
    w = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)  # a row a rank
    grid = spark.range(1, (size["top"] or 0) + 1).select(F.col("id").cast("int").alias("m"))
    return grid.join(counts, "m", "left").select("m", (F.lit(size["n"]) - F.sum(F.coalesce("joins", F.lit(0))).over(w)).alias("components"))


def _widened(nearest: Callable[[int], DataFrame], n: int, first: int) -> list[tuple[int, int]]:
    """(m, components) up to the first m with one component: ranks are looked at ``first`` at a time, then eight times as many."""
    m = first
    while True:
        knn = written(nearest(min(m, n - 1)), "knn")
        held = [knn]
        found = components_by_m(knn, held=held).orderBy("m").collect()  # a row for each m so far
        dropped(*held)
        if m >= n - 1 or found[-1].components == 1:
            return [(r.m, r.components) for r in found]
        m *= 8


def components_of_points(points: DataFrame, key: str = "sample_id", vector: str = "z", first: int = 16) -> DataFrame:
    """(m, components) for every m below the number of points.

    A larger m only adds edges, so once there is one component it stays one. Blocks send on so many neighbours a point,
    not all pairs.
    """
    n, spark = points.count(), points.sparkSession
    rows = _widened(lambda m: nearest_points(points, m, key, vector), n, first) if n > 1 else []
    least = spark.createDataFrame(rows, "m int, components long")
    return least.unionByName(spark.range(len(rows) + 1, max(n, len(rows) + 1)).select(F.col("id").cast("int").alias("m"), F.lit(1).cast("long").alias("components")))


def first_connected(components: DataFrame) -> int:
    """The first m with one component, else the last."""
    r = components.agg(F.min(F.when(F.col("components") == 1, F.col("m"))).alias("one"), F.max("m").alias("last")).first()
    return r.one if r.one is not None else r.last


def optimal_m(pairs: DataFrame, method: str = "connectivity", max_m: int | None = None, first: int = 16) -> int:
    """connectivity: the first m with one component, else the last; avg_distance: behind the largest jump.

    Of each point's neighbours only the ranks that can matter are kept: widening ones until the graph is connected, or
    the n // 4 first among whose means the jump is looked for.
    """
    n = pairs.select(F.explode(F.array("i", "j")).alias("i")).distinct().count()
    most = n - 1 if max_m is None else min(max_m, n - 1)
    if method == "connectivity":
        rows = _widened(lambda m: neighbours(pairs, min(m, most)), most + 1, first)
        return next((m for m, c in rows if c == 1), rows[-1][0])
    if method == "avg_distance":
        return largest_jump(average_mth_distance(neighbours(pairs, min(most, jumps(n) + 1))), n)
    raise ValueError(f"unknown method {method!r}")


#: Bytes of distances that a task of ``mean_by_rank`` sorts at once, and stripes of points for each core.
_SORTED, STRIPES = 1 << 25, 2


def mean_by_rank(points: DataFrame, most: int | None = None, key: str = "sample_id", vector: str = "z") -> DataFrame:
    """(m, avg_dist): the mean distance to the m-th nearest other for every m up to ``most``, without a row for each pair.

    A stripe of points meets all points in one task, which sorts the distances of some points at a time and adds them up
    by rank; a stripe sends on a row a rank. So a task holds the vectors, not the distances, of all points.
    """
    spark, n = points.sparkSession, points.count()
    most = n - 1 if most is None else min(most, n - 1)
    if most < 1:
        return spark.createDataFrame([], "m int, avg_dist double")
    stripes = max(1, min(STRIPES * spark.sparkContext.defaultParallelism, n))
    kind = points.schema[key].dataType.simpleString()
    dealt = _flat(points, key, vector).withColumn("__own", F.pmod(F.xxhash64(key), F.lit(stripes)).cast("int")).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))

    def run(key_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = Vectors(pa.Table.from_batches([b.select([key, vector, "__own"]) for b in batches]), key, vector)
        own = np.flatnonzero(y.table["__own"].to_numpy() == key_[0].as_py())
        sums, seen = np.zeros(most), np.zeros(most, np.int64)
        size = max(1, _SORTED // (8 * len(y)))
        for k in range(0, len(own), size):
            at = own[k : k + size]
            x = y.part(at)
            d = np.concatenate([_distances(x, y, slice(0, len(at)), c) for c in y.slices(_TILE[1])], axis=1)
            d[np.arange(len(at)), at] = np.inf
            d[np.isnan(d)] = np.inf
            if most < len(y) // 2:
                d = np.partition(d, most - 1, axis=1)[:, :most]
            d.sort(axis=1)
            d = d[:, :most]
            if np.isinf(d[:, -1]).any():  # others without a distance have no rank
                seen += np.isfinite(d).sum(0)
                d[np.isinf(d)] = 0.0
            else:
                seen += len(at)
            sums += d.sum(0)
        if len(own):
            yield pa.record_batch([pa.array(np.arange(1, most + 1), pa.int32()), pa.array(sums), pa.array(seen)], ["m", "s", "n"])

    sums = dealt.repartition(stripes, "__s").groupBy("__s").applyInArrow(run, "m int, s double, n long")
    return sums.groupBy("m").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("avg_dist")).filter("avg_dist is not null")


def optimal_m_of_points(points: DataFrame, key: str = "sample_id", vector: str = "z") -> int:
    """``optimal_m`` by the mean distance, of points: the ranks among whose means the jump is looked for."""
    n = points.count()
    return largest_jump(mean_by_rank(points, min(n - 1, jumps(n) + 1), key, vector), n)


def capped_m(m: int, n: int) -> int:
    return max(5, min(m, n // 5))


def similarity(pairs: DataFrame, knn: DataFrame | None = None, method: str = "neighbors") -> DataFrame:
    """(i, j, w), both directions: exp(-dist); ``neighbors`` keeps pairs of which either is a neighbour of the other."""
    if method == "distance":
        return symmetric(pairs).select("i", "j", F.exp(-F.col("dist")).alias("w"))
    if method == "neighbors":
        return both_ways(edges(knn), "w")
    raise ValueError(f"unknown method {method!r}")


def edges(knn: DataFrame) -> DataFrame:
    """(i, j, w) once for each undirected edge of a neighbour table, i < j; weights of 0 or less are no edges."""
    return knn.filter("i <> j").groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.exp(-F.min("dist")).alias("w")).filter("w > 0").select(F.col("a").alias("i"), F.col("b").alias("j"), "w")


def sparsity(edge: DataFrame, n: int) -> DataFrame:
    """The share of the n x n matrix that is above 0."""
    return edge.agg((2 * F.count(F.lit(1)) / (n * n)).alias("sparsity"))


def class_distances(points: DataFrame, label: str = "label", key: str = "sample_id", vector: str = "z") -> DataFrame:
    """(intra, inter): mean distances within and between classes; a row of sums for each pair of blocks."""

    def run(left: Vectors, right: Vectors, same: bool):
        sums, n, codes = np.zeros(2), np.zeros(2, np.int64), {None: -1}
        a, b = (np.array([codes.setdefault(v, len(codes)) for v in side.table[label].to_pylist()]) for side in (left, right))
        for r in left.slices(_TILE[0]):
            for c in right.slices(_TILE[1]):
                d = _distances(left, right, r, c)
                one = a[r, None] == b[c]
                known = (a[r, None] >= 0) & (b[c] >= 0)
                if same:
                    known &= np.arange(r.start, r.stop)[:, None] < np.arange(c.start, c.stop)
                for k, among in enumerate((known & one, known & ~one)):
                    sums[k] += d[among].sum()
                    n[k] += np.count_nonzero(among)
        yield pa.record_batch([pa.array(sums[:1]), pa.array(n[:1]), pa.array(sums[1:]), pa.array(n[1:])], ["si", "ni", "sb", "nb"])

    r = over_vectors(_flat(points, key, vector, label), key, vector, [label], run, "si double, ni long, sb double, nb long")
    mean = lambda s, n: F.try_divide(F.sum(s), F.sum(n))
    return r.agg(mean("si", "ni").alias("intra"), mean("sb", "nb").alias("inter"))


def difference(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """(i, j, w, d): z_i - z_j for every edge, nodes being (sample_id, z)."""
    a, b = nodes.select(F.col("sample_id").alias("i"), F.col("z").alias("zi")), nodes.select(F.col("sample_id").alias("j"), F.col("z").alias("zj"))
    return edge.join(a, "i").join(b, "j").select("i", "j", "w", F.zip_with("zi", "zj", lambda x, y: x - y).alias("d"))


def divergence(values: DataFrame) -> DataFrame:
    """(sample_id, z): the transpose, edge values d summed onto i and, negated, onto j; sums are partial before the shuffle."""
    ends = F.array(F.struct(F.col("i").alias("id"), F.col("d").alias("d")), F.struct(F.col("j").alias("id"), F.transform("d", lambda x: -x).alias("d")))
    both = values.select(F.explode(ends).alias("e")).select(F.col("e.id").alias("sample_id"), F.col("e.d").alias("d"))
    sums = both.select("sample_id", F.posexplode("d").alias("k", "v")).groupBy("sample_id", "k").agg(F.sum("v").alias("v"))
    return sums.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("z"))
