"""Quality: ridge regression on random Fourier features of document statistics, with isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics of the whole text. Each task sums its rows'
normal equations; the sums meet by row of the matrix, so the driver gets one small matrix however many rows are
labelled. Calibration is isotonic regression over the counts of labels in fixed bins of the ridge score.

Defined results: every text has a score; an empty or null text has statistics of 0; without labels, or with one class
only, every score is the share of 1 (0.5 without labels); a label row whose id has no document teaches nothing; the id
is never an input; documents that repeat an id and labels that repeat one teach once for each of their pairs, so two
labels of one document count half each for its statistics; a text of any length is measured in blocks; other columns are not read by ``measure`` and
``scores``, so they cannot clash, and are kept as they are by ``keep``; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm._arrow import slices, utf8
from undula.llm._store import drop_stash, stash
from undula.llm.shingles import BLOCK, word_blocks

FEATURES = 256
#: Width of the kernel, in standard deviations of a statistic, for the distance over all statistics.
WIDTH = 4.0
RIDGE = 1e-3
BINS = 1024
LOW, HIGH = -0.5, 1.5
STATS = (
    "log_bytes", "log_words", "word_length", "word_spread", "lower", "upper", "digit", "sign", "comma", "white", "high",
    "sign_words", "upper_words", "distinct_words", "repeated_next", "log_lines", "line_length",
)
#: Classes of bytes: 0 lower, 1 upper, 2 digit, 3 sign, 4 comma and full stop, 5 white, 6 above 127.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 6
_CLASS[[44, 46, 39]] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 5


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, len(STATS)) of whole texts, block by block."""
    n, size = len(off) - 1, np.diff(off)
    counts, lines = np.zeros((n, 7)), (size > 0).astype(float)
    for a in range(0, len(raw), BLOCK):
        some = raw[a : a + BLOCK]
        lo, hi = np.searchsorted(off, (a, a + len(some) - 1), "right") - 1
        text = np.repeat(np.arange(hi - lo + 1, dtype=np.int32), np.diff(np.clip(off[lo : hi + 2], a, a + len(some))))
        counts[lo : hi + 1] += np.bincount(text * 7 + _CLASS[some], minlength=7 * (hi - lo + 1)).reshape(-1, 7)
        lines[lo : hi + 1] += np.bincount(text[some == 10], minlength=hi - lo + 1)
    total, length, squares, sign_words, upper_words = np.zeros((5, n))
    hashes, many = [np.empty(0, np.uint64)], np.zeros(n, np.int64)
    for h, start, end in word_blocks(raw, off):
        if not len(h):
            continue
        of = np.searchsorted(off, start, "right") - 1
        k = (end - start).astype(float)
        kind = _CLASS[raw[start[0] : end[-1]]]
        ends = np.column_stack((start - start[0], end - start[0])).ravel()[:-1]
        signs, uppers = (np.add.reduceat(kind == c, ends, dtype=np.int32)[::2] for c in (3, 1))
        length += np.bincount(of, k, n)
        squares += np.bincount(of, k * k, n)
        sign_words += np.bincount(of, signs > 0, n)
        upper_words += np.bincount(of, uppers >= 2, n)
        many += np.bincount(of, minlength=n)
        hashes.append(h)
    h = np.concatenate(hashes)
    total = many.astype(float)
    mean = length / np.maximum(total, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(total, 1) - mean**2, 0))
    again, distinct, first = np.zeros(n), np.zeros(n), np.concatenate(([0], np.cumsum(many)))
    for t in np.flatnonzero(many):
        own = h[first[t] : first[t + 1]]
        again[t] = np.count_nonzero(own[1:] == own[:-1])
        own.sort()
        distinct[t] = 1 + np.count_nonzero(own[1:] != own[:-1])
    b, w = np.maximum(size, 1), np.maximum(total, 1)
    share = counts / b[:, None]
    return np.column_stack([
        np.log1p(size), np.log1p(total), np.log1p(mean), np.log1p(spread), share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 4],
        share[:, 5], share[:, 6], sign_words / w, upper_words / w, np.log1p(distinct) / np.log1p(w), again / w, np.log1p(lines), np.log1p(size / np.maximum(lines, 1)),
    ])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # of the features, and the constant last; empty: every score is ``level[0]``
    level: np.ndarray  # calibrated score of each bin

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weight):
            return np.full(len(x), self.level[0])
        return self.level[bins(self.ridge(x))]


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant."""
    rng = np.random.default_rng(11)
    w = rng.normal(0, 1 / WIDTH, (z.shape[1], FEATURES))
    out = np.empty((len(z), FEATURES + 1))
    np.cos(np.clip(z, -8, 8) @ w + rng.uniform(0, 2 * np.pi, FEATURES), out=out[:, :-1])
    out[:, :-1] *= np.sqrt(2 / FEATURES)
    out[:, -1] = 1
    return out


def bins(s: np.ndarray) -> np.ndarray:
    return np.clip(((s - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)


def isotonic(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The non-decreasing levels nearest to ``ones / total``, weighted by ``total``; empty bins take their neighbours' level."""
    full = np.flatnonzero(total)
    blocks: list[list[float]] = []
    for i in full:
        blocks.append([float(total[i]), float(ones[i]), i])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            t, o, _ = blocks.pop()
            blocks[-1][0] += t
            blocks[-1][1] += o
    at = np.array([b[2] for b in blocks])
    level = np.array([b[1] / b[0] for b in blocks])
    return level[np.maximum(np.searchsorted(at, np.arange(len(total)), "right") - 1, 0)]


def measure(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stats array<double>) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part in slices(batches):
            x = statistics(*utf8(part.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.record_batch([part.column(0), lists], ["key", "stats"])

    return docs.select(key, text).mapInArrow(run, f"key {kind}, stats array<double>").withColumnRenamed("key", key)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(stats: DataFrame, labels: DataFrame, key: str, label: str) -> Model:
    """From (key, stats) and the labelled rows that may be learnt from, all of them."""
    known = labels.filter(F.col(label).isNotNull()).select(F.col(key), F.col(label).cast("double").alias("__y"))
    train = stash(stats.join(known, key).select("stats", "__y"), "train")
    moments = train.select(F.posexplode("stats").alias("j", "v"), "__y").groupBy("j").agg(F.avg("v"), F.stddev_pop("v"), F.avg("__y")).orderBy("j").collect()
    if not moments or not 0 < moments[0][3] < 1:
        drop_stash(train)
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)), np.empty(0), np.array([moments[0][3] if moments else 0.5]))
    mean, sd = np.array([r[1] for r in moments]), np.array([r[2] for r in moments])
    model = Model(mean, np.where(sd > 1e-9, sd, 1.0), np.zeros(FEATURES + 1), np.zeros(BINS))

    def equations(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            f = fourier((_matrix(batch.column(0)) - model.mean) / model.scale)
            total[:, :-1] += f.T @ f
            total[:, -1] += f.T @ batch.column(1).to_numpy()
        yield pa.record_batch([pa.array(np.arange(FEATURES + 1), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    def add(key_, table):
        rows = [np.frombuffer(r.as_py()) for r in table["row"]]
        return pa.table({"i": pa.array([key_[0].as_py()], pa.int32()), "row": pa.array([np.sum(rows, axis=0).tobytes()], pa.binary())})

    sums = train.mapInArrow(equations, "i int, row binary").groupBy("i").applyInArrow(add, "i int, row binary").collect()
    a = np.array([np.frombuffer(bytes(r["row"])) for r in sorted(sums, key=lambda r: r["i"])])
    n = a[-1, FEATURES]
    ridge = np.eye(FEATURES + 1) * RIDGE * n / FEATURES
    ridge[-1, -1] = 1e-9 * n
    model.weight = np.linalg.solve(a[:, :-1] + ridge, a[:, -1])

    def binned(batches):
        total = np.zeros((2, BINS))
        for batch in batches:
            at, y = bins(model.ridge(_matrix(batch.column(0)))), batch.column(1).to_numpy()
            total[0] += np.bincount(at, minlength=BINS)
            total[1] += np.bincount(at, y, BINS)
        at = np.flatnonzero(total[0])
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])], ["b", "n", "y"])

    counts = train.mapInArrow(binned, "b int, n double, y double").groupBy("b").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect()
    drop_stash(train)
    total = np.zeros((2, BINS))
    for b, t, y in counts:
        total[:, b] = t, y
    model.level = isotonic(*total)
    return model


def scores(stats: DataFrame, model: Model, key: str) -> DataFrame:
    """(key, score) of every row of (key, stats)."""
    kind = stats.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], ["key", "score"])

    return stats.select(key, "stats").mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep(docs: DataFrame, model: Model, text: str, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``; the texts are not shuffled."""
    at = docs.columns.index(text)

    def run(batches):
        for part in slices(batches, at):
            yield part.filter(pa.array(model.score(statistics(*utf8(part.column(at)))) >= least))

    return docs.mapInArrow(run, docs.schema)
