"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios (NB-SVM with log loss).

A text's features are the hashed n-grams of its lower-case characters, between two blanks and with blanks for ASCII
signs, that it holds at least once, each worth ``r = log((p / |p|) / (q / |q|))``, the ratio of its smoothed document counts in the two classes.
The weights of the features with the largest ``|r| * sqrt(count)`` are fitted by logistic regression. Only labelled
rows are learnt from: a sample of at most ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` of text, those with the least hash
of their id, so the fit is of one size whatever the table's.

Defined results: every text has a score, an empty or null one that of no features; repeated n-grams count once; if
the labels hold fewer than two classes, every score is their share of 1, 0.5 without labels; of several labels of an
id the largest holds; rows that repeat an id are rows of their own, equal ones are learnt from once; a text of any
length is read in overlapping parts; the id is carried along and never an input; an empty table gives an empty table;
only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm._arrow import slices
from undula.llm._sample import drawn

SIZES = (5, 7, 9)
BITS = 20
#: Labelled rows that are learnt from, at most.
SAMPLE_ROWS = 6000
FEATURES = 20_000
LEAST_DOCS = 4
SMOOTHING = 1.0
RIDGE = 0.001
#: Steps of the fit at most, the share of the first gradient that ends it, and steps that it remembers.
STEPS = 60
TOLERANCE = 1e-3
MEMORY = 8
#: A toxic row counts as so many rows in the loss.
TOXIC_WEIGHT = 4.0
SLICE_BYTES = 2 << 20
#: Bytes of text that are learnt from, at most (one row at least).
SAMPLE_BYTES = 32 << 20
#: Characters whose n-grams are held at a time.
PART = 1 << 19
#: Texts whose n-grams are held at a time while fitting.
FIT_ROWS = 200
_MUL = (np.random.default_rng(5).integers(1, 2**62, 16, dtype=np.uint64) * np.uint64(2)) + np.uint64(1)
#: ASCII characters as features see them: anything but a letter or digit is a blank.
_PLAIN = np.array([i if chr(i).isalnum() else 32 for i in range(128)], np.uint64)


@dataclass
class Model:
    weight: np.ndarray  # float32, one for each bucket; 0 for those that are no features
    bias: float


def grams(parts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n-gram size the bucket at every character, and the offsets; buckets of n-grams that leave a part are 0."""
    off = np.concatenate(([0], np.cumsum([len(t) for t in parts])))
    c = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    c[:] = np.where(c < 128, _PLAIN[np.minimum(c, 127).astype(np.intp)], c)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, max(SIZES) + 1):
        h[: max(0, len(c) - n + 1)] += c[n - 1 :] * _MUL[n]
        if n in SIZES:
            b = h ^ (h >> np.uint64(29))
            b *= _MUL[0]
            b = (b >> np.uint64(64 - BITS)).astype(np.int32)
            b[b == 0] = 1
            for k in range(1, n):  # the last n - 1 characters of each part
                at = off[1:] - k
                b[at[at >= off[:-1]]] = 0
            out.append(b)
    return out, off


def _distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values of ``x``, which is sorted in place: much faster here than by hashing."""
    x.sort()
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def _lots(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """(parts, the text of each) of the lower-case texts between blanks, about ``PART`` characters a lot.

    Parts of one text overlap by all but one character of the longest n-gram, so they hold all its n-grams.
    """
    parts, of, size = [], [], 0
    for i, t in enumerate(texts):
        low = f" {t.lower()} "
        for a in range(0, max(len(low) - max(SIZES) + 1, 1), PART):
            parts.append(low[a : a + PART + max(SIZES) - 1])
            of.append(i)
            size += len(parts[-1])
            if size >= PART:
                yield parts, of
                parts, of, size = [], [], 0
    if parts:
        yield parts, of


def present(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each distinct n-gram, of those ``wanted`` (bool for each bucket) if given, text by text."""
    found, last = [np.empty(0, np.int64)], np.empty(0, np.int64)
    for parts, of in _lots(texts):
        buckets, off = grams(parts)
        of = np.array(of, np.int64)
        pairs = []
        for b in buckets:
            at = np.flatnonzero(b if wanted is None else wanted[b])
            pairs.append(of[np.searchsorted(off, at, "right") - 1] << BITS | b[at])
        pairs = _distinct(np.concatenate((last, *pairs)))
        cut = np.searchsorted(pairs, of[-1] << BITS)  # the last text may go on in the next lot
        found.append(pairs[:cut])
        last = pairs[cut:]
    pairs = np.concatenate((*found, last))
    return pairs >> BITS, pairs & (1 << BITS) - 1


def fit(texts: list[str], labels: np.ndarray) -> Model:
    labels = np.asarray(labels, float)
    weight = np.zeros(1 << BITS, np.float32)
    if not len(labels) or labels.min() == labels.max():
        share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 0.5
        return Model(weight, float(np.log(share / (1 - share))))
    count = np.zeros((2, 1 << BITS))
    for a in range(0, len(texts), FIT_ROWS):
        doc, bucket = present(texts[a : a + FIT_ROWS])
        for y in (0, 1):
            count[y] += np.bincount(bucket[labels[a + doc] == y], minlength=1 << BITS)
    q, p = count + SMOOTHING
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    total = count.sum(0)
    worth = np.where(total >= LEAST_DOCS, np.abs(r) * np.sqrt(total), 0)
    worth[0] = 0
    chosen = np.sort(np.argsort(-worth, kind="stable")[:FEATURES])
    chosen = chosen[worth[chosen] > 0]
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen] = True
    place = np.zeros(1 << BITS, np.int64)
    place[chosen] = np.arange(len(chosen))
    docs, cols = [], []
    for a in range(0, len(texts), FIT_ROWS):
        doc, bucket = present(texts[a : a + FIT_ROWS], wanted)
        docs.append((doc + a).astype(np.int32)), cols.append(place[bucket])
    docs, cols = np.concatenate(docs), np.concatenate(cols)
    x = r[chosen].astype(np.float32)[cols]
    n, k = len(texts), len(chosen)
    rows, starts, sizes = np.unique(docs, return_index=True, return_counts=True)
    del docs

    def sums(w):
        """X w, text by text: a text's features are neighbours."""
        out = np.zeros(n)
        if len(rows):
            part = w[cols]
            part *= x
            out[rows] = np.add.reduceat(part, starts)
        return out

    def back(e):
        """X' e."""
        part = np.repeat(e[rows], sizes)
        part *= x
        return np.bincount(cols, part, k)

    each = np.where(labels > 0.5, TOXIC_WEIGHT, 1.0) / n

    def loss(w):
        """The weighted mean logistic loss with its ridge, and the gradient."""
        s = sums(w[:-1]) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(s, -50, 50))) - labels) * each
        value = float((each * (np.logaddexp(0, s) - labels * s)).sum() + RIDGE / 2 * w[:-1] @ w[:-1])
        return value, np.append(back(e) + RIDGE * w[:-1], e.sum())

    w = minimise(loss, np.append(np.zeros(k), np.log(labels.mean() / (1 - labels.mean()))))
    weight[chosen] = (w[:-1] * r[chosen]).astype(np.float32)
    return Model(weight, float(w[-1]))


def minimise(loss, w: np.ndarray) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving, until the gradient is a thousandth of the first or ``STEPS`` are done."""
    value, g = loss(w)
    first, past = np.linalg.norm(g), []
    for _ in range(STEPS):
        if np.linalg.norm(g) <= TOLERANCE * first:
            break
        d, share = -g, []
        for s, y in reversed(past):
            share.append((s @ d) / (s @ y))
            d = d - share[-1] * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(share)):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, step = g @ d, 1.0 if past else 1 / max(first, 1.0)
        while True:
            new, g_new = loss(w + step * d)
            if new <= value + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = step * d, g_new - g
        if s @ y > 1e-12 * (y @ y):
            past = [*past, (s, y)][-MEMORY:]
        w, value, g = w + s, new, g_new
    return w


def score(model: Model, texts: list[str]) -> np.ndarray:
    doc, bucket = present(texts, model.weight != 0)
    s = np.bincount(doc, model.weight[bucket], len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(s, -50, 50)))


def held_out(key: str, parts: int, part: int) -> Column:
    """Rows whose crc32(id as text) leaves the remainder ``part``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts == part


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``rows`` labelled rows that have a document, those whose ids have the least hash."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    known = known.join(docs.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
    ids = known.orderBy(F.xxhash64("key"), "key").limit(rows)
    got = drawn(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(ids), "key"), rows, most)
    return [t or "" for t, _ in got], np.array([x for _, x in got], float)


def scores(docs: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(key, score) of every row."""
    at = np.flatnonzero(model.weight)
    packed = (at, model.weight[at], model.bias)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        weight = np.zeros(1 << BITS, np.float32)
        weight[packed[0]] = packed[1]
        own = Model(weight, packed[2])
        for part in slices(batches, 1, SLICE_BYTES):
            yield pa.record_batch([part.column(0), pa.array(score(own, [t or "" for t in part.column(1).to_pylist()]))], ["key", "score"])

    return docs.select(key, text).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
