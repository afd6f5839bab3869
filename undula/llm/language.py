"""Language: a byte convolutional network, multi-width filters, max pooling and softmax, trained in numpy.

A text is cut into windows of ``WINDOW`` bytes, the last one padded; each window's bytes are embedded, filters of
several widths slide over them, the largest response of each filter, rectified, feeds a softmax over the learnt
languages. A text's scores are the softmax of the mean log-probabilities of all its windows.

Only rows with text and a non-null language that ``learn`` names are learnt from: a sample of at most
``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` of text, those with the least hash of their id, of each all windows.

Defined results: a text that is null or has no letter is ``und`` with score 0; without rows to learn from every text
is; with one language learnt, every other text has it with score 1; equal scores go to the language first by name;
the id is carried along and never an input; all windows of a text of any length are judged, a block at a time; rows
that repeat an id are rows of their own, equal ones are learnt from once; an empty table gives an empty table; only
the named columns are read, so others cannot clash, and ``keep`` returns all as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm._arrow import slices, utf8
from undula.llm._sample import drawn

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
SAMPLE_ROWS = 1200
#: Bytes of text that are learnt from, at most (one row at least).
SAMPLE_BYTES = 16 << 20
EPOCHS = 4
BATCH = 64
RATE = 3e-3
#: Windows that go through the network at a time.
BLOCK = 512
UNKNOWN = "und"
SLICE_BYTES = 2 << 20


@dataclass
class Model:
    names: list[str]
    params: dict[str, np.ndarray]


def windows(raw: np.ndarray, off: np.ndarray, lot: int = 1 << 62) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, WINDOW) bytes of all texts, zero-padded, and the text of each, ``lot`` windows at a time; an empty text has none."""
    n = -(-np.diff(off) // WINDOW)
    upto = np.cumsum(n)
    total = int(upto[-1]) if len(upto) else 0
    for a in range(0, max(total, 1), lot):
        w = np.arange(a, min(a + lot, total))
        text = np.searchsorted(upto, w, "right")
        start = off[text] + (w - (upto - n)[text]) * WINDOW
        size = np.minimum(WINDOW, off[text + 1] - start)
        at = start[:, None] + np.arange(WINDOW)
        out = raw[np.minimum(at, len(raw) - 1)] if len(raw) else np.empty((0, WINDOW), np.uint8)
        short = np.flatnonzero(size < WINDOW)
        out[short] *= np.arange(WINDOW) < size[short, None]
        yield out, text


def start_params(classes: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(3)
    p = {"embed": rng.normal(0, 0.5, (256, EMBED))}
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, np.sqrt(2 / (w * EMBED)), (w * EMBED, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes))
    p["bias"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in p.items()}


def forward(p: dict[str, np.ndarray], x: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Log-probabilities (windows, classes) of windows of bytes."""
    e = p["embed"][x]
    pooled = []
    for w in WIDTHS:
        n = WINDOW - w + 1
        cols = np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)
        a = (cols.reshape(-1, w * EMBED) @ p[f"w{w}"]).reshape(len(x), n, FILTERS)
        if keep is not None:
            keep[w] = cols, a.argmax(1)
        pooled.append(np.maximum(a.max(1) + p[f"b{w}"], 0))
    h = np.concatenate(pooled, axis=1)
    z = h @ p["out"] + p["bias"]
    z -= z.max(1, keepdims=True)
    if keep is not None:
        keep["h"] = h
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Gradients of the mean cross-entropy, and it."""
    keep: dict = {}
    logp = forward(p, x, keep)
    rows, h = np.arange(len(x)), keep["h"]
    d = np.exp(logp)
    d[rows, y] -= 1
    d /= len(x)
    g = {"out": h.T @ d, "bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
    dh = (d @ p["out"].T) * (h > 0)
    for i, w in enumerate(WIDTHS):
        cols, best = keep[w]
        own = dh[:, i * FILTERS : (i + 1) * FILTERS]
        at = cols[rows[:, None], best]  # (rows, filters, w * EMBED)
        g[f"w{w}"] = np.einsum("rfk,rf->kf", at, own)
        g[f"b{w}"] = own.sum(0)
        back = own[:, :, None] * p[f"w{w}"].T[None]
        for j in range(w):
            np.add.at(g["embed"], x[rows[:, None], best + j], back[:, :, j * EMBED : (j + 1) * EMBED])
    return g, float(-logp[rows, y].mean())


def fit(texts: list[bytes], names: list[str]) -> Model:
    """Adam over the sample's windows, shuffled."""
    known = sorted(set(names))
    if len(known) < 2:
        return Model(known, {})
    x, of = next(windows(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))))
    rng = np.random.default_rng(1)
    y = np.array([known.index(n) for n in names])[of]
    p = start_params(len(known))
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(a) for k, a in p.items()}
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            some = order[a : a + BATCH]
            g, _ = gradient(p, x[some], y[some])
            t += 1
            rate = RATE * (1 - t / (1 + EPOCHS * (len(x) // BATCH + 1)))
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(known, p)


def predict(model: Model, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, its probability) of each text."""
    n = len(off) - 1
    if len(model.names) < 2:
        return np.zeros(n, int), np.ones(n)
    total = np.zeros((n, len(model.names)))
    for x, of in windows(raw, off, BLOCK):
        logp = forward(model.params, x)
        for c in range(total.shape[1]):
            total[:, c] += np.bincount(of, logp[:, c], n)
    total /= np.maximum(-(-np.diff(off) // WINDOW), 1)[:, None]
    p = np.exp(total - total.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return p.argmax(1), p.max(1)


def judge(model: Model, column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(language, score) of each text."""
    best, score = predict(model, *utf8(column))
    letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not model.names:
        letters[:] = False
    names = np.array([*model.names, UNKNOWN], dtype=object)
    return pa.array(names[np.where(letters, best, len(model.names))].tolist(), pa.string()), pa.array(np.where(letters, score, 0.0))


def sample(docs: DataFrame, key: str, text: str, lang: str, learn: Column, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> tuple[list[bytes], list[str]]:
    """Texts and languages of at most ``rows`` rows to learn from, those whose ids have the least hash."""
    known = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    got = drawn(known.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("label")), rows, most)
    return [t.encode() for t, _ in got], [x for _, x in got]


def identify(docs: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(key, lang_pred, score) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part in slices(batches, 1, SLICE_BYTES):
            yield pa.record_batch([part.column(0), *judge(model, part.column(1))], ["key", "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def keep(docs: DataFrame, model: Model, text: str, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, that have a language whose score lies at least ``least`` of the way from chance, 1 / languages, to 1."""
    at, chance = docs.columns.index(text), 1 / max(len(model.names), 1)
    least = chance + least * (1 - chance)

    def run(batches):
        for part in slices(batches, at, SLICE_BYTES):
            name, score = judge(model, part.column(at))
            yield part.filter(pc.and_(pc.not_equal(name, UNKNOWN), pc.greater_equal(score, least)))

    return docs.mapInArrow(run, docs.schema)
