"""Fill-in-middle: texts cut into prefix, middle and suffix at unit bounds, put together in another order, and restored.

A unit is a word with the white space before it, or white space that ends the text. One numpy kernel cuts all texts of a
slice together, on the bytes of the Arrow buffer: a table of byte classes, a mask where a byte of white space follows
another byte, cumulative counts that start anew with each document, and two binary searches for all cuts. White space and
marks are ASCII, so bytes decide as code points would.

Draws come from SHA-256 of ``seed:id``, so a row's form does not depend on its task. Texts without a mark have exactly
one of each in the output, so form and output give back the text.

Defined results: a null text is empty; a null id draws as the empty id; rows that repeat an id draw alike; texts that
are empty or hold a mark stay as they are (plain); a text of any length is one slice of its own, of which a worker holds
some ten bytes for each of its own; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from undula.llm._arrow import slices, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = ("plain", "psm", "spm")
_MARKS = np.frombuffer(PREFIX + SUFFIX + MIDDLE, np.uint8)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_NAME = np.zeros(256, bool)
_NAME[list(b"PSM")] = True
#: Pieces longer than this are copied by themselves, shorter ones together.
_LONG = 1 << 16


def _before(mask: np.ndarray) -> np.ndarray:
    """How many bytes of a mask are set before each place, and in all."""
    out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 2**31 else np.int64)
    np.cumsum(mask, out=out[1:], dtype=out.dtype)
    return out


def cut(raw: np.ndarray, off: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, where the middle begins, where it ends) of each text; ``first`` and ``second`` are draws."""
    white = _WHITE[raw]
    begins = np.zeros(len(raw), bool)
    begins[1:] = white[1:] & ~white[:-1]
    begins[off[:-1][off[:-1] < len(raw)]] = True
    count = _before(begins)
    base = count[off[:-1]]
    n = (count[off[1:]] - base).astype(np.int64)
    a, b = first % (n + 1), second % (n + 1)
    place = lambda k: np.where(k == n, off[1:], np.searchsorted(count[1:], base + k + 1))
    return n, place(np.minimum(a, b)), place(np.maximum(a, b))


def marks(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the marks that lie within one text, and the texts they lie in."""
    at = np.flatnonzero((raw[:-2] == ord("<")) & _NAME[raw[1:-1]] & (raw[2:] == ord(">"))) if len(raw) > 2 else np.zeros(0, np.int64)
    of = np.searchsorted(off, at, "right") - 1
    inside = at + 3 <= off[of + 1]
    return at[inside], of[inside]


def gather(source: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces of ``source``, one behind the other."""
    end = np.cumsum(length)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    short = length <= _LONG
    for k in np.flatnonzero(~short):
        out[end[k] - length[k] : end[k]] = source[start[k] : start[k] + length[k]]
    own, size = start[short], length[short]
    total = int(size.sum())
    if total:
        within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(end[short] - size, size) + within] = source[np.repeat(own, size) + within]
    return out


def _texts(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    off = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data)])


def arrange(raw: np.ndarray, off: np.ndarray, h: np.ndarray, rate: int, spm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(units, form, prefix and middle in code points, outputs) of all texts; ``h`` holds four draws a text."""
    n, a, b = cut(raw, off, h[0], h[1])
    start, end = off[:-1], off[1:]
    marked = np.zeros(len(n), bool)
    marked[marks(raw, off)[1]] = True
    form = np.where((n == 0) | marked | (h[2] % 100 >= rate), 0, np.where(h[3] % 100 < spm, 2, 1))
    leads = _before((raw & 0xC0) != 0x80)
    prefix, middle = (leads[a] - leads[start]).astype(np.int64), (leads[b] - leads[a]).astype(np.int64)
    # six pieces a text: mark, text, mark, text, mark, text; a plain one has empty marks and its whole text in one piece
    own, p, s, m = len(raw), np.stack((start, a - start)), np.stack((b, end - b)), np.stack((a, b - a))
    mark = lambda k: np.stack((np.full(len(n), own + 3 * k), np.full(len(n), 3)))
    psm, swapped = (mark(0), p, mark(1), s, mark(2), m), (mark(1), s, mark(0), p, mark(2), m)
    nothing, text = np.zeros((2, len(n)), np.int64), np.stack((start, end - start))
    plain = (nothing, text, nothing, nothing, nothing, nothing)
    pieces = np.stack([np.where(form == 0, x, np.where(form == 1, y, z)) for x, y, z in zip(plain, psm, swapped)], axis=2)  # (start, length) x texts x 6
    data = gather(np.concatenate((raw, _MARKS)), pieces[0].ravel(), pieces[1].ravel())
    return n, form, prefix, middle, _texts(data, pieces[1].sum(1))


def rebuild(raw: np.ndarray, off: np.ndarray, form: np.ndarray) -> pa.Array:
    """The texts that ``arrange`` was given, from its outputs and forms (0 plain, 1 psm, 2 spm)."""
    at, of = marks(raw, off)
    at = at[form[of] > 0]
    moved = np.flatnonzero(form > 0)
    if len(at) != 3 * len(moved):
        raise ValueError("an output doesn't hold each mark once")
    one, two, three = at.reshape(-1, 3).T
    start, length = (np.zeros((len(form), 3), np.int64) for _ in range(2))
    start[:, 0], length[:, 0] = off[:-1], off[1:] - off[:-1]
    x, y, z = ((s + 3, e - s - 3) for s, e in ((one, two), (two, three), (three, off[1:][moved])))
    spm = form[moved] == 2
    for k, (mine, other) in enumerate(((x, y), (z, z), (y, x))):  # prefix, middle, suffix
        start[moved, k], length[moved, k] = np.where(spm, other[0], mine[0]), np.where(spm, other[1], mine[1])
    return _texts(gather(raw, start.ravel(), length.ravel()), length.sum(1))


def transform(df: DataFrame, key: str, text: str, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row.

    ``rate`` of 100 rows are to be moved, ``spm`` of 100 of those with the suffix first; lengths are null if plain.
    """
    kind = df.schema[key].dataType
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("__d", 8 * k + 1, 8), 16, 10).cast("long").alias(f"__h{k}") for k in range(4)]
    rows = df.select(F.col(key).alias("__k"), F.col(text).alias("__t"), digest.alias("__d")).select("__k", "__t", *draws)

    def run(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches, 1):
            raw, off = utf8(part.column(1))
            h = np.stack([part.column(k).to_numpy() for k in range(2, 6)])
            n, form, prefix, middle, out = arrange(raw, off, h, rate, spm)
            plain = form == 0
            yield pa.record_batch(
                [part.column(0).cast(to_arrow_type(kind)), pa.array(n), pa.array(np.array(FORMS)[form]), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), out],
                ["__k", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return rows.mapInArrow(run, f"__k {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("__k", key)


def restore(df: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """The rows of ``transform`` with the texts it was given, as ``name``, in place of ``output``."""
    others = [f for f in df.schema.fields if f.name != output]
    place = [f.name for f in others].index(form) + 1
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{name}` string"])

    def run(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches, 0):
            raw, off = utf8(part.column(0))
            forms = np.array([FORMS.index(f) for f in part.column(place).to_pylist()])
            columns = [part.column(k + 1).cast(to_arrow_type(f.dataType)) for k, f in enumerate(others)]
            yield pa.record_batch([*columns, rebuild(raw, off, forms)], [*(f.name for f in others), name])

    return df.select(output, *(f.name for f in others)).mapInArrow(run, schema)
