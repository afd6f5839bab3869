"""Arrow batches in bounded slices, shared by the operators that run in Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that a worker handles at a time; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Rows of a slice, at most: short texts cost by the row.
SLICE_ROWS = 20_000

#: What a worker keeps from one task to the next: by operator, a key and a value.
_KEPT: dict[str, tuple[Hashable, object]] = {}


def kept(operator: str, key: Hashable, make: Callable[[], object]) -> object:
    """This worker's value of an operator; another key drops the one before."""
    if operator not in _KEPT or _KEPT[operator][0] != key:
        _KEPT.pop(operator, None)
        _KEPT[operator] = key, make()
    return _KEPT[operator][1]


def release(operator: str | None = None) -> None:
    """Drop what other operators keep: workers are used again, and one may go on with another operator's tasks."""
    others = [k for k in _KEPT if k != operator]
    for k in others:
        del _KEPT[k]
    if others:
        trim()


def trim() -> None:
    """Give memory that is free back to the system: workers stay, while other stages need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its offsets (rows + 1); a null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), off - off[:1] if len(off) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
    return raw, off - off[0]


def slices(batches: Iterable[pa.RecordBatch], text: int = 1, most: int = SLICE_BYTES, operator: str | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in order, in slices whose column at ``text`` holds at most ``most`` bytes, or of one row.

    Small batches are put together, large ones are cut. What operators but ``operator`` keep in this worker is dropped.
    """
    release(operator)
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        off = offsets(batch.column(text))
        start = 0
        while start < batch.num_rows:
            room = max(most - size, 0)
            end = min(int(np.searchsorted(off, off[start] + room, "right")) - 1, start + SLICE_ROWS - rows)
            if end <= start:
                if held:
                    yield _whole(held)
                    held, size, rows = [], 0, 0
                    continue
                end = start + 1
            held.append(batch.slice(start, end - start))
            size += int(off[end] - off[start])
            rows += end - start
            start = end
            if size >= most or rows >= SLICE_ROWS:
                yield _whole(held)
                held, size, rows = [], 0, 0
    if held:
        yield _whole(held)
    held.clear()
    trim()


def _whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def offsets(column: pa.Array) -> np.ndarray:
    """Where each text of a text or binary column begins, and where the last ends; its bytes are not copied."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()[1]
    return np.frombuffer(raw, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def binary(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())
