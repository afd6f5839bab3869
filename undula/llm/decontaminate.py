"""Benchmark decontamination by the q-gram lemma: filter on diagonal bands, verify by banded alignment.

Texts and items are compared as lower-case (A-Z) bytes in which every run of ASCII signs and white space is one
blank. An item of m bytes may have k edits: ``RATE`` of m, but no more than leave one q-gram whole, (m - q) // q. With
k edits at least ``m - q + 1 - k * q`` of its q-grams are kept, all on diagonals less than k + 2 apart: hits are counted
in overlapping bands of 2 (k + 1) diagonals, bands that reach the bound are aligned as a whole, and an item is found
where its alignment has at most k edits. This holds for items of any length; the alignment of a long one takes time
m * k. Items shorter than a q-gram have no edits and must stand between word bounds.

Items go to the workers in blocks of ``BLOCK_BYTES`` (a longer item is a block of its own), broadcast as texts; each
worker makes their index itself. A benchmark of one block is one pass over the documents, a larger one a pass for
each block.

Defined results: a null text or item, and an item without a letter or digit, has no match; repeated rows and equal
items match each on their own; several places of an item in a text give one match, the one with the fewest edits, then
the first; a text is looked at in lots, so a worker holds a few times its bytes; an empty table gives no match; only
the named columns are read by ``matches``, so others cannot clash, and ``keep`` returns all as they are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm._arrow import kept, slices, utf8
from undula.llm._store import stash

Q = 8
RATE = 0.1
#: Bytes of benchmark texts that go to the workers at a time; an index takes about 40 times as much.
BLOCK_BYTES = 2 << 20
SLICE_BYTES = 1 << 20
#: Places of a text that are looked up at a time, and hits that are listed at a time.
LOT = 1 << 18
HITS = 1 << 20
#: Cells of alignments that are advanced together.
CELLS = 1 << 16
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = [ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)]


def normalise(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes of all texts, offsets, whether each byte of ``raw`` is kept)."""
    c = _PLAIN[raw]
    blank = c == 32
    keep = ~blank
    keep[:-1] |= ~blank[1:] & blank[:-1]  # of a run of blanks the last stays
    if len(raw):
        ends = off[1:][off[:-1] < off[1:]] - 1
        keep[ends] = ~blank[ends]
    first = np.zeros(len(off), np.int64)
    np.cumsum([np.count_nonzero(keep[a:b]) for a, b in zip(off[:-1], off[1:])], out=first[1:])
    return c[keep], first, keep


def codes(chars: np.ndarray) -> np.ndarray:
    """The q-gram at each byte as a 64-bit number."""
    if len(chars) < Q:
        return np.empty(0, np.uint64)
    return np.ndarray((len(chars) - Q + 1,), "<u8", np.ascontiguousarray(chars), strides=(1,)).copy()


@dataclass
class Index:
    """The items of a block and where each q-gram occurs in them."""

    chars: np.ndarray  # normalised bytes of all items
    start: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    bound: np.ndarray  # q-grams that an item keeps with its edits
    grams: np.ndarray  # sorted distinct codes
    first: np.ndarray  # offsets into item and place
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray  # bool by hash of the code
    shift: int
    short: dict[int, dict[int, list[int]]] = field(default_factory=dict)  # size -> bytes as a number -> items

    @property
    def reach(self) -> int:
        """Places beyond which no two hits share a band."""
        return int((self.size + 4 * self.edits).max(initial=0)) + 8


def build(texts: list[str | None]) -> Index:
    found = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        c = normalise(raw, np.array([0, len(raw)]))[0]
        found.append(c[1:] if len(c) and c[0] == 32 else c)
    size = np.array([len(c) for c in found], np.int64)
    start = np.cumsum(size) - size
    edits = np.maximum(np.minimum((size * RATE).astype(int), (size - Q) // Q), 0)
    grams = [codes(c) for c in found]
    code = np.concatenate(grams) if grams else np.empty(0, np.uint64)
    item = np.repeat(np.arange(len(found), dtype=np.int32), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.empty(0, np.int32)
    order = np.argsort(code, kind="stable")
    distinct, first = np.unique(code[order], return_index=True)
    shift = 64 - max(16, int(len(distinct)).bit_length() + 3)
    seen = np.zeros(1 << (64 - shift), bool)
    seen[_slot(distinct, shift)] = True
    short: dict[int, dict[int, list[int]]] = {}
    for i, c in enumerate(found):
        if 0 < len(c) < Q:
            short.setdefault(len(c), {}).setdefault(int.from_bytes(c.tobytes(), "little"), []).append(i)
    chars = np.concatenate(found) if found else np.empty(0, np.uint8)
    return Index(chars, start, size, edits, size - Q + 1 - edits * Q, distinct, np.append(first, len(code)), item[order], place[order], seen, shift, short)


def _slot(code: np.ndarray, shift: int) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).astype(np.int64)


def bands(index: Index, chars: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, first diagonal) of the bands with enough hits, of texts that begin at ``start``, with a byte 0 in between.

    Diagonals of different texts are kept ``reach`` apart. A band's count is decided once no later hit can fall in it.
    """
    gap = index.reach
    open_, count = np.empty(0, np.int64), np.empty(0, np.int64)
    done = []

    def close(before: int | None) -> None:
        nonlocal open_, count
        item, band = open_ >> 40, open_ & (1 << 40) - 1
        step = index.edits[item] + 1
        over = np.ones(len(open_), bool) if before is None else (band + 2) * step - gap + index.size[item] <= before
        good = over & (count >= index.bound[item])
        done.append((item[good], (band * step - gap)[good]))
        open_, count = open_[~over], count[~over]

    for a in range(0, max(len(chars) - Q + 1, 0), LOT):
        code = codes(chars[a : a + LOT + Q - 1])
        at = np.flatnonzero(index.seen[_slot(code, index.shift)])
        g = np.minimum(np.searchsorted(index.grams, code[at]), len(index.grams) - 1)
        real = index.grams[g] == code[at]
        at, g = at[real] + a, g[real]
        if not len(at):
            continue
        at += (np.searchsorted(start, at, "right") - 1) * gap
        n = index.first[g + 1] - index.first[g]
        total = np.cumsum(n)
        b = 0
        while b < len(at):
            e = max(b + 1, int(np.searchsorted(total, total[b] - n[b] + HITS, "right")))
            m = n[b:e]
            hit = np.repeat(index.first[g[b:e]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            item = index.item[hit].astype(np.int64)
            band = (np.repeat(at[b:e], m) - index.place[hit] + gap) // (index.edits[item] + 1)
            key = item << 40 | band
            key, more = np.unique(np.concatenate((key, key - 1)), return_counts=True)  # every hit is in two bands
            if len(open_):
                key, where = np.unique(np.concatenate((open_, key)), return_inverse=True)
                more = np.bincount(where, np.concatenate((count, more)), len(key)).astype(np.int64)
            open_, count = key, more
            close(int(at[e - 1]))
            b = e
    close(None)
    item, low = (np.concatenate(x) for x in zip(*done))
    begin = start + np.arange(len(start)) * gap
    text = np.searchsorted(begin, low + 2 * (index.edits[item] + 1) + index.size[item] - 2, "right") - 1
    return text, item, low - text * gap


def align(index: Index, chars: np.ndarray, item: np.ndarray, diagonal: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end in ``chars``) of the best alignment of each item between ``lo`` and ``hi`` whose diagonals begin at ``diagonal``.

    Edits over an item's budget come back as more than the budget, whatever they are.
    """
    k, size = index.edits[item], index.size[item]
    width, longest = int(4 * k.max() + 3), int(size.max())
    low = diagonal - k
    at = low[:, None] + np.arange(width + longest)
    text = np.where((at >= lo[:, None]) & (at < hi[:, None]), chars[np.clip(at, 0, len(chars) - 1)], 0)
    at = index.start[item][:, None] + np.arange(longest)
    own = np.where(np.arange(longest) < size[:, None], index.chars[np.minimum(at, len(index.chars) - 1)], 255)
    del at
    x = np.arange(width)
    one = np.int64(1) << 32
    none = one << 28
    valid = x < (4 * k + 3)[:, None]
    cost = np.where(valid, x, none).astype(np.int64)  # edits << 32 | start; a start is free
    best, where = np.full(len(item), none), np.zeros(len(item), np.int64)
    lane = np.arange(len(item))
    for i in range(longest):
        step = cost + one * (text[:, i : i + width] != own[:, i : i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + one)
        cost = np.minimum.accumulate(step - one * x, axis=1) + one * x
        cost[~valid] = none
        last = size[lane] == i + 1
        if last.any():
            rows = cost[last]
            best[lane[last]], where[lane[last]] = rows.min(1), rows.argmin(1)
        if i % 64 == 63 or last.any():  # those that are done, or have too many edits already
            live = ~last & (cost.min(1) >> 32 <= k[lane])
            if not live.any():
                break
            if live.sum() < 0.7 * len(live):
                cost, text, own, valid, lane = cost[live], text[live], own[live], valid[live], lane[live]
    return best >> 32, low + (best & one - 1), low + size + where


def search(index: Index, raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start byte, end byte) of each item found in each text."""
    c, first, keep = normalise(raw, off)
    n = len(off) - 1
    size = np.diff(first)
    start = first[:-1] + np.arange(n)
    chars = np.zeros(len(c) + n + Q, np.uint8)
    for t in range(n):
        chars[start[t] : start[t] + size[t]] = c[first[t] : first[t + 1]]
    del c
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    text, item, diagonal = bands(index, chars, start)
    order = np.argsort(index.size[item], kind="stable")
    a = 0
    while a < len(order):
        most = max(1, CELLS // int(4 * index.edits[item[order[a]]] + 3))
        some = order[a : a + most]
        a += len(some)
        t, p = text[some], item[some]
        edits, begin, end = align(index, chars, p, diagonal[some], start[t], start[t] + size[t])
        for i in np.flatnonzero(edits <= index.edits[p]):
            lo, hi = int(start[t[i]]), int(start[t[i]] + size[t[i]])
            span = int(edits[i]), max(int(begin[i]), lo) - lo, min(int(end[i]), hi) - lo
            key = int(t[i]), int(p[i])
            found[key] = min(found.get(key, span), span)
    for key, span in _short(index, chars, start):
        found[key] = min(found.get(key, span), span)
    out = []
    for (t, p), (edits, lo, hi) in sorted(found.items()):
        out.append((t, p, edits, _origin(keep, off, t, lo), _origin(keep, off, t, hi - 1) + 1))
    return out


def _origin(keep: np.ndarray, off: np.ndarray, text: int, place: int) -> int:
    """The byte of a text that became its normalised byte ``place``."""
    a, end = int(off[text]), int(off[text + 1])
    at = a
    while True:
        n = int(np.count_nonzero(keep[at : min(at + LOT, end)]))
        if place < n:
            return at - a + int(np.flatnonzero(keep[at : min(at + LOT, end)])[place])
        place -= n
        at += LOT


def _short(index: Index, chars: np.ndarray, start: np.ndarray):
    """((text, item), (0, start, end)) of the items shorter than a q-gram, between word bounds."""
    for a in range(0, len(chars) - Q, LOT) if index.short else ():
        own = chars[max(a - 1, 0) : a + LOT + Q]
        edge = (own == 32) | (own == 0)
        low = 1 if a else 0
        code = codes(own)
        begin = ~edge
        begin[1:] &= edge[:-1]
        if a:
            begin[0] = False
        at = np.flatnonzero(begin[: min(low + LOT, len(code))])
        for m, items in index.short.items():
            ends = at[edge[at + m]]
            head = code[ends] & np.uint64((1 << 8 * m) - 1)
            for i in np.flatnonzero(np.isin(head, np.array(list(items), np.uint64))):
                place = int(ends[i]) + a - low
                text = int(np.searchsorted(start, place, "right")) - 1
                for p in items[int(head[i])]:
                    yield (text, p), (0, place - int(start[text]), place - int(start[text]) + m)


def blocks(benchmark: DataFrame, key: str, text: str) -> list[tuple[str, Broadcast]]:
    """(name, broadcast of item ids and texts) of parts of about ``BLOCK_BYTES``, whatever the table's size."""
    sized = benchmark.select(key, text).filter(F.col(text).isNotNull())
    total = sized.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    count = -(-total // BLOCK_BYTES)
    sc, out = benchmark.sparkSession.sparkContext, []
    for b in range(count):
        part = sized if count == 1 else sized.filter(F.pmod(F.xxhash64(key, text), F.lit(count)) == b)
        rows = part.orderBy(key, text).collect()
        if rows:
            out.append((uuid.uuid4().hex, sc.broadcast(([r[0] for r in rows], [r[1] for r in rows]))))
    return out


def _index(name: str, block: Broadcast) -> Index:
    """This worker's index of a block; the last one is kept."""
    return kept("decontaminate", name, lambda: build(block.value[1]))


def matches(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """(key, item, edits, start, end: bytes of the text) of every item found in every row of ``docs``."""
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"key {kinds[0]}, item {kinds[1]}, edits int, start long, end long"
    out = None
    for name, block in blocks(benchmark, item, item_text):

        def run(batches, name=name, block=block):
            for part in slices(batches, 1, SLICE_BYTES, "decontaminate"):
                got = search(_index(name, block), *utf8(part.column(1)))
                if got:
                    rows, items, edits, start, end = map(list, zip(*got))
                    yield pa.record_batch([part.column(0).take(pa.array(rows)), pa.array([block.value[0][i] for i in items]), pa.array(edits, pa.int32()), pa.array(start), pa.array(end)], ["key", "item", "edits", "start", "end"])

        one = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"key": key, "item": item})


def keep(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found; between two blocks they are written."""
    at, first = docs.columns.index(text), True
    for name, block in blocks(benchmark, item, item_text):

        def run(batches, name=name, block=block):
            for part in slices(batches, at, SLICE_BYTES, "decontaminate"):
                clean = np.ones(part.num_rows, bool)
                clean[[m[0] for m in search(_index(name, block), *utf8(part.column(at)))]] = False
                yield part.filter(pa.array(clean))

        docs = (docs if first else stash(docs, "clean")).mapInArrow(run, docs.schema)
        first = False
    return docs
