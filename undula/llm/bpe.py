"""Byte-level BPE by DuckDB recursive queries in each Python worker.

A slice of texts is cut where white space begins, which no piece of the pre-tokenizer's pattern crosses. Distinct
segments are cut into pieces by the pattern, and every piece that is not kept yet is encoded: its bytes are
token-position rows that join the merge table; the recursive query contracts each piece's leftmost pair of minimum
rank until none is left. A document's ids are those of its segments, in order, gathered by offset. Each document's ids
are then decoded by an aggregation ordered by position over the ids joined with the vocabulary.

A piece of more than ``SHORT_BYTES`` is encoded as overlapping windows, which are stitched where two windows hold
the same token at the same place. That is exact: let T be tokens of which every two neighbours come out unchanged when
encoded on their own. The first merge across a border of T would, as all merges before it stay within the two tokens
beside it and are taken in the same order, also happen when these two are encoded alone, which it doesn't. So T is
the encoding. Neighbours in a window's encoding have that property, and stitched neighbours come from one window.
Windows without a common token are joined to one, and encoded again.

Defined results: a null or empty text has no ids and decodes to no bytes; special tokens' strings are ordinary text;
a piece that is itself a token is that token, as in the tiktoken library; malformed UTF-8 counts as U+FFFD; repeated
rows give repeated rows; a text of any length is encoded and decoded in blocks, so a worker holds a few times the
text, its ids and its bytes; an empty table gives an empty table; only the two named columns are read, so other
columns cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm._arrow import kept, slices, trim, utf8

#: A worker keeps segments, pieces and their ids from one slice to the next, up to so many times the bytes of a slice; then all are dropped.
CACHE_SLICES = 16
#: Longer pieces are encoded as windows of twice ``STRIDE`` that start ``STRIDE`` bytes apart.
SHORT_BYTES = 96
STRIDE = 32
#: Segments that are cut, and pieces encoded by one recursive query, at a time.
QUERY_PIECES = 20_000
#: The recursive query keeps the ids of every round: at most so many squared bytes of pieces in one query.
QUERY_SQUARES = 4_000_000
#: Longer windows take the query that contracts many pairs a round.
LONG_BYTES = 2_048
#: Rows that the query for long windows accumulates before it starts again.
LONG_ROWS = 8_000_000
#: Texts' bytes handled at a time, and ids decoded by one query. Larger slices meet fewer new words, smaller ones take less memory.
SLICE_BYTES = 6 << 20
DECODE_IDS = 1 << 17
#: White space as Unicode defines it (fixed values).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

ENCODE = """
with recursive t(w, ids) as (
    select w, ids from seed
    union all
    select t.w, t.ids[: b.p - 1] || [b.k] || t.ids[b.p + 2 :]
    from t join (
        select w, (min(code) >> 20)::int as k, (min(code) & 1048575)::int as p
        from (
            select x.w, (m.k::bigint << 20) | x.p as code
            from (select w, p, (ids[p]::bigint << 20) | ids[p + 1] as pair
                  from (select w, ids, unnest(range(1, len(ids))) as p from t)) x
            join merges m using (pair))
        group by w) b using (w)
)
select w, arg_min(ids, len(ids)) as ids from t group by w
"""

#: As above, as one row for each token; where no pair made from the new token ranks before it, all its places that
#: do not overlap, from the left, are contracted in a round, which gives the same as one after the other.
ENCODE_LONG = """
with recursive t(it, w, p, id) as (
    select 0, w, p, id from seed_long
    union all
    select it + 1, w, p, case when hit then (best >> 32)::int else id end
    from (
        select *, coalesce(lag(hit) over (partition by w order by p), false) as gone
        from (
            select *, case when not coalesce(k = (best >> 32), false) then false
                           when safe then (row_number() over (partition by w, k = (best >> 32), n - i order by p)) % 2 = 1
                           else p = (best & 4294967295) end as hit
            from (
                select *, row_number() over (partition by w, k = (best >> 32) order by p) as i
                from (
                    select a.*, m.k, m.safe, min((m.k::bigint << 32) | a.p) over (partition by a.w) as best
                    from (select it, w, p, id, row_number() over (partition by w order by p) as n,
                                 (id::bigint << 20) | lead(id) over (partition by w order by p) as pair from t) a
                    left join merges m using (pair))))
        where best is not null)
    where not gone and it < $rounds
)
select t.w, t.p, t.id from t join (select w, max(it) as it from t group by w) using (w, it) order by t.w, t.p
"""

DECODE = """
select x.w, unhex(string_agg(v.hex, '' order by x.p)) as raw from ids x join vocabulary v using (id) group by x.w order by x.w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Kept:
    """Byte strings and their ids, as arrays: a few times smaller than a dictionary of Python objects."""

    def __init__(self):
        self.keys = pa.array([], pa.large_binary())
        self.flat, self.start, self.bytes = np.empty(0, np.int32), np.zeros(1, np.int64), 0

    def find(self, keys: pa.LargeBinaryArray) -> np.ndarray:
        """The row of each key, -1 for those that are not here."""
        return pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, keys: pa.LargeBinaryArray, ids: list[np.ndarray]) -> np.ndarray:
        """The rows of new keys."""
        n = len(self.keys)
        if len(keys):
            self.keys = pa.concat_arrays([self.keys, keys])
            self.flat = np.concatenate([self.flat, *ids]).astype(np.int32, copy=False)
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum([len(x) for x in ids])))
            self.bytes = self.keys.nbytes + self.flat.nbytes + self.start.nbytes
        return np.arange(n, len(self.keys))

    def ids(self, row: int) -> np.ndarray:
        return self.flat[self.start[row] : self.start[row + 1]]


class Codec:
    """A worker's encoder and decoder over one vocabulary; its DuckDB connection is in memory."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")).findall
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "allocator_flush_threshold": "8MB"})
        left, right, new = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), new.append(rank)
        left, right, new = (np.array(x, np.int64) for x in (left, right, new))
        unsafe = np.zeros(max(self.ranks.values()) + 1, bool)
        unsafe[left[new <= left]] = unsafe[right[new <= right]] = True
        self._table("merges", pair=pa.array(left << 20 | right), k=pa.array(new.astype(np.int32)), safe=pa.array(~unsafe[new]))
        self._table("vocabulary", id=pa.array(list(self.ranks.values()), pa.int32()), hex=pa.array([t.hex() for t in self.ranks]))
        self.known = np.zeros(max(self.ranks.values()) + 1, bool)
        self.known[list(self.ranks.values())] = True
        size = np.zeros(len(self.known), np.int64)
        size[list(self.ranks.values())] = [len(t) for t in self.ranks]
        self.size = size
        self.kept = Kept()  # segments and pieces; a piece alone is cut into itself
        self.most = CACHE_SLICES * SLICE_BYTES

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"create or replace table {name} as select * from incoming")
        self.con.unregister("incoming")

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        short, long = [], []
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = np.array([r], np.int32)
            else:
                (short if len(p) <= SHORT_BYTES else long).append(i)
        for i, ids in zip(short, self._contract([pieces[i] for i in short])):
            out[i] = ids
        for i in long:
            out[i] = self._stitched(pieces[i])
        return out

    def _contract(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece by the recursive query; a piece that is a token as a whole is contracted all the same."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        order = sorted((i for i, p in enumerate(pieces) if len(p) <= LONG_BYTES), key=lambda i: len(pieces[i]))
        squares = np.cumsum([len(pieces[i]) ** 2 for i in order])
        at = 0
        while at < len(order):
            most = QUERY_SQUARES + (squares[at - 1] if at else 0)
            some = order[at : min(at + QUERY_PIECES, max(at + 1, int(np.searchsorted(squares, most, "right"))))]
            at += len(some)
            flat = self.first[np.frombuffer(b"".join(pieces[i] for i in some), np.uint8)]
            off = np.cumsum([0] + [len(pieces[i]) for i in some]).astype(np.int32)
            self._table("seed", w=pa.array(np.array(some, np.int32)), ids=pa.ListArray.from_arrays(pa.array(off), pa.array(flat)))
            got = self.con.sql(ENCODE).to_arrow_table()
            for w, ids in zip(got["w"].to_pylist(), _lists(got["ids"])):
                out[w] = ids
        for i in (i for i, p in enumerate(pieces) if len(p) > LONG_BYTES):
            ids = self.first[np.frombuffer(pieces[i], np.uint8)]
            while True:
                self._table("seed_long", w=pa.array(np.zeros(len(ids), np.int32)), p=pa.array(np.arange(len(ids), dtype=np.int64)), id=pa.array(ids))
                rounds = max(1, min(32, LONG_ROWS // len(ids)))
                got = self.con.sql(ENCODE_LONG, params={"rounds": rounds}).to_arrow_table()["id"].to_numpy().astype(np.int32)
                if len(got) == len(ids):
                    break
                ids = got
            out[i] = ids
        return out

    def _stitched(self, piece: bytes) -> np.ndarray:
        """The ids of a long piece, from windows that overlap."""
        n = len(piece)
        spans = [(a, min(a + 2 * STRIDE, n)) for a in range(0, max(n - STRIDE, 1), STRIDE)]
        done: dict[bytes, np.ndarray] = {}
        while True:
            new = list({w for a, b in spans if (w := piece[a:b]) not in done})
            done.update(zip(new, self._contract(new)))
            ids = [done[piece[a:b]] for a, b in spans]
            size = [self.size[x] for x in ids]
            # tokens as start << 20 | size, in the order of their starts
            held = [((a + np.cumsum(s) - s) << 20) | s for (a, _), s in zip(spans, size)]
            cut, apart = [0], []
            for k in range(len(spans) - 1):
                x, y = held[k], held[k + 1]
                x = x[np.searchsorted(x, spans[k + 1][0] << 20) :]
                place = np.searchsorted(y, x)
                same = np.flatnonzero(y[np.minimum(place, len(y) - 1)] == x)
                if len(same):
                    cut += [len(held[k]) - len(x) + int(same[0]) + 1, int(place[same[0]]) + 1]
                else:
                    apart.append(k)
            if not apart:
                cut.append(len(ids[-1]))
                return np.concatenate([x[a:b] for x, a, b in zip(ids, cut[::2], cut[1::2])])
            joined, at = [], 0
            for k in apart:
                if joined and k <= at:
                    joined[-1] = joined[-1][0], spans[k + 1][1]
                else:
                    joined += spans[at + 1 if joined else 0 : k] + [(spans[k][0], spans[k + 1][1])]
                at = k + 1
            spans = joined + spans[at + 1 :]
            done = {w: done[w] for w in {piece[a:b] for a, b in spans} if w in done}

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The bytes of each document, whose ids are ``ids[at[i] : at[i + 1]]``; an id that is not in the vocabulary raises ``ValueError``."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        out: list[list[bytes]] = [[] for _ in range(len(at) - 1)]
        for a in range(0, len(ids), DECODE_IDS):
            some = ids[a : a + DECODE_IDS]
            p = np.arange(a, a + len(some))
            w = (np.searchsorted(at, p, "right") - 1).astype(np.int32)
            self._table("ids", w=pa.array(w), p=pa.array(p), id=pa.array(some))
            got = self.con.sql(DECODE).to_arrow_table()
            for w, raw in zip(got["w"].to_pylist(), got["raw"].to_pylist()):
                out[w].append(raw)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _places(self, segments: pa.LargeBinaryArray) -> np.ndarray:
        """The rows of ``kept`` that hold the distinct segments, which are encoded where they are new."""
        if self.kept.bytes > self.most:
            self.kept = Kept()
        kept = self.kept
        out = kept.find(segments)
        new = np.flatnonzero(out < 0)
        for a in range(0, len(new), QUERY_PIECES):
            at = new[a : a + QUERY_PIECES]
            own = segments.take(pa.array(at))
            found = [self.find(x.decode("utf-8", "replace")) for x in own.to_pylist()]
            n = np.array([len(x) for x in found])
            number = {p: k for k, p in enumerate(dict.fromkeys(p for x in found for p in x))}
            pieces = pa.array([p.encode() for p in number], pa.large_binary())
            rows = kept.find(pieces)
            unknown = np.flatnonzero(rows < 0)
            some = pieces.take(pa.array(unknown))
            rows[unknown] = kept.add(some, self.encode_pieces(some.to_pylist()))
            rows = rows[np.fromiter((number[p] for x in found for p in x), np.int64, int(n.sum()))]
            start = np.cumsum(n) - n
            out[at] = rows[start]  # a segment of one piece is that piece
            many = np.flatnonzero(n > 1)
            if len(many):
                out[at[many]] = kept.add(own.take(pa.array(many)), [np.concatenate([kept.ids(r) for r in rows[b : b + k]]) for b, k in zip(start[many].tolist(), n[many].tolist())])
        return out

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets) of texts given as UTF-8 bytes and offsets."""
        parts, total, at = [], 0, np.zeros(len(off), np.int64)
        for start, end, cuts in segments(raw, off):
            data = pa.py_buffer(np.ascontiguousarray(raw[start:end]))
            places = pa.py_buffer(np.append(cuts, end) - start)
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, places, data]).dictionary_encode()
            rows = self._places(coded.dictionary)
            flat, first = self.kept.flat, self.kept.start[rows]
            size = (self.kept.start[rows + 1] - first).astype(np.int32)
            first = first.astype(np.int32)
            which = coded.indices.to_numpy()
            n = size[which]
            after = np.cumsum(n, dtype=np.int32)  # a block has fewer ids than bytes
            place = np.repeat(first[which] - (after - n), n)
            place += np.arange(len(place), dtype=np.int32)
            parts.append(flat[place])
            del coded, rows, which, n, place
            a, b = np.searchsorted(off, (start, end), "left")  # texts that begin in this block
            at[a:b] = total + np.concatenate(([0], after)).astype(np.int64)[np.searchsorted(cuts, off[a:b])]
            total += int(after[-1])
        at[np.searchsorted(off, off[-1], "left") :] = total
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)).astype(np.int32, copy=False), at


def segments(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, starts of segments) of blocks of about ``SLICE_BYTES``: a segment begins with each text and each run of white space."""
    start = 0
    while start < len(raw):
        size = SLICE_BYTES
        while True:
            end = min(start + size, len(raw))
            at = _white_starts(raw, start, end)
            a, b = np.searchsorted(off, (start, end), "left")
            mark = np.zeros(end - start, bool)
            mark[0] = mark[off[a:b] - start] = mark[at - start] = True
            cuts = np.flatnonzero(mark) + start
            if end == len(raw) or len(cuts) > 1:
                break
            size *= 2
        if end < len(raw):
            end, cuts = int(cuts[-1]), cuts[:-1]
        yield start, end, cuts
        start = end


def _white_starts(raw: np.ndarray, start: int, end: int) -> np.ndarray:
    """Places of ASCII white space behind a character that is no white space."""
    low = max(0, start - 3)
    some = np.concatenate((np.full(3 - (start - low), 65, np.uint8), raw[low:end]))
    at = np.flatnonzero((some[3:] == 32) | ((some[3:] >= 9) & (some[3:] <= 13))) + 3
    p1, p2, p3 = some[at - 1], some[at - 2], some[at - 3]
    white = (p1 == 32) | ((p1 >= 9) & (p1 <= 13))
    # the last bytes of other white space, and of some characters beside it, where nothing is cut
    white |= (p1 >= 128) & ((p2 == 0xC2) | ((p3 >= 0xE1) & (p3 <= 0xE3) & ((p2 == 0x80) | (p2 == 0x81) | (p2 == 0x9A))))
    return at[~white] - 3 + start


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        flat, off = chunk.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(chunk.value_lengths().to_numpy(zero_copy_only=False))])
        out += [flat[a:b] for a, b in zip(off[:-1], off[1:])]
    return out


def codec(path: str, pattern: str) -> Codec:
    """This process's codec: workers that are used again keep their pieces."""
    return kept("bpe", (path, pattern), lambda: Codec(path, pattern))


def encode_decode(df: DataFrame, key: str, text: str, path: str, pattern: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(key, ids binary: little-endian unsigned 32-bit, decoded binary) of every row; ``slice_bytes`` of texts at a time."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for part in slices(batches, 1, slice_bytes, "bpe"):
            c = codec(path, pattern)
            c.most = CACHE_SLICES * slice_bytes
            ids, at = c.encode(*utf8(part.column(1)))
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(4 * at), pa.py_buffer(ids.astype("<i4"))])
            yield pa.record_batch([part.column(0), coded.cast(pa.binary()), pa.array(c.decode(ids, at), pa.binary())], ["key", "ids", "decoded"])
            del ids, coded
            trim()

    return df.select(key, text).mapInArrow(run, f"key {kind}, ids binary, decoded binary").withColumnRenamed("key", key)


def digests(df: DataFrame, key: str, text: str, path: str, pattern: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, from ``encode_decode``."""
    return encode_decode(df, key, text, path, pattern, slice_bytes).select(
        key,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def decode(df: DataFrame, key: str, ids: str, path: str, pattern: str) -> DataFrame:
    """(key, decoded binary) of rows whose ``ids`` are little-endian unsigned 32-bit integers; null ids: null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for part in slices(batches, 1, SLICE_BYTES // 4, "bpe"):
            raw, off = utf8(part.column(1))
            if (off % 4).any():
                raise ValueError("ids are not whole 32-bit integers")
            got = codec(path, pattern).decode(np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), off // 4)
            null = part.column(1).is_null().to_pylist()
            yield pa.record_batch([part.column(0), pa.array([None if x else g for x, g in zip(null, got)], pa.binary())], ["key", "decoded"])

    return df.select(key, ids).mapInArrow(run, f"key {kind}, decoded binary").withColumnRenamed("key", key)
