"""WARC 1.1 archives: one gzip member a record, a sequential reader with incremental zlib, digests verified.

An archive is a sequence of byte blocks, rows (archive, block, data): Spark's writer commits them in the shared
folder, so a lost executor's archive is written again, and any store that Spark reaches will do. ``export`` writes
the same bytes as a .warc.gz file. Records that Spark wrote are read with bounded memory: compressed bytes are fed
to zlib piece by piece, the header block ends at an empty line, and Content-Length frames the payload.

Defined results: a null payload is empty; payloads of at least ``least`` bytes that are equal (SHA-256) share one
response, that with the largest id, and the others are revisits that name it; of rows that repeat that id each is a
response; smaller payloads are responses; a null id groups with its equals but never is the largest; an id that is no
whole number raises an error; a payload of any length is a record, which a worker holds a few times; an empty table
gives an empty archive; only the named columns are read, so others cannot clash; a digest or a length that doesn't
match raises ``WarcError``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm._skew import bitmap, bucket, has_bit, spread_join
from undula.llm._store import stash

#: Bytes of an archive's block, and of compressed input that the reader inflates at a time.
BLOCK_BYTES = 1 << 20
FEED_BYTES = 64 << 10
#: No header block may be longer.
HEADER_BYTES = 64 << 10
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that breaks the format, or whose digest doesn't match."""


def _clean(value: str | None) -> str:
    return " ".join((value or "").split())


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None = None, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit, whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(uri)}",
        f"WARC-Payload-Digest: {sha(payload)}",
        f"WARC-Block-Digest: {sha(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _inflate(chunks: Iterable[bytes]) -> Iterator[bytes | None]:
    """Plain bytes of each gzip member, piece by piece; None after each member."""
    z, begun = zlib.decompressobj(31), False
    for chunk in chunks:
        for at in range(0, len(chunk), FEED_BYTES):
            data = chunk[at : at + FEED_BYTES]
            while data:
                begun = True
                piece = z.decompress(data, FEED_BYTES)
                if piece:
                    yield piece
                data = z.unconsumed_tail
                if z.eof:
                    data = z.unused_data
                    yield None
                    z, begun = zlib.decompressobj(31), False
    if begun:
        raise WarcError("the archive ends inside a gzip member")


def read_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive given as byte chunks of any size."""
    head, headers, block, need = bytearray(), None, bytearray(), 0
    for piece in _inflate(chunks):
        if piece is None:
            if headers is None:
                raise WarcError("a member ends inside a record's header")
            if len(block) != need + 4 or block[need:] != b"\r\n\r\n":
                raise WarcError(f"a block of {need} bytes is framed by {len(block)}")
            body = bytes(block[:need])
            _verify(headers.get("warc-block-digest"), body)
            yield headers, body
            head, headers, block = bytearray(), None, bytearray()
        elif headers is None:
            head += piece
            end = head.find(b"\r\n\r\n")
            if end >= 0:
                headers = _headers(bytes(head[:end]))
                need = int(headers["content-length"])
                block += head[end + 4 :]
            elif len(head) > HEADER_BYTES:
                raise WarcError("a header has no end")
        else:
            block += piece
    if head:
        raise WarcError("the archive ends inside a record")


def _headers(raw: bytes) -> dict[str, str]:
    first, *rest = raw.decode("utf-8", "replace").split("\r\n")
    if not first.startswith(("WARC/", "HTTP/")):
        raise WarcError(f"a record starts with {first[:20]!r}")
    out = {k.strip().lower(): v.strip() for k, sep, v in (line.partition(":") for line in rest) if sep}
    if first.startswith("WARC/") and not out.get("content-length", "").isdigit():
        raise WarcError("a record has no Content-Length")
    return out


def _verify(digest: str | None, data: bytes) -> bytes | None:
    if digest is None:
        return None
    kind, _, value = digest.partition(":")
    if kind != "sha1" or base64.b32decode(value) != hashlib.sha1(data).digest():
        raise WarcError(f"digest {digest} doesn't match")
    return base64.b32decode(value)


def parse(headers: dict[str, str], block: bytes) -> dict:
    """What a record says of its page: the payload of a response is verified, that of a revisit is its response's."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("a block has no HTTP header")
    length, payload = int(_headers(block[:end])["content-length"]), block[end + 4 :]
    kind = headers["warc-type"]
    if kind == "response":
        if len(payload) != length:
            raise WarcError(f"a payload of {length} bytes has {len(payload)}")
        _verify(headers["warc-payload-digest"], payload)
    return {
        "record_id": headers["warc-record-id"],
        "record_type": kind,
        "refers": headers.get("warc-refers-to"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": length,
        "payload_digest": base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex(),
    }


def urn(page_id: int | None) -> str:
    """A record id that holds the page's id: its low 64 bits."""
    return f"<urn:uuid:{uuid.UUID(int=((1 << 127) if page_id is None else 0) | (page_id or 0) & (1 << 64) - 1)}>"


def page_of(record_id: str | None) -> int | None:
    if record_id is None:
        return None
    n = uuid.UUID(record_id.strip("<>").rpartition(":")[2]).int
    if n >> 127:
        return None
    return n - (1 << 64) if n >> 63 else n


def choose(pages: DataFrame, key: str, payload: str, least: int = LEAST_BYTES) -> DataFrame:
    """``pages`` (key, uri, payload) with ``refers_to``: of equal payloads, the largest id, null on that one itself.

    The largest is found by an aggregation with partial sums. Digests that repeat are written; a bitmap of them is
    broadcast, and only pages whose digest may be among them, which hold at least ``least`` bytes, are shuffled, those
    of a frequent payload in parts.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    p = pages.withColumn("__digest", F.when(F.octet_length(body) >= least, F.sha2(body, 256)))
    top = p.filter("__digest is not null").groupBy("__digest").agg(F.max(key).alias("__top"), F.count(F.lit(1)).alias("__n"))
    top = stash(top.filter("__n > 1").select("__digest", "__top"), "copies")
    flagged = p.join(F.broadcast(bitmap(top.select("__digest"))), bucket("__digest"), "left").withColumn("__maybe", F.coalesce(has_bit("__digest"), F.lit(False))).drop("__bucket", "__bits")
    light = flagged.filter("__maybe").select("__digest")
    joined = spread_join(flagged.filter("__maybe"), top, ["__digest"], key, "left", light)
    refers = F.when(~F.col("__top").eqNullSafe(F.col(key)), F.col("__top"))
    alone = flagged.filter("not __maybe").withColumn("refers_to", F.lit(None).cast(pages.schema[key].dataType))
    return joined.withColumn("refers_to", refers).select(*pages.columns, "refers_to").unionByName(alone.select(*pages.columns, "refers_to"))


def write(pages: DataFrame, key: str, uri: str, payload: str, least: int = LEAST_BYTES) -> DataFrame:
    """(archive, block, data): one archive for each task, in blocks of about ``BLOCK_BYTES``."""

    def run(batches):
        name, n, data, size = uuid.uuid4().hex, 0, [], 0
        for batch in batches:
            for i, u, h, r in zip(*(batch.column(c).to_pylist() for c in range(4))):
                rec = record(urn(i), u, (h or "").encode(), urn(r) if r is not None else None)
                data.append(rec)
                size += len(rec)
                if size >= BLOCK_BYTES:
                    yield pa.record_batch([[name], pa.array([n], pa.int64()), pa.array([b"".join(data)], pa.binary())], ["archive", "block", "data"])
                    n, data, size = n + 1, [], 0
        if data:
            yield pa.record_batch([[name], pa.array([n], pa.int64()), pa.array([b"".join(data)], pa.binary())], ["archive", "block", "data"])

    kept = pages.select(F.col(key).cast("long").alias("id"), F.col(uri).alias("uri"), F.col(payload).alias("payload"))
    return choose(kept, "id", "payload", least).select("id", "uri", "payload", "refers_to").mapInArrow(run, "archive string, block long, data binary")


def read(archives: DataFrame, key: str = "page_id", payload: bool = True) -> DataFrame:
    """A row for each record of archives (archive, block, data): key, payload (of responses), its bytes, digest, type, refers_to.

    Members don't cross blocks that ``write`` made, so every block is read on its own, in any order.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for headers, block in read_records([data.as_py()]):
                    r = parse(headers, block)
                    rows.append(r)
                    size += len(block)
                    if size > 4 * BLOCK_BYTES:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    def out(rows):
        cols = [pa.array([page_of(r["record_id"]) for r in rows], pa.int64())]
        cols += [pa.array([r["payload"] for r in rows], pa.binary())] if payload else []
        cols += [pa.array([r["payload_bytes"] for r in rows], pa.int64())]
        cols += [pa.array([r[k] for r in rows], pa.string()) for k in ("payload_digest", "record_type")]
        cols += [pa.array([page_of(r["refers"]) for r in rows], pa.int64())]
        return pa.record_batch(cols, names)

    names = ["key", *(["payload"] if payload else []), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = f"key long, {'payload binary, ' if payload else ''}payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select("data").mapInArrow(run, kinds).withColumnRenamed("key", key)


def export(archives: DataFrame, archive: str, path: str) -> None:
    """Write one archive as a .warc.gz file, block by block."""
    with open(path, "wb") as f:
        for row in archives.filter(F.col("archive") == archive).orderBy("block").select("data").toLocalIterator():
            f.write(row[0])
