"""Near-duplicate documents: b-bit minhash signatures, a multi-index Hamming join, exact confirmation, components.

A signature is ``CHUNKS`` chunks of four 16-bit minhashes, one long each. Two signatures that differ in at most
``2 * CHUNKS - 1`` of their symbols have, by pigeonhole, a chunk with at most one error; every chunk enters an index
under each of the four keys that leave one symbol out, so such pairs always meet. At a similarity of 0.8 a pair lies
beyond that distance about once in 10^6.

No index bucket is expanded into all its pairs: first each member is compared with a centre of its bucket, equal
sets being one class; components of the confirmed links follow, and more centres for large buckets. Only pairs across
components are then compared, each in the first bucket that it shares: small buckets by a join whose condition holds
the signature distance, large ones in blocks of bounded size, members outside the bucket's largest component against
all, where only links leave a block. Links are confirmed on full shingle sets.

A bucket, a centre, a class or a component may hold a large part of all rows: joins on them deal frequent keys
(``_skew``), and aggregations combine before their shuffle.

Defined results: a null text has no words; texts without words are linked with nothing; rows that share an id are one
node, which has the links of all its texts; rows of one class share a component; a null id is a member of its class
but never its representative, and is not kept; a text of any length is hashed in blocks; an empty table gives an empty
table; other columns are not read, so they cannot clash.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from undula.llm._arrow import slices, utf8
from undula.llm._skew import bitmap, bucket, has_bit, spread_join
from undula.llm._store import drop_stash, stash
from undula.llm.shingles import shingle_sets

CHUNKS = 12
LANES = 4
#: Symbols in which two signatures may differ: the join finds all such pairs.
MOST_ERRORS = 2 * CHUNKS - 1
#: Buckets up to this size go to the pair join at once; larger ones get more centres first.
SMALL_BUCKET = 64
STAR_ROUNDS = 3
#: Members on each side of a block of a large bucket, and bytes of their sets, about.
BLOCK_MEMBERS = 512
BLOCK_BYTES = 16 << 20
_RNG = np.random.default_rng(77)
_XOR = _RNG.integers(0, 2**63, CHUNKS * LANES, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**62, CHUNKS * LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIG = [f"s{c}" for c in range(CHUNKS)]


def signatures(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """int64 (texts, CHUNKS): four 16-bit minhashes a chunk; rows of empty sets are 0."""
    out = np.zeros((len(off) - 1, CHUNKS), np.uint64)
    full = np.flatnonzero(np.diff(off))
    if not len(full):
        return out.view(np.int64)
    starts = off[full]
    for k in range(CHUNKS * LANES):
        low = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], starts)
        symbol = (low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
        out[full, k // LANES] |= symbol << np.uint64(16 * (k % LANES))
    return out.view(np.int64)


def prints(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """int64 (texts, 2): a 128-bit fingerprint of each set."""
    return np.frombuffer(b"".join(hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(off[:-1], off[1:])), "<i8").reshape(-1, 2)


def sign(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, n_shingles, f0, f1: 128-bit fingerprint of the set, s0...: signature) of every row."""

    def run(batches):
        for part in slices(batches):
            flat, off = shingle_sets(*utf8(part.column(1)), width)
            columns = (*prints(flat, off).T, *signatures(flat, off).T)
            yield pa.record_batch([part.column(0), pa.array(np.diff(off)), *(pa.array(np.ascontiguousarray(c)) for c in columns)], ["id", "n_shingles", "f0", "f1", *SIG])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"id {kind}, n_shingles long, f0 long, f1 long, " + ", ".join(f"{s} long" for s in SIG))


def with_prints(docs: DataFrame, text: str, width: int, names: tuple[str, str]) -> DataFrame:
    """``docs``, all columns, with the fingerprint of each text's set as the columns ``names``."""
    at = docs.columns.index(text)

    def run(batches):
        for part in slices(batches, at):
            flat, off = shingle_sets(*utf8(part.column(at)), width)
            yield pa.record_batch([*part.columns, *(pa.array(np.ascontiguousarray(c)) for c in prints(flat, off).T)], [*part.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(name, LongType()) for name in names)]))


def sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, shingles binary: sorted 64-bit hashes) of every row."""

    def run(batches):
        for part in slices(batches):
            flat, off = shingle_sets(*utf8(part.column(1)), width)
            raw = flat.tobytes()
            yield pa.record_batch([part.column(0), pa.array([raw[8 * a : 8 * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())], ["id", "shingles"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"id {kind}, shingles binary")


def distance(a: str, b: str) -> Column:
    """Symbols in which the signatures of the aliases ``a`` and ``b`` differ."""
    total = None
    for s in SIG:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        for shift in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        n = F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
        total = n if total is None else total + n
    return total


def among(docs: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key may be an id of ``of``; rows that share a bit with one pass as well and meet no partner later."""
    return docs.filter(F.col(key).isNotNull()).join(F.broadcast(bitmap(of.select("id"))), bucket(key)).filter(has_bit(key)).select(docs.columns)


def index_keys(reps: DataFrame) -> DataFrame:
    """(id, pos, key): every chunk under the four keys that leave one of its symbols out."""
    keys = [
        F.xxhash64(F.lit(c * LANES + m), F.col(s).bitwiseAND(F.lit(~(0xFFFF << 16 * m) if m < 3 else 0x0000FFFFFFFFFFFF)))
        for c, s in enumerate(SIG)
        for m in range(LANES)
    ]
    return reps.select("id", F.posexplode(F.array(*keys)).alias("pos", "key"))


def first_shared(a: str, b: str) -> Column:
    """The position of the first index key that the signatures of the aliases ``a`` and ``b`` share."""
    out = F.lit(-1)
    for c in reversed(range(CHUNKS)):
        x = F.col(f"{a}.{SIG[c]}").bitwiseXOR(F.col(f"{b}.{SIG[c]}"))
        for m in reversed(range(LANES)):
            lane = 0xFFFF << 16 * m if m < 3 else -(1 << 48)
            out = F.when(x.bitwiseAND(F.lit(~lane)) == 0, c * LANES + m).otherwise(out)
    return out


class _Set:
    """Disjoint sets of whatever can be hashed."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, x, y) -> None:
        self.up[max(self.find(x), self.find(y))] = min(self.find(x), self.find(y))


def block_links(pos: int, left: list[tuple], right: list[tuple], percent: int) -> list[tuple]:
    """Links (id, id) across components between members (id, comp, outside, signature, sorted shingles).

    Only links that join components which no earlier link of the block has joined.
    """
    found, joined = [], _Set()
    sig_l, sig_r = (np.array([m[3] for m in side], np.int64).view(np.uint16).reshape(len(side), CHUNKS, LANES) for side in (left, right))
    size_r = np.array([len(m[4]) for m in right])
    id_r = np.array([m[0] for m in right])
    outside_r = np.array([m[2] for m in right])
    all_r, off_r = np.concatenate([m[4] for m in right]), np.concatenate(([0], np.cumsum(size_r)))
    for (own, comp, _, _, shingles), sig in zip(left, sig_l):
        same = sig_r == sig
        errors = CHUNKS * LANES - same.sum((1, 2))
        chunk = same.sum(2) >= LANES - 1
        first = chunk.argmax(1)
        lanes = same[np.arange(len(right)), first]
        at = first * LANES + np.where(lanes.all(1), 0, lanes.argmin(1))
        n = len(shingles)
        ok = (errors <= MOST_ERRORS) & chunk.any(1) & (at == pos) & (~outside_r | (id_r > own))
        ok &= 100 * np.minimum(n, size_r) >= percent * np.maximum(n, size_r)
        group = joined.find(comp)
        for i in np.flatnonzero(ok)[np.argsort(errors[ok], kind="stable")]:
            if joined.find(right[i][1]) == group:
                continue
            y = all_r[off_r[i] : off_r[i + 1]]
            place = np.minimum(np.searchsorted(shingles, y), n - 1)
            both = int(np.count_nonzero(shingles[place] == y))
            if 100 * both >= percent * (n + len(y) - both):
                found.append((own, right[i][0]))
                joined.join(comp, right[i][1])
                group = joined.find(comp)
    return found


def large_links(open_: DataFrame, sig: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """(a, b), written: links across components within buckets (key, pos, id, comp) of any size."""
    kind = open_.schema["id"].dataType.simpleString()
    members = stash(open_.select("key", "pos", "id", "comp").join(sig, "id").join(shingles, "id"), "wide")
    weight = F.sum(F.lit(1 / BLOCK_MEMBERS) + F.octet_length("shingles") / BLOCK_BYTES)
    largest = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), weight.alias("w")).groupBy("key")
    largest = largest.agg(F.max_by(F.struct("comp", "w"), F.struct("n", "comp")).alias("top"), F.sum("w").alias("all"))
    blocks = largest.select("key", F.col("top.comp").alias("top"), F.greatest(F.ceil(F.col("all") - F.col("top.w")), F.lit(1)).cast("int").alias("nl"), F.ceil("all").cast("int").alias("nr"))
    m = spread_join(members, blocks, ["key"], "id").withColumn("outside", F.col("comp") != F.col("top"))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["pos", "id", "comp", "outside", *SIG, "shingles"]
    left = m.filter("outside").select("key", deal("nl").alias("lb"), every("nr").alias("rb"), F.lit(0).alias("side"), *own)
    right = m.select("key", every("nl").alias("lb"), deal("nr").alias("rb"), F.lit(1).alias("side"), *own)
    dealt = left.unionByName(right).repartition("key", "lb", "rb").sortWithinPartitions("key", "lb", "rb", "side")

    def run(batches):
        held, now = ([], []), None

        def done():
            links = block_links(now[3], *held, percent) if held[0] and held[1] else []
            return pa.record_batch([pa.array([x for x, _ in links], ids), pa.array([y for _, y in links], ids)], ["a", "b"])

        for batch in batches:
            ids = batch.schema.field("id").type
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and now[:3] != r[:3]:
                    yield done()
                    held = ([], [])
                now = (*r[:3], r[4])
                held[r[3]].append((r[5], r[6], r[7], r[8 : 8 + CHUNKS], np.frombuffer(r[8 + CHUNKS], np.uint64)))
        if now is not None:
            yield done()

    out = stash(dealt.mapInArrow(run, f"a {kind}, b {kind}"), "found")
    drop_stash(members)
    return out


def confirm(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), a written table, those with 100 * intersection >= percent * union."""

    def run(batches):
        for batch in slices(batches, 2):
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(a, b)):
                n, m = len(x) // 8, len(y) // 8
                if 100 * min(n, m) < percent * max(n, m):
                    continue
                both = np.sort(np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))))
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                ok[i] = 100 * same >= percent * (n + m - same)
            keep = pa.array(ok)
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left = shingles.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    right = shingles.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    kind = pairs.schema["a"].dataType.simpleString()
    return spread_join(pairs, right, ["a"], "b").join(left, "b").select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in links (a, b): the least id reachable. Labels spread along links and jump to their labels' labels."""
    both = stash(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    label = stash(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "label")
    while True:
        near = spread_join(both, label.select(F.col("id").alias("b"), F.col("comp").alias("m")), ["b"], "a").groupBy(F.col("a").alias("id")).agg(F.min("m").alias("m"))
        spread = stash(label.join(near, "id").select("id", "comp", F.least("comp", "m").alias("m")), "spread")
        jump = label.select(F.col("id").alias("m"), F.col("comp").alias("j"))
        new = stash(spread_join(spread, jump, ["m"], "id").select("id", F.least("m", "j").alias("comp"), (F.least("m", "j") != F.col("comp")).alias("moved")), "label")
        drop_stash(label), drop_stash(spread)
        label = new
        if label.filter("moved").isEmpty():
            drop_stash(both)
            out = label.select("id", "comp")
            out._undula_path = label._undula_path
            return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept, f0, f1: fingerprint of the set) of every row.

    The component is the least id that links of >= ``percent`` similarity reach.
    """
    signed = stash(sign(docs, key, text, width), "signed")
    full = signed.filter("n_shingles > 0 and id is not null")
    reps = stash(full.groupBy("f0", "f1").agg(F.min("id").alias("id"), *(F.min(s).alias(s) for s in SIG)), "reps")
    keys = index_keys(reps)  # from the written table
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("c0")).filter("n > 1")
    members = stash(spread_join(keys, shared, ["key"], "id"), "members")
    sig = reps.select("id", *SIG)

    def shingles(of: DataFrame) -> DataFrame:
        return stash(sets(among(docs.select(key, text), key, of), key, text, width), "sets")

    def found(pairs: DataFrame) -> DataFrame:
        """The links among written pairs, written; the pairs are dropped."""
        own = shingles(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
        links = stash(confirm(pairs, own, percent), "found")
        drop_stash(own), drop_stash(pairs)
        return links

    def near(pairs: DataFrame) -> DataFrame:
        """Of written pairs, which are dropped, those under the distance, written."""
        x, y = sig.withColumnRenamed("id", "a"), sig.withColumnRenamed("id", "b")
        x = x.select("a", F.struct(*SIG).alias("x"))
        y = y.select("b", F.struct(*SIG).alias("y"))
        out = stash(spread_join(pairs, x, ["a"], "b").join(y, "b").filter(distance("x", "y") <= MOST_ERRORS).select("a", "b"), "pairs")
        drop_stash(pairs)
        return out

    def merged(label: DataFrame, links: list[DataFrame]) -> DataFrame:
        """Labels with further links, both written; both are dropped."""
        every = reduce(DataFrame.union, links)
        out = label
        if not every.isEmpty():
            out = components(label.filter("id != comp").select(F.col("comp").alias("a"), F.col("id").alias("b")).union(every))
            drop_stash(label)
        for x in links:
            drop_stash(x)
        return out

    def still_open(label: DataFrame, among: DataFrame, turn: int) -> DataFrame:
        """Members of buckets that hold several components, with the component, and a centre drawn for the bucket."""
        placed = stash(among.select("key", "pos", "id", "n").join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "placed")
        draw = F.xxhash64("id", F.lit(turn))
        split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("id", "comp"), draw).alias("c")).filter("lo != hi")
        out = stash(spread_join(placed, split.select("key", "c"), ["key"], "id"), "open")
        drop_stash(placed)
        return out

    star = stash(members.filter("id != c0").select(F.col("c0").alias("a"), F.col("id").alias("b")).distinct(), "star")
    links = found(near(star))
    label = components(links)
    drop_stash(links)
    for turn in range(STAR_ROUNDS):
        wide = still_open(label, members.filter(F.col("n") > SMALL_BUCKET), turn)
        if wide.isEmpty():
            drop_stash(wide)
            break
        pairs = stash(wide.filter(F.col("comp") != F.col("c.comp")).select(F.col("c.id").alias("a"), F.col("id").alias("b")).distinct(), "centre")
        drop_stash(wide)
        label = merged(label, [found(near(pairs))])
    open_ = still_open(label, members, STAR_ROUNDS)
    drop_stash(members)
    side = open_.filter(F.col("n") <= SMALL_BUCKET).select("key", "pos", "id", "comp").join(sig, "id")
    across = (F.col("x.key") == F.col("y.key")) & (F.col("x.pos") == F.col("y.pos")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp"))
    pairs = side.alias("x").join(side.alias("y"), across & (distance("x", "y") <= MOST_ERRORS) & (first_shared("x", "y") == F.col("x.pos"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    links = [found(stash(pairs, "pairs"))]
    wide = open_.filter(F.col("n") > SMALL_BUCKET)
    if not wide.isEmpty():
        own = shingles(wide)
        links.append(large_links(wide, sig, own, percent))
        drop_stash(own)
    label = merged(label, links)
    classes = stash(reps.select("f0", "f1", F.col("id").alias("rep")).join(label.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("f0", "f1", F.coalesce("comp", "rep").alias("comp")), "classes")
    for x in (open_, label, reps):
        drop_stash(x)
    named = signed.select("id", "n_shingles", "f0", "f1")
    some, none = named.filter("n_shingles > 0"), named.filter("n_shingles = 0")
    placed = spread_join(some, classes, ["f0", "f1"], "id", "left").unionByName(none.withColumn("comp", F.col("id")))
    return placed.select(F.col("id").alias(key), "n_shingles", F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(False)).alias("kept"), "f0", "f1")
