"""Hierarchical weighted hash tree: region, rack and shard by weighted hash draws, JVM-side only.

A row descends the tree. At each level every child draws ``-ln(u) / weight`` with ``u`` from a hash of
(key, path of the child); the smallest draw wins. A child's draw depends on nothing but the key, its own path and
its own weight, so a change of weights below one child moves rows only into or out of that child's subtree.

Defined results: a null key is a key of its own; equal keys share a shard; an empty table gives an empty table;
other columns are carried along unchanged, and a clash with an output name raises ``ValueError``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Draws use the first 12 hex digits of an MD5 digest: 48 bits.
DRAW_HEX = 12
#: Rows of one shard are numbered in this many independent buckets, so no task sorts a whole shard.
SLOT_BUCKETS = 256


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. A shard has a number and no children; an inner node weighs what its children weigh."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    def shards(self) -> list[int]:
        return [s for c in self.children for s in c.shards()] if self.children else [self.shard]


def build_tree(n: int, base: int = 16, racks: int = 2, per_rack: int = 2) -> Node:
    """A tree of ``n`` shards: the first ``base`` in regions of ``racks`` x ``per_rack``, each later one in a region of its own.

    A later shard adds a root child and leaves every other weight as it was: it takes rows only into itself.
    """
    if n < 1:
        raise ValueError("a tree needs a shard")
    regions, size = [], racks * per_rack
    for r in range(0, min(n, base), size):
        inner = []
        for k in range(r, min(r + size, n, base), per_rack):
            leaves = tuple(Node(f"s{s}", shard=s) for s in range(k, min(k + per_rack, n, base)))
            inner.append(Node(f"k{k // per_rack}", leaves))
        regions.append(Node(f"r{r // size}", tuple(inner)))
    regions += [Node(f"x{s}", (Node("k", (Node(f"s{s}", shard=s),)),)) for s in range(base, n)]
    return Node("root", tuple(regions))


def reweight(node: Node, weights: dict[int, float]) -> Node:
    """The same tree with other weights for the named shards."""
    if not node.children:
        return Node(node.name, (), node.shard, weights.get(node.shard, node.own_weight))
    return Node(node.name, tuple(reweight(c, weights) for c in node.children))


def key_text(key: str) -> Column:
    return F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n"))


def hash_number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_HEX), 16, 10).cast("long")


def _draw(key: Column, path: str, weight: float) -> Column:
    u = (hash_number(F.concat(key, F.lit("|" + path))) + F.lit(1)) / F.lit(float(16**DRAW_HEX))
    return -F.log(u) / F.lit(float(weight))


def shard_of(key: Column, node: Node, path: str = "") -> Column:
    """The shard number as an expression; only the chosen child's branch is evaluated."""
    if not node.children:
        return F.lit(node.shard).cast("int")
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError("all weights are 0")
    paths = [f"{path}/{c.name}" for c in live]
    if len(live) == 1:
        return shard_of(key, live[0], paths[0])
    pick = F.array_min(F.array(*(F.struct(_draw(key, p, c.weight).alias("d"), F.lit(i).alias("i")) for i, (p, c) in enumerate(zip(paths, live)))))["i"]
    # the pick is evaluated once, as the element of a one-element array
    return F.element_at(F.transform(F.array(pick), lambda x: _branch(x, [(shard_of(key, c, p)) for p, c in zip(paths, live)])), 1)


def _branch(pick: Column, below: list[Column]) -> Column:
    out = F.when(pick == 0, below[0])
    for i, b in enumerate(below[1:], 1):
        out = out.when(pick == i, b)
    return out


def assign(df: DataFrame, key: str, trees: dict[str, Node]) -> DataFrame:
    """``df`` with one int column for each tree: the shard of each row. No shuffle."""
    _free(df, trees)
    k = key_text(key)
    return df.select("*", *(shard_of(k, t).alias(name) for name, t in trees.items()))


def _free(df: DataFrame, names) -> None:
    clash = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")


def number_slots(df: DataFrame, shard: str, key: str, slot: str = "slot", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """``df`` with a gapless number from 0 within each shard, in the order of (bucket, key).

    Rows of a shard are dealt to ``buckets`` by a hash of the key; each bucket is numbered on its own, after the rows
    of the buckets before it, whose counts (shards x buckets rows, a fixed bound) are broadcast. Pass a stored,
    narrow ``df``: it is read twice. Repeated keys get neighbouring numbers.
    """
    _free(df, [slot, "__bucket", "__before"])
    d = df.withColumn("__bucket", F.pmod(hash_number(F.concat(key_text(key), F.lit("|slot"))), F.lit(buckets)).cast("int"))
    counts = d.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(shard).orderBy("__bucket")
    before = counts.select(F.col(shard).alias("__s"), F.col("__bucket").alias("__b"), (F.sum("__n").over(w) - F.col("__n")).alias("__before"))
    own = Window.partitionBy(shard, "__bucket").orderBy(F.col(key).asc_nulls_first())
    return (
        d.withColumn(slot, F.row_number().over(own).cast("long") - 1)
        .join(F.broadcast(before), F.col(shard).eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
        .withColumn(slot, F.col(slot) + F.col("__before"))
        .drop("__bucket", "__before", "__s", "__b")
    )
