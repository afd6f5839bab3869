"""Joins whose keys may be shared by a large part of all rows, and bitmaps that spare rows a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that stay together.
TOGETHER = 1000
#: Parts that one key is dealt into, at most.
MOST_PARTS = 1024
#: Keys that are dealt: a key beyond the most frequent ones holds at most this share of the rows.
MOST_KEYS = 10_000
#: Bits of a bitmap of keys: 1 MB.
BITMAP_BITS = 1 << 23


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))


def bitmap(keys: DataFrame) -> DataFrame:
    """(__bucket, __bits) of the hashed rows of one column: ``BITMAP_BITS`` at most, however many there are."""
    bit = keys.select(_bit(keys.columns[0]).alias("__h"))
    return bit.groupBy(F.bitmap_bucket_number("__h").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__h")).alias("__bits"))


def bucket(key: str) -> Column:
    """The condition that joins a row with its part of a ``bitmap``."""
    return F.bitmap_bucket_number(_bit(key)) == F.col("__bucket")


def has_bit(key: str) -> Column:
    """Whether the bit of ``key`` is set in the part of the bitmap that was joined."""
    at = F.bitmap_bit_position(_bit(key))
    byte = F.conv(F.hex(F.substr(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """(on, __parts) of the most frequent keys that more than ``TOGETHER`` rows share: ``MOST_KEYS`` rows at most."""
    n = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > TOGETHER)
    top = n.orderBy(F.desc("__n"), *on).limit(MOST_KEYS)
    return top.select(*on, F.least(F.ceil(F.col("__n") / TOGETHER), F.lit(MOST_PARTS)).cast("int").alias("__parts"))


def spread_join(rows: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner", light: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``small``, which holds few rows for each key, by ``how`` (inner or left).

    Rows of a frequent key are dealt into parts by the hash of ``by``, and its rows of ``small`` are repeated for each
    part, so no task holds a whole frequent key. ``rows`` is read twice: it should be a written table, or ``light`` the
    same rows with the keys alone.
    """
    hot = F.broadcast(hot_keys(rows if light is None else light, on))  # MOST_KEYS rows at most
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(hot, on, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    every = small.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(every, [*on, "__part"], how).drop("__part")
