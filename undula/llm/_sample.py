"""Bounded samples of labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drawn(rows: DataFrame, most_rows: int, most_bytes: int) -> list[tuple[str, object]]:
    """(text, label) of at most ``most_rows`` distinct rows (key, text, label), those whose keys have the least hash.

    No more than ``most_bytes`` of text, but one row at least. Only rows whose hash lies under a bound that some times as
    many rows should pass are shuffled, as hashes and lengths, and the bound is raised until enough do; the texts of the
    chosen ones alone come to the driver. Equal rows count once, whatever share of the table they are.
    """
    light = rows.select("key", "label", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n"))
    share = 4 * most_rows / max(rows.count(), 1)
    while True:
        some = light.filter(F.xxhash64("key") <= F.lit(int(-(2**63) + share * 2**64))) if share < 1 else light
        first = some.distinct().orderBy(F.xxhash64("key"), "key", "h", "label").limit(most_rows).collect()
        if len(first) == most_rows or share >= 1:
            break
        share *= 16
    chosen, size = [], 0
    for r in first:
        size += r.n or 0
        if chosen and size > most_bytes:
            break
        chosen.append((len(chosen), r.key, r.label, r.h))
    if not chosen:
        return []
    schema = f"place int, key {rows.schema['key'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, h long"
    wanted = F.broadcast(rows.sparkSession.createDataFrame(chosen, schema))  # most_rows at most
    got = rows.withColumn("h", F.xxhash64("text")).join(wanted, ["key", "label", "h"]).groupBy("place").agg(F.first("text").alias("text"), F.first("label").alias("label"))
    return [(r.text, r.label) for r in sorted(got.collect(), key=lambda r: r.place)]
