"""From raw documents to token ids: quality, language, near-dedup, decontamination, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undula.llm import stages
from undula.llm._store import drop_since, drop_stash, made, stash

STAGES = [
    ("quality", stages.quality_filter),
    ("language", stages.language_filter),
    ("near_dedup", stages.near_dedup),
    ("decontaminate", stages.decontaminate_filter),
    ("byte_bpe", stages.encode),
]

#: SQL can express none of the trained stages; tests/llm/test_queries.py holds all rows against plain stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage over ``documents``, written as Parquet and read again in between.

    Once a stage's rows are written, the tables that it made on the way and the rows that it read are deleted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark = made()
        kept = stash(stage(spark, docs, sf_dir), name)
        drop_since(mark, kept)
        drop_stash(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
