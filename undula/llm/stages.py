"""The stages of corpus_pipeline.py: each takes (spark, docs, sf_dir), and all but the last return the columns of documents.

Defined results: rows with a null doc_id are judged by their text where a stage needs no id, and pass the near-dedup
stage as they are; rows that repeat a doc_id are one node of near-dedup, but rows of their own: one row of each of its
texts (sets of shingles) that nothing with a lesser id holds stays; ties of equal rows go to any one of them, which are
alike; texts of any length are judged whole, in blocks; further columns pass as they are, whatever their names; an empty
table passes every stage as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import bpe, decontaminate, language, minhash, quality, toxicity
from undula.llm._skew import bitmap, bucket, has_bit
from undula.llm._store import stash
from undula.llm.queries import _read, _vocabulary

LEAST_QUALITY = 0.7
#: Texts' bytes that the encoder handles at a time: by then the stages before it have grown an executor's own memory.
SLICE_BYTES = 1 << 20
#: Documents whose language's probability lies less than this share of the way from chance to 1 are rejected.
LEAST_LANGUAGE = 0.15


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").filter(~toxicity.held_out("doc_id", 4, 2))
    # only documents that may be labelled are measured to learn from: a bitmap of their ids (1 MB) goes to the documents
    some = docs.select("doc_id", "text").join(F.broadcast(bitmap(labels.select("doc_id"))), bucket("doc_id")).filter(has_bit("doc_id"))
    model = quality.fit(quality.measure(some, "doc_id", "text"), labels, "doc_id", "quality")
    return quality.keep(docs, model, "text", LEAST_QUALITY)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(*language.sample(docs, "doc_id", "text", "lang", ~toxicity.held_out("doc_id", 3, 1)))
    return language.keep(docs, model, "text", LEAST_LANGUAGE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = stash(minhash.near_duplicates(docs, "doc_id", "text", width=5, percent=80).filter("doc_id is not null"), "judged")
    names = f0, f1 = [next(n for k in range(len(docs.columns) + 1) if (n := f"{c}_{k}") not in {x.lower() for x in docs.columns}) for c in ("__f0", "__f1")]
    kept = judged.filter("kept").select("doc_id", F.col("f0").alias(f0), F.col("f1").alias(f1))
    again = stash(judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "again")
    null = docs.filter(F.col("doc_id").isNull())
    if again.isEmpty():
        return docs.join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(null)
    once = docs.join(kept.join(again, "doc_id", "left_anti"), "doc_id", "left_semi").select(docs.columns)
    rows = stash(minhash.with_prints(docs.join(again, "doc_id", "left_semi"), "text", 5, tuple(names)), "rows")
    rows = rows.join(kept.distinct(), ["doc_id", *names], "left_semi").dropDuplicates(["doc_id", *names])
    return once.unionByName(rows.select(docs.columns)).unionByName(null)


def decontaminate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep(docs, _read(spark, sf_dir, "benchmark"), "text", "item_id", "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, "doc_id", "text", *_vocabulary(), slice_bytes=SLICE_BYTES)
