"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import bpe, chat, decontaminate, flac, infill, language, minhash, oracles, quality, sharding, tokencount, toxicity, warc, whitening
from undula.llm._store import stash

SHARDS = 16


#: Bytes of an Arrow batch on its way to a worker; Spark's own bound, which holds for other callers, is 64 MB.
ARROW_BYTES = 2 << 20


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    trees = {"shard": sharding.build_tree(SHARDS), "grown_shard": sharding.build_tree(SHARDS + 1)}
    placed = stash(sharding.assign(docs, "doc_id", trees), "op1")
    return sharding.number_slots(placed, "shard", "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), "doc_id", "text", *_vocabulary())


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), "doc_id", "text", width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stash(warc.write(_read(spark, sf_dir, "pages"), "page_id", "url", "html"), "warc")
    return warc.read(archives, "page_id", payload=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    out = toxicity.held_out("doc_id", 4, 2)
    model = toxicity.fit(*toxicity.sample(docs, labels.filter(~out), "doc_id", "text", "toxic"))
    return toxicity.scores(docs, model, "doc_id", "text").select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    out = toxicity.held_out("doc_id", 4, 2)
    stats = stash(quality.measure(docs, "doc_id", "text"), "stats")
    model = quality.fit(stats, labels.filter(~out), "doc_id", "quality")
    return quality.scores(stats, model, "doc_id").select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = toxicity.held_out("doc_id", 3, 1)
    model = language.fit(*language.sample(docs, "doc_id", "text", "lang", ~out))
    return language.identify(docs, model, "doc_id", "text").select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = flac.load(flac.store(_read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -flac.UNIT, flac.UNIT)).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_windows(rows.unionByName(own), "conv_id", "turn", "role", "text"), "conv_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors, "embedding")
    error = whitening.identity_error(vectors, model, "embedding")
    each = whitening.whiten(vectors, model, "vec_id", "embedding").select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, model.explained or [0.0])), F.col("place") + 1)
    return each.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.transform(_read(spark, sf_dir, "documents"), "doc_id", "text")
    cut = cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", F.sha2("output", 256).alias("output_sha256"))
    return infill.restore(cut).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.counts(_read(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_flac_media": op7_flac_media,
    "op8_chat_format": op8_chat_format,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_id": op10_language_id,
    "op11_whitening": op11_whitening,
    "op12_infill": op12_infill,
    "op13_token_counts": op13_token_counts,
}

ORACLES: dict[str, str] = {"op1_sharding": oracles.SHARDING, "op3_minhash_dedup": oracles.NEAR_DUPLICATES, "op4_warc": oracles.WARC, "op12_infill": oracles.INFILL}
