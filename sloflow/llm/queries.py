"""The registered queries: one per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sloflow.llm import (
    best_fit, block_whitening, chat, collision_search, decontaminate, kd_shards, onebit_negatives, secret_scan, simhash_gray, stable_lsh,
    token_files, toxic_gru, zstd_language,
)
from sloflow.llm.common import table
from sloflow.session import shared_dir

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
SHARDS = 24


def held_out(modulus: int, remainder: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(own), public_tokenizers.path(BYTE_BPE)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return secret_scan.digests(found)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(docs, path, public_tokenizers.path(BYTE_BPE), end_id=2)
    return token_files.read_token_files(spark, path, with_ids=False)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kd_shards.kd_shards(table(spark, sf_dir, "documents"), SHARDS)
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op6_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = simhash_gray.written(simhash_gray.fingerprints(docs).drop("text").withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    found = simhash_gray.groups(marked).select("fp", "component_id")
    return marked.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return best_fit.pack(best_fit.pieces(docs, public_tokenizers.path(WORD_BPE), end_id=1))


def op8_stable_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_lsh.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = zstd_language.learn(docs.where(~held_out(5, 0)))
    return zstd_language.classify(docs, model).select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def toxicity_model(docs: DataFrame, labels: DataFrame):
    """The network learned from labels whose crc32(doc_id as text) mod 4 is not 2."""
    return toxic_gru.learn(docs, labels.where(~held_out(4, 2)))


def op10_toxic_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxic_gru.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxic_gru.THRESHOLD).cast("int").alias("predicted"))


def op11_onebit_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return onebit_negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_secret_scan, op3_token_files, op4_decontaminate, op5_kd_shards, op6_simhash_gray, op7_best_fit,
        op8_stable_lsh, op9_zstd_language, op10_toxic_gru, op11_onebit_negatives, op12_collision_search, op13_block_whitening,
    )
}
