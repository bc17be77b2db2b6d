"""The queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitat.llm import ann, bpe, conversation_trie, hard_negatives, mixing, near_dedup, personal_data, quality, secrets, sharding, suffix_dedup, topk, toxicity
from habitat.llm.common import read


def op1_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_report(read(spark, sf, "documents"))


def op2_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf, "documents"), width=3, percent=85)


def op3_nearest(spark: SparkSession, sf: str) -> DataFrame:
    table = read(spark, sf, "embeddings")
    return ann.nearest(table, table.filter("vec_id % 100 = 0"))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity_report(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op5_top_products(spark: SparkSession, sf: str) -> DataFrame:
    table = read(spark, sf, "embeddings")
    return topk.top_products(table, table.filter("vec_id % 50 = 0"))


def op6_remove_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf, "documents")).drop("kept")


def op7_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf, "documents"))


def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(bpe.encode(read(spark, sf, "documents")))


def op9_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_report(read(spark, sf, "documents"))


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_report(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    table = read(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table.withColumn("label", label), "vec_id % 50 = 0")


def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_trie.conversation_trie(read(spark, sf, "conversations"))


def op13_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data.personal_data(read(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_nearest": op3_nearest,
    "op4_toxicity": op4_toxicity,
    "op5_top_products": op5_top_products,
    "op6_remove_repeats": op6_remove_repeats,
    "op7_mix_sources": op7_mix_sources,
    "op8_bpe": op8_bpe,
    "op9_shards": op9_shards,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_personal_data": op13_personal_data,
}
