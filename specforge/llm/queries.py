"""The queries of this package, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, media, mixing, neardup, ngrams, packing, repetition, sharding, suffixes, toxicity
from .common import documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(documents(spark, sf_dir)).drop("covered_words", "longest_repeat")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash": neardup.ORACLE, "op5_mixing": mixing.ORACLE, "op6_chat": chat.ORACLE, "op10_repetition": repetition.ORACLE}
