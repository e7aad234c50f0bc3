"""From raw documents to packed batches: toxicity, near-duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specforge.llm import mixing, neardup, packing, suffixes, toxicity
from specforge.llm.common import documents, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Least similarity, in percent, of word shingles; 85 is for query op4 only.
NEAR_COPIES = 80
#: Repeated passages of over 50 words, and of 400 bytes with fewer words.
PASSAGES = (suffixes.WORDS, suffixes.BYTES)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.representatives(docs, similar=NEAR_COPIES)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.remaining(docs, PASSAGES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("pack", pack_batches),
]

#: Not expressible: a trained classifier comes first.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage's output is written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
