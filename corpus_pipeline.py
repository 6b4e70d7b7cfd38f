"""From raw documents to packed training sequences.

Quality classifier, exact dedup, near dedup, mixing and packing, in this order. Each stage works
on all that its predecessor kept; its result is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quiltframe.llm import exact_dedup, minhash, mixing, packing, quality
from quiltframe.llm.common import deleted, shared_folder, table
from quiltframe.llm.queries import vocabulary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id."""
    return exact_dedup.distinct_documents(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the smallest doc_id."""
    return minhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.packed(docs, vocabulary())


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", unlike), ("mixing", mix), ("packing", pack)]

#: Scores, sketches and tokens can't be had in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage wrote is deleted once the next has read it."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        to = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
        if read:
            deleted(spark, read)
        read = to
    return docs
