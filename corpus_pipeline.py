"""Corpus pipeline: quality, near duplicates, mixture, packing; each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.llm import mixing, packing, simhash, subword
from stallkeeper.llm.common import staged, table
from stallkeeper.llm.queries import BYTE_BPE, QUALITY, WEIGHTS, domain_model, quality_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    return subword.accepted(docs, quality_model(spark, sf_dir), 1, QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the smallest doc_id: candidates by SimHash, then by bands of MinHashes, compared whole."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as their rates say, so that the domains' expected tokens meet the target shares.

    The domains are those of accepted quality: the others went with the first stage.
    """
    model = domain_model(spark, sf_dir, "quality = 1")
    return mixing.resample(docs, model, {k: v for k, v in WEIGHTS.items() if k.endswith(" 1")})[0]


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 2048 token ids: the pieces of every document with their place."""
    pieces = packing.pack(docs, BYTE_BPE)
    return pieces.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", F.crc32("ids").alias("ids_crc32"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packed", packed)]
#: The stages learn models and hash texts, which SQL can't express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
