"""Corpus pipeline: documents -> toxicity, quality rules, exact and near deduplication, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; between
stages the rows are written as Parquet and read again. All stages but the last return the columns
of documents. Nulls, empty texts, repeated rows and empty tables are treated as the operators say.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelens.llm import exact_dedup, packing, quality, simhash, toxicity
from tapelens.llm.common import scratch, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break the rules or fall below the likelihood ratio go."""
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the document with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that stayed, cut and packed into sequences."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("packing", pack),
]

#: The toxicity score and the fingerprints have no SQL form; tests compare with a brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, folder, f"stage{k}")
    return docs
