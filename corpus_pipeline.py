"""From ``documents`` to packed training sequences, in five stages.

Each stage takes all that the one before it kept, as Parquet. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _common, mixing, packing, simhash, substring_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones outside the held-out fold, calls toxic go."""
    _common.ship(spark)
    return toxicity.without_toxic(docs, toxicity.train(*toxicity.training_rows(docs, _common.table(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the least id stays."""
    _common.ship(spark)
    return simhash.without_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a repeated window of 35 words covers go; documents all stay."""
    _common.ship(spark)
    return substring_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their targets: documents repeat, are cut or go."""
    _common.ship(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    _common.ship(spark)
    return packing.pack_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and fingerprints are beyond SQL; tests/llm holds each stage against a plain version of it on all that the stage before kept, and run()
#: against the stages chained by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = _common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
