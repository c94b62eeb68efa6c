"""A training corpus from raw documents, in four stages; each works on all that the one before kept.

Quality classifier (rejected documents go), MinHash near-dedup (one document of
each group stays), secret scans (secrets are masked), best-fit packing (the
pieces of the packed sequences). Every stage takes and returns the columns of
documents, but for the last, which returns one row per piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from markgrove.llm import near_dedup, packing, quality, secrets
from markgrove.llm.common import drop_tables, prepare, settle, table, written


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the labelled good documents (operator 8)."""
    prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more, the least doc_id of each group stays (operator 10)."""
    prepare(spark)
    return near_dedup.keep_one(docs, words=5, percent=80, half=3, tables=10)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span becomes a mask; n_chars follows the text (operator 9)."""
    prepare(spark)
    return secrets.redact(docs, length="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as it can (operator 5)."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("quality classifier", keep_good_documents),
    ("near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: Generative models and tokenizers are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again as the next one's input.

    Once it is written, all tables of its stage and the one before are dropped.
    """
    docs = table(spark, sf_dir, "documents")
    first = written()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            last = written()
            docs = settle(docs, f"stage{i}")
            drop_tables(spark, first, last)
            first = last
    return docs
