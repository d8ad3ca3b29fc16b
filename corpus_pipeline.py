"""A corpus cleaned in stages: quality, near-duplicates, benchmark passages, secrets, and at last tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but the last return the columns
of ``documents``; every result is written to the shared folder and read again as the next stage's ``docs``.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ties, extra columns and empty tables: null
and empty texts are judged as an empty text, texts count whole, rows that are equal share their fate (of near-duplicates one
stays), all columns but those that a stage is there to change stay as they are, and nothing comes of nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, decontaminate, quality, secret_scan, simhash
from siltstone.llm.shared import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It learns from labels of documents that are still there."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the least doc_id.  Near are texts that share 80 % of
    their five-word shingles, and those within two bits."""
    return simhash.keep_one(docs, similar=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows."""
    done = secret_scan.redact(docs)
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests that show they decode to the same bytes."""
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("byte-level BPE encoding and decoding", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows (doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs


#: SQL expresses neither the trained classifier nor byte pairs; tests/llm compares each stage with a plain version.
ORACLE_SQL = None
