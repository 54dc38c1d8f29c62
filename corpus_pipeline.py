"""From raw documents to token ids: the corpus operators as one pipeline.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of docs. run() writes each stage's rows as Parquet and reads them again
for the next one, so that a stage starts from files that every executor can read; a stage's files and
what it wrote on its way are deleted once the next one is written; nothing that other queries wrote is.

Defined cases: null and empty texts fail the quality rules and go; repeated rows are copies, of which
one stays; rows without an id are handled like others; very long texts are processed whole; an empty
table gives an empty table with the last stage's columns; extra columns, also ones named like columns
that stages work with, are kept to the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vocaris.llm import bpe, exact_dedup, mixing, near_dedup, quality
from vocaris.llm.frames import delete, owned, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one stays."""
    return near_dedup.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, ids_sha256, decoded_sha256 of every row of the mix."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, ids_col="token_ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixed_sources", mixed_sources),
    ("tokens", tokens),
]

#: SQL has neither zstandard nor BPE; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with owned(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
