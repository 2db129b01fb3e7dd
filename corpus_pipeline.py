"""A corpus pipeline in five stages, each of them an operator of ``strandloom.llm``.

Every stage works on all rows that its predecessor kept, and is written as Parquet and read
again by the next one.  Stages 1 to 4 return the columns of ``documents``; the last returns
the digests of the encoded documents, a row for each copy that the mix takes.

Nulls, empty and very long texts, ties, repeated rows and empty tables have the results that the stages'
operators state; documents without a letter go in the first stage.  Further columns travel through stages 1 to 4
under numbers, so that their names cannot clash.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from strandloom.llm.common import ship, small_batches, written

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Pieces of a generation of the tokenizer's cache: fewer than usual, since its workers hold what other stages have left.
CACHE = 150_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; lang becomes the language found."""
    small_batches(spark)
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest doc_id, of each group of equal normalised texts."""
    small_batches(spark)
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest doc_id, of each group of near duplicates."""
    small_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in training order, by the sources' target weights."""
    small_batches(spark)
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    small_batches(spark)
    return bpe.round_trip_digests(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, cache=CACHE)


STAGES = [("language_id", identify_language), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix_sources", mix_sources), ("encode", encode)]

#: SQL cannot express the first, third and fifth stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
