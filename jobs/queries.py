"""The jobs as queries: each runs twice into one new folder in the shared folder, and returns what stands there then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.storage import scratch_root
from strandloom.queries import P, chosen_reads_sql, code_counts_sql

from . import kmer_spectrum, select_reads


def folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/strandloom-jobs/{name}-{uuid.uuid4().hex}"


def job1_select_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "select_reads")
    config = {x: P[x] for x in ("k", "coverage", "min_overlap")} | {"genome_size": P["genome"]}
    for _ in range(2):
        result = select_reads.run(spark, f"{sf_dir}/documents.parquet", out, config)
    return result.withColumn("barcode", F.array_join(F.col("barcode").cast("array<string>"), ","))


def job2_kmer_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "kmer_spectrum")
    for _ in range(2):
        result = kmer_spectrum.run(spark, f"{sf_dir}/documents.parquet", out, {"k": P["k"]})
    return result


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_select_reads, job2_kmer_spectrum)}


def oracle_sql() -> dict[str, str]:
    return {"job1_select_reads": chosen_reads_sql(), "job2_kmer_spectrum": code_counts_sql(kmer_spectrum.KNOWN["prefix"])}
