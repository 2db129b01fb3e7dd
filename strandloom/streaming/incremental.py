"""K-mer counts over a growing folder of read tables, as a Structured Streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.storage import exists
from ..operators.kmers import kmer_counts
from ..sources.readers import READ_SCHEMA


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Reads (Parquet) that arrive in a folder."""
    return spark.readStream.schema(READ_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def count_stream(reads: DataFrame, table: str, checkpoint: str, k: int = 21) -> StreamingQuery:
    """Adds the counts of each micro-batch to the folder ``table``; progress is in the checkpoint folder.

    A batch writes a folder of its own, which a repeated batch replaces, so that each read counts once.
    Executors write the counts; none passes through the driver.
    """

    def add(batch: DataFrame, number: int) -> None:
        kmer_counts(batch, k).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_counts(spark: SparkSession, table: str) -> DataFrame:
    """kmer, n of all batches so far."""
    if not exists(spark, table):
        return spark.createDataFrame([], "kmer string, n bigint")
    return spark.read.parquet(table).groupBy("kmer").agg(F.sum("n").alias("n"))
