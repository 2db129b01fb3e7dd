"""Writers: Parquet stores, FASTA, lists and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_store(df: DataFrame, path: str, sort: str | None = None) -> None:
    """Parquet, replacing what is there; sorted inside partitions so that lookups prune row groups."""
    (df.repartitionByRange(sort).sortWithinPartitions(sort) if sort else df).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, path: str, column: str, buckets: int) -> None:
    """Parquet in buckets of a column, replacing what is there: tables of like buckets are joined on it without an exchange (see readers.read_bucketed)."""
    spark, name = df.sparkSession, f"strandloom_{uuid.uuid4().hex}"
    # one task for each bucket, so that each has one file
    dealt = df.repartition(buckets, column)
    dealt.write.mode("overwrite").bucketBy(buckets, column).sortBy(column).option("path", path).format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay


def write_head_index(index: DataFrame, path: str) -> None:
    """Keys in numeric order over all files, and beside it the fence: a row for each file with its first and last key."""
    index.orderBy("key", "file_ord", "start").write.mode("overwrite").parquet(path)
    stored = index.sparkSession.read.schema(index.schema).parquet(path)
    fence = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("key").alias("first"), F.max("key").alias("last"))
    fence.write.mode("overwrite").parquet(f"{path.rstrip('/')}{FENCE}")


#: What a head index' path is followed by in its fence's.
FENCE = "-fence"


def fasta_lines(records: DataFrame, width: int = 60) -> DataFrame:
    """One row a record: header and sequence wrapped, in file order."""
    wrapped = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), "\n$", "")
    return records.orderBy("file_ord").select(F.concat(F.lit(">"), F.col("read_id"), F.lit("\n"), wrapped).alias("value"))


def write_selected_fasta(records: DataFrame, path: str, width: int = 60, one_file: bool = False) -> None:
    """Selected records (see selection.selected_records) as FASTA; quality and descriptions go.

    Parts are numbered in the order of the records, so that they are one FASTA file when put end to end by their names; one_file
    has one task write a single part, for tools that need one and selections that fit.
    """
    lines = fasta_lines(records, width)
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)


def write_contigs(segments: DataFrame, path: str) -> None:
    """Assembly segments as FASTA, unwrapped."""
    segments.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")).alias("value")).write.mode("overwrite").text(path)


def write_unikmers(unikmers: DataFrame, path: str) -> None:
    unikmers.orderBy("unikmer_id").select("kmer").write.mode("overwrite").text(path)


#: The headers of the reports on reads; the histogram's stands in for a workbook without one.
DISTRIBUTION_HEADER = ("# of unikmers", "# of reads", "sum of bases (bp)")
BIN_HEADER = ("unikmer bin", "# of reads", "sum of bases (bp)")
HISTOGRAM_HEADER = ("frequency", "number of k-mers")


def write_report(df: DataFrame, path: str, header: tuple[str, ...], order: str | None = None) -> None:
    """One CSV file with the report's header, in the order of a column, which is left out if the header is shorter; also the
    stand-in for a workbook.  Reports have a row for each distinct count or bin, so one task sorts them."""
    rows = df.coalesce(1)
    if order:
        rows = rows.sortWithinPartitions(order)
    if len(header) < len(df.columns):
        rows = rows.drop(order)
    # another comment character, since values that begin with the usual one are quoted
    rows.toDF(*header).write.mode("overwrite").option("comment", "\x01").csv(path, header=True)
