"""Readers: sequence files, k-mer lists, histograms, assembly graphs and Parquet tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import number_lines, number_rows
from ..functions.sequences import canonical
from ..functions.storage import listing, qualified, small, written
from .scan import SPLIT_BYTES, can_open, scan_records
from .writers import FENCE

READ_SCHEMA = "read_id string, read_int bigint, file_ord bigint, seq string, read_len int"


def sequence_format(path: str) -> str:
    """'fastq' or 'fasta' by the suffix, gzipped or not; ValueError for others."""
    if m := re.search(r"\.(fastq|fasta|fa)(\.gz)?$", path.lower()):
        return "fastq" if m[1] == "fastq" else "fasta"
    raise ValueError(f"not a sequence file by its suffix: {path}")


def format_of(spark: SparkSession, path: str) -> str:
    """'fastq' if all files at the path end in .fastq, gzipped or not, 'fasta' if none does; ValueError for a mixture."""
    kinds = {bool(re.search(r"\.fastq(\.gz)?$", name)) for name, _, _ in listing(spark, path)}
    if len(kinds) > 1:
        raise ValueError(f"FASTQ files among others: {path}")
    return "fastq" if kinds == {True} else "fasta"


#: A record's place: its file's number above its first byte there.
PLACE_BITS = 44


def read_records(spark: SparkSession, path: str, fmt: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """read_id, file_ord, seq, read_len of every record of a file, folder or glob; file_ord grows with the order of files by path and of records in them.

    The id is the header up to the first white space.  FASTQ records have four lines; a
    quality line may start like a header.  Files with other suffixes than .fastq are read as FASTA.
    Gzipped files are unpacked.  Lines may end in CR LF.  An empty file has no records.
    Files that only Hadoop's file systems can open go through Spark's text reader and are written once, with their lines' places.
    """
    files = [(name, size) for name, size, _ in listing(spark, path) if size]
    kind = fmt or format_of(spark, path)
    if len(files) >= 1 << (63 - PLACE_BITS):
        raise ValueError(f"more than {1 << (63 - PLACE_BITS)} files: {path}")
    if all(can_open(name) for name, _ in files[:1]):
        records = scan_records(spark, files, kind, split_bytes).select((F.shiftleft(F.col("file").cast("bigint"), PLACE_BITS) + F.col("start")).alias("file_ord"), F.col("head").alias("_head"), "seq")
    else:
        records = text_records(spark, path, kind)
    records = records.select(F.regexp_extract("_head", r"^\s*(\S*)", 1).alias("read_id"), "file_ord", "seq")
    return records.withColumn("read_len", F.length("seq"))


def text_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """file_ord, _head, seq by Spark's text reader; file_ord is the record's number."""
    if kind == "fastq":
        lines = number_lines(spark.read.text(path), "_line", 4)
        place = F.col("_line") % 4
        head, seq = F.max(F.when(place == 0, F.substring("value", 2, 1 << 30))), F.max(F.when(place == 1, F.col("value")))
        records = lines.where(place < 2).groupBy(F.col("_record").alias("file_ord")).agg(head.alias("_head"), seq.alias("seq"))
        return records.withColumn("seq", F.trim("seq"))
    whole = number_lines(spark.read.option("lineSep", "\n>").text(path), "_line").where(F.trim("value") != "")
    value = F.regexp_replace("value", "^>", "")
    return whole.select(F.col("_record").alias("file_ord"), F.regexp_extract(value, r"^[^\r\n]*", 0).alias("_head"), F.regexp_replace(F.regexp_replace(value, r"^[^\r\n]*", ""), r"\s", "").alias("seq"))


def with_read_ints(records: DataFrame) -> DataFrame:
    """Adds read_int: ids are numbered from 0 in the order of first appearance; repeated ids share one."""
    first = records.groupBy("read_id").agg(F.min("file_ord").alias("_first"))
    return records.join(number_rows(first, [F.col("_first"), F.col("read_id")], "read_int").drop("_first"), "read_id")


def last_records(records: DataFrame) -> DataFrame:
    """One record for each id: the last in the file."""
    return records.groupBy("read_id").agg(F.max_by(F.struct(*[c for c in records.columns if c != "read_id"]), "file_ord").alias("_r")).select("read_id", "_r.*")


def read_unikmers(spark: SparkSession, path: str) -> DataFrame:
    """kmer (canonical), unikmer_id from a list with a k-mer a line; ids are line numbers (of files in the order of their paths), the last of equal k-mers counts."""
    lines = number_lines(spark.read.text(path), "_line")
    kmer = canonical(F.regexp_replace(F.upper(F.trim("value")), "[^ACGT]", "A"))
    return lines.where(F.trim("value") != "").groupBy(kmer.alias("kmer")).agg(F.max("_record").alias("unikmer_id"))


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """freq, n_kmers from white-space separated lines; the row of frequency 0 is kept, the statistics skip it."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("bigint").alias("freq"), parts[1].cast("bigint").alias("n_kmers"))


def read_gfa_segments(spark: SparkSession, path: str) -> DataFrame:
    """name, seq of the segment lines of an assembly graph."""
    parts = F.split("value", r"\s+")
    return spark.read.text(path).where(F.col("value").startswith("S")).select(parts[1].alias("name"), parts[2].alias("seq"))


def barcode_of(barcodes: DataFrame, read_int: int) -> tuple[int, list[int]]:
    """Point lookup: (read_len, barcode); the filter reaches the Parquet scan.  KeyError if the read is not there."""
    row = barcodes.where(F.col("read_int") == read_int).select("read_len", "barcode").first()
    if row is None:
        raise KeyError(read_int)
    return row["read_len"], list(row["barcode"])


def read_bucketed(spark: SparkSession, path: str, column: str, buckets: int) -> DataFrame:
    """A table that write_bucketed wrote with the same column and number of buckets."""
    name, columns = f"strandloom_{uuid.uuid4().hex}", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{column}`) SORTED BY (`{column}`) INTO {int(buckets)} BUCKETS LOCATION '{qualified(spark, path)}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")  # of other files than its own: they stay, and the table's plan has them


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """key, read_int, file_ord, start of the index at a path (see write_head_index) for a table of keys (key).

    Only the files between whose first and last keys some key lies are read.  Repeated keys are looked up once.
    """
    keys = written(keys.select("key").distinct(), "asked")
    fence = spark.read.parquet(f"{path.rstrip('/')}{FENCE}")  # a row for each file
    files = keys.join(F.broadcast(fence), F.col("key").between(F.col("first"), F.col("last"))).select("file").distinct()
    found = sorted(r["file"] for r in files.collect())
    schema = spark.read.parquet(path).schema
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*found).join(small(keys), "key", "left_semi")


def postings_of(head_index: DataFrame, key: list[int], k: int) -> list[int]:
    """Reads of one key in posting order, repeats kept; ValueError for a key of another length."""
    if len(key) != k:
        raise ValueError(f"a key has {k} ids, not {len(key)}")
    at = F.col("key") == F.array(*[F.lit(int(x)).cast("bigint") for x in key])
    return [r["read_int"] for r in head_index.where(at).orderBy("file_ord", "start").collect()]
