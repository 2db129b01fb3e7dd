"""Global numbering without a single-partition sort, and spreading of small inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import plan_bytes, small, written


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds 0, 1, 2 ... in the given order (which must be total to be repeatable).

    Rows are range-partitioned and written, so that both jobs see the same ranges and lost
    executors lose nothing; a count for each range gives the offsets (a row for each range).
    """
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = written(counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")), "offsets")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = ranged.withColumn("_in_part", inside).join(small(offsets), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_in_part") - 1).drop("_part", "_in_part", "_before")


def number_lines(lines: DataFrame, name: str, per_record: int = 1) -> DataFrame:
    """Numbers the rows of a scan of text files: ``name`` in their file, and _record, the number over all files
    (ordered by path) of the record of ``per_record`` lines that holds the row.  No shuffle of lines.

    A split of a file is read in order by one task, so a row's place in it follows from its running id; the
    splits' counts (a row for each split) give the places of splits in files and of files in the whole.  The scan is
    written once with its splits' names, since a second one may have other splits.
    """
    scan = written(lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mono")), "lines")
    splits = scan.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))
    splits = written(splits, "splits")
    here = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block")) - F.col("_n")
    files = splits.groupBy("_file").agg(F.ceil(F.sum("_n") / per_record).alias("_records"))
    files = files.select("_file", (F.sum("_records").over(Window.orderBy("_file")) - F.col("_records")).alias("_base"))
    places = written(splits.select("_file", "_block", (here - F.col("_first")).alias("_shift")).join(files, "_file"), "places")
    out = scan.join(small(places), ["_file", "_block"]).withColumn(name, F.col("_mono") + F.col("_shift"))
    return out.withColumn("_record", F.col("_base") + F.floor(F.col(name) / per_record)).drop("_file", "_block", "_mono", "_shift", "_base")


def spread(df: DataFrame, per_task: int = 8 << 20, size: int | None = None) -> DataFrame:
    """Deals rows out to all cores, in tasks of about per_task of the optimizer's or the given bytes, so that tasks do not grow with the input or its row groups."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-(plan_bytes(df) if size is None else size) // per_task)))
