"""Shared pieces: prefix sums that never put a whole key into one task, and rows that go through Python
in Arrow batches.  Written tables and size-checked broadcasts come from the library's storage module."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.storage import BROADCAST_BYTES as BROADCAST_BYTES
from ..functions.storage import discard as discard
from ..functions.storage import plan_bytes as plan_bytes
from ..functions.storage import ship as ship
from ..functions.storage import small as small
from ..functions.storage import written as written

#: Characters that count as white space in every contract here.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """For applications whose rows hold whole texts: fewer rows in an Arrow batch than Spark's 10,000, unless the session has another number already.

    Operators leave the session's settings alone.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def power_of_two(least: int, low: int, high: int) -> int:
    return max(low, min(high, 1 << max(0, int(least) - 1).bit_length()))


def unit(h: Column) -> Column:
    """A signed 64-bit hash as a number in [0, 1), in the order of the hash."""
    return F.least(h / F.lit(2.0**64) + F.lit(0.5), F.lit(1.0 - 2.0**-53))


def dense_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds 0, 1, 2 ... in the given order, by range partitions; no task sees all rows."""
    df = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = df.groupBy("_part").agg(F.count("*").alias("_n"))
    parts = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return df.withColumn("_in_part", rank).join(F.broadcast(parts), "_part").withColumn(name, F.col("_before") + F.col("_in_part") - 1).drop("_part", "_in_part", "_before")


def running_before(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of value over the rows of the same key that come before in order; (key, order) is unique.

    By range partitions and their sums, so that no task sees all rows of a key; keys have a row each in the end.
    """
    by = [F.col(key), F.col(order)]
    df = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = df.groupBy("_part").agg(F.sum(value).alias("_n"))
    parts = written(parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base")), "parts")
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_sum", inside).join(small(parts), "_part").withColumn(name, F.col("_base") + F.col("_sum") - F.col(value)).drop("_part", "_base", "_sum")
    df = written(df, "running")
    first = written(df.groupBy(key).agg(F.min(name).alias("_first")), "firsts")
    return df.join(small(first), key).withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., which clash with no operator's own names, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def mapped(df: DataFrame, keep: list[str], value: str, fields: list[StructField], make: Callable) -> DataFrame:
    """The columns keep of df with the columns fields, which make() gives as arrays for a list of values.

    Rows go through Python in Arrow batches, without a shuffle.  value may be one of keep;
    columns travel under numbers, so that no name can clash.
    """
    ship(df.sparkSession)
    names = [f"_c{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], *([] if value in keep else [F.col(f"`{value}`").alias("_value")]))
    at = keep.index(value) if value in keep else len(keep)
    new = [f"_n{i}" for i in range(len(fields))]
    schema = StructType([*rows.schema.fields[: len(keep)], *[StructField(n, f.dataType) for n, f in zip(new, fields)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *make(part.column(at).to_pylist())], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *[F.col(n).alias(f.name) for n, f in zip(new, fields)])


#: Rows of Spark's bitmaps hold so many bits.
PIECE = 1 << 15


def maybe_in(rows: DataFrame, value: Column, hashes: DataFrame, max_bits: int = 1 << 27) -> DataFrame:
    """rows with _maybe: false only where value is not among the _hash of hashes, by a broadcast bitmap of at most max_bits / 8 bytes."""
    bits = power_of_two(16 * hashes.count(), PIECE, max_bits)
    at = F.pmod(F.col("_hash"), F.lit(bits))
    pieces = hashes.select(F.floor(at / PIECE).alias("_piece"), (at % PIECE).alias("_bit")).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    at = F.pmod(value, F.lit(bits))
    met = rows.select("*", F.floor(at / PIECE).alias("_piece"), (at % PIECE).alias("_bit")).join(F.broadcast(pieces), "_piece", "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1") == 1, F.lit(False))
    return met.withColumn("_byte", byte).withColumn("_maybe", maybe).drop("_piece", "_bit", "_bits", "_byte")
