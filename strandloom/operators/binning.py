"""Bins of reads by the number of their unikmers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import number_rows
from ..functions.sequences import min_bin_bases, round_to_500
from ..functions.storage import small, written

#: Statistics start at 50 unikmers; counts up to 5 are bins of their own.
START_COUNT, FIXED = 50, 5


def barcode_distribution(barcoded: DataFrame) -> DataFrame:
    """n_barcodes, n_reads, sum_bases."""
    return barcoded.groupBy("n_barcodes").agg(F.count("*").alias("n_reads"), F.sum(F.col("read_len").cast("bigint")).alias("sum_bases"))


def bin_bounds(distribution: DataFrame, start: int = START_COUNT) -> DataFrame:
    """One row: mean, std, lower, upper, adjusted (upper to the nearest 500), over reads with at least start unikmers; nulls without such reads."""
    rows = distribution.where(F.col("n_barcodes") >= start)
    c, n = F.col("n_barcodes").cast("double"), F.col("n_reads").cast("double")
    mean = rows.agg((F.sum(c * n) / F.sum(n)).alias("mean"))
    std = rows.crossJoin(F.broadcast(mean)).agg(F.sqrt(F.sum(n * (c - F.col("mean")) * (c - F.col("mean"))) / F.sum(n)).alias("std"))
    out = mean.crossJoin(F.broadcast(std))
    lower = F.when(F.col("mean").isNotNull(), F.greatest(F.floor(F.col("mean") - 3 * F.col("std")), F.lit(start)))
    out = out.select("mean", "std", lower.cast("bigint").alias("lower"), F.ceil(F.col("mean") + 3 * F.col("std")).cast("bigint").alias("upper"))
    return out.withColumn("adjusted", round_to_500(F.col("upper")))


def bin_starts(distribution: DataFrame, bounds: DataFrame, min_bases: int) -> DataFrame:
    """n_barcodes, bin_id for the counts above 5 up to the adjusted bound.

    A running sum that starts anew when a bin is full is sequential; it folds over the
    distribution, which has one row for each distinct count, inside one expression.
    """
    rows = distribution.crossJoin(F.broadcast(bounds.select("adjusted"))).where(f"n_barcodes > {FIXED} and n_barcodes <= adjusted")
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(F.col("n_barcodes").cast("bigint").alias("c"), F.col("sum_bases").cast("bigint").alias("b")))).alias("cs"))
    fold = f"""aggregate(cs, named_struct('ws', CAST(NULL AS BIGINT), 'acc', CAST(0 AS BIGINT), 'out', CAST(array() AS ARRAY<STRUCT<c: BIGINT, ws: BIGINT>>)),
      (s, x) -> IF(s.ws IS NULL OR s.acc >= {int(min_bases)},
        named_struct('ws', x.c, 'acc', x.b, 'out', concat(s.out, array(named_struct('c', x.c, 'ws', x.c)))),
        named_struct('ws', s.ws, 'acc', s.acc + x.b, 'out', concat(s.out, array(named_struct('c', x.c, 'ws', s.ws))))), s -> s.out)"""
    return listed.select(F.explode(F.expr(fold)).alias("_o")).select(F.col("_o.c").cast("int").alias("n_barcodes"), F.col("_o.ws").alias("bin_id"))


def bin_dimension(distribution: DataFrame, bounds: DataFrame, starts: DataFrame, min_bases: int) -> DataFrame:
    """bin_id, bin_ord of all bins in the order they are made: fixed, dynamic, a bin opened by a closing last window if the last count above 5 exceeds the bound, and overflow."""
    adjusted = F.broadcast(bounds.select("adjusted"))
    fixed = distribution.where(F.col("n_barcodes") <= FIXED).select(F.col("n_barcodes").cast("bigint").alias("bin_id"))
    dynamic = starts.select("bin_id").distinct()
    # a full last window opens one at the next count, whatever it is
    last = starts.groupBy().agg(F.max("bin_id").alias("w"), F.max("n_barcodes").alias("c")).where("w is not null")
    held = starts.join(distribution, "n_barcodes").groupBy("bin_id").agg(F.sum("sum_bases").alias("acc"))
    after = distribution.crossJoin(F.broadcast(last)).where("n_barcodes > c").groupBy("w").agg(F.min("n_barcodes").cast("bigint").alias("bin_id"))
    phantom = after.join(held.withColumnRenamed("bin_id", "w"), "w").where(F.col("acc") >= min_bases).select("bin_id")
    # the first window may stand above the bound when no count lies below it
    first = distribution.where(F.col("n_barcodes") > FIXED).agg(F.min("n_barcodes").cast("bigint").alias("bin_id")).where("bin_id is not null")
    inner = fixed.union(dynamic).union(phantom).union(first).distinct().withColumn("_last", F.lit(0))
    over = bounds.select((F.col("adjusted") + 1).alias("bin_id"), F.lit(1).alias("_last")).where("bin_id is not null")
    inner = inner.join(over.select("bin_id"), "bin_id", "left_anti").select("bin_id", "_last")
    return inner.union(over).select("bin_id", F.row_number().over(Window.orderBy("_last", "bin_id")).alias("bin_ord"))


def bin_reads(barcoded: DataFrame, genome_size: int, coverage: float) -> DataFrame | None:
    """bin_id, read_id, read_len, rank_in_bin (longest first, ties by read_int); None when the genome is too small for bins.

    Ranks are global to a bin, so the rows of a bin are range-sorted, not gathered: see rank_in_bins.
    """
    min_bases = min_bin_bases(genome_size, coverage)
    if min_bases is None:
        return None
    distribution = written(barcode_distribution(barcoded), "distribution")  # a row for each distinct count
    bounds = bin_bounds(distribution)
    of = bin_starts(distribution, bounds, min_bases)
    rows = barcoded.select("read_id", "read_int", "read_len", "n_barcodes").join(small(written(of, "bins")), "n_barcodes", "left").crossJoin(F.broadcast(bounds.select("adjusted")))
    bin_id = F.when(F.col("n_barcodes") <= FIXED, F.col("n_barcodes")).when(F.col("n_barcodes") > F.col("adjusted"), F.col("adjusted") + 1).otherwise(F.col("bin_id"))
    return rank_in_bins(rows.select(bin_id.cast("bigint").alias("bin_id"), "read_id", "read_int", "read_len"))


def rank_in_bins(rows: DataFrame) -> DataFrame:
    order = [F.col("bin_id"), F.col("read_len").desc(), F.col("read_int")]
    numbered = number_rows(rows, order, "_n")
    first = written(numbered.groupBy("bin_id").agg(F.min("_n").alias("_first")), "first_of_bins")
    return numbered.join(small(first), "bin_id").select("bin_id", "read_id", "read_len", (F.col("_n") - F.col("_first") + 1).alias("rank_in_bin"))


def bin_summary(dimension: DataFrame, binned: DataFrame, ordered: bool = False) -> DataFrame:
    """bin_id, n_reads, sum_bases for all bins, empty ones too, in bin order; with ordered also bin_ord."""
    sums = binned.groupBy("bin_id").agg(F.count("*").alias("n_reads"), F.sum(F.col("read_len").cast("bigint")).alias("sum_bases"))
    out = dimension.join(sums, "bin_id", "left").orderBy("bin_ord")
    return out.select("bin_id", F.coalesce("n_reads", F.lit(0)).alias("n_reads"), F.coalesce("sum_bases", F.lit(0)).alias("sum_bases"), *(["bin_ord"] if ordered else []))
