"""The frequency window of a k-mer histogram and the k-mers inside it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import number_rows

#: The ratio that ends the first descent, the least lower bound, and the width in deviations.
VALLEY_RATIO, LEAST_LOWER, DEVIATIONS = 1.25, 5, 3


def frequency_window(histogram: DataFrame) -> DataFrame:
    """One row: start_idx, peak_idx, mean, std, lower, upper.

    A histogram has one row for each distinct count, so its rows are few; the window over
    them is the only single-partition step.  The valley is the first row at most 1.25 times
    the next; the peak is the first row anywhere with the largest value from the valley on.
    lower and upper are null when there is no valley or the window is empty.
    """
    w = Window.orderBy("freq")
    rows = histogram.where("freq > 0").select("freq", "n_kmers", (F.row_number().over(w) - 1).alias("idx"), F.lead("n_kmers").over(w).alias("next"))
    start = rows.where(F.col("n_kmers").cast("double") / F.col("next") <= VALLEY_RATIO).agg(F.min("idx").alias("start_idx"))
    rows = rows.crossJoin(F.broadcast(start))  # one row
    top = rows.where("idx >= start_idx").agg(F.max("n_kmers").alias("top"))
    rows = rows.crossJoin(F.broadcast(top))
    peak = rows.where("n_kmers = top").agg(F.min("idx").alias("peak_idx"))
    rows = rows.crossJoin(F.broadcast(peak)).where("idx between start_idx and start_idx + 2 * (peak_idx - start_idx)")
    f, n = F.col("freq").cast("double"), F.col("n_kmers").cast("double")
    mean = rows.agg(F.min("start_idx").alias("start_idx"), F.min("peak_idx").alias("peak_idx"), (F.sum(f * n) / F.sum(n)).alias("mean"))
    spread = rows.select("freq", "n_kmers").crossJoin(F.broadcast(mean.select("mean"))).agg(F.sqrt(F.sum(n * (f - F.col("mean")) * (f - F.col("mean"))) / F.sum(n)).alias("std"))
    out = mean.crossJoin(F.broadcast(spread))
    lower = F.greatest(F.floor(F.col("mean") - DEVIATIONS * F.col("std")), F.lit(LEAST_LOWER))
    return out.select(F.col("start_idx").cast("bigint"), F.col("peak_idx").cast("bigint"), "mean", "std", F.when(F.col("mean").isNotNull(), lower).cast("bigint").alias("lower"), F.ceil(F.col("mean") + DEVIATIONS * F.col("std")).cast("bigint").alias("upper"))


def window_bounds(histogram: DataFrame) -> tuple[int, int]:
    """(lower, upper), or ValueError when the histogram has no valley or an empty window."""
    row = frequency_window(histogram).first()
    if row is None or row["start_idx"] is None:
        raise ValueError("the histogram has no valley: each count falls to less than 0.8 of the one before")
    if row["mean"] is None or math.isnan(row["mean"]):
        raise ValueError("the window is empty: the peak's value occurs before the valley")
    return row["lower"], row["upper"]


def unikmers(counts: DataFrame, lower: int, upper: int) -> DataFrame:
    """kmer or code (what counts has), and unikmer_id, of the k-mers with lower <= n <= upper, numbered in k-mer order."""
    key = "code" if "code" in counts.columns else "kmer"
    return number_rows(counts.where(F.col("n").between(lower, upper) & F.col(key).isNotNull()).select(key), [F.col(key)], "unikmer_id")
