"""Column functions on sequences and barcodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, COMPLEMENT, DIGITS = "ACGT", "TGCA", "0123"


def normalised(seq: Column) -> Column:
    """Upper case; letters outside ACGT stay and break k-mers."""
    return F.upper(seq)


def encode2bit(kmer: Column) -> Column:
    """A=0 C=1 G=2 T=3, first base highest, as a bigint; other letters count as A; up to 31 bases."""
    known = F.regexp_replace(F.upper(kmer), "[^ACGT]", "A")
    return F.conv(F.translate(known, BASES, DIGITS), 4, 10).cast("bigint")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENT))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement; string order is code order."""
    return F.least(kmer, reverse_complement(kmer))


def is_acgt(kmer: Column) -> Column:
    return ~F.upper(kmer).rlike("[^ACGT]")


def end_window(n: Column, fraction: float, cap: int) -> Column:
    """Length of the window at either end of n ids: truncated share, capped."""
    return F.least(F.floor(n * F.lit(float(fraction))).cast("int"), F.lit(cap))


def key_starts(n: Column, full: Column, k: int, fraction: float, cap: int, stride: int) -> Column:
    """0-based starts of the indexed keys: every one for full reads, else strided ones of both end windows; empty if none fits."""
    w = end_window(n, fraction, cap)
    none = F.array().cast("array<int>")
    ends = F.array_distinct(F.concat(F.sequence(F.lit(0), w - k, F.lit(stride)), F.sequence(n - w, n - k, F.lit(stride))))
    return F.when(full, F.when(n >= k, F.sequence(F.lit(0), n - k, F.lit(1))).otherwise(none)).otherwise(F.when(w >= k, ends).otherwise(none))


def fingerprint(ids: Column) -> Column:
    """SHA-256 of the count and the ids, each as eight big-endian bytes, in order."""
    hex16 = lambda x: F.lpad(F.hex(x.cast("bigint")), 16, "0")
    return F.sha2(F.unhex(F.concat(hex16(F.size(ids)), F.array_join(F.transform(ids, hex16), ""))), 256)


def round_to_500(x: Column) -> Column:
    """The nearest multiple of 500, halves to even."""
    return (F.bround(x / 500.0) * 500).cast("bigint")


#: Genome sizes below the limit use the divisor; larger ones the last.
DIVISORS = ((500_000, None), (5_000_000, 100), (50_000_000, 1_000), (500_000_000, 10_000), (None, 100_000))


def min_bin_bases(genome_size: int, coverage: float) -> int | None:
    """Bases that close a bin; None when the genome is too small for bins."""
    for limit, divisor in DIVISORS:
        if limit is None or genome_size < limit:
            return None if divisor is None else int(genome_size * coverage / divisor)
    raise AssertionError
