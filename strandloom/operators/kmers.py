"""K-mers of reads: windows, counts, histogram.

Up to 31 bases a canonical k-mer is its 2-bit code in a bigint, made for many reads at once by an
Arrow kernel; code order is string order.  Longer ones are strings, cut in the JVM.

Counting sends no k-mers.  K-mers that follow each other in a read and have the same minimizer (the smallest hash of a canonical
m-mer in them, the same for both strands) travel as one run of packed bases, a quarter byte each, to the bucket of
their minimizer, which holds all occurrences of its k-mers and counts them.  There are as many buckets as the input needs to keep
them small.  A bucket that is large all the same (a minimizer in a third of all reads) is counted in parts, and by code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import BASES, DIGITS, is_acgt, normalised, reverse_complement
from ..functions.storage import plan_bytes, ship, small, written

CHUNK = 96
#: The longest k-mer whose code fits into a bigint.
LONGEST_CODE = 31
#: Bases that one task encodes at a time, and codes that it counts before it sends them on.
TOGETHER, FLUSH = 1 << 21, 1 << 22
#: Bases of a minimizer, and k-mers of a run at most.
MINIMIZER, LONGEST_RUN = 11, 1 << 8
#: Windows and packed runs that are worked on at once, so that they stay in a core's cache.
PIECE, RUNS = 1 << 15, 1 << 12
#: Packed bytes of a bucket that are aimed at, and beyond which it is counted in parts.
BUCKET_BYTES, HOT_BYTES = 2 << 20, 16 << 20
#: Bytes of reads at most that tell which buckets are large.
TRIED_BYTES = 64 << 20


def _digits() -> np.ndarray:
    """The 2-bit digit of each byte; 4 for bytes outside ACGT in either case."""
    out = np.full(256, 4, np.uint8)
    for i, b in enumerate(BASES):
        out[ord(b)] = out[ord(b.lower())] = i
    return out


def _digits_of(seqs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The digits of sequences, each followed by a digit that is no base, and where each begins."""
    data = [(s or "").encode("latin-1", "replace") for s in seqs]
    starts = np.cumsum([0, *(len(d) + 1 for d in data)])[:-1]
    return _DIGITS[np.frombuffer(b"\n".join([*data, b""]), np.uint8)], starts


def _all_codes(digit: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Canonical codes of the windows of k digits at some places, or of all, those without a code too, from codes of 1, 2, 4, 8 and 16 bases."""
    n = len(digit) - k + 1
    f = digit & 3
    b = 3 - f
    forward, backward = np.zeros((2, n if at is None else len(at)), np.int64)
    used = 0
    for width, kind in ((1, np.uint8), (2, np.uint8), (4, np.uint8), (8, np.uint16), (16, np.uint32)):
        if width > 1:
            h = width // 2
            f, b = f.astype(kind), b.astype(kind)
            f, b = f[:-h] << (2 * h) | f[h:], b[h:] << (2 * h) | b[:-h]
        if k & width:
            here = slice(used, used + n) if at is None else at + used
            forward = forward << (2 * width) | f[here]
            backward |= b[here].astype(np.int64) << (2 * used)
            used += width
        if 2 * width > k:
            break
    return np.minimum(forward, backward)


def _clean(digit: np.ndarray, k: int) -> np.ndarray:
    """Whether each window of k digits is bases alone."""
    bad = np.concatenate([[0], np.cumsum(digit > 3, dtype=np.int32)])
    return bad[k:] == bad[:-k]


def window_codes(seqs: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical codes of all windows of ACGT, and their sequence's number and place in it, in order."""
    digit, starts = _digits_of(seqs)
    if len(digit) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(_clean(digit, k))
    of = np.searchsorted(starts, at, "right") - 1
    return _all_codes(digit, k, at), of, at - starts[of]


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The least value in each window of a width."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[:n], x[width - have : width - have + n])


def scanned(digit: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Canonical codes of all windows, those without a code too, in pieces that stay in a core's cache: the first window of each, and its codes."""
    for at in range(0, len(digit) - k + 1, PIECE):
        yield at, _all_codes(digit[at : at + PIECE + k - 1], k)


def _minimizers(digit: np.ndarray, k: int) -> np.ndarray:
    """The smallest hash of a canonical m-mer in each window of k digits."""
    m = min(k, MINIMIZER)
    out = np.empty(len(digit) - k + 1, np.uint32)
    for at in range(0, len(out), PIECE):
        code = _all_codes(digit[at : at + PIECE + k - 1], m)
        hashed = (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        out[at : at + PIECE] = _smallest(hashed.astype(np.uint32), k - m + 1)
    return out


def super_kmers(digit: np.ndarray, k: int, buckets: int) -> list[tuple[int, bytes]]:
    """For each bucket with k-mers the packed runs of them: how many, their k-mers less one, and the bases of each from a byte of its own."""
    if len(digit) < k or not (clean := _clean(digit, k)).any():
        return []
    least = _minimizers(digit, k)
    new = np.ones(len(clean), bool)
    new[1:] = (least[1:] != least[:-1]) | ~clean[:-1]
    new &= clean
    last = clean.copy()
    last[:-1] &= new[1:] | ~clean[1:]
    starts = np.flatnonzero(new)
    windows = np.flatnonzero(last) - starts + 1
    if (windows > LONGEST_RUN).any():  # runs that are too long for a byte are cut
        pieces = -(-windows // LONGEST_RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + nth * LONGEST_RUN
        windows = np.minimum(np.repeat(windows, pieces) - nth * LONGEST_RUN, LONGEST_RUN)
    # small hashes win, so they are mixed again
    mixed = least[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    of = ((mixed >> np.uint64(16) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(of, kind="stable")  # short keys are sorted by digits
    starts, windows, of = starts[order], windows[order], of[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    four = np.concatenate([digit & 3, np.zeros(3, np.uint8)])
    four = four[:-3] << 6 | four[1:-2] << 4 | four[2:-1] << 2 | four[3:]
    sizes = _run_bytes(windows, k)
    ends = np.cumsum(sizes)
    packed = np.concatenate([
        four[np.repeat(starts[i : i + PIECE] - 4 * (ends[i : i + PIECE] - sizes[i : i + PIECE]), sizes[i : i + PIECE]) + 4 * np.arange(ends[i] - sizes[i], ends[min(i + PIECE, len(ends)) - 1])]
        for i in range(0, len(ends), PIECE)
    ]).tobytes()
    short, at, until = (windows - 1).astype(np.uint8).tobytes(), (ends - sizes)[first].tolist(), [*first[1:].tolist(), len(starts)]
    return [(b, (j - i).to_bytes(4, "little") + short[i:j] + packed[p:q]) for b, i, j, p, q in zip(of[first].tolist(), first.tolist(), until, at, [*at[1:], len(packed)])]


def _run_bytes(windows: np.ndarray, k: int) -> np.ndarray:
    """Bytes of the bases of runs of so many k-mers."""
    return (windows + (k + 2)) >> 2


def packed_codes(blobs: list[bytes], k: int) -> np.ndarray:
    """Codes of the k-mers of packed runs."""
    counts = [int.from_bytes(x[:4], "little") for x in blobs]
    if not counts:
        return np.zeros(0, np.int64)
    windows = np.concatenate([np.frombuffer(x, np.uint8, n, 4) for x, n in zip(blobs, counts)]).astype(np.int64) + 1
    bases = np.concatenate([np.frombuffer(x, np.uint8, offset=4 + n) for x, n in zip(blobs, counts)])
    ends, out = np.cumsum(_run_bytes(windows, k)), []
    for i in range(0, len(windows), RUNS):
        w, e = windows[i : i + RUNS], ends[i : i + RUNS]
        begin = int(ends[i - 1]) if i else 0
        starts, last = 4 * np.append(0, e[:-1] - begin), np.cumsum(w)
        at = np.repeat(starts - (last - w), w) + np.arange(last[-1])
        out.append(_all_codes(_FOUR[bases[begin : e[-1]]].ravel(), k, at) if k + 3 > 32 else _codes_in(bases[begin : e[-1]], k, at))
    return np.concatenate(out)


def _codes_in(packed: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """Canonical codes of the windows at some places in packed bases; a place and k bases are in eight bytes."""
    word = np.concatenate([packed, np.zeros(7, np.uint8)])
    for kind, bits in ((np.uint16, 8), (np.uint32, 16), (np.uint64, 32)):
        word = word.astype(kind)
        n = bits // 8
        word = word[:-n] << kind(bits) | word[n:]
    unused = np.uint64(64 - 2 * k)
    code = word[at >> 2] << (2 * (at & 3)).astype(np.uint64) >> unused
    # the other strand: digits of the complement in reverse order
    back = (~code).byteswap()
    for bits, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333)):
        back = (back >> np.uint64(bits) & np.uint64(mask)) | (back & np.uint64(mask)) << np.uint64(bits)
    return np.minimum(code, back >> unused).view(np.int64)


#: The four digits of each byte of packed bases.
_FOUR = np.stack([np.arange(256, dtype=np.uint8) >> x & 3 for x in (6, 4, 2, 0)], axis=1)
_DIGITS = _digits()


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about TOGETHER bases each, or one longer read."""
    sizes = np.cumsum([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, "right")))
        yield batch.slice(at, end - at)
        at = end


def decoded(code: Column, k: int) -> Column:
    """The k-mer of a code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), DIGITS, BASES)


def kmer_codes(reads: DataFrame, k: int = 21) -> DataFrame:
    """read_int, pos (0-based), code of every window of ACGT; k is at most 31."""
    ship(reads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "seq"):
                code, of, pos = window_codes(part.column("seq").to_pylist(), k)
                yield pa.RecordBatch.from_arrays([part.column("read_int").take(pa.array(of)), pa.array(pos.astype(np.int32)), pa.array(code)], names=["read_int", "pos", "code"])

    return reads.select(F.col("read_int").cast("bigint").alias("read_int"), F.col("seq").cast("string").alias("seq")).mapInArrow(run, "read_int bigint, pos int, code bigint")


def kmers(reads: DataFrame, k: int = 21) -> DataFrame:
    """read_int, pos (0-based), kmer (canonical) of every window of ACGT, of any length, by column functions alone.

    Reads are cut into overlapping chunks first: substring is linear in its position, so
    windows of a whole read would take quadratic time.
    """
    cut = F.expr(f"explode(transform(sequence(0, length(_seq) - {k}, {CHUNK}), o -> struct(o AS off, substring(_seq, o + 1, {CHUNK + k - 1}) AS w)))")
    chunks = reads.select("read_int", normalised(F.col("seq")).alias("_seq")).where(F.length("_seq") >= k).select("read_int", cut.alias("_c"))
    w = F.col("_c.w")
    chunks = chunks.select("read_int", F.col("_c.off").alias("_off"), w.alias("_w"), reverse_complement(w).alias("_r"), is_acgt(w).alias("_clean"))
    # the reverse complement of a window is a window of the chunk's reverse complement
    each = f"posexplode(transform(sequence(1, length(_w) - {k - 1}), i -> least(substring(_w, i, {k}), substring(_r, length(_w) - i - {k - 2}, {k}))))"
    windows = chunks.select("read_int", "_off", "_clean", F.expr(each).alias("_j", "kmer"))
    return windows.where(F.col("_clean") | is_acgt(F.col("kmer"))).select("read_int", (F.col("_off") + F.col("_j")).alias("pos"), "kmer")


def counted(codes: list[np.ndarray]) -> pa.RecordBatch:
    code, n = np.unique(np.concatenate(codes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])


def packed_runs(reads: DataFrame, k: int, buckets: int) -> DataFrame:
    """bucket, runs: what super_kmers gives, for parts of the reads of a task."""
    ship(reads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "seq"):
                found = super_kmers(_digits_of(part.column(0).to_pylist())[0], k, buckets)
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "runs"])

    return reads.select(F.col("seq").cast("string").alias("seq")).mapInArrow(run, "bucket bigint, runs binary")


def code_counts(reads: DataFrame, k: int = 21, *, least: int = 1, size: int | None = None, bucket_bytes: int = BUCKET_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """code, n over all reads, both strands together, counted by the buckets of their minimizers.

    With ``least`` above 1 also times: the k-mers that are rarer have no rows of their own, but a bucket has a row for each of
    their counts, without a code, that says how many have it.  Most k-mers of reads are rare, and need not be written.
    ``size`` is the bytes of the reads, if the optimizer's are not to be taken.  Runs are shuffled once and not written: some of the
    reads tell beforehand which buckets are large, and these are dealt out in parts.  What they tell wrongly costs time alone.
    """
    spark = reads.sparkSession
    ship(spark)
    size = plan_bytes(reads) if size is None else size
    buckets = max(4 * spark.sparkContext.defaultParallelism, -(-size // bucket_bytes))
    hot, parts = hot_buckets(reads, k, buckets, size, hot_bytes)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        batch, part = counted([packed_codes(table.column("runs").to_pylist(), k)]), key[1].as_py() >= 0
        if least > 1:
            batch = batch.append_column("times", pa.array(np.ones(len(batch), np.int64))) if part else gathered(batch, least)
        return pa.Table.from_batches([batch.append_column("_part", pa.array(np.full(len(batch), part)))])

    part = F.when(F.col("bucket").isin(hot), F.pmod(F.xxhash64("runs"), F.lit(parts))).otherwise(-1) if hot else F.lit(-1)
    runs = packed_runs(reads, k, buckets).select("bucket", part.cast("bigint").alias("_part"), "runs")
    out = runs.groupBy("bucket", "_part").applyInArrow(count, "code bigint, n bigint" + (", times bigint" if least > 1 else "") + ", _part boolean")
    if not hot:
        return out.drop("_part")
    out = written(out, "counted")
    return out.where("not _part").drop("_part").unionAll(_summed(out.where("_part").select("code", "n"), least))


def hot_buckets(reads: DataFrame, k: int, buckets: int, size: int, hot_bytes: int) -> tuple[list[int], int]:
    """Buckets with probably more than hot_bytes, which are few, and in how many parts the largest is to be counted."""
    if size <= hot_bytes:  # all buckets together are hardly larger
        return [], 1
    share = min(1.0, min(TRIED_BYTES, max(1 << 20, size // 16)) / size)
    sizes = packed_runs(reads if share == 1 else reads.sample(share, seed=1), k, buckets).groupBy("bucket").agg(F.sum(F.length("runs").cast("bigint")).alias("_size"))
    found = sizes.where(F.col("_size") > share * hot_bytes).collect()
    return sorted(r["bucket"] for r in found), 1 + max((int(r["_size"] / share) // max(1, hot_bytes) for r in found), default=0)


def _summed(parts: DataFrame, least: int) -> DataFrame:
    """code, n from the counts of parts; with ``least`` as code_counts gives them."""
    out = parts.groupBy("code").agg(F.sum("n").alias("n"))
    return out if least <= 1 else out.groupBy(F.when(F.col("n") >= least, F.col("code")).alias("code"), "n").agg(F.count("*").alias("times"))


def run_counts(runs: DataFrame, k: int, *, least: int = 1, hot_bytes: int = HOT_BYTES, task_bytes: int | None = None) -> DataFrame:
    """What code_counts gives, from a written table of packed_runs; each code once.  Tasks have about task_bytes of runs, if that is given."""
    ship(runs.sparkSession)
    sizes = runs.groupBy("bucket").agg(F.sum(F.length("runs").cast("bigint")).alias("_size"))
    hot = None
    largest, total = sizes.agg(F.max("_size"), F.sum("_size")).first()
    if (largest or 0) > hot_bytes:
        hot = written(sizes.where(F.col("_size") > hot_bytes).select("bucket"), "hot")

    def whole(table: pa.Table) -> pa.Table:
        batch = counted([packed_codes(table.column("runs").to_pylist(), k)])
        return pa.Table.from_batches([batch if least <= 1 else gathered(batch, least)])

    def in_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                parts.append(packed_codes([x], k))
                held += len(parts[-1])
                if held >= FLUSH:
                    yield counted(parts)
                    parts, held = [], 0
        if held:
            yield counted(parts)

    rest = runs if hot is None else runs.join(small(hot), "bucket", "left_anti")
    if task_bytes:
        rest = rest.repartition(max(runs.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // task_bytes)), "bucket")
    out = rest.groupBy("bucket").applyInArrow(whole, "code bigint, n bigint" + (", times bigint" if least > 1 else ""))
    if hot is not None:
        parts = runs.join(small(hot), "bucket", "left_semi").select("runs").mapInArrow(in_part, "code bigint, n bigint")
        out = out.unionAll(_summed(parts, least))
    return out


def gathered(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """Rows (code, n) with times; those of smaller counts as one for each count."""
    code, n = (np.asarray(c) for c in batch.columns)
    rare, times = np.unique(n[n < least], return_counts=True)
    code, n = code[n >= least], n[n >= least]
    codes = pa.array(np.append(code, np.zeros(len(rare), np.int64)), mask=np.arange(len(code) + len(rare)) >= len(code))
    return pa.RecordBatch.from_arrays([codes, pa.array(np.append(n, rare)), pa.array(np.append(np.ones(len(code), np.int64), times))], names=["code", "n", "times"])


def kmer_counts(reads: DataFrame, k: int = 21) -> DataFrame:
    """kmer, n over all reads, both strands together."""
    if k <= LONGEST_CODE:
        return code_counts(reads, k).select(decoded(F.col("code"), k).alias("kmer"), "n")
    return kmers(reads, k).groupBy("kmer").agg(F.count("*").alias("n"))


def kmer_histogram(counts: DataFrame, high: int | None = None) -> DataFrame:
    """freq, n_kmers; high, if given, gathers all larger counts."""
    freq = F.col("n") if high is None else F.least("n", F.lit(high))
    return counts.groupBy(freq.cast("bigint").alias("freq")).agg((F.sum("times") if "times" in counts.columns else F.count("*")).alias("n_kmers"))
