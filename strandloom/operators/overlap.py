"""Overlaps of barcodes: direct bridges, the inverted index of keys, and the overlap graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import end_window, key_starts
from ..functions.storage import ship, small, written


#: An odd number, whose powers weigh the ids of a list, and its inverse, both modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def end_hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each length from 1 on the hash of so many first ids, and of so many last ones; equal lists have equal hashes, wherever they stand."""
    n = len(ids)
    x = ids.astype(np.uint64) + np.uint64(BASE)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    powers, back = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, b, np.uint64))) for b in (BASE, INVERSE))
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(x * powers[:n]))
    return sums[1:].view(np.int64), ((sums[n] - sums[:n]) * back[:n])[::-1].copy().view(np.int64)


def with_end_hashes(rows: DataFrame, ids: str) -> DataFrame:
    """rows (read_int, ids) with _first and _last, the hashes of the beginnings and ends of each length."""
    ship(rows.sparkSession)
    hashes = end_hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [hashes(np.asarray(x.values)) for x in batch.column(1)]
            sides = [pa.array([m[i] for m in made], pa.list_(pa.int64())) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *sides], names=["read_int", "_ids", "_first", "_last"])

    rows = rows.select(F.col("read_int").cast("bigint").alias("read_int"), F.col(ids).alias("_ids"))
    return rows.mapInArrow(run, "read_int bigint, _ids array<bigint>, _first array<bigint>, _last array<bigint>")


def direct_bridges(barcoded: DataFrame, anchors: DataFrame, min_overlap: int = 100) -> DataFrame:
    """read_id, read_int, barcode, read_len of non-anchors whose start is the whole rest of some anchor
    from a position on, and whose end is the whole beginning of some anchor up to a position.

    Both rests have at least min_overlap ids.  The anchors' kept ids are compared.  Positions meet by the two
    outer ids of the first (last) min_overlap; then hashes of the rests are compared, and of the equal ones of a read
    one is cut and compared id by id (all of them should the hashes have deceived).
    """
    others = barcoded.where(F.size("barcode") >= min_overlap).join(anchors.select("read_int").distinct(), "read_int", "left_anti")
    m = min_overlap
    held = written(with_end_hashes(anchors.where(F.size("kept") >= m), "kept"), "held")
    # the place of min_overlap ids, the rest that begins there, and the beginning that ends there
    spots = F.expr(f"transform(sequence(0, size(_ids) - {m}), p -> named_struct('p', p, 'near', element_at(_ids, p + 1), 'far', element_at(_ids, p + {m}), 'rest', element_at(_last, size(_ids) - p), 'start', element_at(_first, p + {m})))")
    spots = written(held.select(F.col("read_int").alias("_a"), F.size("_ids").alias("_len"), F.explode(spots).alias("_s")).select("_a", "_len", "_s.*"), "spots")

    def met(rows: DataFrame, near: int, far: int, size: str, spot: str, whole: str, own: str, side: str) -> DataFrame:
        """Reads whose slice ``own`` equals an anchor's slice ``whole``; of lengths ``size``, with hashes ``spot`` and ``side``."""
        ends = rows.select("read_int", F.size("barcode").alias("_n"), F.element_at("barcode", near).alias("near"), F.element_at("barcode", far).alias("far"))
        pairs = ends.join(small(spots), ["near", "far"]).withColumn("_size", F.expr(size)).where("_n >= _size").select("read_int", "_a", "p", "_size", F.col(spot).alias("_hash"))
        pairs = written(pairs, "pairs")
        ids = small(written(pairs.select("read_int").distinct(), "paired"))
        hashed = written(with_end_hashes(rows.join(ids, "read_int", "left_semi"), "barcode").select("read_int", side), "hashed")
        equal = pairs.join(hashed, "read_int").where(F.element_at(side, F.col("_size")) == F.col("_hash")).select("read_int", "_a", "p", "_size")
        equal = written(equal, "equal")

        def compared(some: DataFrame) -> DataFrame:
            cut = some.join(held.select(F.col("read_int").alias("_a"), "_ids"), "_a").select("read_int", "_size", F.expr(whole).alias("_cut"))
            return rows.select("read_int", "barcode").join(cut, "read_int").where(F.expr(own) == F.col("_cut")).select("read_int").distinct()

        one = equal.groupBy("read_int").agg(F.min(F.struct("_size", "_a", "p")).alias("_e")).select("read_int", "_e.*")
        found = written(compared(one), "compared")
        deceived = equal.join(found, "read_int", "left_anti")
        return found if deceived.isEmpty() else found.union(compared(deceived))

    both = others.join(met(others, 1, m, "_len - p", "rest", "slice(_ids, p + 1, _size)", "slice(barcode, 1, _size)", "_first"), "read_int", "left_semi")
    # a beginning ends m - 1 ids after the spot
    ended = met(both, -m, -1, f"p + {m}", "start", "slice(_ids, 1, _size)", "slice(barcode, size(barcode) - _size + 1, _size)", "_last")
    return both.join(ended, "read_int", "left_semi").select("read_id", "read_int", "barcode", "read_len")


def head_index(barcoded: DataFrame, anchors: DataFrame | None = None, *, k: int = 11, stride: int = 3, fraction: float = 0.25, cap: int = 4000) -> DataFrame:
    """key (k ids), read_int, file_ord, start; anchors are indexed at every start, others in their end windows.

    Without anchors all reads are indexed as others.  Repeated keys of a read stay.
    """
    rows = barcoded.where("n_barcodes > 0")
    if anchors is None:
        rows = rows.withColumn("_full", F.lit(False))
    else:
        flags = anchors.select("read_int").distinct().withColumn("_full", F.lit(True))
        rows = rows.join(flags, "read_int", "left").withColumn("_full", F.coalesce("_full", F.lit(False)))
    starts = key_starts(F.size("barcode"), F.col("_full"), k, fraction, cap, stride)
    return rows.select("read_int", "barcode", F.explode(starts).alias("start")).select(F.slice("barcode", F.col("start") + 1, k).alias("key"), "read_int", F.col("read_int").alias("file_ord"), "start")


def posting_lists(index: DataFrame) -> DataFrame:
    """key, postings in the order of insertion, repeats kept.  A list grows with its key's frequency; joins use head_index itself."""
    listed = F.array_sort(F.collect_list(F.struct("file_ord", "start", "read_int")))
    return index.groupBy("key").agg(F.transform(listed, lambda x: x["read_int"]).alias("postings"))


def index_statistics(index: DataFrame) -> DataFrame:
    """unique_keys, postings, indexed_reads."""
    return index.agg(F.countDistinct("key").alias("unique_keys"), F.count("*").alias("postings"), F.countDistinct("read_int").alias("indexed_reads"))


def read_counters(barcoded: DataFrame, index: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """One row: reads (all of ``reads``, or of ``barcoded``), missing (without a barcode row), empty, indexed, and unindexed (too short for a key)."""
    ids = (reads if reads is not None else barcoded).select("read_int").distinct()
    known = barcoded.groupBy("read_int").agg(F.max("n_barcodes").alias("_n"))
    rows = ids.join(known, "read_int", "left").join(index.select("read_int").distinct().withColumn("_in", F.lit(1)), "read_int", "left")
    n, held = F.col("_n"), F.col("_in").isNotNull()
    return rows.agg(F.count("*").alias("reads"), F.count_if(n.isNull()).alias("missing"), F.count_if(n == 0).alias("empty"), F.count_if(held).alias("indexed"), F.count_if((n > 0) & ~held).alias("unindexed"))


#: Pairs of a key beyond which its holders are dealt out in blocks, and holders of a block.
HOT_PAIRS, KEY_BLOCK = 1 << 20, 512


def overlap_edges(barcoded: DataFrame, index: DataFrame, *, k: int = 11, stride: int = 1, fraction: float = 0.25, cap: int = 4000, hot_pairs: int = HOT_PAIRS, block: int = KEY_BLOCK) -> DataFrame:
    """src, dst: some key in the end window of src is indexed for dst; pairs once, self-overlaps included.

    A key with many holders on both sides gives as many edges as pairs; its holders meet in blocks, so that tasks share them.
    """
    n, w = F.size("barcode"), end_window(F.size("barcode"), fraction, cap)
    starts = F.when(w >= k, F.sequence(n - w, n - k, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    tails = barcoded.where("n_barcodes > 0").select(F.col("read_int").alias("src"), "barcode", F.explode(starts).alias("_s"))
    tails = tails.select("src", F.slice("barcode", F.col("_s") + 1, k).alias("key")).distinct()
    return pairs_by_key(tails, index.select("key", F.col("read_int").alias("dst")).distinct(), hot_pairs, block).select("src", "dst").distinct()


def pairs_by_key(tails: DataFrame, heads: DataFrame, hot_pairs: int, block: int) -> DataFrame:
    """The join of tails (src, key) and heads (dst, key); keys of more than hot_pairs pairs meet in blocks of holders."""
    tails, heads = written(tails, "tails"), written(heads, "heads")
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    sizes = tails.groupBy("key").agg(F.count("*").alias("_n")).join(heads.groupBy("key").agg(F.count("*").alias("_m")), "key")
    hot = written(sizes.where(F.col("_n") * F.col("_m") > hot_pairs).select("key", parts("_n").alias("_tails"), parts("_m").alias("_heads")), "hot_keys")
    if hot.isEmpty():
        return tails.join(heads, "key").select("key", "src", "dst")
    rest = tails.join(small(hot), "key", "left_anti").join(heads, "key").select("key", "src", "dst")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = tails.join(small(hot), "key").select("key", "src", own("src", "_tails").alias("_t"), every("_heads").alias("_h"))
    right = heads.join(small(hot), "key").select("key", "dst", own("dst", "_heads").alias("_h"), every("_tails").alias("_t"))
    return rest.unionAll(left.join(right.hint("shuffle_hash"), ["key", "_t", "_h"]).select("key", "src", "dst"))
