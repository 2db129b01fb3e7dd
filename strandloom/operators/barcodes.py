"""Barcodes: the unikmer ids of a read in the order of their positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import encode2bit
from ..functions.storage import ship, written
from .kmers import LONGEST_CODE, _clean, _digits_of, _parts, kmers, scanned

#: Unikmers that are broadcast at most: 16 bytes each, 64 MB.
MOST_BROADCAST = 1 << 22
#: Bits of the filter for each unikmer beyond that, of which two are set, and bytes of the filter at most.
FILTER_BITS, FILTER_BYTES = 16, 256 << 20
#: Bits that one row of Spark's bitmaps holds.
PIECE = 1 << 15

SCHEMA = "read_id string, read_int bigint, read_len int, barcode array<bigint>"


def barcodes(reads: DataFrame, unikmers: DataFrame, k: int = 21, *, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """read_id, read_int, read_len, barcode, n_barcodes; repeats stay; reads without unikmers have an empty barcode.

    While the unikmers are at most ``most_broadcast``, their sorted codes go to all tasks and reads are not
    shuffled.  Beyond that, a filter of two bytes a unikmer goes to all tasks, k-mers that it does not hold end there
    (all but 1.4% of those that are none, while the filter is below its bound), and the others meet the unikmers by a join; the lists, each as long as its read, are
    gathered by read.  Unikmers carry their code or else their k-mer.
    """
    if k > LONGEST_CODE:
        hits = kmers(reads, k).join(unikmers.select("kmer", "unikmer_id"), "kmer")
        return _gathered(reads, hits)
    code = F.col("code") if "code" in unikmers.columns else encode2bit(F.col("kmer"))
    marks = written(unikmers.select(code.cast("bigint").alias("code"), F.col("unikmer_id").cast("bigint").alias("unikmer_id")), "unikmers")
    n = marks.count()
    if n > most_broadcast:
        return _gathered(reads, suspected_codes(reads, marks, n, k).join(marks, "code"))
    table = marks.orderBy("code").toArrow()
    spark = reads.sparkSession
    ship(spark)
    known, ids = table.column("code").to_numpy(), table.column("unikmer_id").to_numpy()
    # most k-mers end at a filter that a core's cache holds
    bits = max(PIECE, 1 << (FILTER_BITS * n - 1).bit_length())
    full = np.zeros(bits, bool)
    full[next(_spots(known, bits))] = True
    sent = spark.sparkContext.broadcast((known, ids, np.packbits(full, bitorder="little")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, bits = sent.value
        for batch in batches:
            for part in _parts(batch, "seq"):
                digit, starts = _digits_of(part.column("seq").to_pylist())
                places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for first, code in scanned(digit, k) if len(known) else ():
                    spot = next(_spots(code, 8 * len(bits)))
                    maybe = np.flatnonzero(bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
                    at = np.minimum(np.searchsorted(known, code[maybe]), len(known) - 1)
                    hit = known[at] == code[maybe]
                    places.append(first + maybe[hit])
                    found.append(at[hit])
                place, at = np.concatenate(places), np.concatenate(found)
                clean = _clean(digit, k)[place]
                ends = np.searchsorted(place[clean], np.append(starts, len(digit)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[at[clean]], pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists], names=["read_id", "read_int", "read_len", "barcode"])

    rows = reads.select(F.col("read_id").cast("string").alias("read_id"), F.col("read_int").cast("bigint").alias("read_int"), F.col("read_len").cast("int").alias("read_len"), F.col("seq").cast("string").alias("seq"))
    return rows.mapInArrow(run, SCHEMA).withColumn("n_barcodes", F.size("barcode"))


def _spots(code: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Two places of each code in a filter of bits, a power of two."""
    for turn in range(len(SPOTS)):
        yield _spot(code, bits, turn)


#: Factors and shifts that give the places of a code in the filter.
SPOTS = (0x9E3779B97F4A7C15, 20), (0xD6E8FEB86659FD93, 22)


def _spot(code: np.ndarray, bits: int, turn: int) -> np.ndarray:
    factor, shift = SPOTS[turn]
    return ((code.astype(np.uint64) * np.uint64(factor)) >> np.uint64(shift)).astype(np.int64) & (bits - 1)


def unikmer_filter(marks: DataFrame, n: int, filter_bytes: int = FILTER_BYTES) -> np.ndarray:
    """The bits of the codes of n unikmers as bytes: FILTER_BITS for each, filter_bytes in all at most."""
    bits = max(PIECE, min(8 * filter_bytes, 1 << (FILTER_BITS * n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(list(_spots(np.asarray(batch.column(0)), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at // PIECE), pa.array(at % PIECE)], names=["piece", "bit"])

    pieces = marks.select("code").mapInArrow(run, "piece bigint, bit bigint").groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((bits // PIECE, PIECE // 8), np.uint8)
    for row in pieces.toLocalIterator():  # bounded by filter_bytes
        out[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def suspects(seqs: list[str | None], known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What window_codes gives for the windows that the filter ``known`` holds; the others end at their first bit that is not set, and their reads and places are not looked up."""
    digit, starts = _digits_of(seqs)
    places, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, code in scanned(digit, k):
        place = np.arange(first, first + len(code))
        for turn in range(len(SPOTS)):
            at = _spot(code, 8 * len(known), turn)
            held = (known[at >> 3] >> (at & 7).astype(np.uint8) & 1).nonzero()[0]
            code, place = code[held], place[held]
        places.append(place)
        codes.append(code)
    place, code = np.concatenate(places), np.concatenate(codes)
    if len(place):
        clean = _clean(digit, k)[place]
        place, code = place[clean], code[clean]
    of = np.searchsorted(starts, place, "right") - 1
    return code, of, place - starts[of]


def suspected_codes(reads: DataFrame, marks: DataFrame, n: int, k: int) -> DataFrame:
    """read_int, pos, code of the k-mers that the filter of the unikmers holds."""
    spark = reads.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(unikmer_filter(marks, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in _parts(batch, "seq"):
                code, of, pos = suspects(part.column("seq").to_pylist(), known, k)
                yield pa.RecordBatch.from_arrays([part.column("read_int").take(pa.array(of)), pa.array(pos.astype(np.int32)), pa.array(code)], names=["read_int", "pos", "code"])

    return reads.select(F.col("read_int").cast("bigint").alias("read_int"), F.col("seq").cast("string").alias("seq")).mapInArrow(run, "read_int bigint, pos int, code bigint")


def _gathered(reads: DataFrame, hits: DataFrame) -> DataFrame:
    hits = hits.select("read_int", "pos", F.col("unikmer_id").cast("bigint").alias("unikmer_id"))
    lists = hits.groupBy("read_int").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "unikmer_id"))), lambda x: x["unikmer_id"]).alias("barcode"))
    out = reads.select("read_id", "read_int", "read_len").join(lists, "read_int", "left").withColumn("barcode", F.coalesce("barcode", F.array().cast("array<bigint>")))
    return out.select("read_id", "read_int", "read_len", "barcode", F.size("barcode").alias("n_barcodes"))


def read_stats(barcoded: DataFrame) -> DataFrame:
    """read_id, n_barcodes, read_len."""
    return barcoded.select("read_id", "n_barcodes", "read_len")
