"""Line dedup with two Bloom filters, of lines seen once and lines seen twice.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower
case.  Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents
lose all their lines except those in the document with the largest id.

1. Every task hashes the keys of its documents, each once a document, and sends their cells of the filters,
   2 bytes a cell, to the slices of the filters (ranges of cells), where a once-seen and a twice-seen filter
   are built, in two rounds (a cell that two tasks have seen once was seen twice).
2. The twice-seen filter, of bounded size, goes to all tasks.  Only lines that it suspects
   are shuffled, with their text: they are counted exactly and the keeper is chosen.
3. The line numbers to drop meet their documents again: by a broadcast while they are small; beyond that a bitmap
   of bounded size tells which documents may lose lines, and only these travel.

What tasks send follows the lines, not the filters' size.  That size follows the input's up to ``max_bits``; when it
is too small, more lines are shuffled and the result stays exact.  A key that a third of all documents hold is
counted by partial aggregation and met by a join that Spark can split.

Defined results: a null or empty text is one empty line.  A null id is one document and
keeps a line only if no other holds it.  Rows with equal ids count as one document; each
row is treated by its own text.  Lines outside keys, and their order, stay as they are.  Lines and texts of any length
are read whole.  An empty table gives an empty table.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from xxhash import xxh3_64_intdigest

from .common import BROADCAST_BYTES, maybe_in, plan_bytes, power_of_two, small, slices, written

EDGES = b" \t\n\x0b\x0c\r"
#: Cells of a slice of the filters.
SLICE = 1 << 16


def long_keys(text: str | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Line number and key of the lines whose key is long enough.  bytes.lower() changes A-Z alone."""
    for i, line in enumerate((text or "").encode().lower().split(b"\n")):
        key = line.strip(EDGES)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.decode()) >= min_chars):
            yield i, key


def cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)


def _cells(bits: int, min_chars: int, flush: int):
    """Rows (slice, once, twice): the cells, as packed 16-bit places, that a task has seen once and more often."""

    def found(hashes: list[int]) -> pa.RecordBatch:
        # both cells of each key, told apart as the filters see them
        at, n = np.unique(np.concatenate(cells(np.array(hashes, np.uint64), bits)), return_counts=True)
        part = at // np.uint64(SLICE)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        place, rows = (at % np.uint64(SLICE)).astype(np.uint16), []
        for i, j in zip(starts, [*starts[1:], len(at)]):
            more = n[i:j] > 1
            rows.append((int(part[i]), place[i:j][~more].tobytes(), place[i:j][more].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["slice", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[int] = []
        for batch in batches:
            for part in slices(batch, 1024):
                hashes += [xxh3_64_intdigest(k) for x in part.column(0).to_pylist() for k in {k for _, k in long_keys(x, min_chars)}]
                if len(hashes) >= flush:
                    yield found(hashes)
                    hashes = []
        if hashes:
            yield found(hashes)

    return run


def _slice(key: tuple, once: np.ndarray, twice: np.ndarray) -> pa.Table:
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "once": [once.tobytes()], "twice": [twice.tobytes()]})


def _built(key: tuple, table: pa.Table) -> pa.Table:
    """The filters of a slice from the cells that flushes of tasks have seen."""
    once, twice = np.zeros(SLICE, bool), np.zeros(SLICE, bool)
    for a, b in zip(table.column("once"), table.column("twice")):
        a, b = np.frombuffer(a.as_py(), np.uint16), np.frombuffer(b.as_py(), np.uint16)
        twice[a] |= once[a]
        twice[b] = once[a] = once[b] = True
    return _slice(key, np.packbits(once), np.packbits(twice))


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """One pair of filters from several."""
    once, twice = np.zeros(SLICE // 8, np.uint8), np.zeros(SLICE // 8, np.uint8)
    for a, b in zip(table.column("once"), table.column("twice")):
        a = np.frombuffer(a.as_py(), np.uint8)
        twice |= np.frombuffer(b.as_py(), np.uint8) | (once & a)
        once |= a
    return _slice(key, once, twice)


def twice_seen(texts: DataFrame, bits: int, min_chars: int, flush: int = 1 << 20) -> bytes:
    """The merged twice-seen filter: bits / 8 bytes."""
    schema = "slice int, once binary, twice binary"
    parts = texts.mapInArrow(_cells(bits, min_chars, flush), schema)
    lanes = max(1, math.isqrt(max(1, plan_bytes(texts) >> 24)))
    merged = parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes))).groupBy("slice", "lane").applyInArrow(_built, schema)
    if lanes > 1:
        merged = merged.groupBy("slice").applyInArrow(_merged, schema)
    out = bytearray(bits // 8)
    for r in merged.select("slice", "twice").toLocalIterator():
        out[r["slice"] * SLICE // 8 : (r["slice"] + 1) * SLICE // 8] = r["twice"]
    return bytes(out)


def _suspects(filter_of, bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(filter_of.value, np.uint8)

        def held(at: np.ndarray) -> np.ndarray:
            return twice[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1 == 1

        for batch in batches:
            for part in slices(batch, 1024):
                rows, keys, lines = [], [], []
                for row, x in enumerate(part.column(2).to_pylist()):
                    by: dict[bytes, list[int]] = {}
                    for i, k in long_keys(x, min_chars):
                        by.setdefault(k, []).append(i)
                    rows += [row] * len(by)
                    keys += by.keys()
                    lines += by.values()
                a, b = cells(np.array([xxh3_64_intdigest(k) for k in keys], np.uint64), bits)
                hit = np.flatnonzero(held(a) & held(b))
                at = pa.array(np.array(rows, np.int64)[hit])
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array([keys[i].decode() for i in hit], pa.string()), pa.array([lines[i] for i in hit], pa.list_(pa.int32()))], names=["_id", "_text_hash", "_key", "_lines"])

    return run


def lines_to_drop(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_chars: int = 20, min_docs: int = 3, max_bits: int = 1 << 30, flush: int = 1 << 20) -> DataFrame:
    """_id, _text_hash and _drop, the numbers of the lines that the row loses; only rows that lose some."""
    bits = power_of_two(plan_bytes(docs) >> 6, SLICE, max_bits)
    sent = docs.sparkSession.sparkContext.broadcast(twice_seen(docs.select(F.col(text).alias("_text")), bits, min_chars, flush))
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_text_hash"), F.col(text).alias("_text"))
    schema = StructType([*rows.schema.fields[:2], StructField("_key", StringType()), StructField("_lines", ArrayType(IntegerType()))])
    hits = written(rows.mapInArrow(_suspects(sent, bits, min_chars), schema), "suspects")
    keepers = hits.select("_key", "_id").distinct().groupBy("_key").agg(F.count("*").alias("_docs"), F.max("_id").alias("_keep")).where(F.col("_docs") >= min_docs)
    # written, so that a frequent key is met by a broadcast or by a join that Spark can split
    keepers = small(written(keepers.select("_key", "_keep"), "keepers"))
    lost = hits.join(keepers, "_key").where(~F.col("_id").eqNullSafe(F.col("_keep")))
    lost = lost.groupBy("_id", "_text_hash").agg(F.flatten(F.collect_list("_lines")).alias("_drop"))
    # rows with equal id and text gave each line more than once
    return written(lost.withColumn("_drop", F.array_distinct("_drop")), "drops")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            kept, total, gone = [], [], []
            for x, drop in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                lines, drop = (x or "").split("\n"), set(drop or ())
                total.append(len(lines))
                gone.append(len(drop))
                kept.append("\n".join([y for i, y in enumerate(lines) if i not in drop]) if drop else x or "")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["_id", "kept_text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, broadcast_bytes: int = BROADCAST_BYTES, **kw) -> DataFrame:
    """id, kept_text, n_lines (before) and n_dropped for every row of docs."""
    drops = lines_to_drop(docs, doc_id, text, **kw)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_text_hash"))

    def met(rows: DataFrame, drops: DataFrame) -> DataFrame:
        on = rows["_id"].eqNullSafe(drops["_id"]) & (rows["_text_hash"] == drops["_text_hash"])
        return rows.join(drops, on, "left").select(rows["_id"], "_text", "_drop")

    if plan_bytes(drops) <= broadcast_bytes:
        rows = met(rows, F.broadcast(drops))
    else:
        row = F.xxhash64("_id", "_text_hash")
        rows = maybe_in(rows, row, drops.select(row.alias("_hash")))
        stay = rows.where("not _maybe").select("_id", "_text", F.lit(None).cast("array<int>").alias("_drop"))
        rows = stay.union(met(rows.where("_maybe"), drops))
    schema = StructType([rows.schema.fields[0], StructField("kept_text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return rows.mapInArrow(_without, schema).withColumnRenamed("_id", doc_id)
