"""Sequence records and barcodes from ordinary tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import spread
from ..functions.storage import plan_bytes, ship, written

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def bases_without(masked: str) -> str:
    """The base of each letter, N for the masked ones."""
    return "".join("N" if x in masked else b for x, b in zip(LETTERS, BASES))


def letters(text: str) -> Column:
    """The letters of a text; none of a null."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))


def bases_of(texts: pa.Array, masked: str = "") -> pa.Array:
    """The bases of the letters of texts, or N for masked letters; none of a null."""
    base = np.zeros(256, np.uint8)
    for x, b in zip(LETTERS, bases_without(masked)):
        base[ord(x)] = base[ord(x.upper())] = ord(b)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    found = base[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)]
    sizes, some = np.zeros(len(texts), np.int32), np.flatnonzero(np.diff(ends))
    if len(some):  # bytes beyond ASCII are no letters
        sizes[some] = np.add.reduceat(found > 0, ends[some] - ends[0], dtype=np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(found[found > 0]))


def reads_from_documents(docs: DataFrame, masked: str = "") -> DataFrame:
    """Letters of a text, as bases, or N for masked letters; read_int and file_ord are the document's id."""
    ship(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("string").alias("read_id"), F.col("doc_id").alias("read_int"), F.col("doc_id").alias("file_ord"), _bases(masked)("text").alias("seq"))
    return out.withColumn("read_len", F.length("seq"))


def kept_reads(docs: DataFrame, masked: str = "") -> DataFrame:
    """reads_from_documents, dealt out and written, for what reads them several times: bases pack to about a quarter byte each."""
    return written(spread(reads_from_documents(docs, masked), size=plan_bytes(docs)), "reads", "zstd")


def _bases(masked: str):
    def run(texts: pa.Array) -> pa.Array:
        return bases_of(texts, masked)

    return F.arrow_udf(run, "string")


def barcodes_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Parts of an order, in line order; ties in the line number are settled by part, supplier and price."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    out = lineitem.groupBy(F.col("l_orderkey").alias("read_int")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l_partkey"]).alias("barcode"), F.sum(F.col("l_quantity").cast("bigint")).alias("read_len"))
    return _completed(out)


def barcodes_from_events(events: DataFrame) -> DataFrame:
    """Kinds of a user's events with the hour (the first 32 bits of their MD5), in time order."""
    code = F.conv(F.substring(F.md5(F.concat("event_type", F.lit("/"), F.hour("ts").cast("string"))), 1, 8), 16, 10).cast("bigint")
    out = events.groupBy(F.col("user_id").alias("read_int")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", code.alias("code")))), lambda x: x["code"]).alias("barcode"), F.count("*").alias("read_len"))
    return _completed(out)


def _completed(out: DataFrame) -> DataFrame:
    return out.select(F.col("read_int").cast("string").alias("read_id"), "read_int", F.col("read_len").cast("int").alias("read_len"), "barcode", F.size("barcode").alias("n_barcodes"))
