"""Near-duplicate detection by Order MinHash, verified by banded alignment.

Words are the text's ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; k-mers are five words,
labelled by their occurrence (the second copy of a k-mer in a text differs from the
first).  Each of ``sketches`` hash functions samples the ``order`` labelled k-mers with the
smallest hashes and keeps them in text order; texts that share such a tuple are tested.

The test aligns the k-mer sequences of two texts within a band (longest common subsequence,
bit-parallel): m aligned k-mers of a and b give the similarity m / (a + b - m), which is
the Jaccard similarity for k-mers in equal order.  Links have at least ``threshold``.

Texts with equal words are one class and are represented by their smallest id.  Buckets
are tested leader first, then in blocks (see linking); no bucket gives all its pairs.

Defined results: texts of fewer than five words are one k-mer; null and empty texts are one
class without words, linked with nothing else.  Rows with a null id are alone.  Rows with
equal ids and equal words stay or go together; those with equal ids and other words are
documents of their own, of which a group keeps one.  Texts of any length are sketched and aligned whole.  Ties go
to the smallest id.  An empty table gives an empty table.  near_duplicates reads no other columns; for drop_near_duplicates
they travel under numbers, so that names cannot clash.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField
from xxhash import xxh3_128_digest

from .common import mapped, renamed, small, written
from .linking import linked_components

K = 5
#: K-mers that are sketched at a time, or those of one longer text.
TOGETHER = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
S32, S29 = np.uint64(32), np.uint64(29)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_codes(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(crc32, found), np.uint32, len(found))


def key_of(text: str | None) -> bytes:
    """128 bits of a text's words themselves."""
    return xxh3_128_digest(b" ".join(words(text)))


def mixed(x: np.ndarray) -> np.ndarray:
    y = x >> S32
    y ^= x
    y *= MIX
    y ^= y >> S29
    return y


def shingles(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of word codes; of all words if they are fewer than k."""
    n = max(len(codes) - k + 1, min(len(codes), 1))
    wide = codes.astype(np.uint64)
    wide += np.uint64(1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(codes))):
        out *= ODD
        out += wide[i : i + n]
        out = mixed(out)
    return out


def order_sketches(parts: list[np.ndarray], sketches: int, order: int) -> np.ndarray:
    """One row of sketches for each array of k-mer hashes; none may be empty."""
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc = np.repeat(np.arange(len(parts)), sizes)
    kmer = np.concatenate(parts)
    own = mixed(kmer + doc.astype(np.uint64) * ODD)
    by = np.argsort(own, kind="stable")
    ranked = own[by]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    place = np.arange(len(by))
    label = np.empty(len(by), np.uint64)
    label[by] = place - np.maximum.accumulate(np.where(first, place, 0))
    kmer = mixed(kmer + label * MIX)
    out = np.empty((len(parts), sketches), np.uint64)
    full, none = np.uint64(0xFFFFFFFFFFFFFFFF), len(kmer)
    value = np.append(kmer, np.uint64(0))
    for s in range(sketches):
        h = mixed(kmer ^ np.uint64((s + 1) * int(ODD) & 0xFFFFFFFFFFFFFFFF))
        at = np.full((len(parts), order), none)
        for m in range(min(order, int(sizes.max()))):
            low = np.minimum.reduceat(h, starts)
            hit = np.flatnonzero(h == np.repeat(low, sizes))[::-1]
            hit = hit[h[hit] != full]
            at[doc[hit], m] = hit
            h[hit] = full
        at.sort(axis=1)
        code = np.full(len(parts), s + 1, np.uint64)
        for m in range(order):
            code = mixed(code * ODD + value[at[:, m]])
        out[:, s] = code
    return out


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """m / (|a| + |b| - m) for the longest common subsequence m inside the band that the threshold allows; 0 if that is below it."""
    total = len(a) + len(b)
    need = int(np.ceil(threshold * total / (1 + threshold) - 1e-9))
    band = total - 2 * need
    if total == 0 or min(len(a), len(b)) < need:
        return 0.0
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    m = head + tail
    if len(a) and len(b):
        where: dict[int, list[int]] = {}
        for i, x in enumerate(a.tolist()):
            where.setdefault(x, []).append(i)
        full = (1 << len(a)) - 1
        v = full
        for j, x in enumerate(b.tolist()):
            match = 0
            for i in where.get(x, ()):
                if -band <= i - j <= band:
                    match |= 1 << i
            if match:
                u = v & match
                v = ((v + u) | (v - u)) & full
        m += len(a) - v.bit_count()
    found = m / (total - m)
    return found if found >= threshold - 1e-12 else 0.0


def _sketch(sketches: int, order: int, k: int):
    def make(texts):
        codes = [word_codes(x) for x in texts]
        parts = [shingles(c, k) for c in codes]
        rows: list = [None] * len(parts)
        held, size = [], 0
        for i, p in enumerate([*parts, None]):
            if held and (p is None or size + len(p) > TOGETHER):
                for j, r in zip(held, order_sketches([parts[j] for j in held], sketches, order).view(np.int64).tolist()):
                    rows[j] = r
                held, size = [], 0
            if p is not None and len(p):
                held.append(i)
                size += len(p)
        return pa.array([key_of(x) for x in texts], pa.binary()), pa.array([len(p) for p in parts], pa.int32()), pa.array(rows, pa.list_(pa.int64()))

    return make


class Shingled:
    """K-mers of a text in order, and each once, sorted."""

    def __init__(self, codes: bytes, k: int):
        self.all = shingles(np.frombuffer(codes, np.uint32), k)
        self.set = np.unique(self.all)

    def near(self, other: Shingled, threshold: float) -> bool:
        a, b = len(self.all), len(other.all)
        # common k-mers bound the alignment
        m = len(np.intersect1d(self.set, other.set, assume_unique=True)) + a - len(self.set)
        return m >= threshold * (a + b - m) - 1e-9 and aligned(self.all, other.all, threshold) > 0


def _labelled(docs: DataFrame, doc_id: str, text: str, k: int, threshold: float, sketches: int, order: int) -> DataFrame:
    """One row for each row of docs: _id, _key of its words, _class, _group and _kept.

    Classes are linked under a hash of their key, since texts of equal ids are different classes.
    """
    made = [StructField("_key", BinaryType()), StructField("_n", IntegerType()), StructField("_sketch", ArrayType(LongType()))]
    base = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = written(mapped(base, ["_id"], "_text", made, _sketch(sketches, order, k)), "sketches")
    classes = rows.where("_id is not null").groupBy("_key").agg(F.min(F.struct("_id", "_n", "_sketch")).alias("_r"))
    classes = written(classes.select("_key", F.xxhash64("_key").alias("_c"), "_r.*"), "classes")
    members = classes.select(F.col("_c").alias("_id"), "_n", F.explode("_sketch").alias("_bucket"))

    def payload(ids: DataFrame) -> DataFrame:
        wanted = written(classes.select(F.col("_c"), "_id").join(ids.select(F.col("_id").alias("_c")), "_c", "left_semi").select("_id").distinct(), "wanted")
        texts = base.join(small(wanted), "_id", "left_semi")

        def codes(xs):
            return pa.array([key_of(x) for x in xs], pa.binary()), pa.array([word_codes(x).tobytes() for x in xs], pa.binary())

        held = mapped(texts, ["_id"], "_text", [StructField("_key", BinaryType()), StructField("_payload", BinaryType())], codes)
        return held.select(F.xxhash64("_key").alias("_id"), "_payload").dropDuplicates(["_id"])

    labels = linked_components(members, payload, lambda x: Shingled(x, k), lambda x, y: x.near(y, threshold), lambda n, m: F.least(n, m) >= threshold * F.greatest(n, m))
    labels = written(labels.withColumnRenamed("_id", "_c").join(classes.select("_c", F.col("_id").alias("_class")), "_c"), "labels")
    leads = labels.groupBy("_comp").agg(F.min(F.struct("_class", "_c")).alias("_lead"))
    of = classes.select("_key", "_c", F.col("_id").alias("_class")).join(labels.join(leads, "_comp").select("_c", "_lead"), "_c", "left")
    of = of.select("_key", "_class", F.coalesce("_lead._class", "_class").alias("_group"), F.coalesce(F.col("_lead._c") == F.col("_c"), F.lit(True)).alias("_leads"))
    out = rows.select("_id", "_key").join(written(of, "groups"), "_key", "left")
    known = F.col("_id").isNotNull()
    kept = ~known | (F.col("_id") == F.col("_group")) & F.col("_leads")
    return out.select("_id", "_key", F.when(known, F.col("_class")).alias("_class"), F.when(known, F.col("_group")).alias("_group"), kept.alias("_kept"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, k: int = K, threshold: float = 0.8, sketches: int = 16, order: int = 3) -> DataFrame:
    """One row for each row of docs: id, class_id (smallest id with the same words), group_id (smallest id reachable by links) and kept."""
    out = _labelled(docs, doc_id, text, k, threshold, sketches, order)
    return out.select(F.col("_id").alias(doc_id), F.col("_class").alias("class_id"), F.col("_group").alias("group_id"), F.col("_kept").alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, k: int = K, threshold: float = 0.8, sketches: int = 16, order: int = 3) -> DataFrame:
    """The rows of docs, whole, without those that are not the first of their group."""
    columns = docs.columns
    docs, name = renamed(docs)
    doc_id, text = name[doc_id], name[text]
    found = written(_labelled(docs, doc_id, text, k, threshold, sketches, order), "labelled")
    dropped = written(found.where("not _kept").select(F.col("_id").alias("_gone"), F.col("_key").alias("_words")).distinct(), "dropped")
    gone = written(dropped.select("_gone").distinct(), "gone")
    # ids of which some texts go and others stay
    split = written(found.where("_kept and _id is not null").select("_id").join(small(gone), F.col("_id") == F.col("_gone"), "left_semi").distinct(), "split")
    kept = docs.join(small(gone), F.col(doc_id) == F.col("_gone"), "left_anti")
    if not split.isEmpty():
        some = docs.join(small(split), F.col(doc_id) == F.col("_id"), "left_semi")
        some = mapped(some, some.columns, text, [StructField("_words", BinaryType())], lambda xs: (pa.array([key_of(x) for x in xs], pa.binary()),))
        some = some.join(small(dropped).withColumnRenamed("_words", "_of"), (F.col(doc_id) == F.col("_gone")) & (F.col("_words") == F.col("_of")), "left_anti")
        kept = kept.unionByName(some.drop("_words"))
    return kept.toDF(*columns)
