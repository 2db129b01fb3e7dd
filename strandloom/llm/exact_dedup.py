"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame functions.  Texts are equal when they are identical after each run of
white space became one space.  Three passes of small rows:

1. per row the length and a hash of the first characters; groups of one length, then of
   one length and prefix, of a single row are done;
2. the keys of the surviving groups go into a bitmap of bounded size that is broadcast;
3. a second scan takes the full hash of those rows whose key is in the bitmap, and only
   these are grouped by it.

Texts are never shuffled.  Groups are aggregated before they meet, so that a group with
a third of all rows costs one row for each task.

Defined results: a null text counts as empty.  Of equal texts the smallest id stays; null
ids come last.  Repeated rows (same id and text) count each, and one of them stays.
Texts of any length are hashed whole.
Empty tables give empty tables.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SPACE, maybe_in, plan_bytes, small, written


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _keyed(docs: DataFrame, text: str, prefix_chars: int, *keep: Column) -> DataFrame:
    norm = normalised(F.col(text))
    return docs.select(*keep, norm.alias("_norm")).select(
        "*", F.length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, prefix_chars)).alias("_prefix")
    )


def _survivors(docs: DataFrame, text: str, prefix_chars: int) -> DataFrame:
    """(length, prefix hash) of the groups with more than one row."""
    heads = _keyed(docs, text, prefix_chars).groupBy("_len", "_prefix").agg(F.count("*").alias("_n"))
    heads = written(heads, "heads")
    lengths = heads.groupBy("_len").agg(F.sum("_n").alias("_rows")).where("_rows > 1").select("_len")
    return heads.join(lengths, "_len", "left_semi").where("_n > 1").select("_len", "_prefix")


def surviving_keys(docs: DataFrame, text: str, prefix_chars: int = 64) -> DataFrame:
    return written(_survivors(docs, text, prefix_chars), "survivors")


def refined(docs: DataFrame, text: str, *keep: Column, keys: DataFrame | None = None, prefix_chars: int = 64, max_bits: int = 1 << 27, digest_all: bool = False) -> DataFrame:
    """keep columns, _len, _prefix, _maybe (its group survived) and _sha (null unless it did, or digest_all)."""
    keys = surviving_keys(docs, text, prefix_chars) if keys is None else keys
    key = F.xxhash64("_len", "_prefix")
    rows = maybe_in(_keyed(docs, text, prefix_chars, *keep), key, keys.select(key.alias("_hash")), max_bits)
    wanted = F.lit(True) if digest_all else F.col("_maybe")
    return rows.withColumn("_sha", F.when(wanted, F.sha2("_norm", 256))).drop("_norm")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, digest_all: bool = False) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    text_sha256 is null for rows that needed no full hash, unless digest_all asks for it.
    """
    rows = refined(docs, text, F.col(doc_id).alias("_id"), digest_all=digest_all)
    rows = written(rows, "digests")
    single = rows.where("not _maybe").select(
        F.col("_id").alias(doc_id), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256")
    )
    rest = rows.where("_maybe")
    same = rest.groupBy("_len", "_prefix", "_sha", "_id").agg(F.count("*").alias("_n"))
    groups = rest.groupBy("_len", "_prefix", "_sha").agg(F.min("_id").alias("_keep"), F.count("*").alias("_size"))
    # written, so that a group with many rows is met by a broadcast or by a join that Spark can split
    same, groups = written(same, "same"), small(written(groups, "sizes"))
    multi = (
        same.join(groups, ["_len", "_prefix", "_sha"])
        .select("*", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy"))
        .select(
            F.col("_id").alias(doc_id), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
            (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_copy") == 1)).alias("kept"), F.col("_sha").alias("text_sha256"),
        )
    )
    return single.unionByName(multi)


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, whole, that stay.

    Groups are settled on digests; the ids and digests of rows that go are broadcast while
    they are few, so that no text is shuffled.  Beyond that only rows that may have a copy
    are.  Of rows with the same id and equal texts the one with the first JSON stays.
    """
    keys = surviving_keys(docs, text)
    digests = refined(docs, text, F.col(doc_id).alias("_id"), keys=keys).where("_maybe").select("_id", "_sha")
    digests = written(digests.groupBy("_sha", "_id").agg(F.count("*").alias("_n")), "digests")
    # null ids come last: min() skips them
    groups = digests.groupBy("_sha").agg(F.min("_id").alias("_keep"), F.sum("_n").alias("_size")).where("_size > 1")
    # written, so that a group with many ids is met by a broadcast or by a join that Spark can split
    groups = small(written(groups.select("_sha", "_keep"), "keepers"))
    groups = digests.join(groups, "_sha").withColumn("_stays", F.col("_id").eqNullSafe(F.col("_keep")))
    # rows that go, and those that stay but are repeated, so that one of them has to be chosen
    met = written(groups.where("not _stays or _n > 1").select(F.col("_id").alias("_out"), F.col("_sha").alias("_of"), "_stays"), "copies")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = refined(docs, text, row, F.col(doc_id).alias("_id"), keys=keys)
    on = F.col("_id").eqNullSafe(F.col("_out")) & (F.col("_sha") == F.col("_of"))
    if plan_bytes(met) <= BROADCAST_BYTES:
        left = rows.join(F.broadcast(met), on, "left_anti").select("_row")
    else:
        left = rows.where("not _maybe").select("_row").union(rows.where("_maybe").join(met, on, "left_anti").select("_row"))
    twins = met.where("_stays")
    if twins.isEmpty():
        return left.select("_row.*")
    chosen = rows.where("_maybe").join(small(twins), on).groupBy("_id", "_sha").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return left.union(chosen.select("_row")).select("_row.*")
