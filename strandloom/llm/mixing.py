"""Mixing sources to target weights as a time-varying curriculum.

Every source has a schedule of its weight over training time [0, 1].  The schedule's
integral is its share of all words; the words of a source, laid out in a seeded order and
repeated by epochs, meet its cumulative demand, and the inverse of that demand at the
middle of a document is the document's training position.  Documents are range-sorted by
position.

Targets: the sources in code-point order (null last) weigh 3, 1, 2, repeating; they share
``share`` times all words.  No target exceeds ``cap`` times its source's words; what is
above goes to the others by weight until none is above.

Taken words: as many whole epochs as fit, then the documents of the seeded order until the
target is met.  boundary="split" cuts the one document copy at the end of each source at a
word, so that a source gives exactly its target, rounded down; "whole" takes that copy
whole if at least half of it fits, else not.

A running sum over a source of any size goes by hash buckets of about ``bucket_rows``
documents, and over its buckets by ranges, so no task holds a source or all its buckets.

Defined results: size of a null or empty text is 0, and such documents take 0 words.  A
null source is a source.  Rows with equal ids are separate documents; a null id is an id.
Untaken documents have the positions (1 or more) that they would have were training to go
on.  Ties in the seeded order go by id and size; documents equal in both may change places, with equal results.
Texts of any length are counted whole, and are cut by words where a copy is.  Empty tables give empty tables.  Columns other than the named ones travel inside one
struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, dense_index, running_before, small, unit, written

#: Weight over training time relative to its mean, for each place in the cycle of weights: (time, weight).
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def inverse_demand(x: Column, knots) -> Column:
    """The time at which the integral of the piecewise linear schedule is the share x of its whole; runs on after 1."""
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if whole <= 0 or min(w for _, w in knots) < 0 or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError("a schedule needs times from 0 to 1 and weights of at least 0, not all 0")
    out, done = F.when(x >= 1, x), 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        here = (t1 - t0) * (w0 + w1) / 2 / whole
        need, slope = (x - F.lit(done)) * F.lit(whole), (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0)))
        out = out.when(x < done + here, F.lit(t0) + F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / (F.lit(w0) + root)))
        done += here
    return out.otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From rows (_source, _size): _key, _source_size, _docs, _slot, _target for each source."""
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("_source_size"), F.count("*").alias("_docs"))
    per = dense_index(per, [F.col("_source").asc_nulls_last()], "_rank")
    slot = (F.col("_rank") % len(weights)).cast("int")
    per = per.withColumn("_slot", slot).withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_slot") + 1))
    per = written(per.withColumn("_cap", F.col("_source_size") * cap), "sources")
    total = share * (per.agg(F.sum("_source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # one round for each step of resharing; each returns three numbers
        over = (F.col("_w") * level > F.col("_cap")) if capped >= 0 else F.lit(False)
        n, used, open_w = per.agg(
            F.coalesce(F.sum(over.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0))
        ).first()
        if n == capped:
            break
        capped = n
        level = (total - used) / open_w if open_w else float("inf")
    target = F.least(F.col("_cap"), F.col("_w") * F.lit(level)) if level != float("inf") else F.col("_cap")
    return per.select(source_key(F.col("_source")).alias("_key"), "_source_size", "_docs", "_slot", target.alias("_target"))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def mix_plan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, schedules=SCHEDULES, seed: int = 17, boundary: str = "split", bucket_rows: int = 1024) -> DataFrame:
    """One row for each document: _id, _size, _source_size, _target, _taken, _full (whole epochs),
    _extra (words of the last, partial epoch), _start (words of its source before it), _slot; with carry also _row."""
    order = F.xxhash64(F.lit(seed), F.col(doc_id))
    sizes = docs.select(
        F.col(doc_id).alias("_id"), F.col(source).alias("_source"), words_in(F.col(text)).alias("_size"), order.alias("_h"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []),
    )
    if not carry:
        sizes = written(sizes, "sizes")
    per = written(source_targets(sizes.select("_source", "_size"), weights, share, cap), "targets")
    rows = sizes.withColumn("_key", source_key(F.col("_source"))).drop("_source").join(small(per), "_key")
    bucket = F.floor(unit(F.col("_h")) * F.ceil(F.col("_docs") / bucket_rows)).cast("long")
    rows = rows.withColumn("_bucket", bucket)
    sums = rows.groupBy("_key", "_bucket").agg(F.sum("_size").alias("_in"))
    sums = written(running_before(sums, "_key", "_bucket", "_in", "_before").select("_key", "_bucket", "_before"), "buckets")
    inside = Window.partitionBy("_key", "_bucket").orderBy("_h", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_size").over(inside)).join(small(sums), ["_key", "_bucket"])
    full = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0)
    rows = rows.withColumn("_start", F.col("_before") + F.col("_sum") - F.col("_size")).withColumn("_full", full.cast("long"))
    left = F.col("_target") - F.col("_full") * F.col("_source_size") - F.col("_start")
    if boundary == "split":
        extra = F.greatest(F.lit(0), F.least(F.col("_size"), F.floor(left)))
    elif boundary == "whole":
        extra = F.when((F.col("_size") > 0) & (left * 2 >= F.col("_size")), F.col("_size")).otherwise(0)
    else:
        raise ValueError("boundary is 'split' or 'whole'")
    rows = rows.withColumn("_extra", extra.cast("long")).withColumn("_taken", F.col("_full") * F.col("_size") + F.col("_extra"))
    return rows.withColumn("_schedules", F.lit(len(schedules))).drop("_sum", "_before", "_bucket", "_key", "_docs")


def position(epoch: Column, words: Column, schedules=SCHEDULES) -> Column:
    """Training position of a copy: its middle word, through the inverse of its source's demand."""
    middle = epoch * F.col("_source_size") + F.col("_start") + words / 2
    x = F.when(F.col("_target") > 0, middle / F.col("_target")).otherwise(F.lit(1.0) + unit(F.col("_h")))
    out = F.when(F.col("_slot") % len(schedules) == 0, inverse_demand(x, schedules[0]))
    for k in range(1, len(schedules)):
        out = out.when(F.col("_slot") % len(schedules) == k, inverse_demand(x, schedules[k]))
    return out


def mix_documents(docs: DataFrame, *, text: str = "text", n_chars: str = "n_chars", schedules=SCHEDULES, **kw) -> DataFrame:
    """The mix: the rows of docs, one for each copy taken, in training order; a cut copy has the words that fit."""
    plan = mix_plan(docs, text=text, carry=True, schedules=schedules, **kw)
    epochs = F.when(F.col("_taken") > 0, F.sequence(F.lit(0), (F.col("_full") + (F.col("_extra") > 0).cast("long")).cast("int") - 1))
    copies = plan.select("*", F.explode(epochs).alias("_epoch"))
    words = F.when(F.col("_epoch") < F.col("_full"), F.col("_size")).otherwise(F.col("_extra"))
    copies = copies.withColumn("_words", words).withColumn("_position", position(F.col("_epoch"), F.col("_words"), schedules))
    copies = copies.repartitionByRange("_position", "_h", "_epoch").sortWithinPartitions("_position", "_h", "_epoch")
    short = F.expr("regexp_extract(_row[TEXT], concat('^(?:[\\\\x20\\\\x09-\\\\x0D]*+[^\\\\x20\\\\x09-\\\\x0D]++){', _words, '}+'), 0)".replace("TEXT", repr(text)))
    value = F.when(F.col("_words") < F.col("_size"), short).otherwise(F.col("_row")[text])
    copies = copies.withColumn("_text", value)
    new = {text: F.col("_text"), n_chars: F.when(F.col("_words") < F.col("_size"), F.length("_text").cast("long")).otherwise(F.col("_row")[n_chars]) if n_chars in docs.columns else None}
    return copies.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
