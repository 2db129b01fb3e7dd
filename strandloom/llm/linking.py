"""Links among members of hash buckets, and connected components, without all pairs of a bucket.

``linked_components`` first tests every member against one leader of its bucket.  A bucket
whose members then lie in one component needs nothing more.  The others are tested in
blocks of bounded size: a task holds two blocks of one bucket, skips members that are
connected already and returns links alone.  So every pair of a bucket is tested or known to
be connected: no link between different components is lost, and a bucket of near copies
costs about one test a member.

Components come from alternating large-star and small-star steps over written tables; no
link or label reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, small, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (_a, _b) with _a > _b, no loops.

    In a large star the least neighbours are written, so that a node with many edges, such as the least of a component, is
    met by a broadcast or by a join that Spark can split; in a small star nodes have only the edges to smaller ones.
    """
    if large:
        both = edges.union(edges.select("_b", "_a"))
        least = written(both.groupBy("_a").agg(F.min("_b").alias("_m")).select("_a", F.least("_m", "_a").alias("_m")), "least")
        out = both.join(small(least), "_a").where("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
    else:
        least = edges.groupBy("_a").agg(F.min("_b").alias("_m"))
        met = edges.join(least, "_a")
        out = met.where("_b <> _m").select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).union(least.select("_a", F.col("_m").alias("_b")))
    return out.where("_a <> _b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(_id, _comp): the smallest id reachable from each id that has a link (_a, _b)."""
    edges = written(links.where("_a <> _b").select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct(), "links")
    last = None
    while True:
        before, edges = edges, written(_star(_star(edges, True), False), "stars")
        discard(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return written(edges.select(F.col("_a").alias("_id"), F.col("_b").alias("_comp")).union(edges.select("_b", "_b")).distinct(), "components")


def linked_components(members: DataFrame, payload: Callable[[DataFrame], DataFrame], ready: Callable[[bytes], object], linked: Callable[[object, object], bool], compatible: Callable[[Column, Column], Column] | None = None, block: int = 512) -> DataFrame:
    """(_id, _comp) of the ids with a link, from members (_bucket, _id, _n).

    payload gives (_id, _payload binary) for a table of ids, ready makes of a payload what
    linked compares; compatible(n, m) tells from the members' _n which pairs can be links.
    """
    can = compatible or (lambda n, m: F.lit(True))
    members = written(members, "members")
    heads = members.groupBy("_bucket").agg(F.count("*").alias("_g"), F.min(F.struct("_id", "_n")).alias("_lead")).where("_g > 1")
    shared = written(members.join(heads, "_bucket"), "buckets")
    pairs = shared.where(F.col("_lead._id") != F.col("_id")).where(can(F.col("_n"), F.col("_lead._n")))
    pairs = written(pairs.select(F.col("_lead._id").alias("_a"), F.col("_id").alias("_b")).distinct(), "pairs")
    held = written(payload(pairs.select(F.col("_a").alias("_id")).union(pairs.select("_b")).distinct()), "payload")
    both = pairs.join(held.select(F.col("_id").alias("_a"), F.col("_payload").alias("_x")), "_a").join(held.select(F.col("_id").alias("_b"), F.col("_payload").alias("_y")), "_b")
    ship(members.sparkSession)
    links = written(both.select("_a", "_b", "_x", "_y").mapInArrow(_tested(ready, linked), pairs.schema), "verified")
    labels = components(links)
    # buckets of two have been tested whole
    known = shared.where("_g > 2").drop("_lead").join(labels, "_id", "left").withColumn("_comp", F.coalesce("_comp", "_id"))
    known = written(known, "labelled")
    mixed = known.groupBy("_bucket").agg(F.min("_comp").alias("_low"), F.max("_comp").alias("_high")).where("_low <> _high").select("_bucket")
    known = written(known.join(mixed, "_bucket", "left_semi"), "mixed")
    if known.isEmpty():
        return labels
    held = written(payload(known.select("_id").distinct()), "payload")
    parts = F.ceil(F.col("_g") / block).cast("int")
    known = known.join(held, "_id").withColumn("_own", F.pmod(F.xxhash64("_id", "_bucket"), parts).cast("int"))
    units = known.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_other"))
    units = units.select("_bucket", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).cast("int").alias("_side"), "_id", "_comp", "_payload")
    units = units.repartition(F.col("_bucket"), F.col("_i"), F.col("_j")).sortWithinPartitions("_bucket", "_i", "_j", "_id")
    more = units.mapInArrow(_blocks(ready, linked), pairs.schema)
    return components(links.union(more))


#: Bytes of leaders that a task keeps ready, at eight for each byte of a payload.
READY_BYTES = 32 << 20


def _tested(ready, linked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, object] = {}
        held = 0
        for batch in batches:
            keep = []
            for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns[:2]], batch.column(2), batch.column(3)):
                if a not in made:
                    if held > READY_BYTES:  # k-mers of whole texts
                        made, held = {}, 0
                    made[a] = ready(x := x.as_py())
                    held += 8 * len(x)
                keep.append(linked(made[a], ready(y.as_py())))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["_a", "_b"])

    return run


def _blocks(ready, linked):
    """Tests block pairs of buckets, which come sorted; members that are connected already are not tested again."""

    def unit_links(i: int, j: int, rows: list[tuple]) -> list[tuple[int, int]]:
        parent = {comp: comp for _, _, comp, _ in rows}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        made = [(side, k, comp, ready(payload)) for side, k, comp, payload in rows]
        left = [r for r in made if r[0] == 0]
        out = []
        for at, (_, a, comp_a, x) in enumerate(left):
            for _, b, comp_b, y in left[at + 1 :] if i == j else (r for r in made if r[0] == 1):
                if (p := root(comp_a)) != (q := root(comp_b)) and linked(x, y):
                    parent[p] = q
                    out.append((a, b))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []
        for batch in batches:
            for *unit, side, k, comp, payload in zip(*[c.to_pylist() for c in batch.columns]):
                if unit != key:
                    if rows:
                        found += unit_links(key[1], key[2], rows)
                    key, rows = unit, []
                rows.append((side, k, comp, payload))
            yield _links(found)
            found = []
        if rows:
            yield _links(unit_links(key[1], key[2], rows))

    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"_a": pa.array([a for a, _ in found], pa.int64()), "_b": pa.array([b for _, b in found], pa.int64())})
