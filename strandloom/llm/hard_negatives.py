"""Hard negatives by bit-sliced integer inner products.

Components become whole numbers, floor(256 x).  Anchors lie in packed blocks, and so do all rows; every block of
anchors meets every block of rows (the anchors are a stated query set against all rows), and no pair of rows leaves a
task.  The row blocks that a block of anchors meets are dealt to tasks, at most ``together`` for each, and a task
sends on the ``first`` rows of each of its anchors alone.

In a task a block's components, less the least of them, are cut into bit-planes, and these are multiplied with
the anchors one after the other, the most significant first.  What the planes so far give, and the least and the most
that the others can add, bound a score; each plane halves that interval.  A pair is dropped as soon as its interval

* cannot reach the anchor's first rows so far (positives), or
* meets no window [ratio * positive score, positive score] of the anchor's, or cannot reach the first rows
  of the windows that it meets (negatives).

Pairs are multiplied as a matrix while many are alive, and one by one afterwards.  Products and sums are exact: in
doubles while all sums of a block are below 2^53, else in 64-bit integers.

1. Positives: the first rows of each anchor among those with its label.
2. Negatives: the anchors, with their positives' scores, meet the rows again.

Defined results: rows with a null id, label or vector, or a component that is null or not finite, take no part, nor do
rows whose squared length in whole numbers is 2^62 or more, since their scores need not fit 64 bits.  Vectors of
different length have no score with each other; empty vectors score 0.  Repeated rows are rows of their own, as
candidates and as anchors, whose results then repeat; a row is no "other" of one with its own id.  Ties in the score go by the smaller
id.  Vectors of any length are used whole.  An empty table gives an empty table.  Other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, plan_bytes, ship, slices, small, written

#: Rows of a packed block at most, and bytes of its whole numbers as 32-bit ones.
BLOCK_ROWS, BLOCK_BYTES = 1024, 256 << 10
PACKED = "_dim int, _n int, _ids binary, _labels binary, _ints binary"
FOUND = "_a bigint, _place int, _anchor bigint, _window bigint, _other bigint, _score bigint"
#: The share of pairs alive below which they are multiplied one by one.
SPARSE = 0.05
LEAST = np.iinfo(np.int64).min


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str, label: Column, scale: int = 256) -> DataFrame:
    """_id, _label, _ints of the rows that take part."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("_id"), label.cast("bigint").alias("_label"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    fine = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**31 / scale))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select("_id", "_label", F.transform("_v", lambda x: F.floor(x * scale)).alias("_ints"))
    return rows.where(F.aggregate("_ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) < 2.0**62)


def packed(rows: DataFrame) -> DataFrame:
    """Rows (_id, _label, _ints) in blocks of one length each, and a _name for each block."""

    def pack(dim: int, held: list[tuple]) -> pa.RecordBatch:
        ids, labels, ints = (np.array(x, np.int64) for x in zip(*held))
        width = np.int16 if np.abs(ints).max(initial=0) < 1 << 15 else np.int32
        cells = [dim, len(held), ids.tobytes(), labels.tobytes(), ints.astype(width).tobytes()]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=["_dim", "_n", "_ids", "_labels", "_ints"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for part in slices(batch):
                for row in zip(*[c.to_pylist() for c in part.columns]):
                    dim = len(row[2])
                    held.setdefault(dim, []).append(row)
                    if len(held[dim]) == block_rows(dim):
                        yield pack(dim, held.pop(dim))
        for dim, rest in held.items():
            yield pack(dim, rest)

    return rows.select("_id", "_label", "_ints").mapInArrow(run, PACKED).withColumn("_name", F.monotonically_increasing_id())


def block_rows(dim: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * max(1, dim))))


class Block:
    def __init__(self, dim: int, n: int, ids: bytes, labels: bytes, ints: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.ints = np.frombuffer(ints, np.int16 if len(ints) == 2 * n * dim else np.int32).reshape(n, dim).astype(np.int64)


class Planes:
    """The bit-planes of rows, and for each anchor the least and the most that the planes below one can add."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray):
        least = int(rows.min(initial=0))
        self.rows = rows - least
        self.n = int(self.rows.max(initial=0)).bit_length()
        most = int(np.abs(anchors).sum(axis=1).max(initial=0)) << max(self.n, abs(least).bit_length())
        #: Too large for intervals in 64 bits: sums may wrap, though the scores themselves do not.
        self.wide = most >= 1 << 62
        self.kind = np.float64 if most < 1 << 53 else np.int64
        self.anchors = anchors.astype(self.kind)
        self.below, self.above = np.minimum(anchors, 0).sum(axis=1), np.maximum(anchors, 0).sum(axis=1)
        #: What the shift by the least component took off each score.
        self.base = least * anchors.sum(axis=1)

    def matrix(self, plane: int) -> np.ndarray:
        """Products of all rows' plane with all anchors."""
        return ((self.rows >> plane & 1).astype(self.kind) @ self.anchors.T).astype(np.int64) << plane

    def pairs(self, plane: int, r: np.ndarray, a: np.ndarray, together: int = 1 << 13) -> np.ndarray:
        """Products of some rows' plane with an anchor each."""
        out = np.zeros(len(r), np.int64)
        for i in range(0, len(r), together):
            x, y = r[i : i + together], a[i : i + together]
            out[i : i + together] = np.einsum("ij,ij->i", (self.rows[x] >> plane & 1).astype(self.kind), self.anchors[y])
        return out << plane

    def rest(self, plane: int) -> tuple[np.ndarray, np.ndarray]:
        return self.below * ((1 << plane) - 1), self.above * ((1 << plane) - 1)


def kth_in_columns(values: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of the masked values of each column; LEAST where there are fewer."""
    if len(values) < k:
        return np.full(values.shape[1], LEAST)
    return np.partition(np.where(mask, values, LEAST), len(values) - k, axis=0)[len(values) - k]


def kth_in_groups(values: np.ndarray, groups: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th largest value of each of n groups; LEAST where there are fewer."""
    order = np.lexsort((-values, groups))
    counts = np.bincount(groups, minlength=n)
    full = np.flatnonzero(counts >= k)
    out = np.full(n, LEAST)
    out[full] = values[order][(np.cumsum(counts) - counts)[full] + k - 1]
    return out


def settled(block: Block, anchors: Block, allowed: np.ndarray, k: int, keep: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and score of the allowed pairs whose intervals keep(low, high, of, kth) never drops.

    of(x) lays a value of each anchor beside the pairs; kth(values, mask) is the k-th largest of each anchor's.
    """
    cut, n = Planes(block.ints, anchors.ints), len(anchors.ids)
    if cut.wide:
        r, a = np.nonzero(allowed)
        return r, a, (block.ints @ anchors.ints.T)[r, a]
    alive, sums, plane = allowed, np.repeat(cut.base[None], len(block.ids), axis=0), cut.n
    while plane and np.count_nonzero(alive) > SPARSE * alive.size:
        plane -= 1
        sums += cut.matrix(plane)
        low, high = (sums + x for x in cut.rest(plane))
        alive = alive & keep(low, high, lambda x: x[None], lambda values, mask: kth_in_columns(values, mask & alive, k))
    r, a = np.nonzero(alive)
    sums = sums[r, a]
    while plane and len(r):
        plane -= 1
        sums = sums + cut.pairs(plane, r, a)
        low, high = (sums + x[a] for x in cut.rest(plane))
        left = keep(low, high, lambda x: x[a], lambda values, mask: kth_in_groups(values[mask], a[mask], n, k))
        r, a, sums = r[left], a[left], sums[left]
    return r, a, sums


class First:
    """The first k rows of each key, by score and id."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def floor(self, key) -> int:
        """The score that a row needs."""
        held = self.rows.get(key, ())
        return -held[-1][0] if len(held) == self.k else LEAST

    def add(self, keys: list, scores: list[int], ids: list[int]) -> None:
        for key, score, i in zip(keys, scores, ids):
            held = self.rows.setdefault(key, [])
            if len(held) < self.k or (-score, i) < held[-1]:
                held.append((-score, i))
                held.sort()
                del held[self.k :]


def add_positives(first: First, block: Block, anchors: Block) -> None:
    allowed = (block.labels[:, None] == anchors.labels) & (block.ids[:, None] != anchors.ids)
    floors = np.array([first.floor(i) for i in range(len(anchors.ids))])
    everything = np.ones(1, bool)
    r, a, scores = settled(block, anchors, allowed, first.k, lambda low, high, of, kth: high >= of(np.maximum(floors, kth(low, np.broadcast_to(everything, low.shape)))))
    first.add(a.tolist(), scores.tolist(), block.ids[r].tolist())


def add_negatives(first: First, block: Block, anchors: Block, positive_scores: list[list[int]], ratio: tuple[int, int]) -> None:
    windows = [sorted(set(s)) for s in positive_scores]
    most = max(map(len, windows), default=0)
    # of each anchor its windows' bounds, and the scores that their first rows have reached; no window is (1, 0)
    lows, highs, floors = (np.full((most, len(windows)), x, np.int64) for x in (1, 0, LEAST))
    for i, scores in enumerate(windows):
        for w, s in enumerate(scores):
            lows[w, i], highs[w, i], floors[w, i] = -(-ratio[0] * s // ratio[1]), s, first.floor((i, s))
    allowed = (block.labels[:, None] != anchors.labels) & (lows <= highs).any(axis=0)

    def keep(low, high, of, kth):
        out = np.zeros(low.shape, bool)
        for lo, hi, floor in zip(lows, highs, floors):
            sure = (low >= of(lo)) & (high <= of(hi))
            out |= (high >= of(np.maximum(lo, np.maximum(floor, kth(low, sure))))) & (low <= of(hi))
        return out

    r, a, scores = settled(block, anchors, allowed, first.k, keep)
    for lo, hi in zip(lows, highs):
        inside = np.flatnonzero((scores >= lo[a]) & (scores <= hi[a]))
        first.add(list(zip(a[inside].tolist(), hi[a[inside]].tolist())), scores[inside].tolist(), block.ids[r[inside]].tolist())


def _scan(k: int, ratio: tuple[int, int] | None):
    """The first rows of a task's anchors (without a ratio), or of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, anchors, first = None, None, First(k)

        def out() -> pa.RecordBatch:
            rows = [(key, s, i) if ratio else ((key, None), s, i) for key, held in first.rows.items() for s, i in held]
            place, window = [key[0] for key, _, _ in rows], [key[1] for key, _, _ in rows]
            cells = [name] * len(rows), place, [int(anchors.ids[p]) for p in place], window, [i for _, _, i in rows], [-s for _, s, _ in rows]
            types = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=[x.split()[0] for x in FOUND.split(", ")])

        for batch in batches:
            for part in slices(batch, 4):
                for now, *cells, scores in zip(*[c.to_pylist() for c in part.columns]):
                    if now != name:
                        if name is not None:
                            yield out()
                        name, anchors, first = now, Block(*cells[5:]), First(k)
                    if ratio:
                        add_negatives(first, Block(*cells[:5]), anchors, scores, ratio)
                    else:
                        add_positives(first, Block(*cells[:5]), anchors)
        if name is not None:
            yield out()

    return run


def first_found(rows: DataFrame, anchors: DataFrame, k: int, ratio: tuple[int, int] | None, together: int) -> DataFrame:
    """The first k rows of each anchor or window, over all blocks; each (_a, _place) is an anchor."""
    n_rows, n_anchors = rows.count(), anchors.count()
    deals = max(1, min(n_rows, rows.sparkSession.sparkContext.defaultParallelism), -(-n_rows // together))
    cells = [c.split()[0] for c in PACKED.split(", ")]
    anchors = anchors.select("_a", *[F.col(c).alias(f"_x{c}") for c in cells], "_scores")
    met = rows.withColumn("_deal", F.pmod(F.xxhash64("_name"), F.lit(deals)).cast("int")).withColumn("_a", F.explode(F.expr(f"sequence(0L, {n_anchors}L - 1)"))) if n_anchors else rows.where("false").withColumns({"_deal": F.lit(0), "_a": F.lit(0).cast("bigint")})
    if plan_bytes(anchors) <= BROADCAST_BYTES:
        met = met.join(F.broadcast(anchors), "_a").where("_dim = _x_dim").repartition(max(1, n_anchors * deals), "_a", "_deal")
    else:  # a copy of each block for each deal, so that no task meets all rows
        met = met.join(anchors.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))), ["_a", "_deal"]).where("_dim = _x_dim")
    met = met.sortWithinPartitions("_a", "_deal").select("_a", *cells, *[f"_x{c}" for c in cells], "_scores")
    found = met.mapInArrow(_scan(k, ratio), FOUND)
    by = ["_a", "_place"] + (["_window"] if ratio else [])
    return found.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_score"), "_other"))).where(F.col("_rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", *, positives: int = 5, negatives: int = 5, ratio: tuple[int, int] = (80, 100), scale: int = 256, together: int = 64) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; is_anchor is a condition on vec_id, named _id in it."""
    spark = vectors.sparkSession
    ship(spark)
    rows = written(whole_numbers(vectors, vec_id, vector, F.col(f"`{label}`") if isinstance(label, str) else label, scale), "rows")
    chosen = rows.where(is_anchor)
    blocks = written(packed(rows), "row_blocks")
    anchors = written(packed(chosen.repartition(max(1, -(-chosen.count() // BLOCK_ROWS)))), "anchor_blocks")
    # a row for each block of anchors
    numbers = written(anchors.select("_name", (F.row_number().over(Window.orderBy("_name")) - 1).cast("bigint").alias("_a")), "numbers")
    anchors = written(anchors.join(small(numbers), "_name").drop("_name"), "anchors")
    none = F.lit(None).cast("array<array<bigint>>")
    best = written(first_found(blocks, anchors.withColumn("_scores", none), positives, None, together), "positives")
    scores = best.groupBy("_a", "_place").agg(F.collect_set("_score").alias("_s")).groupBy("_a").agg(F.map_from_entries(F.collect_list(F.struct("_place", "_s"))).alias("_of"))
    each = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.coalesce(F.try_element_at("_of", i), F.array().cast("array<bigint>")))
    asked = written(anchors.join(scores, "_a").withColumn("_scores", each).drop("_of"), "asked")
    found = first_found(blocks, asked, negatives, ratio, together).select("_a", "_place", F.col("_window").alias("_score"), "_rank", F.col("_other").alias("_negative"), F.col("_score").alias("_ns"))
    pairs = best.select("_a", "_place", "_anchor", "_score", F.col("_other").alias("_positive")).join(found, ["_a", "_place", "_score"])
    return pairs.select(
        F.col("_anchor").alias("anchor_id"), F.col("_positive").alias("positive_id"), F.col("_rank").cast("int").alias("rank"),
        F.col("_negative").alias("negative_id"), F.col("_score").alias("positive_score"), F.col("_ns").alias("negative_score"),
    )
