"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random to ``blocks`` times eight dimensions in each of
``tables`` tables; every block is decoded to its nearest point of the lattice E8, and the
points of a table together are the cell.  A vector also belongs to the ``probes`` cells
that come next: those with one block moved to a neighbouring lattice point, nearest first.
Vectors with the same label that share a cell are tested by cosine in double precision.

Buckets are tested leader first, then in blocks (see linking).  When the components are known, all links
lie inside them, and each component is counted in blocks of ``block`` vectors a side:
every pair once, no pair emitted.

Vectors equal in every bit and label are one class, tested once and counted as often as
they occur.

Defined results: a null label or id, or a vector that is null, empty, zero or holds a null
or non-finite component, links with nothing and is its own component; so do vectors of
different length with each other.  Rows with equal ids are separate vectors and share the
component id.  Links at the very threshold are settled by one exact sum, for tests and counts alike.
Vectors of any length are used whole.  An empty table gives an empty table.  Other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

from itertools import combinations, product
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from .common import mapped, small, written
from .linking import linked_components


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(out, np.int64)


def nearest_d8(y: np.ndarray) -> np.ndarray:
    """The nearest integer vectors with an even sum."""
    out = np.rint(y)
    off = y - out
    worst = np.abs(off).argmax(-1)
    rows = np.flatnonzero(out.sum(-1).astype(np.int64) & 1)
    out[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
    return out


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and D8 shifted by a half."""
    a, b = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    closer = ((y - a) ** 2).sum(-1) <= ((y - b) ** 2).sum(-1)
    return np.where(closer[..., None], a, b)


class Lattice:
    def __init__(self, dim: int, tables: int, blocks: int, probes: int, scale: float, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        self.probes = probes
        self.project = rng.standard_normal((tables, dim, 8 * blocks)) * scale
        self.weight = rng.integers(1, 2**62, (tables, blocks, 8)).astype(np.uint64) | np.uint64(1)
        self.near = minimal_vectors()

    def cells(self, unit_rows: np.ndarray) -> np.ndarray:
        """Hashes of the cells of each vector, for all tables: the own cell and the next ones."""
        n, out = len(unit_rows), []
        for project, weight in zip(self.project, self.weight):
            y = (unit_rows @ project).reshape(n, -1, 8)
            at = nearest_e8(y.reshape(-1, 8)).reshape(y.shape)
            own = ((2 * at).astype(np.int64).astype(np.uint64) * weight).sum((1, 2))
            farther = (2 - (y - at) @ self.near.T).reshape(n, -1)  # squared distance added by each move
            best = np.argpartition(farther, self.probes, axis=1)[:, : self.probes]
            step = (self.near.astype(np.uint64)[None] * weight[:, None]).sum(-1).reshape(-1)
            out.append(np.concatenate([own[:, None], own[:, None] + step[best]], axis=1))
        return np.stack(out, axis=1)


def usable(v) -> np.ndarray | None:
    if not v or any(x is None for x in v):
        return None
    a = np.array(v, np.float64)
    return a if np.isfinite(a).all() and a.any() else None


def _units(rows: list[bytes]) -> np.ndarray:
    a = np.stack([np.frombuffer(r, np.float64) for r in rows])
    a = a / np.abs(a).max(axis=1)[:, None]  # no overflow in squares
    return a / np.sqrt((a * a).sum(axis=1))[:, None]


def _ready(payload: bytes) -> tuple[bytes, np.ndarray]:
    return payload[:32], _units([payload[32:]])[0]  # the label's hash goes first


#: A product that is too near to the threshold to tell; the order of its sum could decide.
MAYBE = 2


def reach(products: np.ndarray, threshold: float) -> np.ndarray:
    """1 where a product of unit vectors is at least the threshold, 0 where it is less, else MAYBE."""
    return np.where(np.abs(products - threshold) < 1e-9, MAYBE, products >= threshold).astype(np.int8)


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """The product of two unit vectors, summed without rounding between."""
    return fsum((x * y).tolist())


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """The one rule for links, wherever they are tested or counted."""
    hit = int(reach(x @ y, threshold))
    return cosine(x, y) >= threshold if hit == MAYBE else hit == 1


def _cells(dim_args: tuple):
    def make(values):
        ready: dict[int, Lattice] = {}
        by_dim: dict[int, list[int]] = {}
        for i, v in enumerate(values):
            by_dim.setdefault(len(v) // 8, []).append(i)
        out: list = [None] * len(values)
        for dim, rows in by_dim.items():
            lattice = ready.setdefault(dim, _lattice(dim, *dim_args))
            found = lattice.cells(_units([values[i] for i in rows]))
            table = (np.arange(found.shape[1], dtype=np.uint64) + np.uint64(dim << 8)) * np.uint64(0x9E3779B97F4A7C15)
            for i, r in zip(rows, (found + table[None, :, None]).reshape(len(rows), -1).view(np.int64).tolist()):
                out[i] = r
        return (pa.array(out, pa.list_(pa.int64())),)

    return make


_lattices: dict[tuple, Lattice] = {}


def _lattice(*args) -> Lattice:
    if args not in _lattices:
        _lattices[args] = Lattice(*args)
    return _lattices[args]


def _counted(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Links of each class in a bin of block pairs, copies of the partner counted."""
        ids, links = [], []
        frame = table.to_pydict()
        parts: dict[tuple, tuple[list, list]] = {}
        for r, key in enumerate(zip(frame["_comp"], frame["_i"], frame["_j"])):
            parts.setdefault(key, ([], []))[frame["_side"][r]].append(r)
        for (_, i, j), (left, right) in parts.items():
            right = left if i == j else right
            if not left or not right:
                continue
            dims = np.array([len(frame["_vector"][r]) for r in left + right])
            if dims.min() != dims.max():
                raise ValueError("a component holds vectors of one length only")
            a, b = (_units([frame["_vector"][r] for r in rows]) for rows in (left, right))
            near = reach(a @ b.T, threshold)
            for p, q in np.argwhere(near == MAYBE):
                near[p, q] = cosine(a[p], b[q]) >= threshold
            near = near == 1
            if i == j:
                np.fill_diagonal(near, False)
            for rows, others, hit in [(left, right, near)] + [(right, left, near.T)] * (i != j):
                ids += [frame["_id"][r] for r in rows]
                links += (hit @ np.array([frame["_copies"][r] for r in others])).tolist()
        return pa.table({"_id": pa.array(ids, pa.int64()), "_links": pa.array(links, pa.int64())})

    return run


def embedding_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", *, threshold: float = 0.93, tables: int = 12, blocks: int = 3, probes: int = 8, scale: float = 0.45, block: int = 256) -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id, kept."""

    def packed(values):
        return (pa.array([None if (a := usable(v)) is None else a.tobytes() for v in values], pa.binary()),)

    rows = vectors.select(F.col(vec_id).alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("_v"))
    rows = mapped(rows, ["_id", "_label"], "_v", [StructField("_vector", BinaryType())], packed)
    fine = F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_vector").isNotNull()
    rows = written(rows.withColumn("_vector", F.when(fine, F.col("_vector"))), "vectors")
    classes = rows.where("_vector is not null").groupBy("_label", "_vector").agg(F.min("_id").alias("_id"), F.count("*").alias("_copies"))
    classes = written(classes, "classes")
    cells = mapped(classes, ["_id", "_label"], "_vector", [StructField("_cells", ArrayType(LongType()))], _cells((tables, blocks, probes, scale)))
    members = cells.select("_id", F.lit(0).alias("_n"), F.explode("_cells").alias("_cell"), "_label").select("_id", "_n", F.xxhash64("_cell", "_label").alias("_bucket"))

    def payload(ids: DataFrame) -> DataFrame:
        return classes.join(small(written(ids, "wanted")), "_id", "left_semi").select("_id", F.concat(F.unhex(F.sha2(F.col("_label").cast("string"), 256)), "_vector").alias("_payload"))

    labels = linked_components(members, payload, _ready, lambda x, y: x[0] == y[0] and len(x[1]) == len(y[1]) and linked(x[1], y[1], threshold))
    inside = classes.join(labels, "_id")
    sizes = inside.groupBy("_comp").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    inside = inside.join(small(written(sizes, "sizes")), "_comp").withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
    # block pairs (i, j), i <= j: each vector goes to those of its block
    met = inside.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    met = met.select("_comp", "_id", "_vector", "_copies", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).cast("int").alias("_side"))
    met = written(met, "block_pairs")
    bins = max(1, met.count() // 2048)
    met = met.withColumn("_bin", F.pmod(F.xxhash64("_comp", "_i", "_j"), F.lit(bins)))
    counted = met.groupBy("_bin").applyInArrow(_counted(threshold), "_id long, _links long").groupBy("_id").agg(F.sum("_links").alias("_links"))
    known = classes.join(labels, "_id", "left").join(counted, "_id", "left")
    known = known.select("_label", "_vector", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"), F.coalesce("_comp", "_id").alias("_comp"))
    out = rows.join(written(known, "known"), ["_label", "_vector"], "left")
    comp = F.coalesce("_comp", "_id")
    return out.select(F.col("_id").alias(vec_id), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("_id").eqNullSafe(comp).alias("kept"))
