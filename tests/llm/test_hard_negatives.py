"""Hard negatives against all pairs, and the bit-planes against plain products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import hard_negatives, registry

SCHEMA = "vec_id bigint, embedding array<double>, label int, _id int, _label string, rank int"


def plain(rows, is_anchor, k=5, n=5, ratio=(80, 100)):
    """All pairs, one by one; rows are (id, vector, label)."""
    ready = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * x) for x in v]
        if sum(x * x for x in ints) < 2**62:
            ready.append((i, ints, label))
    out = []
    for a, x, label in ready:
        if not is_anchor(a):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, other) for i, y, other in ready if len(y) == len(x)]
        best = sorted((s, i) for s, i, other in scored if other == label and i != a)[:k]
        for s, i in best:
            fits = sorted((t, j) for t, j, other in scored if other != label and ratio[0] * -s <= ratio[1] * -t <= ratio[1] * -s)[:n]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(fits)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def clustered(rng, n, dim, labels, coarse=None):
    centers = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rng.choices(range(labels), [labels, *[1] * (labels - 1)])[0]  # a hot label
        v = [(c + rng.gauss(0, 1)) / dim**0.5 for c in centers[rng.choice([label, rng.randrange(labels)])]]
        rows.append((i, [round(x * coarse) / coarse for x in v] if coarse else v, label))
    return rows


@pytest.mark.parametrize("coarse", [None, 4])
@pytest.mark.parametrize("joined", [False, True])
def test_against_all_pairs(spark, coarse, joined, monkeypatch):
    """Several blocks of rows; with few distinct scores most are ties; anchors that are broadcast, and that are not."""
    if joined:
        monkeypatch.setattr(hard_negatives, "BROADCAST_BYTES", 0)
    rng = random.Random(f"{coarse}")
    rows = clustered(rng, 2600, 12, 4, coarse)
    got = hard_negatives.hard_negatives(frame(spark, rows).repartition(5), F.col("_id") % 100 == 0, together=2)
    want = plain(rows, lambda i: i % 100 == 0)
    assert found(got) == want and len(want) > 200


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = clustered(rng, 60, 6, 3, 3)
    nan, inf = float("nan"), float("inf")
    odd = [(100, None, 1), (101, [0.5] * 6, None), (None, [0.5] * 6, 1), (102, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (103, [nan] * 6, 1), (104, [inf] + [0.0] * 5, 1), (105, [], 0), (106, [], 0), (110, [], 1), (107, [0.0] * 6, 0), (108, [1.0, 2.0], 0), (109, [1e300] * 6, 0), (120, [-0.001, 0.5, 0.25, -1.0, 3.0, 4.0e6], 1)]
    every = rows + odd
    got = hard_negatives.hard_negatives(frame(spark, every), F.col("_id") % 5 == 0)
    assert found(got) == plain(every, lambda i: i % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert any(r[0] == 110 or r[0] == 105 for r in found(got))  # empty vectors score 0 with each other
    assert hard_negatives.hard_negatives(frame(spark, []), F.col("_id") % 5 == 0).count() == 0
    assert hard_negatives.hard_negatives(frame(spark, rows), F.col("_id") < 0).count() == 0


def test_repeated_rows(spark):
    """Copies are rows of their own, as candidates and as anchors; a row with an anchor's id is never its positive."""
    rows = clustered(random.Random(8), 40, 4, 2, 2)
    rows = rows + rows[:12] + [(3, [1.0, 1.0, 0.0, 0.0], 0), (3, [1.0, 1.0, 0.0, 0.0], 1)]
    got = hard_negatives.hard_negatives(frame(spark, rows), F.col("_id") % 4 == 0)
    assert found(got) == plain(rows, lambda i: i % 4 == 0)


@pytest.mark.parametrize("size", [1, 200, 2**20, 2**30])
def test_planes_drop_no_pair(size):
    """Scores of what is left are the products, and nothing of the first k is dropped, for components of all sizes."""
    rng = np.random.default_rng(size)
    rows, anchors = (rng.integers(-size, size + 1, (n, 9)) for n in (150, 20))
    blocks = [hard_negatives.Block(9, len(x), np.arange(len(x)).tobytes(), rng.integers(0, 2, len(x)).tobytes(), x.astype(np.int32).tobytes()) for x in (rows, anchors)]
    assert hard_negatives.Planes(*[b.ints for b in blocks]).wide == (size == 2**30)
    products = rows @ anchors.T
    allowed = rng.random(products.shape) < 0.9
    floors = np.full(len(anchors), hard_negatives.LEAST)
    r, a, scores = hard_negatives.settled(*blocks, allowed, 4, lambda low, high, of, kth: high >= of(np.maximum(floors, kth(low, np.ones_like(low, bool)))))
    assert (scores == products[r, a]).all()
    left = set(zip(r.tolist(), a.tolist()))
    for j in range(len(anchors)):
        some = np.flatnonzero(allowed[:, j])
        assert all((int(i), j) in left for i in some[np.argsort(-products[some, j])][:4])
    if size == 200:
        assert len(left) < 0.2 * allowed.sum()


def test_query_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["label"] is not None and r["vec_id"] % 7 == 0 else r["label"]) for r in rows]
    assert found(registry.op12_hard_negatives(spark, "/root/testdata/sf0.01")) == plain(rows, lambda i: i % 100 == 0)
