"""Operators of the sequence pipeline against hand-derived cases and independent models."""

import gzip
import hashlib
import json
import os
import random
import signal
import struct
from collections import Counter, deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom import queries
from strandloom.functions import sequences as S
from strandloom.functions import storage
from strandloom.functions.ordering import spread
from strandloom.operators import barcodes, binning, cover, kmers, overlap, paths, selection, spectrum
from strandloom.plans import runner, search_log
from strandloom.sources import adapters, readers, writers
from strandloom.streaming import incremental

BARCODED = "read_id string, read_int bigint, read_len int, barcode array<bigint>, n_barcodes int"


def coded(spark, lists, length=100):
    return spark.createDataFrame([(str(i), i, length, b, len(b)) for i, b in lists.items()], BARCODED)


def edge_frame(spark, edges):
    return spark.createDataFrame([(a, b) for a, bs in edges.items() for b in bs], "src bigint, dst bigint")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "read_int bigint")


def test_canonical_kmers_reset_at_other_letters(spark):
    reads = spark.createDataFrame([(0, "acgNACG"), (1, "TTT"), (2, "AC"), (3, "")], "read_int bigint, seq string")
    assert sorted(map(tuple, kmers.kmers(reads, 3).collect())) == [(0, 0, "ACG"), (0, 4, "ACG"), (1, 0, "AAA")]


def test_chunks_do_not_change_kmers(spark):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGTN" if i % 97 == 0 else "ACGT") for i in range(1000))
    flip = str.maketrans("ACGT", "TGCA")
    want = [(i, min(w, w.translate(flip)[::-1])) for i in range(980) if "N" not in (w := seq[i : i + 21])]
    got = kmers.kmers(spark.createDataFrame([(0, seq)], "read_int bigint, seq string"), 21).select("pos", "kmer").collect()
    assert sorted(map(tuple, got)) == want


def model_windows(seq, k):
    flip = str.maketrans("ACGT", "TGCA")
    s = seq.upper()
    return [(i, min(w, w.translate(flip)[::-1])) for i in range(len(s) - k + 1) if set(w := s[i : i + k]) <= set("ACGT")]


def test_codes_are_the_kmers(spark, monkeypatch):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGTNacgt" if i % 5 == 0 else "ACGT") for _ in range(rng.randint(0, 400))) for i in range(40)]
    seqs += ["", "ACG", None, "é" * 50, "A" * 300]
    reads = spark.createDataFrame([(str(i), i, s, len(s or "")) for i, s in enumerate(seqs)], "read_id string, read_int bigint, seq string, read_len int")
    want = sorted((i, p, w) for i, s in enumerate(seqs) for p, w in model_windows(s or "", 21))
    for together in (1, kmers.TOGETHER):
        monkeypatch.setattr(kmers, "TOGETHER", together)
        got = kmers.kmer_codes(reads, 21).select("read_int", "pos", kmers.decoded(F.col("code"), 21)).collect()
        assert sorted(map(tuple, got)) == want
    assert sorted(map(tuple, kmers.kmers(reads, 21).collect())) == want
    assert dict(map(tuple, kmers.kmer_counts(reads, 21).collect())) == Counter(w for _, _, w in want)
    assert dict(map(tuple, kmers.kmer_counts(reads, 35).collect())) == Counter(w for s in seqs for _, w in model_windows(s or "", 35))
    marks = spectrum.unikmers(kmers.code_counts(reads, 21), 1, 300)
    ids = {w: i for i, w in enumerate(sorted({w for _, _, w in want}))}
    lists = {i: [ids[w] for j, _, w in want if j == i] for i in range(len(seqs))}
    for most in (0, 1 << 22):  # by a join, and by a broadcast
        assert {r["read_int"]: r["barcode"] for r in barcodes.barcodes(reads, marks, 21, most_broadcast=most).collect()} == lists
    assert all(r["barcode"] == [] for r in barcodes.barcodes(reads, marks.limit(0), 21).collect())
    assert kmers.kmer_counts(reads.limit(0), 21).count() == 0


@pytest.mark.parametrize("k", [1, 4, 11, 21, 31])
def test_super_kmers(k):
    """Packed runs hold each k-mer as often as the reads do, each one in the bucket of its own."""
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGTNacgt" if i % 5 == 0 else "ACGT") for _ in range(rng.randint(0, 300))) for i in range(40)]
    seqs += ["", "ACG", None, "é" * 50, "A" * 70_000, "AC" * 20_000]
    code = lambda w: sum("ACGT".index(c) << 2 * i for i, c in enumerate(reversed(w)))
    want = Counter(code(w) for s in seqs for _, w in model_windows(s or "", k))
    for buckets in (1, 7, 1000):
        found = kmers.super_kmers(kmers._digits_of(seqs)[0], k, buckets)
        assert Counter(kmers.packed_codes([x for _, x in found], k).tolist()) == want
        homes = Counter(c for b in {b for b, _ in found} for c in set(kmers.packed_codes([x for y, x in found if y == b], k).tolist()))
        assert set(homes.values()) <= {1} and all(0 <= b < buckets for b, _ in found)


def test_a_hot_minimizer(spark):
    """A read that makes a third of the input, and one run of a base: their buckets are counted in part."""
    rng = random.Random(9)
    hot = "".join(rng.choice("ACGT") for _ in range(200))
    seqs = [hot] * 150 + ["A" * 5000] * 20 + ["".join(rng.choice("ACGT") for _ in range(300)) for _ in range(100)]
    reads = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_int bigint, seq string").repartition(3)
    whole = sorted(map(tuple, kmers.code_counts(reads, 21).collect()))
    for limit in (0, 3000):
        assert sorted(map(tuple, kmers.code_counts(reads, 21, bucket_bytes=500, hot_bytes=limit).collect())) == whole
    flip = str.maketrans("ACGT", "TGCA")
    want = Counter(min(w, w.translate(flip)[::-1]) for s in seqs for i in range(len(s) - 20) if (w := s[i : i + 21]))
    assert dict(map(tuple, kmers.kmer_counts(reads, 21).collect())) == want


def test_runs_are_shuffled_once_and_not_written(spark, monkeypatch):
    """Counting writes no runs, and what some reads tell wrongly about large buckets changes no count."""
    rng = random.Random(19)
    seqs = ["A" * 3000] * 5 + ["".join(rng.choice("ACGT") for _ in range(400)) for _ in range(50)]
    reads = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_int bigint, seq string").repartition(3)
    tags = []
    monkeypatch.setattr(kmers, "written", lambda df, tag, *a: tags.append(tag) or storage.written(df, tag, *a))
    whole = sorted(map(tuple, kmers.code_counts(reads, 21, bucket_bytes=500).collect()))
    assert not tags
    for told in ([], [1], list(range(1000))):
        monkeypatch.setattr(kmers, "hot_buckets", lambda *a: (told, 4))
        assert sorted(map(tuple, kmers.code_counts(reads, 21, bucket_bytes=500).collect())) == whole
        rare = kmers.kmer_histogram(kmers.code_counts(reads, 21, least=5, bucket_bytes=500))
        assert sum(r["freq"] * r["n_kmers"] for r in rare.collect()) == sum(n for _, n in whole)
    assert "runs" not in tags


def test_hot_buckets_from_some_of_the_reads(spark):
    """A minimizer of many reads is told by a share of them, with the parts that its bucket needs."""
    rng = random.Random(20)
    seqs = ["A" * 4000] * 300 + ["".join(rng.choice("ACGT") for _ in range(4000)) for _ in range(300)]
    reads = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_int bigint, seq string").repartition(3)
    hot, parts = kmers.hot_buckets(reads, 21, 64, 16 << 20, 100_000)
    assert len(hot) == 1 and parts >= 2
    assert kmers.hot_buckets(reads, 21, 64, 1 << 20, 16 << 20) == ([], 1)


def test_queries_on_barcodes_deal_reads_out_once(spark, monkeypatch):
    """Barcodes take the reads that counting took, as they were written, and do not deal the texts out again."""
    dealt, made = [], barcodes.barcodes
    monkeypatch.setattr(barcodes, "barcodes", lambda r, *a: dealt.append("RoundRobin" in r._jdf.queryExecution().toString()) or made(r, *a))
    assert queries.q_barcode_distribution(spark, "/root/testdata/sf0.01").agg(F.sum("n_reads")).first()[0] == 1000
    assert dealt == [False]


def test_filter_of_unikmers(spark, monkeypatch):
    """With more unikmers than are broadcast, the k-mers that reach the join are the hits and a small share of the others."""
    rng = random.Random(13)
    seqs = ["".join(rng.choice("ACGT") for _ in range(2000)) for _ in range(60)]
    reads = spark.createDataFrame([(str(i), i, s, len(s)) for i, s in enumerate(seqs)], "read_id string, read_int bigint, seq string, read_len int")
    few = spectrum.unikmers(kmers.code_counts(reads.where("read_int < 20"), 21), 1, 99)
    n = few.count()
    sent = barcodes.suspected_codes(reads, few, n, 21).count()
    hits = 20 * 1980
    assert n > 30_000 and hits <= sent <= hits + 0.02 * (60 * 1980 - hits)
    by_filter = barcodes.barcodes(reads, few, 21, most_broadcast=n - 1)
    assert sorted(map(tuple, by_filter.collect())) == sorted(map(tuple, barcodes.barcodes(reads, few, 21).collect()))
    # a filter at its bound holds more, and loses none
    bits = barcodes.unikmer_filter(few, n, 1 << 12)
    assert len(bits) == 1 << 12
    monkeypatch.setattr(barcodes, "unikmer_filter", lambda *a: bits)
    assert barcodes.suspected_codes(reads.where("read_int < 20"), few, n, 21).count() == hits


def test_suspects_are_the_windows_that_the_filter_holds():
    rng = np.random.default_rng(6)
    seqs = ["".join(rng.choice(list("ACGTN"), n, p=[0.248] * 4 + [0.008])) for n in rng.integers(0, 3000, 40)] + [None, "", "ACGT" * 5]
    code, of, pos = kmers.window_codes(seqs, 21)
    marks = rng.choice(code, 300)
    bits = 1 << 15
    full = np.zeros(bits, bool)
    for at in barcodes._spots(marks, bits):
        full[at] = True
    known = np.packbits(full, bitorder="little")
    hit = np.all([full[at] for at in barcodes._spots(code, bits)], axis=0)
    assert hit.sum() >= 300
    for got, want in zip(barcodes.suspects(seqs, known, 21), (code[hit], of[hit], pos[hit])):
        assert got.tolist() == want.tolist()
    assert [len(x) for x in barcodes.suspects(["ACGT"], known, 21)] == [0, 0, 0]
    assert [len(x) for x in barcodes.suspects(seqs, np.zeros_like(known), 21)] == [0, 0, 0]


def test_frequency_window(spark):
    h = spark.createDataFrame([(0, 7), (1, 1000), (2, 100), (3, 50), (4, 45), (5, 60), (6, 80), (7, 60), (8, 40)], "freq bigint, n_kmers bigint")
    row = spectrum.frequency_window(h).first()
    assert (row["start_idx"], row["peak_idx"], row["lower"], row["upper"]) == (2, 5, 5, 11)
    assert row["mean"] == pytest.approx(5.522388059701493) and row["std"] == pytest.approx(1.5774361302227284)
    for rows in ([(1, 100), (2, 10), (3, 1)], []):
        with pytest.raises(ValueError, match="valley"):
            spectrum.window_bounds(spark.createDataFrame(rows, "freq bigint, n_kmers bigint"))


def test_bins(spark):
    dist = {0: (2, 200), 3: (1, 400), 5: (1, 500), 7: (1, 600), 8: (1, 500), 60: (2, 900), 300: (1, 1000), 520: (1, 700)}
    d = spark.createDataFrame([(c, n, b) for c, (n, b) in dist.items()], "n_barcodes int, n_reads bigint, sum_bases bigint")
    bounds = binning.bin_bounds(d)
    row = bounds.first()
    assert (row["mean"], row["lower"], row["upper"], row["adjusted"]) == (pytest.approx(235.0), 50, 810, 1000)
    starts = binning.bin_starts(d, bounds, 1000)
    assert dict(map(tuple, starts.collect())) == {7: 7, 8: 7, 60: 60, 300: 60, 520: 520}
    dim = binning.bin_dimension(d, bounds, starts, 1000)
    assert [r["bin_id"] for r in dim.orderBy("bin_ord").collect()] == [0, 3, 5, 7, 60, 520, 1001]
    assert S.min_bin_bases(499_999, 1) is None and S.min_bin_bases(500_000, 0.2) == 1000
    assert [r[0] for r in spark.createDataFrame([(250,), (750,)], "x bigint").select(S.round_to_500(F.col("x"))).collect()] == [0, 1000]


def test_key_starts(spark):
    def starts(n, full=False):
        return spark.range(1).select(S.key_starts(F.lit(n), F.lit(full), 11, 0.25, 4000, 3).alias("s")).first()["s"]

    assert starts(43) == [] and starts(44) == [0, 33] and starts(48) == [0, 36]
    assert starts(100) == [0, 3, 6, 9, 12, 75, 78, 81, 84, 87]
    assert starts(100, True) == list(range(90)) and starts(10, True) == []


@pytest.mark.parametrize("lists, order, kept", [
    ({0: [1, 2, 3, 4, 5], 1: [6, 7], 2: [4, 5, 8, 9], 3: [6, 6, 7]}, [0, 3, 2], [[1, 2, 3, 4, 5], [6, 6, 7], [8, 9]]),
    ({0: [1, 2, 3, 4, 5], 1: [6, 7], 2: [1, 2, 8, 9]}, [0, 2, 1], [[1, 2, 3, 4, 5], [8, 9], [6, 7]]),
])
def test_lazy_greedy(spark, lists, order, kept):
    rows = cover.anchors(coded(spark, lists)).orderBy("sel_ord").collect()
    assert [r["read_int"] for r in rows] == order and [r["kept"] for r in rows] == kept


def model_cover(lists):
    """The queue, as it is told: the head's true score against the next stale one."""
    queue, covered, out = sorted((-len(b), i) for i, b in lists.items() if b), set(), []
    while queue:
        _, i = queue.pop(0)
        fresh = [x for x in lists[i] if x not in covered]
        if fresh and queue and len(fresh) < -queue[0][0]:
            queue = sorted([*queue, (-len(fresh), i)])
        elif fresh:
            out.append((i, fresh))
            covered |= set(fresh)
    return out


@pytest.mark.parametrize("round_ids", [1, 40, 150, 1 << 20])
def test_lazy_greedy_in_rounds(spark, round_ids):
    """Rounds of any size have the order of the one queue, with many ties, repeats and reads that are covered before their turn."""
    rng = random.Random(round_ids)
    lists = {i: [rng.randrange(40) for _ in range(rng.choice([0, 1, 3, 3, 4, 5, 8, 12]))] for i in range(28)}
    lists |= {100 + i: lists[i] for i in range(3)}
    got = [(r["read_int"], r["kept"]) for r in cover.anchors(coded(spark, lists), round_ids).orderBy("sel_ord").collect()]
    assert got == model_cover(lists)


def test_lazy_greedy_queue_in_pieces():
    """The rule of a piece of the queue with a rest behind it, for all ways to cut small queues."""
    rng = random.Random(11)
    for _ in range(300):
        lists = {i: [rng.randrange(12) for _ in range(rng.randint(1, 6))] for i in range(9)}
        queue, covered, out = {i: len(b) for i, b in lists.items()}, set(), []
        while queue:
            order = sorted((-s, i) for i, s in queue.items())
            n = rng.randint(1, len(order))
            rest = (-order[n][0], order[n][1]) if n < len(order) else None
            taken, back = cover.lazy_greedy([(i, -s, np.array([x for x in lists[i] if x not in covered], np.int64)) for s, i in order[:n]], rest)
            out += [(i, x.tolist()) for i, x in taken]
            covered |= {y for _, x in taken for y in x.tolist()}
            queue = {i: -s for s, i in order[n:]} | dict(back)
        assert out == model_cover(lists)


def test_cover_by_rounds_covers(spark):
    rng = random.Random(2)
    lists = {i: [rng.randrange(60) for _ in range(rng.randrange(12))] for i in range(80)}
    b = coded(spark, lists)
    for chosen in (cover.anchors_by_rounds(b), cover.champions(b)):
        assert cover.coverage(chosen, cover.universe(b)).first()["pct"] == 100.0
    empty = coded(spark, {})
    assert cover.anchors(empty).count() == cover.anchors_by_rounds(empty).count() == 0
    assert cover.coverage(cover.champions(empty), cover.universe(empty)).first()["pct"] == 0.0


def test_direct_bridges(spark):
    b = coded(spark, {0: [1, 2, 3, 4], 1: [5, 6, 7], 2: [3, 4, 9, 5, 6], 3: [3, 4, 9], 4: [4, 9, 5, 6], 5: [1, 2, 3, 4]})
    anchors = b.where("read_int < 2").withColumnRenamed("barcode", "kept")
    assert sorted(r["read_int"] for r in overlap.direct_bridges(b, anchors, 2).collect()) == [2, 5]


def test_bridges_of_long_anchors(spark):
    """An anchor of 20,000 ids, whose rests would be 200 million ids together."""
    long = list(range(20_000))
    b = coded(spark, {0: long, 1: list(range(50_000, 50_200)), 2: [*long[-150:], 7, *range(50_000, 50_120)], 3: [*long[-150:], 7, *range(50_001, 50_120)], 4: long[5000:5200]})
    anchors = b.where("read_int < 2").withColumnRenamed("barcode", "kept")
    assert [r["read_int"] for r in overlap.direct_bridges(b, anchors, 100).collect()] == [2]


def test_rounds_end_in_one_task(spark):
    """Rounds on the cluster and the rounds of one task take the same reads in the same order, and a long tail of rounds needs few jobs."""
    rng = random.Random(3)
    lists = {r: [rng.randrange(120) for _ in range(rng.randrange(0, 14))] for r in range(80)}
    # a chain: each read waits for the one before it
    lists |= {100 + i: [1000 + i, 1001 + i] for i in range(40)}
    b = spark.createDataFrame([(str(r), r, 10, x, len(x)) for r, x in lists.items()], "read_id string, read_int bigint, read_len int, barcode array<bigint>, n_barcodes int")
    want = sorted(map(tuple, cover.anchors_by_rounds(b, 30).collect()))
    tracker = spark.sparkContext
    tracker.setJobGroup("rounds", "rounds")
    try:
        found = cover.anchors_by_rounds(b)
        jobs = len(tracker.statusTracker().getJobIdsForGroup("rounds"))
    finally:
        tracker._jsc.clearJobGroup()
    assert sorted(map(tuple, found.collect())) == want and len(want) > 30
    assert jobs < 40


def model_rounds(lists):
    """Rounds as they are told: a read is taken if none that shares an open id with it has more open occurrences; ties to the smaller."""
    left, out = {r: list(x) for r, x in lists.items() if x}, []
    while left:
        rank = {r: (-len(x), r) for r, x in left.items()}
        first = {u: min(rank[r] for r, x in left.items() if u in x) for u in {u for x in left.values() for u in x}}
        wins = sorted(r for r, x in left.items() if all(first[u] == rank[r] for u in x))
        out += sorted(((r, left[r]) for r in wins), key=lambda t: rank[t[0]])
        covered = {u for r in wins for u in left[r]}
        left = {r: y for r, x in left.items() if r not in wins and (y := [u for u in x if u not in covered])}
    return out


def test_rounds_of_copies_and_of_ids_that_stay_together(spark):
    """Copies of reads, in another order too, and ids that the same reads hold need no rounds on the cluster; results are those of the plain rounds."""
    rng = random.Random(8)
    lists = {3 * r: [rng.randrange(30) for _ in range(rng.randrange(0, 9))] for r in range(25)}
    lists |= {300 + 3 * i: [100 + i, 101 + i] for i in range(25)}  # each waits for the one before it
    lists = {r: [5 * u + i for u in x for i in range(5)] for r, x in lists.items()}
    lists |= {r + 1: x for r, x in lists.items()} | {r + 2: x[::-1] for r, x in lists.items()}
    lists[0] = [*lists[0], 7, 7, 8]  # some ids of one class twice, some once
    want = model_rounds(lists)
    for round_ids in (200, 1 << 20):
        spark.sparkContext.setJobGroup(f"rounds {round_ids}", "rounds")
        try:
            found = cover.anchors_by_rounds(coded(spark, lists), round_ids)
            jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds {round_ids}"))
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        assert [(r["read_int"], r["kept"]) for r in found.orderBy("sel_ord").collect()] == want
        assert jobs < 40
    assert len(want) > 20 and sum(map(len, lists.values())) > 6 * 200


def test_rare_kmers_are_counted_without_their_codes(spark):
    """Spectra need no rows of rare k-mers; counted whole or in parts, histogram and frequent k-mers are the same."""
    rng = random.Random(4)
    part = "".join(rng.choice("ACGT") for _ in range(60))
    seqs = ["".join(rng.choice("ACGT") for _ in range(80)) + part * (i % 3) for i in range(30)]
    reads = spark.createDataFrame([(str(i), i, i, s, len(s)) for i, s in enumerate(seqs)], "read_id string, read_int bigint, file_ord bigint, seq string, read_len int")
    every = kmers.code_counts(reads, 21)
    want, often = sorted(map(tuple, kmers.kmer_histogram(every).collect())), sorted((r["code"], r["n"]) for r in every.where("n >= 5").collect())
    for kw in ({}, {"bucket_bytes": 500, "hot_bytes": 600}, {"bucket_bytes": 500, "hot_bytes": 0}):
        some = kmers.code_counts(reads, 21, least=5, **kw)
        assert sorted(map(tuple, kmers.kmer_histogram(some).collect())) == want
        rows = some.collect()
        assert sorted((r["code"], r["n"]) for r in rows if r["code"] is not None) == often and len(rows) < every.count()


def test_letters_of_texts():
    """The bases of a text's letters, also of a slice of a batch, of nulls and of letters beyond ASCII."""
    texts = pa.array(["aB c1", None, "", "Z\u00e9~q", "\u212a\u0130x"])
    assert adapters.bases_of(texts).to_pylist() == ["ACG", "", "", "CA", "T"]
    assert adapters.bases_of(texts.slice(1, 3), "q").to_pylist() == ["", "", "CN"]
    assert adapters.bases_of(pa.array([], pa.string())).to_pylist() == []


def test_tasks_do_not_grow_with_the_input(spark):
    """Rows are dealt out in tasks of a bounded size, also when there are more than a task for each core."""
    assert spread(spark.range(1 << 16), 1 << 14).rdd.getNumPartitions() == 32


def test_bucketed_barcodes_are_not_exchanged(spark, tmp_path):
    """Barcodes in buckets of read_int meet what joins them by read_int without being sent anywhere."""
    rng, path = random.Random(17), str(tmp_path / "barcodes")
    b = coded(spark, {i: [rng.randrange(9) for _ in range(rng.randint(0, 30))] for i in range(300)})
    for _ in range(2):  # a second write replaces the first
        writers.write_bucketed(b, path, "read_int", 5)
    stored = readers.read_bucketed(spark, path, "read_int", 5)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, b.collect())) and not [t for t in spark.catalog.listTables() if t.name.startswith("strandloom_")]
    chosen = b.where("read_int < 20").withColumnRenamed("barcode", "kept")
    want = sorted(map(tuple, overlap.direct_bridges(b, chosen, 2).collect()))
    old = {n: spark.conf.get(n, None) for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = overlap.direct_bridges(stored, chosen, 2)
        assert sorted(map(tuple, got.collect())) == want != []
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    lines = [(len(x) - len(x.lstrip(" :+-*()0123456789")), x) for x in plan.splitlines()]
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    for i, (depth, x) in enumerate(lines):
        if "Exchange hashpartitioning" in x:
            below = lines[i + 1 : next((j for j in range(i + 1, len(lines)) if lines[j][0] <= depth), len(lines))]
            assert not any("Bucketed: true" in y for _, y in below)


def test_end_hashes():
    rng = random.Random(1)
    for n in (1, 2, 7, 300):
        a = [rng.randrange(-5, 5) for _ in range(n)]
        first, last = overlap.end_hashes(np.array(a, np.int64))
        for size in range(1, n + 1):
            assert first[size - 1] == overlap.end_hashes(np.array(a[:size], np.int64))[0][-1]
            assert last[size - 1] == overlap.end_hashes(np.array(a[n - size :], np.int64))[0][-1]
    assert len({overlap.end_hashes(np.array(x, np.int64))[0][-1] for x in ([1, 2], [2, 1], [1, 1], [2, 2], [1, 2, 0], [0, 1, 2])}) == 6


def test_bridges_of_a_repeated_id(spark, monkeypatch):
    """An anchor of one id at 20,000 places; each read meets all of them, and one slice of each is compared."""
    b = coded(spark, {0: [7] * 20_000, 1: list(range(100, 400)), **{i: [7] * (90 + 10 * i) + list(range(100, 250)) for i in range(2, 8)}, 8: [7] * 300 + [5] + list(range(100, 250)), 9: [7] * 50 + list(range(100, 250))})
    anchors = b.where("read_int < 2").withColumnRenamed("barcode", "kept")
    assert sorted(r["read_int"] for r in overlap.direct_bridges(b, anchors, 100).collect()) == list(range(2, 9))
    # hashes that say nothing: the ids decide
    monkeypatch.setattr(overlap, "end_hashes", lambda x: (np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)))
    few = coded(spark, {0: [7] * 30, 1: list(range(100, 130)), 2: [7] * 12 + list(range(100, 115)), 3: [7] * 12 + [5] + list(range(101, 115)), 4: [7] * 11 + list(range(100, 111))})
    anchors = few.where("read_int < 2").withColumnRenamed("barcode", "kept")
    assert sorted(r["read_int"] for r in overlap.direct_bridges(few, anchors, 10).collect()) == [2, 4]


def test_bridges_against_a_model(spark):
    rng = random.Random(8)
    lists = {i: [rng.randrange(6) for _ in range(rng.randint(0, 9))] for i in range(120)}
    anchors = {i: lists[i] for i in range(10)}

    def bridge(c, m):
        ends = [(a[p:], a[: p + 1]) for a in anchors.values() for p in range(len(a))]
        return len(c) >= m and any(len(r) >= m and c[: len(r)] == r for r, _ in ends) and any(len(r) >= m and c[-len(r) :] == r for _, r in ends)

    b = coded(spark, lists)
    chosen = b.where("read_int < 10").withColumnRenamed("barcode", "kept")
    for m in (1, 2, 3):
        assert {r["read_int"] for r in overlap.direct_bridges(b, chosen, m).collect()} == {i for i, c in lists.items() if i >= 10 and bridge(c, m)}


def test_index_lookup_and_counters(spark):
    b = coded(spark, {0: list(range(60)), 1: list(range(60)), 2: [1, 2], 3: []})
    index = overlap.head_index(b, b.where("read_int = 0"))
    assert readers.postings_of(index, list(range(11)), 11) == [0, 1] and readers.postings_of(index, [99] * 11, 11) == []
    assert readers.postings_of(index, list(range(20, 31)), 11) == [0]
    with pytest.raises(ValueError):
        readers.postings_of(index, [1], 11)
    reads = spark.createDataFrame([(i,) for i in range(6)], "read_int bigint")
    assert tuple(overlap.read_counters(b, index, reads).first()) == (6, 2, 1, 2, 1)
    assert readers.barcode_of(b, 2) == (100, [1, 2])
    with pytest.raises(KeyError):
        readers.barcode_of(b, 9)
    assert barcodes.read_stats(b).where("read_id = '2'").first()["n_barcodes"] == 2


def test_fenced_lookup(spark, tmp_path):
    """Many keys at once read the files that hold them, and no others."""
    rng = random.Random(21)
    b = coded(spark, {i: [rng.randrange(50) for _ in range(60)] for i in range(200)})
    index, path = overlap.head_index(b, k=3), str(tmp_path / "index")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_head_index(index, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = {tuple(r["key"]): 0 for r in index.collect()}
    files = len(spark.read.parquet(path).inputFiles())
    low = [[7, x, y] for x in range(4) for y in range(50)] + [[99, 0, 0], [7, 1, 1]]
    got = readers.lookup(spark, path, spark.createDataFrame([(x,) for x in low], "key array<bigint>"))
    want = sorted((r["key"], r["read_int"], r["start"]) for r in index.collect() if r["key"] in low)
    assert sorted((r["key"], r["read_int"], r["start"]) for r in got.collect()) == want != []
    assert files > 20 and len(got.inputFiles()) <= 4 and (99, 0, 0) not in every
    assert readers.lookup(spark, path, spark.createDataFrame([([99, 0, 0],)], "key array<bigint>")).count() == 0
    assert readers.lookup(spark, path, spark.createDataFrame([], "key array<bigint>")).count() == 0


def test_a_hot_key(spark):
    """One key in thousands of reads: its pairs are dealt out evenly, and the edges are those of the plain join."""
    rng = random.Random(4)
    tails = [(i, [1, 2]) for i in range(3000)] + [(i, [3, rng.randrange(40)]) for i in range(300)]
    heads = [(i, [1, 2]) for i in range(1500)] + [(i, [3, rng.randrange(40)]) for i in range(300)]
    tails, heads = spark.createDataFrame(tails, "src bigint, key array<bigint>"), spark.createDataFrame(heads, "dst bigint, key array<bigint>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = overlap.pairs_by_key(tails, heads, 100_000, 64)
        of_task = got.where("key[0] = 1").groupBy(F.spark_partition_id().alias("p")).count().orderBy("count").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    counts = [r["count"] for r in of_task]
    assert sum(counts) == 3000 * 1500 and counts[-1] <= 2 * counts[len(counts) // 2] and len(counts) >= 4
    plain = tails.join(heads, "key").select("key", "src", "dst")
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("key", "src", "dst").cast("decimal(38,0)"))).first()
    assert digest(got) == digest(plain)


def model_paths(edges, source, targets, depth, k, cap):
    """Breadth-first search with a queue."""
    found, used, queue = [], 0, deque([((source,), 0)])
    while queue and (cap is None or used < cap):
        path, d = queue.popleft()
        for child in sorted(edges.get(path[-1], ())):
            if child in path:
                continue
            used += 1
            if child in targets and child != source:
                found.append([*path, child])
            if d + 1 < depth:
                queue.append(((*path, child), d + 1))
            if cap is not None and used >= cap:
                break
    return sorted(found, key=lambda p: (-len(p), p))[:k]


def searched(spark, edges, sources, **kw):
    out = {s: [] for s in sources}
    for r in paths.top_paths(edge_frame(spark, edges), nodes(spark, sources), **kw).orderBy("source", "rank").collect():
        out[r["source"]].append(r["path"])
    return out


def test_paths_against_queue_model(spark):
    fixed = {0: [1, 2, 5, 6], 1: [0, 3, 5], 2: [3, 7], 3: [5, 8, 9], 5: [6], 6: [8], 7: [9], 8: [0]}
    ends = [0, 5, 6, 7, 8, 9]
    assert searched(spark, fixed, ends, max_depth=4, top_k=10, max_expansions=1000) == {s: model_paths(fixed, s, ends, 4, 10, 1000) for s in ends}
    rng = random.Random(3419)
    for _ in range(5):  # six graphs side by side in each run
        g, ends = {}, []
        for at in range(0, 60, 10):
            g |= {at + a: [at + b for b in range(8) if a != b and rng.random() < 0.3] for a in range(8)}
            ends += [at, at + 2, at + 5, at + 7]
        depth, k, cap = rng.randint(2, 5), rng.randint(1, 7), rng.randint(1, 59)
        assert searched(spark, g, ends, max_depth=depth, top_k=k, max_expansions=cap) == {s: model_paths(g, s, ends, depth, k, cap) for s in ends}


def test_path_limits(spark):
    assert searched(spark, {0: [1], 1: [0, 2]}, [0, 1, 2], max_depth=3, top_k=10, max_expansions=2)[0] == [[0, 1, 2], [0, 1]]
    assert searched(spark, {0: [1]}, [0, 1], max_depth=1, top_k=10)[0] == [[0, 1]]
    wide = {0: [1, *range(100, 130)], 1: [2], 2: list(range(100, 130))}
    assert searched(spark, wide, [0, *range(100, 130)], max_depth=4, top_k=10)[0] == [[0, 1, 2, t] for t in range(100, 110)]
    with pytest.raises(ValueError):
        searched(spark, {}, [0], max_depth=256)


def test_a_source_with_many_children(spark):
    edges = spark.range(1, 250_001).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    for cap, targets in ((250_000, [0]), (1000, [0, 999, 1000, 1001])):
        found = paths.top_paths(edges, nodes(spark, [0]), nodes(spark, targets), max_depth=3, top_k=10, max_expansions=cap)
        assert [r["path"] for r in found.orderBy("rank").collect()] == [[0, t] for t in targets if 0 < t <= cap]


def test_labels_and_selection(spark):
    labels = spark.createDataFrame([(0, "a"), (1, "x"), (2, "b"), (3, "c")], "read_int bigint, read_id string")
    found = spark.createDataFrame([(0, 1, [0, 1, 2])], paths.PATH_SCHEMA)
    bridged = paths.bridges(found, nodes(spark, [0, 3]), labels)
    assert {r["read_id"]: r["paths"] for r in bridged.collect()} == {"a": [["a", "x", "b"]], "c": []}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "read_id string")
    binned = spark.createDataFrame([(0, "e"), (200, "f"), (201, "g")], "bin_id bigint, read_id string")
    assert sorted(r[0] for r in selection.final_selection(ids("a"), bridged, ids("d"), binned).collect()) == list("abcdefx")
    with pytest.raises(RuntimeError):
        paths.label_paths(found, labels.where("read_int <> 1"))


def test_fingerprint(spark):
    want = hashlib.sha256(struct.pack(">4Q", 3, 7, 3, 11)).hexdigest()
    assert runner.anchor_fingerprint([7, 3, 11]) == want != runner.anchor_fingerprint([3, 7, 11])
    assert spark.range(1).select(S.fingerprint(F.array(F.lit(7), F.lit(3), F.lit(11)))).first()[0] == want


def test_files_round_trip(spark, tmp_path):
    fasta = tmp_path / "r.fasta"
    fasta.write_text(">a first\nACGT\nAC\n>b\nGG\n>a again\nTT\n")
    fastq = tmp_path / "r.fastq"
    fastq.write_text("@a x\nACGT\n+\n@@@@\n@b\nGG\n+\n@I\n")
    got = readers.with_read_ints(readers.read_records(spark, str(fasta)))
    assert sorted(map(tuple, got.select("read_id", "read_int", "seq").collect())) == [("a", 0, "ACGTAC"), ("a", 0, "TT"), ("b", 1, "GG")]
    assert sorted((r["read_id"], r["seq"]) for r in readers.last_records(got).collect()) == [("a", "TT"), ("b", "GG")]
    assert sorted((r["read_id"], r["seq"]) for r in readers.read_records(spark, str(fastq)).collect()) == [("a", "ACGT"), ("b", "GG")]
    with pytest.raises(ValueError):
        readers.sequence_format("x.txt")
    assert readers.sequence_format("X.FA.GZ") == "fasta"
    with pytest.raises(ValueError):
        readers.read_records(spark, str(tmp_path))
    records = readers.read_records(spark, str(fasta))
    chosen = spark.createDataFrame([("a",)], "read_id string")
    writers.write_selected_fasta(selection.selected_records(records, chosen), str(tmp_path / "out"), width=4)
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == ">a\nACGT\nAC\n>a\nTT\n"


@pytest.mark.parametrize("kind", ["fastq", "fastq.gz", "fa", "txt"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_files_in_small_splits(spark, tmp_path, kind, end):
    """Files of unequal sizes, the largest neither first nor last, cut into many splits: records stay whole and in order."""
    rng, want = random.Random(7), []
    for f, n in enumerate((3, 40, 1, 0, 17)):
        lines = []
        for i in range(n):
            seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 150)))
            want.append((f"r{f}.{i}", seq))
            lines += [f"@r{f}.{i} x", seq, "+", "@" * len(seq)] if "fastq" in kind else [f">r{f}.{i} x", seq[:70], *([seq[70:]] if seq[70:] else [])]
        text = "".join(x + end for x in lines).encode()
        (tmp_path / f"{f}.{kind}").write_bytes(gzip.compress(text) if kind.endswith("gz") else text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
    try:
        rows = readers.read_records(spark, str(tmp_path), split_bytes=97).orderBy("file_ord").collect()
        text = readers.text_records(spark, str(tmp_path), readers.format_of(spark, str(tmp_path))).orderBy("file_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["read_id"], r["seq"]) for r in rows] == want and len({r["file_ord"] for r in rows}) == len(want)
    assert [(r["_head"].split()[0], r["seq"]) for r in text] == want and len({r["file_ord"] for r in text}) == len(want)


@pytest.fixture
def restored(spark):
    """Settings that a test changes are put back."""
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("kind", ["fastq", "fa"])
@pytest.mark.parametrize("reader", ["source", "text", "list"])
def test_records_while_cores_change(spark, tmp_path, kind, reader, restored):
    """The number of cores changes between making a table of records and reading it."""
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(6000)]
    body = "".join(f"{x}\n" if reader == "list" else f"@r{i}\n{x}\n+\n{'@' * 30}\n" if kind == "fastq" else f">r{i}\n{x}\n" for i, x in enumerate(seqs))
    (tmp_path / f"x.{kind}").write_text(body)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "4")
    if reader == "list":
        table = readers.read_unikmers(spark, str(tmp_path)).select(F.col("unikmer_id").alias("file_ord"), F.col("kmer").alias("seq"))
        flip = str.maketrans("ACGT", "TGCA")
        seqs = [min(x, x.translate(flip)[::-1]) for x in seqs]
    elif reader == "text":
        table = readers.text_records(spark, str(tmp_path), "fastq" if kind == "fastq" else "fasta")
    else:
        table = readers.read_records(spark, str(tmp_path), split_bytes=10_000)
    for cores in (4, 7, 3):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(cores))
        assert [r["seq"] for r in table.orderBy("file_ord").collect()] == seqs


def test_odd_records(spark, tmp_path):
    """Quality lines like headers, empty sequences, blank lines at the end, a cut last record, long lines."""
    long = "ACGT" * 3_000_000
    (tmp_path / "a.fastq").write_text(f"@a 1\nAC\n+\n@+\n@b\n\n+\n\n@\nGG\n+x\n+@\n@c\n{long}\n+\n{'@' * len(long)}\n\n\n@d\nTT")
    got = readers.read_records(spark, str(tmp_path / "a.fastq"), split_bytes=5_000_003).orderBy("file_ord").collect()
    assert [(r["read_id"], r["seq"]) for r in got] == [("a", "AC"), ("b", ""), ("", "GG"), ("c", long), ("d", "TT")]
    (tmp_path / "b.fa").write_text(f"\n>a\n\n>b x\nA C\n{long}\n>\nGG")
    got = readers.read_records(spark, str(tmp_path / "b.fa"), split_bytes=5_000_003).orderBy("file_ord").collect()
    assert [(r["read_id"], r["seq"]) for r in got] == [("a", ""), ("b", "AC" + long), ("", "GG")]


def test_lists_and_graphs(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "1").write_text("ACG\nTTT\n" * 50)
    (tmp_path / "k" / "2").write_text("GGG\nCGT\n")
    marks = readers.read_unikmers(spark, str(tmp_path / "k"))
    assert {r["kmer"]: r["unikmer_id"] for r in marks.collect()} == {"ACG": 101, "AAA": 99, "CCC": 100}
    writers.write_unikmers(marks, str(tmp_path / "list"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "list").glob("part-*"))) == "AAA\nCCC\nACG\n"
    (tmp_path / "h").write_text("0 5\n1 10\n2  3\n")
    h = readers.read_histogram(spark, str(tmp_path / "h"))
    assert sorted(map(tuple, h.collect())) == [(0, 5), (1, 10), (2, 3)]
    writers.write_report(h, str(tmp_path / "csv"), writers.HISTOGRAM_HEADER, "freq")
    assert [p.read_text() for p in (tmp_path / "csv").glob("part-*")] == ["frequency,number of k-mers\n0,5\n1,10\n2,3\n"]
    (tmp_path / "g.gfa").write_text("H\tVN\nS\tone\tACGT\textra\nL\tone\t+\nS\ttwo\tGG\n")
    segments = readers.read_gfa_segments(spark, str(tmp_path / "g.gfa"))
    writers.write_contigs(segments, str(tmp_path / "contigs"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "contigs").glob("part-*"))) == ">one\nACGT\n>two\nGG\n"


def test_streamed_counts(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "counts", "state"))
    assert incremental.streamed_counts(spark, out).count() == 0
    seqs = ["ACGTACGTAA", "GGGTTTACGA", "ACGTACGTAA"]
    for i, x in enumerate(seqs):
        spark.createDataFrame([(str(i), i, i, x, len(x))], readers.READ_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        if i:  # two runs; the second goes on after the first
            incremental.count_stream(incremental.read_stream(spark, folder, 1), out, state, 4).awaitTermination()
    want = Counter(w for s in seqs for _, w in model_windows(s, 4))
    assert dict(map(tuple, incremental.streamed_counts(spark, out).collect())) == want


def anchors_of(spark, ids):
    return spark.createDataFrame(list(enumerate(ids)), "sel_ord int, read_int bigint")


def found_paths(df):
    return sorted((r["source"], r["rank"], r["path"]) for r in df.collect())


def test_log_is_a_checked_prefix(spark, tmp_path):
    folder, belongs = str(tmp_path / "log"), {"anchors": 3, "order": "7", "inputs": {}, "config": {"k": 1}}
    rows = lambda *x: spark.createDataFrame(list(x), paths.PATH_SCHEMA)
    log = search_log.SearchLog(spark, folder, belongs)
    assert log.done == 0 and log.paths().count() == 0
    assert log.commit(0, 0, 2, rows((7, 1, [7, 2, 3]))) == 1 and log.commit(1, 2, 3, rows()) == 0
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "log").rglob("*") if p.is_file()}
    again = search_log.SearchLog(spark, folder, belongs)
    assert again.done == 2 and found_paths(again.paths()) == [(7, 1, [7, 2, 3])] and again.count() == 1
    # what a stopped batch has left does not count
    rows((9, 1, [9, 1])).write.parquet(f"{folder}/paths/batch=2")
    again = search_log.SearchLog(spark, folder, belongs)
    assert again.done == 2 and again.paths().count() == 1
    again.commit(2, 3, 4, rows((11, 1, [11, 1])))
    assert found_paths(again.paths()) == [(7, 1, [7, 2, 3]), (11, 1, [11, 1])] and all(p.stat().st_mtime_ns == t for p, t in before.items())

    def refused(match, belongs=belongs):
        with pytest.raises(search_log.StateError, match=f"{match}.*--restart"):
            search_log.SearchLog(spark, folder, belongs)

    refused("config", belongs | {"config": {"k": 2}})
    refused("order", belongs | {"order": "8"})
    for name, change, match in (("000000001", {"batch": 5}, "prefix"), ("000000001", {"first": 1}, "prefix"), ("000000000", {"paths": 2}, "differ"), ("000000000", {"digest": "1"}, "differ")):
        file = tmp_path / "log" / "commits" / f"{name}.json"
        text = file.read_text()
        (file.parent / f".{name}.json.crc").unlink(missing_ok=True)
        file.write_text(json.dumps(json.loads(text) | change))
        refused(match)
        file.write_text(text)
    run = tmp_path / "log" / "run.json"
    text = run.read_text()
    (tmp_path / "log" / ".run.json.crc").unlink()
    for bad in ("{", "[]"):
        run.write_text(bad)
        refused("state")
    run.unlink()
    refused("belong")
    run.write_text(text)
    assert search_log.SearchLog(spark, folder, belongs).done == 3
    assert search_log.SearchLog(spark, folder, belongs, restart=True).done == 0
    with pytest.raises(ValueError):
        runner.protect(spark, folder, [f"file:{folder}"])
    other = str(tmp_path / "t.json")
    for text in ("one", "two"):
        runner.write_text(spark, other, text)
        assert runner.read_new(spark, other) == text and not os.path.exists(other + ".part")
    assert search_log.anchor_digest(anchors_of(spark, [7, 3, 11])) != search_log.anchor_digest(anchors_of(spark, [3, 7, 11]))
    assert search_log.anchor_digest(anchors_of(spark, [])) == (0, "0")


def test_search_resumes(spark, tmp_path):
    edges = edge_frame(spark, {0: [1], 1: [2]}).persist()
    config, state = runner.Config(max_depth=3, batch=1), str(tmp_path / "state")

    def stop(batch, done, total):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        runner.search(edges, anchors_of(spark, [0, 1, 2]), config, {}, state, on_batch=stop)
    done = []
    found = runner.search(edges, anchors_of(spark, [0, 1, 2]), config, {}, state, on_batch=lambda b, d, t: done.append(b))
    assert done == [range(1, 2), range(2, 3)] and found_paths(found) == [(0, 1, [0, 1, 2]), (0, 2, [0, 1]), (1, 1, [1, 2])]


def test_state_of_many_anchors_stays_off_the_driver(spark, tmp_path, monkeypatch):
    """100,000 anchors in two batches: what the driver collects are single rows, and what it writes are small records."""
    edges = spark.range(100_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    anchors = spark.range(100_000).select(F.col("id").cast("int").alias("sel_ord"), F.col("id").alias("read_int"))
    seen, collect = [], type(edges).collect

    def counted(self):
        out = collect(self)
        seen.append(len(out))
        return out

    monkeypatch.setattr(type(edges), "collect", counted)
    monkeypatch.setattr(type(edges), "toLocalIterator", None)
    folder = str(tmp_path / "state")
    found = runner.search(edges, anchors, runner.Config(max_depth=2, batch=60_000), {}, folder)
    assert found.count() == 99_999 + 99_998 and max(seen, default=0) <= 5
    assert sum(p.stat().st_size for p in (tmp_path / "state" / "commits").glob("*.json")) < 1000 and (tmp_path / "state" / "run.json").stat().st_size < 2000


def test_paths_of_full_depth(spark):
    """A chain with branches, searched to the depth of 15 that the runner has, with and without a cap, against the queue's model."""
    rng = random.Random(15)
    graph = {i: sorted({i + 1, *([i + 2] if i % 4 == 0 else []), *([rng.randrange(20)] if i % 5 == 0 else [])} - {i}) for i in range(20)}
    ends = [0, 3, 15, 16, 18, 20]
    for cap in (10_000_000, 700):
        got = searched(spark, graph, ends, max_depth=15, top_k=10, max_expansions=cap)
        assert got == {s: model_paths(graph, s, ends, 15, 10, cap) for s in ends}
    assert max(len(p) for p in got[0]) > 10


@pytest.fixture(scope="module")
def reads_file(tmp_path_factory):
    """Reads of a genome with errors, so that the histogram has a valley; some are held by others."""
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(4000))
    path = tmp_path_factory.mktemp("reads") / "reads.fa"
    rows = []
    for i in range(420):
        at = rng.randrange(3600)
        s = list(genome[at : at + rng.randint(150, 400)])
        for _ in range(rng.randrange(3)):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        rows.append("".join(s))
    path.write_text("".join(f">r{i}\n{s}\n" for i, s in enumerate(rows)))
    return str(path)


ARGS = ["--genome-size", "600000", "--coverage", "0.1", "--min-overlap", "20", "--key", "5", "--max-depth", "3", "--top-k", "3", "--max-expansions", "60", "--batch", "3", "--progress-every", "3", "--buckets", "3"]


def stored(spark, folder, name):
    return sorted(map(str, spark.read.parquet(f"{folder}/{name}").collect()))


def test_stopped_run_goes_on(spark, reads_file, tmp_path, capsys):
    """A signal after a batch gives its exit code; the next run searches only the rest and has the same results as a run of one piece."""
    whole, parted = str(tmp_path / "whole"), str(tmp_path / "parted")
    total = []
    assert runner.main(["--reads", reads_file, "--run-dir", whole, *ARGS], on_batch=lambda b, d, t: total.append(t)) == 0
    assert len(total) > 2 and "searched" in capsys.readouterr().err

    def stop(batch, done, total):
        if done >= 6:
            os.kill(os.getpid(), signal.SIGTERM)

    args = ["--reads", reads_file, "--run-dir", parted, *ARGS]
    with pytest.raises(SystemExit) as e:
        runner.main(args, on_batch=stop)
    assert e.value.code == 128 + signal.SIGTERM
    assert [json.loads(p.read_text())["last"] for p in sorted((tmp_path / "parted" / "search" / "commits").glob("*.json"))] == [3, 6]
    before = (tmp_path / "parted" / "barcodes" / "_SUCCESS").stat().st_mtime_ns

    def interrupt(batch, done, total):
        raise KeyboardInterrupt

    assert runner.main(args, on_batch=interrupt) == 130
    again = []
    assert runner.main(args, on_batch=lambda b, d, t: again.append(b)) == 0
    assert sum(map(len, again)) == total[0] - 9 and before == (tmp_path / "parted" / "barcodes" / "_SUCCESS").stat().st_mtime_ns
    for name in ("barcodes", "anchors", "edges", "bridges", "selected"):
        assert stored(spark, parted, name) == stored(spark, whole, name)
    ids = {r[0] for r in spark.read.parquet(f"{whole}/selected").collect()}
    assert ids and ids <= {f"r{i}" for i in range(420)}
    fasta = "".join(p.read_text() for p in (tmp_path / "whole" / "selected_fasta").glob("part-*"))
    assert fasta.count(">") == len(ids)
    for name, header in (("distribution", writers.DISTRIBUTION_HEADER), ("bins", writers.BIN_HEADER), ("histogram", writers.HISTOGRAM_HEADER)):
        lines = "".join(p.read_text() for p in (tmp_path / "whole" / "reports" / name).glob("part-*")).splitlines()
        assert lines[0] == ",".join(header) and len(lines) > 2
        assert [int(x.split(",")[0]) for x in lines[1:]] == sorted(int(x.split(",")[0]) for x in lines[1:])
    # finished: nothing is searched; other settings leave the state unusable, and a restart makes it anew
    assert runner.main(args, on_batch=interrupt) == 0
    other = [*args[:-2], "--max-depth", "2"]
    assert runner.main(other) == 2 and "--restart" in capsys.readouterr().err
    assert runner.main([*other, "--restart"]) == 0
    (tmp_path / "parted" / "search" / ".run.json.crc").unlink()
    (tmp_path / "parted" / "search" / "run.json").write_text("{")
    assert runner.main(args) == 2


def test_changed_inputs_stop_a_search(spark, tmp_path):
    edges = edge_frame(spark, {0: [1], 1: [2]}).persist()
    store = tmp_path / "store"
    store.write_text("x")

    def change(batch, done, total):
        store.write_text("other")

    with pytest.raises(RuntimeError, match="store"):
        runner.search(edges, anchors_of(spark, [0, 1, 2]), runner.Config(max_depth=3, batch=1), {"store": str(store)}, str(tmp_path / "state"), on_batch=change)
    with pytest.raises(SystemExit) as e:
        runner.main(["--reads", "x", "--run-dir", "y", "--max-expansions", "0"])
    assert e.value.code == 2


def test_events_have_barcodes(spark):
    events = spark.createDataFrame([(1, 7, "2024-01-01 05:00:00", "a"), (0, 7, "2024-01-01 05:00:00", "b"), (2, 8, "2024-01-01 06:00:00", "a")], "event_id bigint, user_id bigint, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    code = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    assert {r["read_int"]: r["barcode"] for r in adapters.barcodes_from_events(events).collect()} == {7: [code("b/5"), code("a/5")], 8: [code("a/6")]}
