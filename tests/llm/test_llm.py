"""Operators on training data against brute force on small fixtures."""

import base64
import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from strandloom.functions import storage
from strandloom.llm import bpe, embedding_dedup, exact_dedup, language_id, line_dedup, mixing, near_dedup, registry, spans, substring_dedup, token_counts, token_output

PATH, PATTERN = public_tokenizers.path(registry.TOKENIZER), public_tokenizers.PATTERN
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, _text string, size int"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [sentence(rng, rng.randint(60, 200)) for _ in range(30)]
    near = [" ".join(w if i != 30 else "changed" for i, w in enumerate(b.split())) for b in base[:8]]
    passage = sentence(rng, 70)
    shared = [f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}" for _ in range(4)]
    lines = ["one line that many documents hold\n" + sentence(rng, 9) + "\n\tONE line that many documents hold " for _ in range(4)]
    odd = [None, "", " ", "\n", "a", "x" * 5000, "naïve café ß 漢字🙂 1234 !!\n\n  end ", base[0], base[0].replace(" ", "\n", 1), sentence(rng, 6000)]
    return base + near + shared + lines + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "x", "y", 1) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "a text without an id", None, "s1", 5, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, docs):
    got = exact_dedup.exact_dedup(docs, digest_all=True).collect()
    rows = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in docs.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    want = sorted(((i, min((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(empty(spark)).count() == exact_dedup.drop_exact_copies(empty(spark)).count() == 0


@pytest.mark.parametrize("kw", [{}, {"max_bits": 1 << 16, "flush": 3}, {"max_bits": 1 << 16, "broadcast_bytes": 0}])
def test_line_dedup(spark, docs, kw, monkeypatch):
    """With filters that fit, with one so full that it suspects other lines too, and with losing documents that travel."""
    if kw:
        monkeypatch.setattr(line_dedup, "cells", lambda h, bits: (h & np.uint64(63), h >> np.uint64(32) & np.uint64(63)))
    where = {}
    rows = [(r["doc_id"], (r["text"] or "").split("\n")) for r in docs.collect()]
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for i, lines in rows:
        for x in lines:
            if len(key(x)) >= 20:
                where.setdefault(key(x), set()).add(i)
    lost = {k: max(x for x in v if x is not None) for k, v in where.items() if len(v) >= 3}
    want = sorted(((i, len(lines), "\n".join(x for x in lines if lost.get(key(x), i) == i)) for i, lines in rows), key=str)
    got = line_dedup.dedup_lines(docs, **kw).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["kept_text"]) for r in got), key=str) == want
    assert lost and all(r["n_dropped"] == r["n_lines"] - len(w[2].split("\n")) or w[2] == "" for r, w in zip(sorted(got, key=lambda r: str((r["doc_id"], r["n_lines"], r["kept_text"]))), want))
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_mixing(spark, docs):
    plan = mixing.mix_plan(docs).toPandas()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()]
    assert sorted(plan._size) == sorted(size)
    by = {}
    for r in docs.collect():
        by[r["source"]] = by.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        rest = 1.5 * sum(by.values()) - sum(2 * by[s] for s in by if s not in open_)
        over = {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 2 * by[s]}
        if not over:
            break
        open_ -= over
    target = {s: rest * weight[s] / sum(weight[x] for x in open_) if s in open_ else 2 * by[s] for s in by}
    assert sorted(plan._target.round(6).unique()) == sorted({round(t, 6) for t in target.values()})
    assert (plan._taken <= 2 * plan._size).all() and plan._taken.sum() == sum(int(t) for t in target.values())
    mix = mixing.mix_documents(docs)
    assert mix.columns == docs.columns
    assert mix.select(F.sum(mixing.words_in(F.col("text")))).first()[0] == plan._taken.sum()
    assert mixing.mix_documents(empty(spark)).count() == mixing.mix_plan(empty(spark)).count() == 0


@pytest.mark.parametrize("boundary, bucket_rows", [("split", 1024), ("split", 2), ("whole", 3)])
def test_mixing_against_a_plain_model(spark, docs, boundary, bucket_rows):
    """Words taken of each document, positions and training order, from the seeded order of documents and the targets."""
    kw = {"boundary": boundary, "bucket_rows": bucket_rows}
    targets = {}
    for r in mixing.mix_plan(docs, **kw).select("_source_size", "_target", "_slot").distinct().collect():
        targets[r["_source_size"]] = (r["_target"], r["_slot"])
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    hashed = docs.select("doc_id", "text", "source", F.xxhash64(F.lit(17), F.col("doc_id")).alias("h")).collect()
    by = {}
    for r in hashed:
        by.setdefault(r["source"], []).append(r)
    taken, copies = [], []
    for rows in by.values():
        rows.sort(key=lambda r: (r["h"], r["doc_id"] is not None, r["doc_id"] or 0, len(words(r["text"]))))
        total = sum(len(words(r["text"])) for r in rows)
        target, slot = targets[total]
        grid = np.linspace(0, 1, 200_001)
        w = np.interp(grid, *zip(*mixing.SCHEDULES[slot]))
        demand = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        full, start = int(target // total), 0
        for r in rows:
            n = len(words(r["text"]))
            left = target - full * total - start
            extra = max(0, min(n, int(np.floor(left)))) if boundary == "split" else n if n and 2 * left >= n else 0
            taken.append((r["doc_id"], n, full * n + extra))
            for epoch in range(full + (extra > 0)):
                given = n if epoch < full else extra
                if given:
                    x = (epoch * total + start + given / 2) / target
                    copies.append((float(np.interp(x, demand / demand[-1], grid)) if x < 1 else x, r["doc_id"], given))
            start += n
    plan = mixing.mix_plan(docs, **kw).collect()
    assert sorted(((r["_id"], r["_size"], r["_taken"]) for r in plan), key=str) == sorted(taken, key=str)
    mix = mixing.mix_documents(docs, **kw).collect()
    copies.sort(key=lambda c: c[0])
    assert Counter((r["doc_id"], len(words(r["text"]))) for r in mix) == Counter(c[1:] for c in copies)
    # the order is that of the positions, up to the model's grid
    at = {}
    for i, (p, doc, n) in enumerate(copies):
        at.setdefault((doc, n), []).append(p)
    found = [at[r["doc_id"], len(words(r["text"]))].pop(0) for r in mix]
    assert all(b >= a - 1e-4 for a, b in zip(found, found[1:]))


def test_inverse_demand(spark):
    x = spark.range(1, 100).select((F.col("id") / 100).alias("x"))
    for knots in mixing.SCHEDULES:
        t = np.array([r[0] for r in x.select(mixing.inverse_demand(F.col("x"), knots)).collect()])
        grid = np.linspace(0, 1, 20001)
        w = np.interp(grid, *zip(*knots))
        total = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        assert np.allclose(np.interp(t, grid, total / total[-1]), np.arange(1, 100) / 100, atol=1e-6)


@pytest.fixture(scope="module")
def library():
    ranks = spans.parsed(spans.ranks_of(PATH))
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs, library):
    for r in bpe.round_trip_digests(docs, PATH, PATTERN).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = bpe.decode_ids(bpe.encode_texts(docs, PATH, PATTERN), PATH, PATTERN)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back.collect())
    assert bpe.round_trip_digests(empty(spark), PATH, PATTERN).count() == 0


def test_rank_queue_with_untrained_ranks():
    """Ranks for which a merge can make a lower pair: the lowest pair, leftmost first, must win each time."""
    rng = random.Random(6)
    ranks = {bytes([b]): 300 + b for b in range(256)}
    while len(ranks) < 340:
        ranks.setdefault(bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))), rng.randrange(300))
    unique = {}
    for b, r in ranks.items():
        unique.setdefault(r, b)
    ranks = {b: r for r, b in unique.items()}
    t = bpe.ByteBPE(ranks, r"\S+")
    for _ in range(200):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
        parts = [bytes([b]) for b in piece]
        while True:
            best = min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert list(t.merge([piece])[0]) == [ranks[p] for p in parts]


def test_near_duplicates(spark, docs, texts):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    sets = {i: set(zip(*[(t or "").lower().split()[j:] for j in range(5)])) for i, t in enumerate(texts)}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b:
                near = len(a & b) / len(a | b) >= 0.8
                assert near == (got[i]["group_id"] == got[j]["group_id"]), (i, j)
    assert got[None]["group_id"] is None
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and near_dedup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_rows_with_equal_ids(spark):
    rng = random.Random(11)
    one, two, three = (sentence(rng, 90) for _ in range(3))
    near = lambda x: " ".join(w if i != 40 else "changed" for i, w in enumerate(x.split()))
    # the rows of id 1 have other texts, each with a near copy; of id 5 one text is a copy and one is alone
    rows = [(1, one), (1, two), (2, near(one)), (3, near(two)), (5, near(near(one)) + " end"), (5, three), (None, one)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["group_id"], r["kept"]) for r in near_dedup.near_duplicates(frame).collect()]
    assert sorted(x for x in got if x[0]) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 1, False), (5, 5, True)]
    assert {tuple(r) for r in near_dedup.drop_near_duplicates(frame).collect()} == {(1, one), (1, two), (5, three), (None, one)}


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(7)
    for _ in range(200):
        a = np.array([rng.randrange(9) for _ in range(rng.randint(1, 40))], np.uint64)
        b = np.array([x for x in a if rng.random() < 0.9] or [1], np.uint64)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        m = table[-1, -1]
        want = m / (len(a) + len(b) - m)
        assert near_dedup.aligned(a, b, 0.7) == (pytest.approx(want) if want >= 0.7 else 0.0)


def test_repeated_passages(spark, docs, texts):
    got = substring_dedup.repeated_passages(docs).collect()
    first, need = {}, set()
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) != i:
                need.add(i)
    assert need <= {r["doc_id"] for r in got}
    for r in got:
        a = (texts[r["doc_id"]]).lower().split()[r["start_word"] : r["end_word"]]
        b = (texts[r["other_id"]]).lower().split()[r["other_start"] : r["other_end"]]
        assert len(set(a) & set(b)) >= 0.7 * len(set(a)) and r["other_id"] < r["doc_id"]
    assert substring_dedup.repeated_passages(empty(spark)).count() == 0


def test_whole_runs_whose_parts_are_elsewhere(spark):
    """Parts of each shared run stand in documents before its first holder, and runs of one word have other lengths."""
    rng = random.Random(12)
    rows = []
    for i in range(40):
        run = sentence(rng, rng.randint(50, 70), 5000).split()
        cut = rng.randint(15, 35)
        rows += [" ".join([*run[:cut], sentence(rng, 40)]), " ".join([sentence(rng, 40), *run[cut:]])]
        rows += [" ".join([sentence(rng, rng.randint(0, 30), 5000), *run, *run[:20], sentence(rng, rng.randint(0, 30), 5000)]) for _ in range(2)]
    rows += ["w1 w2 w3 " * 30, sentence(rng, 20) + " w1 w2 w3" * 60]
    first, need = {}, set()
    for i, t in enumerate(rows):
        w = t.split()
        need |= {(i, j) for j in range(len(w) - 49) if first.setdefault(tuple(w[j : j + 50]), i) != i}
    got = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()
    assert len({i for i, _ in need}) >= 41
    for i, j in need:
        assert any(r["doc_id"] == i and r["start_word"] <= j and j + 50 <= r["end_word"] for r in got), (i, j)
    assert {r["doc_id"] for r in got} == {i for i, _ in need}


def planted(rng, n, share):
    """Two texts of 400 words that share n words, of which share are other ones in the second, and the passage's place there."""
    passage = sentence(rng, n, 5000).split()
    changed = set(rng.sample(range(n), round(share * n)))
    other = [f"x{rng.randrange(5000)}" if i in changed else w for i, w in enumerate(passage)]
    at = [rng.randint(0, 300) for _ in range(2)]
    return [" ".join([sentence(rng, s, 5000), *p, sentence(rng, 400 - n - s, 5000)]) for s, p in zip(at, (passage, other))], at[1]


def test_fuzzy_passages(spark):
    """Planted passages whose words differ here and there, up to the threshold, and in length; unrelated texts give nothing."""
    rng = random.Random(14)
    rows, want = [], {}
    for n in (60, 80, 100):
        for share in (0.1, 0.15, 0.2):
            for _ in range(12):
                pair, at = planted(rng, n, share)
                rows += pair
                want[len(rows) - 1] = (at, at + n)
    inserted = sentence(rng, 120, 5000).split()
    rows += [" ".join(inserted), " ".join([*inserted[:55], "new", "words", *inserted[55:80], *inserted[83:]])]
    want[len(rows) - 1] = (0, 119)
    got = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()
    held = {i for i, (s, e) in want.items() for r in got if r["doc_id"] == i and r["other_id"] == i - 1 and min(e, r["end_word"]) - max(s, r["start_word"]) >= 50}
    assert len(held) >= 0.97 * len(want) and len(rows) - 1 in held
    assert {r["doc_id"] for r in got} <= set(want)


def test_parts_of_a_passage_compared_with_brute_force():
    """A part is found if any has enough equal words and ends that pay."""
    rng = np.random.default_rng(15)
    for _ in range(60):
        equal = rng.random(90) < rng.choice([0.7, 0.8, 0.9])
        at, total = np.arange(91), np.concatenate([[0], np.cumsum(equal)])
        pays = 2 * total - at
        any_fits = any(total[j] - total[i] >= 0.8 * (j - i) - 1e-9 and pays[i] == pays[i : j + 1].min() and pays[j] == pays[i : j + 1].max() for i in range(91) for j in range(i + 50, 91))
        parts = substring_dedup.similar_parts(at, at, equal, 50, 0.8)
        assert bool(parts) == any_fits
        assert all(j - i >= 50 and total[j] - total[i] >= 0.8 * (j - i) - 1e-9 for i, j in parts)


@pytest.mark.parametrize("copies", [1, 12])
def test_fuzzy_passages_whose_lines_are_elsewhere(spark, copies):
    """No exact run of 50 words, and each line stands in other, earlier documents: once, or in more than the seed's partners."""
    rng = random.Random(16)
    rows, want = [], {}
    for _ in range(20):
        lines = [sentence(rng, 33, 5000).split() for _ in range(3)]
        rows += [" ".join([sentence(rng, 20, 5000), *line, sentence(rng, 20, 5000)]) for line in lines for _ in range(copies)]
        for change in (False, True):
            passage = sum(lines, [])
            if change:  # the first words of the second and third line
                passage[33] = passage[66] = "changed"
            rows.append(" ".join([sentence(rng, 30, 5000), *passage, sentence(rng, 30, 5000)]))
        want[len(rows) - 1] = len(rows) - 2
    got = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()
    assert want.items() <= {(r["doc_id"], r["other_id"]) for r in got if r["n_words"] >= 95}
    assert {r["doc_id"] for r in got} == set(want)


def test_matches_against_all_places():
    """Equal k-mers of two texts, those that the other repeats by their number; in runs each fifth and the last."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        words = rng.integers(0, 1 << 32, 12 if rng.random() < 0.5 else 400, np.uint64).astype(np.uint32)
        a, b = (words[rng.integers(0, len(words), 150)] for _ in range(2))
        b[40:90] = a[20:70]
        b[95:125] = np.tile(a[:2], 15)
        a[100:130] = b[90:120]
        x, y, times = substring_dedup.matches(substring_dedup.Shingles(a, 5), substring_dedup.Shingles(b, 5), 5)
        one, two = ([tuple(t[i : i + 5]) for i in range(len(t) - 4)] for t in (a.tolist(), b.tolist()))
        number = lambda t: [t[:i].count(g) for i, g in enumerate(t)]
        want = {(i, j) for i, g in enumerate(one) for j, h in enumerate(two) if g == h and (two.count(g) <= 4 or number(one)[i] == number(two)[j])}
        assert set(zip(x.tolist(), y.tolist())) <= want and len(set(zip(x.tolist(), y.tolist()))) == len(x)
        runs = {(i, j) for i, j in want if (i - 1, j - 1) not in want}
        kept = {(i + n, j + n) for i, j in runs for n in range(150) if (i + n, j + n) in want and all((i + m, j + m) in want for m in range(n)) and (n % 5 == 0 or (i + n + 1, j + n + 1) not in want)}
        assert set(zip(x.tolist(), y.tolist())) == kept
        assert times.tolist() == ([two.count(g) for g in one] if any(two.count(g) > 4 for g in one) else [])


def test_comparing_texts_hashes_their_words_once(monkeypatch):
    """Texts without an equal run are not hashed in windows, and hashes that are compared alone are not mixed."""
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 1 << 32, 300, np.uint64).astype(np.uint32) for _ in range(2))
    b[100:190] = a[60:150]
    b[120::9] += 1
    b[:30] = np.tile(a[:1], 30)  # more than four times in the other text
    a[:12] = a[0]
    want = substring_dedup.passages(substring_dedup.Shingles(a, 5), substring_dedup.Shingles(b, 5), 5, 0.05, 50, 0.8)
    assert want and want[0][0] <= 60 and want[0][1] >= 145

    def none(*args):
        raise AssertionError("hashed again")

    monkeypatch.setattr(substring_dedup, "window_hashes", none)
    monkeypatch.setattr(substring_dedup, "shingles", none)
    assert substring_dedup.passages(substring_dedup.Shingles(a, 5), substring_dedup.Shingles(b, 5), 5, 0.05, 50, 0.8) == want


def test_chains_against_all_predecessors():
    rng = np.random.default_rng(8)
    for _ in range(50):
        n = int(rng.integers(1, 25))
        x, y = rng.integers(0, 60, n), rng.integers(0, 60, n)
        best = np.full(n, 8.0)
        for i in np.lexsort((y, x)):
            for j in range(n):
                if x[j] < x[i] and y[j] < y[i]:
                    best[i] = max(best[i], best[j] + 8 - 0.1 * (x[i] - x[j] + y[i] - y[j]))
        chain = substring_dedup.chains(x, y, 8, 0.1)[0]
        score = 8.0 + sum(8 - 0.1 * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(chain, chain[1:]))
        assert score == pytest.approx(best.max())


def test_embeddings(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((40, 32))
    rows = []
    for i in range(160):
        v = base[i % 40] + rng.standard_normal(32) * rng.choice([0.0, 0.1, 0.25, 0.4])
        rows.append((i, v.astype(np.float32).tolist(), None if i == 5 else int(i % 3)))
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 32, 1), (203, [1.0, None] * 16, 1), (204, [float("nan")] * 32, 1), (205, [1.0, 2.0], 1), (None, rows[0][1], 0), rows[9]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    fine = {k: r for k, r in enumerate(rows) if r[0] is not None and r[2] is not None and embedding_dedup.usable(r[1]) is not None}
    near = {k: set() for k in range(len(rows))}
    for a, ra in fine.items():
        for b, rb in fine.items():
            x, y = np.array(ra[1], float), np.array(rb[1], float)
            if a != b and ra[2] == rb[2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                near[a].add(b)
    comp = {k: r[0] for k, r in enumerate(rows)}
    for _ in rows:
        comp = {k: min([comp[k], *(comp[j] for j in near[k])]) if near[k] else comp[k] for k in comp}
    want = sorted(((rows[k][0], len(near[k]), comp[k]) for k in near), key=str)
    got = embedding_dedup.embedding_duplicates(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == want
    assert embedding_dedup.embedding_duplicates(df.limit(0)).count() == 0


def test_lattice_decoding_is_nearest():
    rng = np.random.default_rng(10)
    y = rng.standard_normal((300, 8)) * 2
    at = embedding_dedup.nearest_e8(y)
    far = ((y - at) ** 2).sum(1)
    for m in embedding_dedup.minimal_vectors() / 2:
        assert (((y - at - m) ** 2).sum(1) >= far - 1e-9).all()


def test_token_counts(spark, docs, library):
    got = token_counts.count_tokens(docs, PATH, PATTERN).toPandas()
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] != 3}
    for i, g in got.groupby("doc_id"):
        if i in rows:
            assert g.n_tokens.sum() == len(library.encode_ordinary(rows[i])) and len(g) == rows[i].count("\n") + 1
    start, end = np.array([0, 2, 5]), np.array([2, 5, 9])
    low, high = np.array([0, 3, 8]), np.array([3, 8, 9])
    want = {"most": [1, 2, 0], "first": [2, 1, 0], "last": [1, 1, 1], "share": [1 + 1 / 3, 2 / 3 + 3 / 4, 1 / 4]}
    for rule, counts in want.items():
        assert token_counts.allocate(start, end, low, high, rule).tolist() == pytest.approx(counts)
    fields = token_counts.count_field_tokens(docs.select("doc_id", "text", "source"), PATH, PATTERN, ["text", "source"])
    assert fields.count() == 2 * docs.count() and token_counts.count_tokens(empty(spark), PATH, PATTERN).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_against_each_character(spark, library, rule):
    """Each token's characters are counted one by one, for lines and for fields, in texts whose tokens cross their ends."""
    rng = random.Random(31)
    texts = ["".join(rng.choice(["a", "bc", " ", "\n", "\n\n", "é", "漢字", "🙂", "the", "  ", "\t\n"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]

    def plain(text, bounds):
        out, char_of = [0.0] * len(bounds), [i for i, c in enumerate(text) for _ in c.encode()]
        section = {c: k for k, (a, b) in enumerate(bounds) for c in range(a, b)}
        at = 0
        for t in library.encode_ordinary(text):
            n = len(library.decode_single_token_bytes(t))
            chars = sorted(set(char_of[at : at + n]))
            at += n
            held = Counter(section[c] for c in chars if c in section)
            if rule == "most":
                out[min(held, key=lambda k: (-held[k], k))] += 1
            elif rule == "share":
                for k, c in held.items():
                    out[k] += c / len(chars)
            else:
                out[section[chars[0 if rule == "first" else -1]]] += 1
        return out

    frame = spark.createDataFrame([(i, t, t[::-1]) for i, t in enumerate(texts)], "doc_id int, text string, other string")
    got = token_counts.count_tokens(frame, PATH, PATTERN, rule=rule).toPandas()
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("section")
        bounds, at = [], 0
        lines = texts[i].split("\n")
        for j, x in enumerate(lines):
            bounds.append((at, at + len(x) + (j < len(lines) - 1)))
            at = bounds[-1][1]
        assert list(zip(g.start, g.end)) == bounds and g.n_tokens.tolist() == pytest.approx(plain(texts[i], bounds))
    fields = token_counts.count_field_tokens(frame, PATH, PATTERN, ["text", "other"], rule=rule).toPandas()
    for i, g in fields.groupby("doc_id"):
        t = texts[i]
        want = plain(t + "\n" + t[::-1], [(0, len(t) + 1), (len(t) + 1, 2 * len(t) + 1)])
        assert dict(zip(g.field, g.n_tokens)) == pytest.approx(dict(zip(["text", "other"], want)))


def test_encoder_is_like_the_library(texts, library):
    e = spans.encoder(spans.ranks_of(PATH), PATTERN)
    for t in [*texts, " a  b", "a ", "x \n y", "it's 's 3rd", "  nbsp  "]:
        assert e.ids(t).tolist() == library.encode_ordinary(t or "")


def written_in_order(got, folder, rows, library, stride=64, pad=65535):
    """Whether the shards hold the sequences of rows at their slots, and each slot once."""
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    whole = {}
    for r in rows:
        whole.setdefault(r["doc_id"], []).append(library.encode_ordinary(r["text"] or ""))
    for r in got:
        assert r["shard_path"] == f"{folder}/shard-{r['shard']:08d}.bin"
        record = token_output.read_shard(folder, r["shard"], stride, from_record=r["byte_offset"] // (2 * stride))[0]
        assert record[: r["n_tokens"]].tolist() in [w[stride * r["seq_no"] :][:stride] for w in whole[r["doc_id"]]]
        assert (record[r["n_tokens"] :] == pad).all()
    assert sum(r["n_tokens"] for r in got) == sum(len(w) for ws in whole.values() for w in ws)


@pytest.mark.parametrize("files", [False, True])
def test_training_order(spark, docs, library, tmp_path, files):
    folder, kw = f"file://{tmp_path}/shards", {"stride": 64, "per_shard": 20, "shards_per_task": 4}
    if files:  # several files, in small splits
        docs.repartition(5).write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    out = token_output.write_training_order(docs, PATH, PATTERN, folder=folder, **kw)
    got, rows = out.collect(), docs.collect()
    written_in_order(got, folder, rows, library)
    assert len({r["shard"] for r in got}) > 5
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "shards").glob("shard-*")}
    assert token_output.write_training_order(docs, PATH, PATTERN, folder=folder, **kw).collect() == got
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "shards").glob("shard-*")} == before
    # another key, size or input does not mix with what is there
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 4, F.concat(F.lit("x"), F.substring("text", 2, 9999))).otherwise(F.col("text")))
    for d, other in ((docs, {"key": 21}), (docs, {"stride": 32}), (docs, {"pad": 7}), (changed, {})):
        with pytest.raises(ValueError, match="new folder"):
            token_output.write_training_order(d, PATH, PATTERN, folder=folder, **{**kw, **other})
    # a run that stopped between shards goes on
    manifest = f"{folder}/manifest.json"
    storage.write_text(spark, manifest, storage.read_text(spark, manifest).replace("true", "false"))
    next((tmp_path / "shards").glob("shard-*3.bin")).unlink()
    again = token_output.write_training_order(docs, PATH, PATTERN, folder=folder, **kw)
    written_in_order(again.collect(), folder, rows, library)
    other = token_output.write_training_order(changed, PATH, PATTERN, folder=f"{folder}-2", **{**kw, "key": 21})
    written_in_order(other.collect(), f"{folder}-2", changed.collect(), library)
    assert token_output.write_training_order(empty(spark), PATH, PATTERN).count() == 0


@pytest.fixture
def restored(spark):
    """Settings that a test changes are put back."""
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_training_order_while_cores_change(spark, docs, library, tmp_path, monkeypatch, restored):
    """The number of cores changes between the two scans of files that are cut by it."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, sentence(rng, rng.randint(0, 60))) for i in range(6000)], "doc_id bigint, text string")
    docs.repartition(1).write.option("parquet.block.size", 10_000).parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    rows, numbered = spark.read.parquet(f"{tmp_path}/docs"), token_output.numbered
    splits = set()
    for cores in ("7", "3"):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
        splits.add(frozenset(r[0] for r in spark.read.parquet(f"{tmp_path}/docs").select(F.col("_metadata.file_block_start")).distinct().collect()))
    assert len(splits) == 2 and min(map(len, splits)) > 1  # the case is real

    def then_more_cores(*args):
        out = numbered(*args)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "7")
        return out

    monkeypatch.setattr(token_output, "numbered", then_more_cores)
    folder = f"file://{tmp_path}/shards"
    got = token_output.write_training_order(rows, PATH, PATTERN, folder=folder, stride=64, per_shard=20)
    written_in_order(got.collect(), folder, docs.collect(), library)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    # rows that only one of the scans has are an error, and the folder stays unfinished
    for change in (lambda s, n, texts, d: (s.where("_block < 0"), n, texts, d), lambda s, n, texts, d: (s, n, texts + 1, d), lambda s, n, texts, d: (s.withColumn("_base", F.lit(0).cast("long")), n, texts, d)):
        monkeypatch.setattr(token_output, "numbered", lambda *a, change=change: change(*numbered(*a)))
        other = f"file://{tmp_path}/{random.random()}"
        with pytest.raises(Exception, match="input changed"):
            token_output.write_training_order(rows, PATH, PATTERN, folder=other, stride=64, per_shard=20)
        assert '"complete": false' in storage.read_text(spark, f"{other}/manifest.json")


def test_foreign_shards_are_refused(spark, docs, tmp_path):
    folder, kw = f"file://{tmp_path}/shards", {"stride": 64, "per_shard": 20}
    token_output.write_training_order(docs, PATH, PATTERN, folder=folder, **kw)
    (tmp_path / "shards" / "manifest.json").unlink()
    with pytest.raises(ValueError, match="no manifest"):
        token_output.write_training_order(docs, PATH, PATTERN, folder=folder, **kw)


def test_cache_is_bounded_by_bytes(library):
    """Long pieces, each another one, leave nothing behind, and are encoded as the library does."""
    t = bpe.ByteBPE(spans.parsed(spans.ranks_of(PATH)), PATTERN)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([3, 60, 70, 3000]))) for _ in range(300)]
    for i in range(0, 300, 30):
        assert list(t.encode_many(texts[i : i + 30])) == [library.encode_ordinary(x) for x in texts[i : i + 30]]
        assert not t.long and max(map(len, t.cache)) <= t.LONGEST


def test_language_samples_are_bounded(spark):
    """A third of all rows has one id."""
    rows = [(i, f"some words of text {i} in this language", "en") for i in range(200)] + [(92, f"many rows of one id {i}", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    one = language_id.learn(docs, samples=16)["en"]
    assert one.count(b"\n") < 16 and one.count(b"one id") == 1 == language_id.learn(docs, samples=16)["en"].count(b"one id")


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    a, b = (token_output.permuted(np.arange(n), n, key) for key in (1, 2))
    assert sorted(a) == sorted(b) == list(range(n)) and (n < 100 or (a != b).any())


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    test = got[got.held_out]
    assert (test.lang == test.lang_pred).mean() > 0.97 and got.accepted.mean() > 0.98 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(0, None, "en"), (1, "", "en"), (2, "12 !?", "en"), (None, "words", None)], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in language_id.language_id(odd).where("doc_id is not null").collect()} == {"und"}
    assert language_id.keep_identified(empty(spark)).count() == 0


def test_texts_in_no_language_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng, letters = random.Random(1), "abcdefghijklmnopqrstuvwxyz"
    junk = ["".join(rng.choice(letters + " ") for _ in range(rng.randint(20, 600))) for _ in range(200)]
    junk += [" ".join(str(rng.randrange(10 ** rng.randint(1, 8))) for _ in range(rng.randint(5, 80))) + " x" for _ in range(200)]
    junk += [base64.b64encode(rng.randbytes(rng.randint(20, 400))).decode() for _ in range(200)]
    learned = language_id.learn(docs)
    found = language_id.identify(spark.createDataFrame(list(enumerate(junk)), "id int, text string"), ["id"], "text", learned)
    assert found.where("not _rejected").count() <= 0.03 * len(junk)
    right = language_id.identify(docs, ["lang"], "text", learned).where("lang = _lang_pred")
    assert right.where("not _rejected").count() >= 0.99 * right.count()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    got = registry.queries()[name](spark, folder).toPandas()
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)


def test_pipeline(spark, docs, texts):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "encode"]
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_pipeline_stages_compared_with_plain_python(spark, library):
    import corpus_pipeline as P

    rng = random.Random(21)
    base = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 2500").collect() if r["text"]]
    columns = list(base[0].asDict())
    rows = [tuple(r) for r in base]
    at = {c: columns.index(c) for c in columns}

    def add(n, doc_id, text):
        row = list(rows[n])
        row[at["doc_id"]], row[at["text"]] = doc_id, text
        rows.append(tuple(row))

    long = [i for i, r in enumerate(base) if len(r["text"].split()) >= 80]
    for j, i in enumerate(long[:6]):
        w = base[i]["text"].split()
        add(i, 900_000 + j, base[i]["text"].replace(" ", "\n", 1))
        w[30] = "changed"
        add(i, 910_000 + j, " ".join(w))
        # at and under the threshold
        for n in (4, 12):
            v = list(w)
            for p in rng.sample(range(len(v)), n):
                v[p] = f"other{p}"
            add(i, 920_000 + 100 * n + j, " ".join(v))
    for j, x in enumerate((None, "", "12 !?", " ")):
        add(0, 930_000 + j, x)
    docs = spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))

    def told(inputs, _):
        sizes, want = language_id.Classifier(language_id.learn(docs)), []
        for r in inputs:
            if any(map(str.isalpha, r["text"] or "")):
                (best, lang), (other, _) = sorted(zip(sizes.sizes(r["text"].lower().encode()), sizes.langs))[:2]
                if 1 - best / other >= 0.02:
                    want.append((r["doc_id"], r["text"], lang))
        return want

    def smallest(groups):
        return [(r["doc_id"], r["text"], r["lang"]) for g in groups for r in [min(g, key=lambda r: r["doc_id"])]]

    def exact(inputs, _):
        groups = {}
        for r in inputs:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), []).append(r)
        return smallest(groups.values())

    def near(inputs, _):
        seqs = []
        for r in inputs:
            w = r["text"].encode().lower().split()
            seqs.append([tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))])
        bags, group = [Counter(s) for s in seqs], list(range(len(seqs)))
        for i, a in enumerate(seqs):
            for j in range(i):
                b, bound = seqs[j], (bags[i] & bags[j]).total()
                if not bound or bound < 0.8 * (len(a) + len(b) - bound):
                    continue
                line = [0] * (len(b) + 1)
                for x in a:
                    new = [0]
                    for k, y in enumerate(b):
                        new.append(line[k] + 1 if x == y else max(line[k + 1], new[k]))
                    line = new
                if line[-1] >= 0.8 * (len(a) + len(b) - line[-1]) - 1e-9:
                    group = [group[j] if g == group[i] else g for g in group]
        return smallest([[r for r, g in zip(inputs, group) if g == x] for x in set(group)])

    def mixed(inputs, out):
        by = {}
        for r in inputs:
            by[r["source"]] = by.get(r["source"], 0) + size(r["text"])
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
        open_ = set(by)
        while True:
            rest = 1.5 * sum(by.values()) - sum(2 * by[s] for s in by if s not in open_)
            over = {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 2 * by[s]}
            if not over:
                break
            open_ -= over
        given, text_of = Counter(), {r["doc_id"]: r["text"] for r in inputs}
        for r in out:
            given[r["source"]] += size(r["text"])
            assert text_of[r["doc_id"]].startswith(r["text"])
        assert given == {s: int(rest * weight[s] / sum(weight[x] for x in open_)) if s in open_ else 2 * by[s] for s in by}
        cut = Counter(r["source"] for r in out if r["text"] != text_of[r["doc_id"]])
        assert max(cut.values(), default=0) <= 1 and max(Counter(r["doc_id"] for r in out).values()) <= 2

    def encoded(inputs, _):
        ids = [library.encode_ordinary(r["text"]) for r in inputs]
        return [(r["doc_id"], len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()) for r, x in zip(inputs, ids)]

    current, counts = docs, {}
    for (name, stage), plain in zip(P.STAGES, (told, exact, near, mixed, encoded), strict=True):
        inputs = current.collect()
        current = P.written(stage(spark, current, ""), name)
        got = current.collect()
        want = plain(inputs, got)
        if want is not None:
            shown = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if name == "encode" else ["doc_id", "text", "lang"]
            assert sorted(tuple(r[c] for c in shown) for r in got) == sorted(want), name
        counts[name] = (len(inputs), len(got))
    assert all(a > b for a, b in (counts[n] for n in ("language_id", "exact_dedup", "near_dedup"))), counts
