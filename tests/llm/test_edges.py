"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import bpe, embedding_dedup, exact_dedup, language_id, line_dedup, mixing, near_dedup, registry, spans, substring_dedup, token_counts, token_output

PATH, PATTERN = public_tokenizers.path(registry.TOKENIZER), public_tokenizers.PATTERN
#: Names that the operators use themselves, as further columns.
CLASHING = ["_id", "_text", "_key", "_h", "_row", "_lang_pred", "_rejected", "_gone", "_words", "_size", "_taken", "_position", "keep_id", "n_tokens", "position", "_value"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING)
RNG = random.Random(41)
LONG = " ".join(f"word{RNG.randrange(30_000)}" for _ in range(30_000))
PIECE = "".join(RNG.choice("abcdeé漢") for _ in range(20_000))  # one match of the pattern, mostly
TEXTS = [None, "", " ", "\n\n", "a", LONG, LONG[: len(LONG) - 9], PIECE, "same words here, told twice over and over again", "same words here, told twice over and over again", "\x00 odd \U0001f642 \u202e text", "Zwei  Wörter"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", "s", None, *["x"] * len(CLASHING)) for i, t in enumerate(TEXTS)]
    rows += [rows[8], rows[5], (None, "a row without an id", None, None, None, *[None] * len(CLASHING)), (None, None, None, None, None, *[None] * len(CLASHING))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=spans.parsed(spans.ranks_of(PATH)), special_tokens={})


def test_operators_that_return_a_row_for_each_document(spark, docs, library):
    n, ids = docs.count(), sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str)
    made = {
        "exact": exact_dedup.exact_dedup(docs), "lines": line_dedup.dedup_lines(docs), "near": near_dedup.near_duplicates(docs),
        "bpe": bpe.round_trip_digests(docs, PATH, PATTERN), "lang": language_id.language_id(docs),
    }
    rows = {name: df.collect() for name, df in made.items()}
    for name, found in rows.items():
        assert len(found) == n and sorted((r["doc_id"] for r in found), key=str) == ids, name
    text = {i: t for i, t in enumerate(TEXTS)}
    for r in rows["bpe"]:
        if r["doc_id"] is not None:
            want = library.encode_ordinary(text[r["doc_id"]] or "")
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and r["n_tokens"] == len(want)
    assert {r["doc_id"]: r["keep_id"] for r in rows["exact"] if r["doc_id"] is not None} == {i: {1: 0, 3: 2, 9: 8}.get(i, i) for i in range(len(TEXTS))}
    near = {r["doc_id"]: r["group_id"] for r in rows["near"]}
    assert near[6] == 5 and near[9] == 8 and near[7] == 7
    assert all(r["lang_pred"] == "und" and not r["accepted"] for r in rows["lang"] if r["doc_id"] in (0, 1, 2, 3))


def test_operators_that_return_whole_rows(docs):
    for kept in (exact_dedup.drop_exact_copies(docs), near_dedup.drop_near_duplicates(docs), language_id.keep_identified(docs), mixing.mix_documents(docs)):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert all(set(r[len(r) - len(CLASHING) :]) in ({"x"}, {None}) for r in rows)
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_copies(docs).where("doc_id is not null").collect()) == [0, 2, 4, 5, 6, 7, 8, 10, 11]
    back = bpe.encode_texts(docs.drop("n_tokens"), PATH, PATTERN).select("text", "ids", "n_tokens", "_id")
    assert all(len(r["ids"]) == r["n_tokens"] for r in back.collect())


def test_searches_and_sections(spark, docs, library):
    found = substring_dedup.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["other_id"]) for r in found} == {(6, 5)} and max(r["n_words"] for r in found) >= 29_990
    counts = token_counts.count_tokens(docs, PATH, PATTERN).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in counts if r["doc_id"] in (0, 3, 7, 10)} == {i: len(library.encode_ordinary(TEXTS[i] or "")) for i in (0, 3, 7, 10)}
    order = token_output.write_training_order(docs, PATH, PATTERN).collect()
    size = sum(len(library.encode_ordinary(r["text"] or "")) for r in docs.select("text").collect())
    assert sum(r["n_tokens"] for r in order) == size and sorted(r["slot"] for r in order) == list(range(len(order)))
    one = np.arange(1.0, 65.0).tolist()
    vectors = spark.createDataFrame([(0, one, 1, "x"), (1, one, 1, "x"), (1, one, 1, "x"), (2, one, None, "x"), (3, None, 1, "x")], "vec_id bigint, embedding array<double>, label int, _id string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_duplicates(vectors).collect())
    assert got == [(0, 2, 0), (1, 2, 0), (1, 2, 0), (2, 0, 2), (3, 0, 3)]


def test_empty_tables_alone(docs):
    none = docs.limit(0)
    for made in (exact_dedup.exact_dedup(none), line_dedup.dedup_lines(none), near_dedup.near_duplicates(none), bpe.round_trip_digests(none, PATH, PATTERN), language_id.language_id(none), mixing.mix_plan(none), substring_dedup.repeated_passages(none), token_counts.count_tokens(none, PATH, PATTERN), token_output.write_training_order(none, PATH, PATTERN)):
        assert made.count() == 0 and made.columns


def test_lines_beyond_the_largest_filter(spark):
    """A filter that is far too small suspects nearly all lines, and the result is the same."""
    rng = random.Random(12)
    common = [f"a line that several documents hold {i}" for i in range(300)]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.2 else f"a line of its own {i} {j} {rng.random()}" for j in range(60)) for i in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    exact = sorted(map(tuple, line_dedup.dedup_lines(docs).collect()))
    for bits in (1 << 16, 1 << 18):
        assert sorted(map(tuple, line_dedup.dedup_lines(docs, max_bits=bits).collect())) == exact
    assert sum(r[3] for r in exact) > 10_000


def test_language_of_ties_and_repeats(spark):
    """Equal dictionaries tie: the first language by code point, rejected; repeated rows have equal results."""
    learned = {"bb": b"one two three", "aa": b"one two three"}
    rows = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, LONG)], "doc_id int, text string")
    got = language_id.identify(rows, ["doc_id"], "text", learned).collect()
    assert [tuple(r) for r in got] == [(1, "aa", 0.0, True), (1, "aa", 0.0, True), (2, "aa", 0.0, True)]
    alone = language_id.identify(rows, ["doc_id"], "text", {"aa": b"one two three"}).collect()
    assert all(r["_lang_pred"] == "aa" and not r["_rejected"] for r in alone)


def test_pipeline_without_rows_and_with_odd_ones(spark, docs):
    documents = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for rows, least in ((documents.limit(0), 0), (documents, 1)):
        for name, stage in corpus_pipeline.STAGES:
            rows = corpus_pipeline.written(stage(spark, rows, ""), name)
        assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() >= least
