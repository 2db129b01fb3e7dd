"""Token counts by offset-mapped attribution.

Each document is encoded once, as a whole.  The tokens' character spans are joined as
intervals to the spans of sections (sorted, disjoint), and a token that crosses a boundary
is allocated by a rule:

``most``   to the section that holds most of its characters, the first of equals;
``first``  to the section of its first character; ``last`` to that of its last;
``share``  to each section in proportion to the characters there.

A token that covers part of a character's bytes has that character in its span.  Characters
outside every section count for no section; a token without a section is not counted.

Defined results: a null or empty text is one empty section without tokens.  Rows are
independent of each other, so repeated rows and ties give repeated results; a null id is
kept.  With fields, a null field is empty and the fields are joined by newlines, which
belong to the field before.  Texts of any length are encoded whole.  An empty table gives an empty table.  Other
columns are not read, and the named ones travel under names of their own, so that names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField

from .common import mapped
from .spans import encoder, ranks_of

RULES = ("most", "first", "last", "share")


def token_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of tokens that are so many bytes long."""
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    return char[ends - lengths], char[ends - 1] + 1


def allocate(start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str = "most") -> np.ndarray:
    """Tokens of each section [low, high); the sections are sorted and disjoint."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    out = np.zeros(len(low))
    a = np.searchsorted(high, start, "right")  # the first section that ends after the token's start
    b = np.searchsorted(low, end, "left") - 1  # the last that starts before its end
    inside = a == b
    whole = inside & (low[np.minimum(a, len(low) - 1)] <= start) & (end <= high[np.minimum(a, len(low) - 1)]) if len(low) else inside
    np.add.at(out, a[whole], 1)
    for i in np.flatnonzero(~whole & (a <= b)):
        held = np.arange(a[i], b[i] + 1)
        chars = np.minimum(high[held], end[i]) - np.maximum(low[held], start[i])
        held, chars = held[chars > 0], chars[chars > 0]
        if not len(held):
            continue
        if rule == "most":
            out[held[chars.argmax()]] += 1
        elif rule == "share":
            out[held] += chars / (end[i] - start[i])
        elif rule == "first" and low[held[0]] <= start[i]:
            out[held[0]] += 1
        elif rule == "last" and high[held[-1]] >= end[i]:
            out[held[-1]] += 1
    return out


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their newlines; they cover the whole text."""
    lengths = np.array([len(x) + 1 for x in text.split("\n")], np.int64)
    high = np.cumsum(lengths)
    high[-1] -= 1
    return np.concatenate([[0], high[:-1]]), high


def count_tokens(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", *, sections: Callable = line_sections, rule: str = "most") -> DataFrame:
    """id, section (0, 1, ...), start, end and n_tokens (double) for every section of every row."""
    ranks = ranks_of(path)

    def make(texts):
        encode, lows, highs, counts = encoder(ranks, pattern), [], [], []
        for x in texts:
            low, high = sections(x or "")
            spans = token_spans(x, encode.lengths[encode.ids(x)]) if x else (np.zeros(0, np.int64),) * 2
            lows.append(low)
            highs.append(high)
            counts.append(allocate(*spans, low, high, rule))
        return pa.array(lows, pa.list_(pa.int64())), pa.array(highs, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.float64()))

    fields = [StructField("_low", ArrayType(LongType())), StructField("_high", ArrayType(LongType())), StructField("_tokens", ArrayType(DoubleType()))]
    rows = mapped(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), ["_id"], "_text", fields, make)
    rows = rows.select("_id", F.posexplode(F.arrays_zip("_low", "_high", "_tokens")).alias("section", "_s"))
    return rows.select(F.col("_id").alias(doc_id), F.col("section").cast("long").alias("section"), F.col("_s._low").alias("start"), F.col("_s._high").alias("end"), F.col("_s._tokens").alias("n_tokens"))


def count_field_tokens(docs: DataFrame, path: str, pattern: str, fields: list[str], doc_id: str = "doc_id", *, rule: str = "most") -> DataFrame:
    """id, field and n_tokens: the fields of a row are encoded together, joined by newlines."""
    ranks = ranks_of(path)
    texts = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields])

    def make(rows):
        encode, out = encoder(ranks, pattern), []
        for parts in rows:
            whole = "\n".join(parts)
            high = np.cumsum([len(p) + 1 for p in parts])
            high[-1] -= 1
            spans = token_spans(whole, encode.lengths[encode.ids(whole)]) if whole else (np.zeros(0, np.int64),) * 2
            out.append(allocate(*spans, np.concatenate([[0], high[:-1]]), high, rule))
        return (pa.array(out, pa.list_(pa.float64())),)

    rows = mapped(docs.select(F.col(doc_id).alias("_id"), texts.alias("_texts")), ["_id"], "_texts", [StructField("_tokens", ArrayType(DoubleType()))], make)
    names = F.array(*[F.lit(c) for c in fields])
    rows = rows.select("_id", F.explode(F.arrays_zip(names.alias("field"), F.col("_tokens").alias("n_tokens"))).alias("_f"))
    return rows.select(F.col("_id").alias(doc_id), "_f.field", "_f.n_tokens")
