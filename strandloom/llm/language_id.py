"""Language identification by compression.

Each learned language has a zstandard raw-content dictionary made from a bounded sample of
its labelled texts.  A text is compressed, whole, with each dictionary: in blocks, so that
the dictionary and not the text's own past explains a long text.  The smallest total wins.
Short texts are compressed at a higher level, where single bytes count.  A margin under
``min_margin`` is a rejection.

The sample: of each language the rows with the smallest hash of their id in each of
``samples`` hash buckets; this is its only use of ids, and lang is read only there.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected;
so is every text when nothing could be learned.  Equal sizes go to the first language by
code point and are rejected.  A null id is held out.  Empty tables give empty tables.  Rows are independent: repeated
rows have equal results (and count once in the sample, as do rows of one id and language, by the smallest text).  Texts of any length are compressed whole.  Columns travel
under numbers, so that names cannot clash.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from .common import mapped, renamed

UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", *, samples: int = 192, piece_chars: int = 512, dict_bytes: int = 1 << 16) -> dict[str, bytes]:
    """Raw-content dictionaries by language from at most ``samples`` texts of each, ``piece_chars`` characters of
    each and ``dict_bytes`` bytes in all: the documented bound of the fit."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    h = F.xxhash64(F.lit("sample"), F.col(doc_id))
    picked = rows.groupBy(F.col(lang).alias("_lang"), F.pmod(h, F.lit(samples)).alias("_bucket")).agg(F.min(F.struct(h.alias("h"), F.col(doc_id).alias("id"))).alias("_min"))
    ids = sorted({r["_min"]["id"] for r in picked.select("_min").collect()})  # samples for each language
    # rows of these ids, of which repeated ones may be many: again one for each language and bucket
    texts = rows.where(F.col(doc_id).isin(ids)).select(F.col(lang).alias("_lang"), F.pmod(h, F.lit(samples)).alias("_bucket"), h.alias("_h"), F.substring(F.col(text), 1, piece_chars).alias("_piece"))
    texts = texts.groupBy("_lang", "_bucket").agg(F.min(F.struct("_h", "_piece")).alias("_m")).select("_lang", "_m.*").collect() if ids else []
    out: dict[str, list[bytes]] = {}
    for r in sorted(texts, key=lambda r: (r["_lang"], r["_h"], r["_piece"])):
        out.setdefault(r["_lang"], []).append(r["_piece"].lower().encode())
    return {k: b"\n".join(v)[:dict_bytes] for k, v in out.items() if any(v)}


class Classifier:
    """Compressors for each language."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 5, short_level: int = 12, short: int = 256, block: int = 2048):
        self.short, self.block = short, block
        self.langs = sorted(dictionaries)
        self.long_by, self.short_by = ([self._compressor(dictionaries[k], n) for k in self.langs] for n in (level, short_level))

    @staticmethod
    def _compressor(raw: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def sizes(self, data: bytes) -> list[int]:
        if len(data) < self.short:
            return [len(c.compress(data)) for c in self.short_by]
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.long_by]

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language and margin: how much smaller the best size is than the next, 0 to 1."""
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        found = sorted(zip(self.sizes(text.lower().encode()), self.langs))
        return found[0][1], 1 - found[0][0] / found[1][0] if len(found) > 1 else 1.0


def identify(docs: DataFrame, keep: list[str], text: str, dictionaries: dict[str, bytes], min_margin: float = 0.02) -> DataFrame:
    """The columns keep with _lang_pred, _score and _rejected; no shuffle."""

    def make(texts):
        if (classify := _ready.get("by")) is None or _ready["for"] != dictionaries:
            classify = _ready["by"] = Classifier(dictionaries)
            _ready["for"] = dictionaries
        got = [classify(x) for x in texts]
        return pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64()), pa.array([a == UNKNOWN or b < min_margin for a, b in got], pa.bool_())

    fields = [StructField("_lang_pred", StringType()), StructField("_score", DoubleType()), StructField("_rejected", BooleanType())]
    return mapped(docs, keep, text, fields, make)


#: The classifier of this worker process.
_ready: dict = {}


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **fit) -> DataFrame:
    """id, held_out, lang_pred, score and accepted for every row of docs."""
    found = identify(docs, [doc_id], text, learn(docs, doc_id, text, lang, **fit))
    return found.select(doc_id, held_out(F.col(doc_id)).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), (~F.col("_rejected")).alias("accepted"))


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **fit) -> DataFrame:
    """The rows of docs, whole, whose language was told; lang becomes the language found."""
    rows, name = renamed(docs)
    found = identify(rows, rows.columns, name[text], learn(docs, doc_id, text, lang, **fit)).where("not _rejected")
    return found.select(*[(F.col("_lang_pred") if c == lang else F.col(n)).alias(c) for c, n in name.items()])
