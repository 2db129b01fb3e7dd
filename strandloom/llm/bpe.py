"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All pieces that are not known yet are laid out behind each other as one linked list of
tokens with gaps between pieces.  The queue has a bucket of list positions for each merge
rank and a bitmap of three levels over the ranks; find-first-set picks the lowest rank,
its positions are merged from left to right, and entries whose pair has changed since are
skipped.  So a piece of n bytes costs O(n log n) however long it is.

Each match of the pattern is a piece; a piece that is a token itself is that token.
Pieces seen before come from a cache of bounded size, which changes speed alone.

Defined results: a null text counts as empty; an empty text has no tokens and decodes to
no bytes.  Rows are independent: repeated rows and ties give repeated results, a null id is kept.  Texts and pieces
of any length are encoded whole.  An empty table gives an empty table.  Columns travel under numbers, so that names
cannot clash; encode_texts adds ids and n_tokens to the columns that are there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField

from .common import mapped
from .spans import parsed, ranks_of


class RankQueue:
    """Positions by rank, lowest rank first."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int] | None] = [None] * ranks
        self.levels = []
        while True:
            ranks = (ranks + 63) >> 6
            self.levels.append([0] * ranks)
            if ranks == 1:
                break

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        for level in self.levels:
            word = level[rank >> 6]
            level[rank >> 6] = word | 1 << (rank & 63)
            if word:
                return
            rank >>= 6

    def first(self) -> int:
        """The lowest rank with positions, or -1."""
        if not self.levels[-1][0]:
            return -1
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at << 6 | (word & -word).bit_length() - 1
        return at

    def take(self, rank: int) -> list[int]:
        bucket, self.buckets[rank] = self.buckets[rank], None
        for level in self.levels:
            level[rank >> 6] &= ~(1 << (rank & 63))
            if level[rank >> 6]:
                break
            rank >>= 6
        return bucket


class ByteBPE:
    """A tokenizer from ranks (bytes to id) and a pattern of pieces."""

    #: Entries of a generation of the cache (the older of two goes when the younger is full), the longest piece in it in
    #: characters, and bytes of unknown pieces that are merged together.  So a generation has 26 million characters at most, and about 100 MB with usual pieces.
    CACHE, LONGEST, TOGETHER = 400_000, 64, 1 << 19

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.most = cache
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.vocab = {i: b for b, i in ranks.items()}
        self.text = [str(i) for i in range(self.size)]
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {}
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    self.pairs[a * self.size + b] = rank
        self.cache: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        #: Pieces too long to stay in the cache after their group of texts.
        self.long: set[str] = set()

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The tokens of each piece (not empty)."""
        size, pairs, byte = self.size, self.pairs, self.byte
        token = [byte[b] for p in pieces for b in p]
        n = len(token)
        after, before, rank_at = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        heads, at = [], 0
        for p in pieces:
            heads.append(at)
            before[at] = -1
            at += len(p)
            after[at - 1] = -1
        queue = RankQueue(size)
        push, buckets = queue.push, queue.buckets
        for i in range(n):
            j = after[i]
            if j >= 0 and (r := pairs.get(token[i] * size + token[j], -1)) >= 0:
                rank_at[i] = r
                if (bucket := buckets[r]) is None:
                    push(r, i)
                else:
                    bucket.append(i)
        while (rank := queue.first()) >= 0:
            todo = queue.take(rank)
            todo.sort()
            for k, i in enumerate(todo):
                if rank_at[i] != rank:
                    continue  # stale
                j = after[i]
                rank_at[j] = -1
                token[i] = rank
                after[i] = j = after[j]
                lower = False
                if j >= 0:
                    before[j] = i
                    r = rank_at[i] = pairs.get(rank * size + token[j], -1)
                    if r >= 0:
                        if (bucket := buckets[r]) is None:
                            push(r, i)
                        else:
                            bucket.append(i)
                        lower = r < rank
                else:
                    rank_at[i] = -1
                j = before[i]
                if j >= 0:
                    r = rank_at[j] = pairs.get(token[j] * size + rank, -1)
                    if r >= 0:
                        if (bucket := buckets[r]) is None:
                            push(r, j)
                        else:
                            bucket.append(j)
                        lower = lower or r < rank
                if lower:  # never with trained ranks
                    for i in todo[k + 1 :]:
                        push(rank, i)
                    break
        out = []
        for i in heads:
            ids = []
            while i >= 0:
                ids.append(token[i])
                i = after[i]
            out.append(tuple(ids))
        return out

    def learn(self, pieces: set[str]) -> None:
        """Puts the tokens of pieces into the cache."""
        todo, held = [], 0
        for p in pieces:
            if (r := self.ranks.get(b := p.encode())) is not None:
                self.cache[p] = (r,)
                continue
            todo.append((p, b))
            held += len(b)
            if held > self.TOGETHER:
                self._learn(todo)
                todo, held = [], 0
        self._learn(todo)

    def _learn(self, todo: list[tuple[str, bytes]]) -> None:
        self.cache.update(zip([p for p, _ in todo], self.merge([b for _, b in todo])))
        self.long.update(p for p, _ in todo if len(p) > self.LONGEST)

    def encode_many(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text; unknown pieces of several texts are merged together."""
        group, held = [], 0
        for x in texts:
            group.append(self.find(x) if x else [])
            held += len(x or "")
            if held > self.TOGETHER:
                yield from self._encode(group)
                group, held = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str]]) -> Iterator[list[int]]:
        if len(self.cache) > self.most:
            self.cache, self.old = {}, self.cache
        if unknown := set(chain.from_iterable(group)).difference(self.cache):
            again = unknown & self.old.keys()
            self.cache.update((p, self.old[p]) for p in again)
            self.learn(unknown - again)
        get = self.cache.__getitem__
        out = [list(chain.from_iterable(map(get, pieces))) for pieces in group]
        for p in self.long:
            del self.cache[p]
        self.long.clear()
        yield from out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


_loaded: dict[tuple[int, str, int], ByteBPE] = {}


def tokenizer(ranks: bytes, pattern: str, cache: int = ByteBPE.CACHE) -> ByteBPE:
    """One tokenizer for each worker process, from the lines of its vocabulary."""
    name = (hash(ranks), pattern, cache)
    if name not in _loaded:
        _loaded[name] = ByteBPE(parsed(ranks), pattern, cache)
    return _loaded[name]


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids array<int> and n_tokens."""
    ranks = ranks_of(path)

    def make(texts):
        ids = list(tokenizer(ranks, pattern).encode_many(texts))
        return pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())

    return mapped(docs, docs.columns, text, [StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())], make)


def decode_ids(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """rows with decoded, the bytes of their ids; null ids count as none."""
    ranks = ranks_of(path)

    def make(values):
        return (pa.array([tokenizer(ranks, pattern).decode(x or ()) for x in values], pa.binary()),)

    return mapped(rows, rows.columns, ids, [StructField("decoded", BinaryType())], make)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", *, cache: int = ByteBPE.CACHE) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes each text and returns digests in place of both."""
    ranks = ranks_of(path)

    def make(texts):
        t = tokenizer(ranks, pattern, cache)
        counts, of_ids, of_bytes = [], [], []
        for ids in t.encode_many(texts):
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(t.text.__getitem__, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(t.decode(ids)).hexdigest())
        return pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())

    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return mapped(docs, [doc_id], text, fields, make)
