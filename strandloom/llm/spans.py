"""Whole-text encoding to token ids in binary form, for operators that need ids and byte lengths.

Texts go to the library as they are.  A cache of the ids of space-separated chunks was slower
here: where many chunks are rare it cannot hold them.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import tiktoken


def ranks_of(path: str) -> bytes:
    """The vocabulary file, read by the driver alone: its lines travel with the tasks, so executors need no such file."""
    with open(path, "rb") as f:
        return f.read()


def parsed(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x.strip())}


class Encoder:
    def __init__(self, lines: bytes, pattern: str):
        ranks = parsed(lines)
        self.dtype = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for b, i in ranks.items():
            self.lengths[i] = len(b)
        self.whole = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text as little-endian integers."""
        # by way of 32 bits, which array() fills faster than 16
        return np.frombuffer(array("I", self.whole(text)), np.uint32).astype(self.dtype).tobytes() if text else b""

    def count(self, text: str | None) -> int:
        return len(self.whole(text)) if text else 0

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self(text), self.dtype)


_encoders: dict[tuple[int, str], Encoder] = {}


def encoder(ranks: bytes, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    name = (hash(ranks), pattern)
    if name not in _encoders:
        _encoders[name] = Encoder(ranks, pattern)
    return _encoders[name]
