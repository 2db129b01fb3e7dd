"""A Spark data source of FASTA and FASTQ records.

The files are listed once, when a scan is made, and cut every ``split_bytes``, whatever the cluster's size is then or
later.  A split reads on from its first byte to the first record that begins there, and past its end until its last record is
whole; so each record belongs to the split of its first byte, and nothing is numbered or shuffled.  A record's place is
its file's number (files by path) and its first byte there.  Gzipped files are one split each, with places in the unpacked text.

In FASTQ, a line is a header if it begins with @ and the second line after it with +: a quality line may begin with
@ too, but the second line after that is a sequence.  Lines may end in CR LF; blank lines between records are skipped.
"""

from __future__ import annotations

import gzip
import json
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.storage import ship

SPLIT_BYTES, BLOCK_BYTES = 32 << 20, 4 << 20
SCHEMA = "file int, start bigint, head string, seq string"
BLANKS = b" \t\r\n\v\f"


def opened(path: str):
    """A stream of a file, by any file system that Arrow knows."""
    fs, at = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.open_input_file(at)


def can_open(path: str) -> bool:
    try:
        opened(path).close()
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def lines_from(stream, at: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of the lines of a stream that stands at a line's start; lines of any length."""
    held: list[bytes] = []
    while block := stream.read(BLOCK_BYTES):
        first, *others = block.split(b"\n")
        held.append(first)
        if not others:
            continue
        others.insert(0, b"".join(held))
        held = [others.pop()]
        for x in others:
            yield at, x.removesuffix(b"\r")
            at += len(x) + 1
    if rest := b"".join(held):
        yield at, rest.removesuffix(b"\r")


def fastq_records(lines: Iterator[tuple[int, bytes]], end: int, aligned: bool) -> Iterator[tuple[int, bytes, bytes | None]]:
    """Records that begin before end, from the first header on; the lines begin with a record if they are aligned."""
    ahead: deque[tuple[int, bytes]] = deque()

    def more(n: int) -> bool:
        while len(ahead) < n and (x := next(lines, None)):
            ahead.append(x)
        return len(ahead) >= n

    while more(1):
        at, head = ahead[0]
        if at >= end:
            return
        if aligned:
            begins = head.startswith(b"@")
        elif more(3):
            begins = head.startswith(b"@") and ahead[2][1].startswith(b"+")
        else:  # a last record of two lines
            begins = len(ahead) == 2 and head.startswith(b"@") and ahead[1][1][:1] not in (b"", b"@")
        if not begins:
            ahead.popleft()
            continue
        aligned = True
        more(4)
        yield at, head[1:], ahead[1][1].strip(BLANKS) if len(ahead) > 1 else None
        for _ in range(min(4, len(ahead))):
            ahead.popleft()


def fasta_records(lines: Iterator[tuple[int, bytes]], end: int, aligned: bool) -> Iterator[tuple[int, bytes, bytes]]:
    """Records that begin before end; lines before the first header are skipped."""
    now: tuple[int, bytes] | None = None
    held: list[bytes] = []
    for at, x in lines:
        if x.startswith(b">"):
            if now:
                yield *now, b"".join(held).translate(None, BLANKS)
            if at >= end:
                return
            now, held = (at, x[1:]), []
        elif now:
            held.append(x)
        elif at >= end:
            return
    if now:
        yield *now, b"".join(held).translate(None, BLANKS)


@dataclass
class Split(InputPartition):
    file: int
    path: str
    start: int
    end: int


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.kind, self.split = json.loads(options["files"]), options["kind"], int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        out = []
        for i, (path, size) in enumerate(self.files):
            step = max(1, size if path.endswith(".gz") else self.split)
            out += [Split(i, path, at, 1 << 62 if path.endswith(".gz") else min(at + step, size)) for at in range(0, size, step)]
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        with opened(split.path) as f:
            stream, at = gzip.GzipFile(fileobj=f) if split.path.endswith(".gz") else f, 0
            if split.start:
                f.seek(split.start - 1)
                at = split.start - 1
            lines = lines_from(stream, at)
            if split.start:
                next(lines)  # the rest of a line that began before; nothing but its end if one begins here
            rows, held = [], 0
            for start, head, seq in (fastq_records if self.kind == "fastq" else fasta_records)(lines, split.end, not split.start):
                rows.append((split.file, start, head.decode("utf-8", "replace"), None if seq is None else seq.decode("latin-1")))
                held += len(seq or b"") + len(head)
                if held >= BLOCK_BYTES or len(rows) >= 4096:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.string(), pa.string()))], names=["file", "start", "head", "seq"])


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandloom_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


def scan_records(spark: SparkSession, files: list[tuple[str, int]], kind: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, start, head, seq of the records of files (path, size)."""
    ship(spark)
    spark.dataSource.register(RecordSource)
    return spark.read.format(RecordSource.name()).option("files", json.dumps(files)).option("kind", kind).option("split_bytes", str(split_bytes)).load()
