"""Token-ID output in training order.

A document's ids are cut into sequences of ``stride`` ids.  A text of b bytes has b tokens at most, so it gets a number
for each ``stride`` bytes begun, without gaps (files by path, rows in a file, sequences in a row), and uses the first
of them, one for each sequence.  A keyed Feistel permutation with cycle-walking over all numbers 0 .. N-1 gives each
its place in the order of training: a shuffle that needs no sort key but the place, and that any reader can invert.
Places are cut into ranges of ``per_shard``; a partition of ranges is sorted by place, and writes a shard of each
range: records of fixed size, as many as the range has sequences.  A table of the shards, a row for each, gives their
sizes and the slot of their first record: slots are the sequences' numbers in the order of places, without gaps.  So slot s
lies at byte (s - first slot) * record of its shard, and training can read on from any slot.

1. A scan sums the numbers of each split, by the texts' lengths alone.  Splits of files are read in order, so a row's
   first number is that of its split (a row for each split, broadcast within a bound) and what stands before it
   there.  No text is shuffled.  Input that is not a plain scan of files, whose order would not be fixed, is written first.
2. A second scan encodes each text, once, numbers and cuts; the ids go to the ranges of places and into shards.

Both scans have the same splits, however many cores there are meanwhile: the settings that splits follow are held
during a call, and put back after it.  A row whose split the first scan did not have, a place that is there twice,
and texts that are missing from the index are errors, and the folder stays unfinished.

A record: ``stride`` ids, little-endian, those after the sequence's end being ``pad``.

The folder has a manifest that names the key, the sizes, the tokenizer and a digest of the input in its order.  A
folder with another manifest is refused, and so is one that holds anything without a manifest.  With the same one the work goes on: whole shards are kept
(they are written under another name and renamed), and a finished folder is only read.

Defined results: null and empty texts have no sequences.  Repeated rows are separate documents, and ties in the
order do not arise, since a row has its own place in its file.  A null id is an id.
Texts of any length are cut alike.  An empty table writes no shard.  Other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh3_128_digest, xxh64_intdigest

from ..functions.storage import listing, read_new, scratch_path, write_text
from .common import plan_bytes, ship, slices, small, written
from .spans import encoder, ranks_of


def permuted(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed bijection of 0 .. n-1: a balanced Feistel network, walked until it lands below n."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(xxh64_intdigest(f"{key}/{r}")) for r in range(rounds)]

    def once(v):
        a, b = v >> half, v & mask
        for k in keys:
            f = (b ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f ^ (f >> np.uint64(32))) & mask)
        return a << half | b

    out = once(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


#: Splits of the input at most, apart from one for each file, and bytes of their table that are broadcast at most.
MOST_SPLITS, SPLIT_BYTES = 200_000, 64 << 20


@contextlib.contextmanager
def same_splits(spark: SparkSession, input_bytes: int) -> Iterator[None]:
    """Holds what the splits of a scan depend on, the number of cores among it."""
    least, most = "spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes"
    before = {least: spark.conf.get(least, None), most: spark.conf.get(most)}
    size = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[most]))
    spark.conf.set(least, before[least] or str(spark.sparkContext.defaultParallelism))
    spark.conf.set(most, str(max(size, input_bytes // MOST_SPLITS)))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Pieces:
    """The sequences of texts, compressed; those of texts seen before come from a cache of bounded size."""

    def __init__(self, ranks: bytes, pattern: str, stride: int, most: int = 16 << 20):
        self.encode, self.pack, self.most = encoder(ranks, pattern), zstandard.ZstdCompressor(level=1).compress, most
        self.width = self.encode.dtype.itemsize
        self.size, self.known, self.held = stride * self.width, {}, 0

    def __call__(self, text: str | None) -> tuple[list[bytes], list[int]]:
        """The sequences and their lengths."""
        if not text:
            return [], []
        name = xxh3_128_digest(text.encode())
        if name not in self.known:
            codes = self.encode(text)
            cut = [codes[i : i + self.size] for i in range(0, len(codes), self.size)]
            made = [self.pack(c) for c in cut], [len(c) // self.width for c in cut]
            self.held += sum(map(len, made[0]))
            if self.held > self.most:
                self.known, self.held = {}, 0
            self.known[name] = made
        return self.known[name]


def in_file_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_id, _text, _path and _block (the split) of rows that are read from files in a fixed order."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    if not any(x in plan for x in ("Exchange", "Sort", "Join", "Aggregate", "Generate", "Map", "Union", "Limit", "Sample", "InMemoryTableScan", "LocalTableScan", "Range (")):
        try:
            return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
        except AnalysisException:  # not files
            pass
    return written(rows, "rows").select("_id", "_text", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))


def numbered(rows: DataFrame, stride: int) -> tuple[DataFrame, int, int, str]:
    """From rows of in_file_order: the first number of each split (_f, a hash of its path, _block, _base), how many numbers and
    how many texts with sequences there are, and a digest of the rows in their order."""
    size = F.ceil(F.coalesce(F.octet_length("_text"), F.lit(0)) / stride).cast("bigint")
    counts = written(rows.select("_path", "_block", F.xxhash64("_id", "_text").alias("_hash"), F.monotonically_increasing_id().alias("_at"), size.alias("_n")), "counts")
    splits = counts.groupBy("_path", "_block").agg(F.sum("_n").alias("_n"), F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    files = Window.orderBy("_path", "_block")  # a row for each split
    before = lambda c: F.sum(c).over(files.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c)
    splits = written(splits.select("_path", "_block", F.xxhash64("_path").alias("_f"), "_n", "_first", before("_n").alias("_base"), before("_rows").alias("_row")), "splits")
    total = splits.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    # a row's place over all files, whatever its split and task
    place = F.col("_row") + F.col("_at") - F.col("_first")
    known = counts.join(F.broadcast(splits.select("_path", "_block", "_row", "_first")), ["_path", "_block"])
    state = known.agg(F.count("*").alias("n"), F.count_if(F.col("_n") > 0).alias("texts"), F.sum(F.xxhash64("_hash", place, "_n").cast("decimal(38,0)")).alias("h")).first()
    return splits.select("_f", "_block", "_base"), total, state["texts"], f"{state['n']}/{state['h']}"


def _cut(ranks: bytes, pattern: str, stride: int, total: int, key: int):
    """Sequences of the rows (_id, _text, _f, _block, _base) of splits, which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, split, at = Pieces(ranks, pattern, stride), None, 0
        for batch in batches:
            for part in slices(batch, 64):
                rows, numbers, seq, pieces, lengths = [], [], [], [], []
                sizes = np.ceil(np.asarray(pc.fill_null(pc.binary_length(part.column(1)), 0)) / stride).astype(np.int64).tolist()
                for r, (size, x, *here, base) in enumerate(zip(sizes, *[part.column(i).to_pylist() for i in range(1, 5)])):
                    if here != split:
                        if base is None:
                            raise ValueError("the input changed between the scans: a split was not counted")
                        split, at = here, base
                    cut, n = made(x)
                    lengths += n
                    rows += [r] * len(cut)
                    numbers += range(at, at + len(cut))
                    seq += range(len(cut))
                    pieces += cut
                    at += size
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(rows)), pa.array(seq, pa.int64()), pa.array(lengths, pa.int64()), pa.array(permuted(np.array(numbers, np.int64), total, key)), pa.array(pieces, pa.binary())],
                        names=["_id", "_seq", "_len", "_place", "_ids"],
                    )

    return run


def _shards(folder: str, record: int, per_shard: int, pad: bytes):
    def store(fs, base: str, shard: int, records: list[bytes]) -> None:
        name, size = f"{base}/shard-{shard:08d}.bin", record * len(records)
        if fs.get_file_info(name).size == size:
            return
        part = f"{name}.{uuid.uuid4().hex}"
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(part) as f:
            for r in records:
                f.write(r)
        fs.move(part, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        unpack, shard, held, last = zstandard.ZstdDecompressor(), None, [], -1
        for batch in batches:
            at = []
            for place, ids in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if place <= last:
                    raise ValueError("the input changed between the scans: a place is there twice")
                last = place
                if place // per_shard != shard:
                    if held:
                        store(fs, base, shard, held)
                    shard, held = place // per_shard, []
                ids = unpack.decompress(ids)
                at.append(len(held))
                held.append(ids + pad * ((record - len(ids)) // len(pad)))
            places = np.array(batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(places // per_shard), pa.array(at, pa.int64())], names=["_id", "_seq", "_len", "_shard", "_record"])
        if held:
            store(fs, base, shard, held)

    return run


def write_training_order(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", *, stride: int = 1024, per_shard: int = 4096, key: int = 20, pad: int | None = None, folder: str | None = None, shards_per_task: int = 16) -> DataFrame:
    """Writes shards, their index and a manifest below folder, and returns the index; without a folder they go to a new one in the
    shared folder, which goes when the driver ends.

    The index: id, seq_no, n_tokens, slot, shard, byte_offset and shard_path of every sequence.  per_shard: places of a
    shard, and so its records at most.  pad: the largest id that fits by default."""
    spark = docs.sparkSession
    ship(spark)
    folder = (folder or scratch_path(spark, "shards")).rstrip("/")
    with same_splits(spark, plan_bytes(docs)):
        _write(docs, path, pattern, doc_id, text, stride, per_shard, key, pad, folder, shards_per_task)
    name = F.concat(F.lit(f"{folder}/shard-"), F.lpad(F.col("shard").cast("string"), 8, "0"), F.lit(".bin"))
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "first_slot")
    index = spark.read.parquet(f"{folder}/index").join(small(shards), "shard")
    return index.select(doc_id, "seq_no", "n_tokens", (F.col("first_slot") + F.col("record")).alias("slot"), "shard", "byte_offset", name.alias("shard_path"))


def _write(docs: DataFrame, path: str, pattern: str, doc_id: str, text: str, stride: int, per_shard: int, key: int, pad: int | None, folder: str, shards_per_task: int) -> None:
    spark, ranks = docs.sparkSession, ranks_of(path)
    e = encoder(ranks, pattern)
    pad = int(np.iinfo(e.dtype).max) if pad is None else pad
    rows = in_file_order(docs, doc_id, text)
    splits, total, texts, digest = numbered(rows, stride)
    made_by = {"version": 3, "key": key, "stride": stride, "per_shard": per_shard, "pad": pad, "dtype": e.dtype.str, "places": total, "texts": texts, "tokenizer": hashlib.sha256(ranks).hexdigest(), "pattern": pattern, "input": digest}
    if _begin(spark, folder, made_by):
        return
    if plan_bytes(splits) > SPLIT_BYTES:
        raise ValueError("too many files for their table to be broadcast; write the input to fewer ones")
    rows = rows.select("_id", "_text", F.xxhash64("_path").alias("_f"), "_block").join(F.broadcast(splits), ["_f", "_block"], "left").select("_id", "_text", "_f", "_block", "_base")
    schema = StructType([rows.schema["_id"], *[StructField(c, LongType()) for c in ("_seq", "_len", "_place")]]).add("_ids", "binary")
    cut = rows.mapInArrow(_cut(ranks, pattern, stride, total, key), schema)
    shards = max(1, -(-total // per_shard))
    tasks = -(-shards // shards_per_task)
    cut = cut.repartitionById(tasks, F.floor(F.floor(F.col("_place") / per_shard) * tasks / shards).cast("int")).sortWithinPartitions("_place")
    record = stride * e.dtype.itemsize
    out = StructType([*schema.fields[:3], StructField("_shard", LongType()), StructField("_record", LongType())])
    done = cut.mapInArrow(_shards(folder, record, per_shard, np.array([pad], e.dtype).tobytes()), out)
    done = done.select(F.col("_id").alias(doc_id), F.col("_seq").alias("seq_no"), F.col("_len").alias("n_tokens"), F.col("_shard").alias("shard"), F.col("_record").alias("record"), (F.col("_record") * record).alias("byte_offset"))
    done.write.mode("overwrite").parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    found = index.agg(F.count_if(F.col("seq_no") == 0)).first()[0]
    if found != texts:
        raise ValueError(f"the input changed between the scans: {found} of {texts} texts are written")
    # sums over shards by blocks of them
    sizes = written(index.groupBy("shard").agg(F.count("*").alias("records")).withColumn("_block", F.floor(F.col("shard") / 4096)), "shards")
    before = lambda c, *by: F.sum(c).over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) - F.col(c)
    blocks = written(sizes.groupBy("_block").agg(F.sum("records").alias("_n")).select("_block", before("_n", "_block").alias("_base")), "blocks")
    sizes = sizes.join(small(blocks), "_block").withColumn("first_slot", F.col("_base") + before("records", "_block", "shard"))
    sizes.select("shard", "first_slot", "records").write.mode("overwrite").parquet(f"{folder}/shards")
    write_text(spark, f"{folder}/manifest.json", json.dumps(made_by | {"complete": True}))


def _begin(spark: SparkSession, folder: str, made_by: dict) -> bool:
    """Whether the folder is finished; a new one gets its manifest, another one's is refused."""
    found = read_new(spark, f"{folder}/manifest.json")
    if found is None:
        if listing(spark, f"{folder}/*"):
            raise ValueError(f"{folder} holds files but no manifest; choose a new folder")
        write_text(spark, f"{folder}/manifest.json", json.dumps(made_by | {"complete": False}))
        return False
    found = json.loads(found)
    if different := [k for k in made_by if found.get(k) != made_by[k]]:
        raise ValueError(f"{folder} holds shards with another {', '.join(different)}; choose a new folder")
    return found["complete"]


def read_shard(folder: str, shard: int, stride: int, dtype="<u2", from_record: int = 0) -> np.ndarray:
    """Records of a shard, from one of them on, as rows of ids."""
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
        f.seek(from_record * stride * np.dtype(dtype).itemsize)
        return np.frombuffer(f.read(), dtype).reshape(-1, stride)
