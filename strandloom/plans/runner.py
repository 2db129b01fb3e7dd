"""The pipeline from reads to selected reads, which goes on where an earlier run stopped.

    python -m strandloom.plans.runner --reads R --run-dir D --genome-size N --coverage X

Every stage is a store below the run folder.  The manifest there names the input files and the settings that
made each finished store; a later run with the same ones reads it.  The path search keeps an append-only log of its
batches (see search_log).  All paths may lie on any file system that Hadoop knows.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import signal
import struct
import sys
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import listing, qualified, read_new, remove, write_text, written
from ..operators import barcodes as B
from ..operators import binning, cover, kmers, overlap, paths, selection, spectrum
from ..sources import readers, writers
from .search_log import HINT, SearchLog, StateError, anchor_digest

STATE_VERSION = 3


@dataclass(frozen=True)
class Config:
    k: int = 21
    min_overlap: int = 100
    key: int = 11
    stride: int = 3
    query_stride: int = 1
    fraction: float = 0.25
    cap: int = 4000
    max_depth: int = 15
    top_k: int = 10
    max_expansions: int = 10_000_000
    genome_size: int = 0
    coverage: float = 1.0
    batch: int = 64
    round_ids: int = cover.ROUND_IDS
    cover: str = "lazy"
    buckets: int = 64


def anchor_fingerprint(ids: list[int]) -> str:
    return hashlib.sha256(struct.pack(f">{len(ids) + 1}Q", len(ids), *ids)).hexdigest()


def signatures(spark: SparkSession, inputs: dict[str, str]) -> dict[str, list]:
    """Path and the files (name, size, time of change) of each input, by role."""
    return {role: [qualified(spark, path), listing(spark, path)] for role, path in inputs.items()}


def assert_unchanged(before: dict, now: dict) -> None:
    if changed := [role for role in now if list(now[role]) != list(before[role])]:
        raise RuntimeError(f"inputs changed during the run: {', '.join(changed)}")


def protect(spark: SparkSession, state_path: str, others: list[str]) -> None:
    if qualified(spark, state_path) in {qualified(spark, p) for p in others}:
        raise ValueError("the state file must not be an input or an output")


def search(edges: DataFrame, anchors: DataFrame, config: Config, inputs: dict[str, str], folder: str, *, restart: bool = False, on_batch: Callable[[range, int, int], None] | None = None, progress_every: int = 0) -> DataFrame:
    """source, rank, path of all anchors (sel_ord from 0 without gaps, read_int), a batch at a time in their order; batches in the log at ``folder`` are not searched again."""
    spark = edges.sparkSession
    protect(spark, folder, list(inputs.values()))
    before = signatures(spark, inputs)
    total, digest = anchor_digest(anchors)
    log = SearchLog(spark, folder, {"version": STATE_VERSION, "anchors": total, "order": digest, "inputs": before, "config": asdict(config)}, restart)
    targets, found = anchors.select("read_int"), log.count() if progress_every else 0
    for batch in range(log.done, -(-total // config.batch)):
        first, last = batch * config.batch, min(total, (batch + 1) * config.batch)
        sources = anchors.where(F.col("sel_ord").between(first, last - 1)).select("read_int")
        made = paths.top_paths(edges, sources, targets, max_depth=config.max_depth, top_k=config.top_k, max_expansions=config.max_expansions)
        made = written(made, "found")
        assert_unchanged(before, signatures(spark, inputs))
        found += log.commit(batch, first, last, made)
        if progress_every and first // progress_every < last // progress_every:
            print(f"searched {last} of {total} anchors, {found} paths", file=sys.stderr)
        if on_batch:
            on_batch(range(first, last), last, total)
    return log.paths()


class Stores:
    """The stores of a run folder, and its manifest: for each finished store what made it, and the files it has."""

    def __init__(self, spark: SparkSession, run_dir: str, restart: bool):
        self.spark, self.folder = spark, run_dir.rstrip("/")
        try:
            self.done = {} if restart else json.loads(read_new(spark, self.path("manifest.json")) or "{}")
        except (OSError, ValueError) as e:
            raise StateError(f"the manifest cannot be read ({e}); {HINT}") from e

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def fresh(self, name: str, made_by: dict) -> bool:
        """Whether the store was finished by the same inputs and settings and is as it was left."""
        entry = self.done.get(name)
        return bool(entry) and entry["by"] == json.loads(json.dumps(made_by)) and entry["files"] == listing(self.spark, self.path(name))

    def finish(self, name: str, made_by: dict) -> None:
        self.done[name] = {"by": made_by, "files": listing(self.spark, self.path(name))}
        write_text(self.spark, self.path("manifest.json"), json.dumps(self.done))

    def kept(self, name: str, made_by: dict, make: Callable[[], DataFrame], write: Callable[[DataFrame, str], None] = writers.write_store, read: Callable[[str], DataFrame] | None = None) -> DataFrame:
        if not self.fresh(name, made_by):
            write(make(), self.path(name))
            self.finish(name, made_by)
        return (read or self.spark.read.parquet)(self.path(name))


def run(spark: SparkSession, reads_path: str, run_dir: str, config: Config, *, state_path: str | None = None, restart: bool = False, on_batch=None, progress_every: int = 0) -> DataFrame:
    """All stages; each is stored under run_dir.  Returns the selected read ids.

    Finished stores of an earlier run on the same reads with the same settings are read, and a search that it
    began goes on; restart makes all of them anew.
    """
    if config.max_expansions <= 0:
        raise ValueError("max_expansions is positive")
    if config.cover not in ("lazy", "rounds"):
        raise ValueError("cover is 'lazy' or 'rounds'")
    stores = Stores(spark, run_dir, restart)
    state_path = state_path or stores.path("search")
    source = signatures(spark, {"reads": reads_path})
    by = lambda *names: {"inputs": source, **{n: getattr(config, n) for n in names}}
    sorted_by = lambda c: (lambda df, path: writers.write_store(df, path, c))
    k = by("k")
    records = readers.read_records(spark, reads_path)
    every = stores.kept("reads", by(), lambda: readers.last_records(readers.with_read_ints(records)), sorted_by("read_int"))
    longer = config.k > kmers.LONGEST_CODE
    counts = stores.kept("kmer_counts", k, lambda: kmers.kmer_counts(every, config.k) if longer else kmers.code_counts(every, config.k))
    histogram = stores.kept("histogram", k, lambda: kmers.kmer_histogram(counts))
    lower, upper = spectrum.window_bounds(histogram)
    marks = stores.kept("unikmers", k, lambda: spectrum.unikmers(counts, lower, upper))
    # in buckets of read_int, so that bridges, index and bins meet the barcodes without an exchange of them
    in_buckets = lambda df, path: writers.write_bucketed(df, path, "read_int", config.buckets)
    barcoded = stores.kept("barcodes", by("k", "buckets"), lambda: B.barcodes(every, marks, config.k), in_buckets, lambda path: readers.read_bucketed(spark, path, "read_int", config.buckets))
    distribution = stores.kept("distribution", k, lambda: binning.barcode_distribution(barcoded))
    binning_by = by("k", "genome_size", "coverage")
    min_bases = binning.min_bin_bases(config.genome_size, config.coverage)
    none = lambda: spark.createDataFrame([], "bin_id bigint, read_id string, read_len int, rank_in_bin bigint")
    binned = stores.kept("bins", binning_by, none if min_bases is None else lambda: binning.bin_reads(barcoded, config.genome_size, config.coverage))
    covering = by("k", "cover")
    choose = (lambda: cover.anchors(barcoded, config.round_ids)) if config.cover == "lazy" else (lambda: cover.anchors_by_rounds(barcoded))
    chosen = stores.kept("anchors", covering, choose, sorted_by("sel_ord"))
    direct = stores.kept("direct_bridges", by("k", "cover", "min_overlap"), lambda: overlap.direct_bridges(barcoded, chosen, config.min_overlap))
    indexing = by("k", "cover", "key", "stride", "fraction", "cap")
    shape = {"k": config.key, "fraction": config.fraction, "cap": config.cap}
    index = stores.kept("head_index", indexing, lambda: overlap.head_index(barcoded, chosen, stride=config.stride, **shape), writers.write_head_index)
    edges = stores.kept("edges", indexing | by("query_stride"), lambda: overlap.overlap_edges(barcoded, index, stride=config.query_stride, **shape), sorted_by("src"))
    if not stores.fresh("reports", binning_by | covering | indexing):
        write_reports(stores, histogram, distribution, barcoded, binned, index, every, min_bases)
        stores.finish("reports", binning_by | covering | indexing)
    inputs = {name: stores.path(name) for name in ("barcodes", "anchors", "head_index")}
    protect(spark, state_path, [reads_path, *map(stores.path, stores.done)])
    found = search(edges, chosen.select("sel_ord", "read_int"), config, inputs, state_path, restart=restart, on_batch=on_batch, progress_every=progress_every)
    everything = {"inputs": source, **asdict(config)}
    bridged = stores.kept("bridges", everything, lambda: paths.bridges(found, chosen, every))
    if not stores.fresh("path_statistics", everything):
        statistics = paths.path_statistics(found, chosen)
        writers.write_report(statistics, stores.path("path_statistics"), tuple(statistics.columns))
        stores.finish("path_statistics", everything)
    selected = stores.kept("selected", everything, lambda: selection.final_selection(chosen, bridged, direct, binned).orderBy("read_id"))
    if not stores.fresh("selected_fasta", everything):
        writers.write_selected_fasta(selection.selected_records(records, selected), stores.path("selected_fasta"))
        stores.finish("selected_fasta", everything)
    return selected


def write_reports(stores: Stores, histogram, distribution, barcoded, binned, index, every, min_bases: int | None) -> None:
    """CSV reports below reports/: the histogram, the distribution, the bins in the order they were made (if the genome is large enough), and counters."""
    at = lambda name: stores.path(f"reports/{name}")
    remove(stores.spark, stores.path("reports"))
    writers.write_report(histogram, at("histogram"), writers.HISTOGRAM_HEADER, "freq")
    writers.write_report(distribution, at("distribution"), writers.DISTRIBUTION_HEADER, "n_barcodes")
    if min_bases is not None:
        bounds = binning.bin_bounds(distribution)
        dimension = binning.bin_dimension(distribution, bounds, binning.bin_starts(distribution, bounds, min_bases), min_bases)
        writers.write_report(binning.bin_summary(dimension, binned, ordered=True), at("bins"), writers.BIN_HEADER, "bin_ord")
    counters = overlap.index_statistics(index).crossJoin(F.broadcast(overlap.read_counters(barcoded, index, every)))  # one row each
    writers.write_report(counters, at("index_counters"), tuple(counters.columns))


#: Options: the name, its type, and the field of Config (the name, if it is the same).
OPTIONS = (
    ("k", int), ("min-overlap", int), ("key", int), ("stride", int), ("query-stride", int), ("fraction", float), ("cap", int), ("max-depth", int), ("top-k", int),
    ("max-expansions", int), ("genome-size", int), ("coverage", float), ("batch", int), ("cover", str), ("round-ids", int), ("buckets", int),
)


def main(args: list[str] | None = None, on_batch=None) -> int:
    """Exit codes: 0, 1 out of memory, 2 unusable state, 130 interrupted, 128 + the signal when stopped by one."""
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for names, variable in ((("--reads",), "STRANDLOOM_READS"), (("--run-dir", "--base-dir"), "STRANDLOOM_RUN_DIR")):
        p.add_argument(*names, default=os.environ.get(variable), required=variable not in os.environ, help=f"{variable} by default")
    p.add_argument("--state-path", "--checkpoint-path")
    p.add_argument("--restart", action="store_true")
    p.add_argument("--progress-every", type=int, default=1000, help="anchors between lines on the progress; 0: none")
    for name, kind in OPTIONS:
        names = [f"--{name}", *(["--max-expansions-per-source"] if name == "max-expansions" else [])]
        p.add_argument(*names, type=kind, default=getattr(Config, name.replace("-", "_")), dest=name.replace("-", "_"))
    a = p.parse_args(args)
    config = Config(**{field: getattr(a, field) for field in (name.replace("-", "_") for name, _ in OPTIONS)})
    if config.max_expansions <= 0:
        p.error("--max-expansions is positive")
    if config.cover not in ("lazy", "rounds"):
        p.error("--cover is lazy or rounds")

    def stop(number, _frame):
        raise SystemExit(128 + number)

    old = signal.signal(signal.SIGTERM, stop)
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    try:
        run(spark, a.reads, a.run_dir, config, state_path=a.state_path, restart=a.restart, on_batch=on_batch, progress_every=a.progress_every)
    except KeyboardInterrupt:
        return 130
    except MemoryError:
        return 1
    except StateError as e:
        print(e, file=sys.stderr)
        return 2
    finally:
        signal.signal(signal.SIGTERM, old)
    return 0


if __name__ == "__main__":
    sys.exit(main())
