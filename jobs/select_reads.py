"""Reads for the assembler, chosen from a table of reads.

    python -m jobs.select_reads --config jobs/select_reads.json --reads documents.parquet --out folder [--counts folder]

A run takes all reads: k-mer counts (or those that ``jobs.kmer_spectrum`` keeps), their window, barcodes, bins, a cover
by anchors, direct bridges between anchors, and the reads that any of them selects.  Below ``out`` it writes

* ``reads``, a row for each read: barcode, place in its bin, and why it is selected; by ``bin_id``;
* ``fasta``, the selected records;
* ``bins``, the bins' reads and bases, as CSV.

A run replaces what an earlier one left, so a repeated run, also after one that was stopped, gives the same files' rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import counted, log, main
from strandloom.functions.storage import plan_bytes, written
from strandloom.operators import barcodes as B
from strandloom.operators import binning, cover, kmers, overlap, selection, spectrum
from strandloom.sources import adapters, writers

#: cover: champions (one pass), rounds, or lazy (exact order of ties).
KNOWN = {"k": 21, "genome_size": 600_000, "coverage": 3.0, "min_overlap": 10, "cover": "champions", "first_bin": selection.FIRST_BIN, "last_bin": selection.LAST_BIN}
COVERS = {"champions": cover.champions, "rounds": cover.anchors_by_rounds, "lazy": cover.anchors}


def run(spark: SparkSession, reads: str, out: str, config: dict | None = None, counts: str | None = None) -> DataFrame:
    """Runs the job and returns ``reads`` below out, read back."""
    c = KNOWN | (config or {})
    if c["cover"] not in COVERS or not 0 < c["k"] <= kmers.LONGEST_CODE:
        raise ValueError(f"cover is one of {', '.join(COVERS)}, k at most {kmers.LONGEST_CODE}")
    if (least := binning.min_bin_bases(c["genome_size"], c["coverage"])) is None:
        raise ValueError("the genome is too small for bins")
    table = spark.read.parquet(reads).select("doc_id", "text")
    log.info("reads: %d rows of %s", table.count(), reads)
    every = adapters.kept_reads(table)
    kept = spark.read.parquet(counts) if counts else written(kmers.code_counts(every, c["k"], least=spectrum.LEAST_LOWER, size=plan_bytes(table)), "counts")
    marks = spectrum.unikmers(kept, *spectrum.window_bounds(kmers.kmer_histogram(kept)))
    barcoded = written(B.barcodes(every, marks, c["k"]), "barcodes")
    binned = written(binning.bin_reads(barcoded, c["genome_size"], c["coverage"]), "bins")
    chosen = written(COVERS[c["cover"]](barcoded), "anchors")
    direct = written(overlap.direct_bridges(barcoded, chosen, c["min_overlap"]).select("read_int"), "bridges")
    flagged = (
        barcoded.join(binned.select("read_id", "bin_id", "rank_in_bin"), "read_id")
        .join(chosen.select("read_int", F.lit(True).alias("_anchor")), "read_int", "left")
        .join(direct.select("read_int", F.lit(True).alias("_bridge")), "read_int", "left")
    )
    flag = lambda name: F.coalesce(name, F.lit(False))
    by_bin = F.col("bin_id").between(c["first_bin"], c["last_bin"])
    flagged = flagged.select("read_id", "read_int", "read_len", "n_barcodes", "barcode", "rank_in_bin", flag("_anchor").alias("is_anchor"), flag("_bridge").alias("is_bridge"), (flag("_anchor") | flag("_bridge") | by_bin).alias("selected"), "bin_id")
    # bins of any size become files of like size: small ones share a task, a large one has many
    counted(flagged.hint("rebalance", "bin_id"), lambda w: w.mode("overwrite").partitionBy("bin_id").parquet(f"{out}/reads"), f"{out}/reads")
    result = spark.read.parquet(f"{out}/reads")
    records = selection.selected_records(every, result.where("selected"))
    counted(writers.fasta_lines(records), lambda w: w.mode("overwrite").text(f"{out}/fasta"), f"{out}/fasta")
    distribution = written(binning.barcode_distribution(barcoded), "distribution")
    bounds = binning.bin_bounds(distribution)
    dimension = binning.bin_dimension(distribution, bounds, binning.bin_starts(distribution, bounds, least), least)
    writers.write_report(binning.bin_summary(dimension, binned, ordered=True), f"{out}/bins", writers.BIN_HEADER, "bin_ord")
    log.info("wrote %s", f"{out}/bins")
    return result


if __name__ == "__main__":
    main(__doc__.splitlines()[0], ("reads", "out", "counts"), KNOWN, run, optional=("counts",))
