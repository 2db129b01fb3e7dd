"""K-mer counts and yields of a growing table of reads.

    python -m jobs.kmer_spectrum --config jobs/kmer_spectrum.json --reads documents.parquet --out folder

Sequencing goes on until the spectrum has its peak, so counts are wanted after each delivery, without counting old reads
again.  A run takes the files that no earlier run has taken (a file stream; its progress is in ``out/checkpoint``):

1. Each micro-batch writes its k-mers, as packed runs of bases by minimizer, to ``new/batch=N`` and its sources' yields to ``yields/batch=N``.
   A batch that is repeated after a stop replaces its own folders, so each read counts once.
2. What batches have brought since the last run is counted and added to the totals.  Totals lie in two places in turn: the old ones stay
   whole until the new ones are, and then ``marks`` gets a row that names the place and the last batch in it.  A run that
   stops in between adds the same batches to the same old totals again.
3. The histogram is written anew from the totals, as CSV.

Totals: code (2 bits a base; see operators.kmers), n, and prefix, the first bases of the k-mer, by which they are
partitioned.  A run that finds nothing new leaves the totals as they are.  Files that change after they were taken
are not taken again.  Settings other than those of the first run are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import counted, log, main, read_parquet
from strandloom.operators import kmers
from strandloom.sources import adapters, writers

#: prefix: bases that name a partition of the totals; files_per_batch: files of a micro-batch at most.
KNOWN = {"k": 21, "prefix": 2, "files_per_batch": 1000}


#: Buckets of minimizers, the same for all batches.
BUCKETS = 1 << 12
#: Packed runs of a task that counts them: some six million k-mers, which are sorted in memory.
TASK_BYTES = 8 << 20


def last_mark(spark: SparkSession, out: str) -> dict | None:
    """The newest row of the marks: batch, place, k, prefix."""
    marks = read_parquet(spark, f"{out}/marks")
    row = marks.orderBy(F.desc("batch")).first() if marks is not None else None
    return row.asDict() if row else None


def set_mark(spark: SparkSession, out: str, mark: dict) -> None:
    row = spark.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in mark.items()])
    row.write.mode("append").parquet(f"{out}/marks")
    log.info("mark: batch %d in place %d", mark["batch"], mark["place"])


def totals(spark: SparkSession, out: str) -> DataFrame:
    """code, n, prefix of all reads taken so far."""
    mark = last_mark(spark, out)
    if mark is None or mark["batch"] < 0:
        return spark.createDataFrame([], "code bigint, n bigint, prefix string")
    return spark.read.schema("code bigint, n bigint, prefix string").parquet(f"{out}/totals/place={mark['place']}")


def yields(spark: SparkSession, out: str, after: int = -1) -> DataFrame:
    """source, reads, bases of all reads taken so far, or in the batches after one."""
    table = read_parquet(spark, f"{out}/yields")
    if table is None:
        return spark.createDataFrame([], "source string, reads bigint, bases bigint")
    return table.where(F.col("batch") > after).groupBy("source").agg(F.sum("reads").alias("reads"), F.sum("bases").alias("bases"))


def take_new(spark: SparkSession, reads: str, out: str, c: dict) -> None:
    """Counts the reads of new files, a micro-batch at a time."""

    def add(batch: DataFrame, number: int) -> None:
        every = adapters.reads_from_documents(batch.select("doc_id", "text"))
        counted(kmers.packed_runs(every, c["k"], BUCKETS), lambda w: w.mode("overwrite").parquet(f"{out}/new/batch={number}"), f"{out}/new/batch={number}")
        of = batch.select("source", F.length(adapters.letters("text")).cast("bigint").alias("_len")).groupBy("source").agg(F.count("*").alias("reads"), F.sum("_len").alias("bases"))
        counted(of, lambda w: w.mode("overwrite").parquet(f"{out}/yields/batch={number}"), f"{out}/yields/batch={number}")

    schema = spark.read.parquet(reads).schema
    # a path as a pattern may be a folder or a single file
    path = reads.rstrip("/")
    path = path if any(x in path for x in "*?[]{}") else f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(path)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("took %d new rows of %s", yields(spark, out, last_mark(spark, out)["batch"]).agg(F.coalesce(F.sum("reads"), F.lit(0))).first()[0], reads)


def add_to_totals(spark: SparkSession, out: str, c: dict) -> bool:
    """Adds what batches after the mark have brought; whether there was any."""
    mark, new = last_mark(spark, out), read_parquet(spark, f"{out}/new")
    new = new.where(F.col("batch") > mark["batch"]) if new is not None else None
    last = new.agg(F.max("batch")).first()[0] if new is not None else None
    if last is None:
        return False
    k, p, place = c["k"], c["prefix"], 1 - max(mark["place"], 0)
    summed = kmers.run_counts(new.select("bucket", "runs"), k, task_bytes=TASK_BYTES)
    if mark["batch"] >= 0:  # without old totals each code is there once
        summed = totals(spark, out).select("code", "n").unionAll(summed).groupBy("code").agg(F.sum("n").alias("n"))
    summed = summed.withColumn("prefix", kmers.decoded(F.shiftright("code", 2 * (k - p)), p))
    path = f"{out}/totals/place={place}"
    # no further shuffle: a task writes a file of each prefix; codes in order are stored by their small differences
    summed = summed.sortWithinPartitions("prefix", "code")
    counted(summed, lambda w: w.mode("overwrite").option("parquet.writer.version", "v2").partitionBy("prefix").parquet(path), path)
    set_mark(spark, out, mark | {"batch": last, "place": place})
    return True


def run(spark: SparkSession, reads: str, out: str, config: dict | None = None) -> DataFrame:
    """Takes what is new and returns the totals, read back."""
    c = KNOWN | (config or {})
    if not 0 < c["prefix"] <= c["k"] <= kmers.LONGEST_CODE:
        raise ValueError(f"a prefix has 1 to k bases, and k is at most {kmers.LONGEST_CODE}")
    first = {"batch": -1, "place": -1, "k": c["k"], "prefix": c["prefix"]}
    if (mark := last_mark(spark, out)) is None:
        set_mark(spark, out, first)
    elif different := [x for x in ("k", "prefix") if mark[x] != c[x]]:
        raise ValueError(f"{out} was begun with another {', '.join(different)}; choose a new folder")
    take_new(spark, reads, out, c)
    if add_to_totals(spark, out, c):
        histogram = kmers.kmer_histogram(totals(spark, out))
        writers.write_report(histogram, f"{out}/histogram", writers.HISTOGRAM_HEADER, "freq")
        log.info("wrote %s", f"{out}/histogram")
    return totals(spark, out)


if __name__ == "__main__":
    main(__doc__.splitlines()[0], ("reads", "out"), KNOWN, run)
