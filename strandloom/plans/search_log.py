"""An append-only log of a search in batches of anchors.

A folder holds ``run.json``, what the search belongs to; ``paths/batch=N``, the results of each batch; and ``commits``, a
small record for each finished batch.  A batch counts when its record is there, which appears in one step after its
results; what a stopped batch has left is replaced.  A record is written once and never again, so the log grows by what
is new.  No path passes through the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import exists, read_new, remove, saved_at, write_text
from ..operators.paths import PATH_SCHEMA

#: Fixed value: the advice at the end of each error about saved state.
HINT = "use --restart to start a fresh run"
RECORD = "batch bigint, first bigint, last bigint, paths bigint, digest string"


class StateError(RuntimeError):
    """Saved state that does not belong to this run."""


def anchor_digest(anchors: DataFrame) -> tuple[int, str]:
    """How many anchors there are, and a number for which they are in which order, from (sel_ord, read_int)."""
    row = anchors.agg(F.count("*").alias("n"), F.sum(F.xxhash64("sel_ord", "read_int").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], str(row["h"] or 0)


class SearchLog:
    def __init__(self, spark: SparkSession, folder: str, belongs_to: dict, restart: bool = False):
        self.spark, self.folder = spark, folder.rstrip("/")
        expected = json.loads(json.dumps(belongs_to))
        if restart:
            remove(spark, self.folder)
        if saved_at(spark, f"{self.folder}/run.json") is None:
            if exists(spark, f"{self.folder}/commits"):
                raise StateError(f"{self.folder} has finished batches, but not what they belong to; {HINT}")
            write_text(spark, f"{self.folder}/run.json", json.dumps(expected))
        try:
            found = json.loads(read_new(spark, f"{self.folder}/run.json"))
        except (OSError, ValueError) as e:
            raise StateError(f"the saved state cannot be read ({e}); {HINT}") from e
        if not isinstance(found, dict) or (different := sorted(k for k in expected.keys() | found.keys() if found.get(k) != expected.get(k))):
            raise StateError(f"the saved state differs in {', '.join(different) if isinstance(found, dict) else 'its form'}; {HINT}")
        self.done = self._checked()

    def _checked(self) -> int:
        """The number of finished batches, which are the first ones, without a gap, and have the paths that their records tell."""
        if not exists(self.spark, f"{self.folder}/commits"):
            return 0
        records = self.spark.read.schema(RECORD).json(f"{self.folder}/commits")
        n, batches, least, most = records.agg(F.count("*"), F.countDistinct("batch"), F.min("batch"), F.max("batch")).first()
        if not n:
            return 0
        gaps = records.join(records.select((F.col("batch") + 1).alias("batch"), F.col("last").alias("_before")), "batch", "left")
        if batches != n or least != 0 or most != n - 1 or not gaps.where("first <> coalesce(_before, 0)").isEmpty():
            raise StateError(f"finished batches are no prefix of the anchors; {HINT}")
        held = self._read().groupBy("batch").agg(F.count("*").alias("_paths"), self._digest().alias("_digest"))
        if not records.join(held, "batch", "left").where("paths <> coalesce(_paths, 0) or digest <> coalesce(_digest, '0')").isEmpty():
            raise StateError(f"saved paths and finished batches differ; {HINT}")
        return n

    def _read(self) -> DataFrame:
        if not exists(self.spark, f"{self.folder}/paths"):
            return self.spark.createDataFrame([], f"{PATH_SCHEMA}, batch bigint")
        return self.spark.read.schema(f"{PATH_SCHEMA}, batch bigint").parquet(f"{self.folder}/paths")

    @staticmethod
    def _digest():
        return F.coalesce(F.sum(F.xxhash64("source", "rank", "path").cast("decimal(38,0)")), F.lit(0)).cast("string")

    def commit(self, batch: int, first: int, last: int, found: DataFrame) -> int:
        """Writes the paths of a batch, the anchors first to last - 1, and then its record; the number of paths."""
        path = f"{self.folder}/paths/batch={batch}"
        found.select("source", "rank", "path").write.mode("overwrite").parquet(path)
        n, digest = self.spark.read.schema(PATH_SCHEMA).parquet(path).agg(F.count("*"), self._digest()).first()
        write_text(self.spark, f"{self.folder}/commits/{batch:09d}.json", json.dumps({"batch": batch, "first": first, "last": last, "paths": n, "digest": digest}))
        self.done = batch + 1
        return n

    def paths(self) -> DataFrame:
        """source, rank, path of the finished batches."""
        return self._read().where(F.col("batch") < self.done).drop("batch")

    def count(self) -> int:
        """Paths of the finished batches, from their records."""
        if not self.done:
            return 0
        return self.spark.read.schema(RECORD).json(f"{self.folder}/commits").agg(F.coalesce(F.sum("paths"), F.lit(0))).first()[0]
