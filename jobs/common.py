"""What the jobs share: their command line, their settings, and writes that count their rows.

Everything is read and written by Spark, so all paths may lie on any file system that Spark knows.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def settings(spark: SparkSession, path: str, known: dict) -> dict:
    """The settings of a JSON file over the known ones; ValueError for a name that is not known or a value of another kind."""
    row = spark.read.json(path, multiLine=True).first()
    found = row.asDict() if row else {}
    if unknown := sorted(set(found) - set(known)):
        raise ValueError(f"{path} has unknown settings: {', '.join(unknown)}")
    if wrong := sorted(k for k, v in found.items() if not isinstance(v, type(known[k])) and not (isinstance(known[k], float) and isinstance(v, int))):
        raise ValueError(f"{path} has settings of another kind: {', '.join(wrong)}")
    return known | found


def read_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def counted(df: DataFrame, write: Callable[[DataFrameWriter], None], what: str) -> int:
    """Writes df; the rows are counted in the job that writes them, and logged."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")).write)
    log.info("wrote %s: %d rows", what, seen.get["rows"])
    return seen.get["rows"]


def main(about: str, options: tuple[str, ...], known: dict, run: Callable, args: list[str] | None = None, optional: tuple[str, ...] = ()) -> None:
    """Reads the command line and the config file, and runs the job in a session of its own."""
    p = argparse.ArgumentParser(description=about)
    p.add_argument("--config", required=True, help="a JSON file of settings")
    for name in options:
        p.add_argument(f"--{name}", required=name not in optional)
    a = vars(p.parse_args(args))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("strandloom job").getOrCreate()
    try:
        run(spark, **{name: a[name] for name in options}, config=settings(spark, a["config"], known))
    finally:
        spark.stop()
