"""The shared scratch folder, written intermediate tables, small files on any Hadoop file system, size-checked
broadcasts, and sending this package to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its written table is at most this large.
BROADCAST_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once, so that workers can import it wherever they run."""
    sc = spark.sparkContext
    if hasattr(sc, "_strandloom_sent"):
        return
    root = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as d:
        name = f"{d}/strandloom.zip"
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(shutil.copy(name, f"{sc._temp_dir}/strandloom.zip"))
    sc._strandloom_sent = True


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, so that they share the machine's folders."""
    return master == "local" or master.startswith("local[")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/strandloom-{spark.sparkContext.applicationId}"


_cleaned: set[str] = set()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in this application's part of the scratch folder, which goes when the driver's Python ends."""
    folder = f"{scratch_root(spark)}/strandloom/{spark.sparkContext.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_forget, spark, folder)
    return f"{folder}/{uuid.uuid4().hex}-{tag}"


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        remove(spark, folder)
    except Exception:  # the JVM may be gone; the folder is scratch
        pass


def written(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: short lineage, no lost work, known size."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_strandloom_path", None):
            remove(t.sparkSession, path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size of df in bytes; for files and written tables this is their length."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A hint to broadcast a written table if it is small enough; else Spark shuffles both sides."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, so that two spellings of one path are equal."""
    where, fs = _at(spark, path)
    return fs.makeQualified(where).toString()


def listing(spark: SparkSession, path: str) -> list[list]:
    """Name, size and time of change of each file at or below a path (a glob too), hidden ones aside, by name."""
    where, fs = _at(spark, path)
    out = []

    def walk(status):
        name = status.getPath().getName()
        if name.startswith(("_", ".")):
            return
        if status.isDirectory():
            for s in fs.listStatus(status.getPath()):
                walk(s)
        else:
            out.append([status.getPath().toString(), status.getLen(), status.getModificationTime()])

    for status in fs.globStatus(where) or ():
        walk(status)
    return sorted(out)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file; OSError if it cannot be read, be it for a checksum that differs."""
    where, fs = _at(spark, path)
    try:
        stream = fs.open(where)
        try:
            return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
    except Py4JJavaError as e:
        raise OSError(f"{path}: {e.java_exception}") from e


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place, then renamed over what is there.

    A file system without a renaming that replaces may lose the old file for a moment; read_new finds the new one.
    """
    where, fs = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    if where.getParent() is not None:
        fs.mkdirs(where.getParent())
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
        stream.hsync()
    finally:
        stream.close()
    replace = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    uri = fs.makeQualified(where).toUri()
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(where), replace)


def read_new(spark: SparkSession, path: str) -> str | None:
    """The text that write_text wrote last, or None."""
    place = saved_at(spark, path)
    return place and read_text(spark, place)


def saved_at(spark: SparkSession, path: str) -> str | None:
    return next((p for p in (path, f"{path}.part") if exists(spark, p)), None)
