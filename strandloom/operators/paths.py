"""Bounded search of simple paths between sources and targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import number_rows
from ..functions.storage import written

PATH_SCHEMA = "source bigint, rank int, path array<bigint>"
MAX_DEPTH = 255


def top_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, *, max_depth: int = 10, top_k: int = 5, max_expansions: int | None = None, save: Callable[[DataFrame], DataFrame] = lambda df: written(df, "paths")) -> DataFrame:
    """source, rank, path: for each source the best simple paths that end at another target.

    Breadth first, a level at a time: a level joins the paths' ends to the edges and drops
    reads already on the path.  Accepted children count towards max_expansions of their
    source in the order of parent and dst, which is the order of equally long paths; the last that fits is kept.
    Only sources whose children exceed what is left are ranked, by ranges of (source, path), so
    that no task holds a source; such a source is done.  A child is extended
    while depth + 1 < max_depth (so a depth of 1 still gives paths of two).  Longer paths
    come first, then smaller ids.  save cuts the lineage of each level.
    """
    if max_depth > MAX_DEPTH:
        raise ValueError(f"max_depth is at most {MAX_DEPTH}")
    if max_expansions is not None and max_expansions <= 0:
        raise ValueError("max_expansions is positive")
    spark = edges.sparkSession
    sources = sources.select(F.col("read_int").alias("source")).distinct()
    if top_k <= 0 or max_depth < 1:
        return spark.createDataFrame([], PATH_SCHEMA)
    ends = (sources if targets is None else targets.select(F.col("read_int").alias("source")).distinct()).withColumnRenamed("source", "_target")
    edges = edges.select(F.col("src").alias("_tip"), F.col("dst").alias("_dst")).distinct()
    front = sources.select("source", F.array("source").alias("path"))
    used = sources.select("source", F.lit(0).cast("bigint").alias("_used"))
    found, depth = None, 0
    while True:
        children = front.withColumn("_tip", F.element_at("path", -1)).join(edges, "_tip").where(~F.array_contains("path", F.col("_dst")))
        children = save(children.select("source", F.concat("path", F.array("_dst")).alias("path")))
        going = children
        if max_expansions is not None:
            made = children.groupBy("source").agg(F.count("*").alias("_n"))
            used = save(used.join(made, "source").select("source", "_n", "_used", (F.col("_n") + F.col("_used")).alias("_sum")))
            if not used.where(F.col("_sum") > max_expansions).isEmpty():
                over = used.where(F.col("_sum") > max_expansions)
                ranked = number_rows(children.join(over.select("source"), "source", "left_semi"), [F.col("source"), F.col("path")], "_g")
                first = ranked.groupBy("source").agg(F.min("_g").alias("_first"))
                fits = ranked.join(first, "source").join(over, "source").where(F.col("_g") - F.col("_first") < max_expansions - F.col("_used"))
                children = save(children.join(over, "source", "left_anti").select("source", "path").union(fits.select("source", "path")))
            going = children.join(used.where(F.col("_sum") >= max_expansions), "source", "left_anti")
            used = used.select("source", F.col("_sum").alias("_used"))
        tip = F.element_at("path", -1)
        hits = children.join(ends, tip == F.col("_target"), "left_semi").where(tip != F.col("source"))
        # a level's paths are equally long, so only its best top_k can stay
        hits = _best(hits, top_k)
        found = hits if found is None else found.union(hits)
        depth += 1
        if depth >= max_depth or going.isEmpty():
            break
        front = going
    return _best(found, top_k, "rank").select("source", F.col("rank").cast("int").alias("rank"), "path")


def _best(paths: DataFrame, k: int, name: str = "_rank") -> DataFrame:
    order = F.row_number().over(Window.partitionBy("source").orderBy(F.size("path").desc(), "path"))
    out = paths.withColumn(name, order).where(F.col(name) <= k)
    return out if name == "rank" else out.drop(name)


def path_statistics(paths: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: sources, with_paths (sources that have some), paths and longest (reads of the longest path)."""
    found = paths.agg(F.countDistinct("source").alias("with_paths"), F.count("*").alias("paths"), F.max(F.size("path")).alias("longest"))
    return sources.agg(F.countDistinct("read_int").alias("sources")).crossJoin(F.broadcast(found))  # one row each


def label_paths(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """source, rank, path of read ids; RuntimeError when a read has no id."""
    steps = paths.select("source", "rank", F.posexplode("path").alias("_i", "read_int")).join(labels.select("read_int", "read_id"), "read_int", "left")
    if missing := [r["read_int"] for r in steps.where("read_id is null").select("read_int").distinct().take(5)]:
        raise RuntimeError(f"reads without an id: {missing}")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_i", "read_id"))), lambda x: x["read_id"])
    return steps.groupBy("source", "rank").agg(ordered.alias("path"))


def bridges(paths: DataFrame, sources: DataFrame, labels: DataFrame) -> DataFrame:
    """read_id of every source and its labelled paths in rank order; an empty list when it has none."""
    named = label_paths(paths, labels)
    lists = named.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))
    out = sources.select(F.col("read_int").alias("source")).distinct().join(lists, "source", "left").join(labels.select(F.col("read_int").alias("source"), "read_id"), "source")
    return out.select("read_id", F.coalesce("paths", F.array().cast("array<array<string>>")).alias("paths"))
