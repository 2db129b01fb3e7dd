"""The final selection of reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins whose reads are always selected, by bin id.
FIRST_BIN, LAST_BIN = 0, 200


def bridge_reads(bridged: DataFrame) -> DataFrame:
    """Reads of bridges: every source, also one without paths, and all members of paths."""
    return bridged.select("read_id").union(bridged.select(F.explode(F.flatten("paths")).alias("read_id"))).distinct()


def binned_reads(binned: DataFrame, first: int = FIRST_BIN, last: int = LAST_BIN) -> DataFrame:
    return binned.where(F.col("bin_id").between(first, last)).select("read_id").distinct()


def final_selection(anchors: DataFrame, bridged: DataFrame, direct: DataFrame, binned: DataFrame, first: int = FIRST_BIN, last: int = LAST_BIN) -> DataFrame:
    """read_id of anchors, bridges, direct bridges and the reads of the given bins; each once."""
    parts = [anchors.select("read_id"), bridge_reads(bridged), direct.select("read_id"), binned_reads(binned, first, last)]
    return reduce(DataFrame.union, parts).where(F.col("read_id").isNotNull()).distinct()


def selected_records(records: DataFrame, selected: DataFrame) -> DataFrame:
    """The records, each as often as it occurs, whose id is selected."""
    return records.join(selected.select("read_id").distinct(), "read_id", "left_semi")
