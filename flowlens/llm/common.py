"""Helpers shared by the text operators: staged tables, skew-safe lookups, a store that outlives a task."""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.small import scratch_path

# Task code travels with its helpers, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; letters beyond ASCII stay as they are."""
    return F.translate(text, UPPER, LOWER)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: lineage ends, a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark, path: str) -> None:
    """Delete an intermediate table of ours from the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], size: str, hot_share: int = 10_000) -> DataFrame:
    """Left join of ``rows`` to a table with one row per key, whatever share of the rows one key has.

    ``size`` is the table's column with the number of rows of its key. Keys with more than 1/hot_share of
    all rows are at most ``hot_share`` in number, so they are broadcast; the others meet by shuffle.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    cut = F.col(size) > F.lit(max(1000, total // hot_share))
    hot = table.filter(cut)
    if hot.isEmpty():
        return rows.join(table, keys, "left")
    values = [c for c in table.columns if c not in keys]
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    here = marked.filter("_hot").drop("_hot")
    rest = marked.filter("_hot IS NULL").drop("_hot", *values).join(table.filter(~cut), keys, "left")
    return here.unionByName(rest)


def release_arrow() -> None:
    """Give the memory that Arrow keeps for later back to the system; a worker outlives its task and shares its executor's memory."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def worker_store() -> dict:
    """A dictionary of the Python worker process; it outlives one task."""
    return sys.__dict__.setdefault("_flowlens_store", {})
