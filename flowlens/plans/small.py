"""Fitted parameters are small tables; these helpers prove that before using it."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, functions as F

# Rows a fitted table may have before it is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000


def fetch_small(params: DataFrame, limit: int = BROADCAST_ROWS):
    """Rows of ``params`` when it has at most ``limit`` of them, otherwise None.

    At most ``limit + 1`` rows ever reach the driver.
    """
    rows = params.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def settle(params: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate ``params`` once.

    A table within the limit comes back as literal rows (True: safe to
    broadcast). A larger one is checkpointed to the shared folder (False), so
    later joins do not recompute it and survive lost executors.
    """
    rows = fetch_small(params, limit)
    if rows is not None:
        return params.sparkSession.createDataFrame(rows, params.schema), True
    ensure_checkpoint_dir(params.sparkSession)
    return params.checkpoint(), False


def keyed_join(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a NULL key meets a NULL key, as groups and windows take it; key columns appear once, those of ``df``."""
    names = {c: f"_key_{i}" for i, c in enumerate(on)}
    check_free(df, names.values())
    renamed = table.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in table.columns])
    same = F.lit(True)
    for c, k in names.items():
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(k))
    out = df.join(renamed, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def check_free(df: DataFrame, names) -> None:
    """ValueError if ``df`` has a column with a name that is needed inside."""
    if taken := sorted(set(names) & set(df.columns)):
        raise ValueError(f"columns in use: {taken}")


def attach(df: DataFrame, params: DataFrame, on: list[str], how: str = "left",
           limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a fitted table to ``df`` (NULL keys meet), broadcasting only after its size was checked."""
    table, small = settle(params, limit)
    return keyed_join(df, F.broadcast(table) if small else table, on, how)


def lookup(key: Column, mapping: dict, default=None) -> Column:
    """CASE expression for a short driver-side mapping."""
    out = None
    for k, v in mapping.items():
        cond = key.isNull() if k is None else key == F.lit(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))


def ensure_checkpoint_dir(spark) -> str:
    """The shared folder for lineage cuts and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only a local session
    without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    import tempfile

    own = tempfile.mkdtemp(prefix="flowlens-")
    sc.setCheckpointDir(own)
    return own


# Input below this many bytes per core is too small to fill the cores by its own splits.
SPREAD_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Spread a small table over the cores before repeated work on it.

    A small file is one split, and every job on it would run in one task. Large
    tables, judged by the optimizer's size estimate, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SPREAD_BYTES * cores else df


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Later jobs then scan narrow columnar files, pruned to the columns they use,
    instead of repeating the work; losing an executor loses nothing.
    """
    return written(spread(df), label)


def written(df: DataFrame, label: str) -> DataFrame:
    """``materialise`` without spreading: the rows stay in their partitions."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of an intermediate table that nothing reads any more."""
    spark = df.sparkSession
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, root)


def _delete(spark, root: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_WORKSPACES: list[str] = []


@contextmanager
def workspace(spark):
    """Owns the intermediate tables made inside it: they are deleted at the end, so write results before."""
    import uuid

    root = f"{ensure_checkpoint_dir(spark)}/flowlens/workspace-{uuid.uuid4().hex}"
    _WORKSPACES.append(root)
    try:
        yield root
    finally:
        _WORKSPACES.remove(root)
        _delete(spark, root)


def scratch_path(spark, label: str) -> str:
    """A fresh path in the shared folder; callers never reuse one. A workspace, if one is open, deletes it."""
    import uuid

    base = _WORKSPACES[-1] if _WORKSPACES else f"{ensure_checkpoint_dir(spark)}/flowlens"
    return f"{base}/{label}-{uuid.uuid4().hex}"
