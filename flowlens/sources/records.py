"""Fixed-width binary records: 32-bit floats followed by one label byte."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable, Iterator

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, functions as F


# Task code travels with its helpers, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])


def record_dtype(n_features: int):
    import numpy as np

    return np.dtype([("x", "<f4", (n_features,)), ("label", "u1")])


def record_size(n_features: int) -> int:
    return 4 * n_features + 1


def _open(path: str):
    """Arrow file system and path for a local path or a URI."""
    from pyarrow import fs as pfs

    if "://" not in path:
        path = path.removeprefix("file:")
        return pfs.LocalFileSystem(), path
    return pfs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system: one without a scheme lies in the cluster's default one, for every executor."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def write_records(df: DataFrame, features: list[str], label: str, path: str) -> None:
    """One file per task in a folder every executor can reach.

    A task writes a file of its own name; only files of attempts that Spark reports
    as successful are listed, so a retried task leaves no second copy in the data.
    """
    m, path = len(features), qualified(df.sparkSession, path)

    def put(batches: Iterable) -> Iterator:
        import numpy as np
        import pandas as pd

        system, root = _open(path)
        system.create_dir(f"{root}/attempts", recursive=True)
        name = f"attempts/part-{uuid.uuid4().hex}.bin"
        rows = 0
        with system.open_output_stream(f"{root}/{name}") as out:
            for pdf in batches:
                rec = np.zeros(len(pdf), dtype=record_dtype(m))
                rec["x"] = pdf[features].to_numpy(dtype="float32")
                rec["label"] = pdf[label].to_numpy(dtype="uint8")
                out.write(rec.tobytes())
                rows += len(pdf)
        yield pd.DataFrame({"file": [f"{path}/{name}"], "rows": [rows]})

    done = df.select(*features, label).mapInPandas(put, "file string, rows bigint")
    done.write.mode("error").parquet(f"{path}/_files")


def record_files(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """(file, rows) of a plain folder of record files, from their lengths; nothing is read."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.col("path").alias("file"), F.floor(F.col("length") / record_size(n_features)).alias("rows"))


def read_records(spark: SparkSession, path: str, n_features: int, written: bool = True,
                 block_rows: int = 1_000_000) -> DataFrame:
    """Read in blocks of ``block_rows`` records: a task seeks to its block and decodes it as one array.

    ``written`` folders list their own files; any other folder is listed by length.
    """
    files = spark.read.parquet(f"{path}/_files") if written else record_files(spark, path, n_features)
    blocks = files.filter("rows > 0").withColumn("block", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("rows") - 1) / block_rows).cast("int"))))
    # An explicit number keeps this short table from being merged into one task.
    spread = blocks.select("file", "block").repartition(max(1, min(blocks.count(), 100_000)), "file", "block")
    size, names = record_size(n_features), [f"f{i}" for i in range(n_features)]

    def load(batches: Iterable) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for file, block in zip(pdf["file"], pdf["block"]):
                system, name = _open(file)
                with system.open_input_file(name) as src:
                    src.seek(int(block) * block_rows * size)
                    raw = src.read(block_rows * size)
                rec = np.frombuffer(raw, dtype=record_dtype(n_features), count=len(raw) // size)
                out = pd.DataFrame(rec["x"], columns=names)
                out["label"] = rec["label"].astype("int8")
                yield out

    schema = ", ".join(f"{n} float" for n in names) + ", label tinyint"
    return spread.mapInPandas(load, schema)
