"""Run metrics as JSON, fitted parameters and models as Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_metrics(df: DataFrame, path: str, digits: int = 6, append: bool = True) -> None:
    """Metric rows as JSON lines, doubles rounded; runs are appended."""
    cols = [F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
            for f in df.schema.fields]
    df.select(*cols).write.mode("append" if append else "error").json(path)


def read_metrics(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
