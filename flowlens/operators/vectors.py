"""Array columns and long-form matrices (row, dim, v)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import expr as X
from ..plans.small import fetch_small


def as_doubles(c: Column) -> Column:
    return c.cast("array<double>")


def elementwise(a: Column, b, op: str) -> Column:
    """add, sub, mul or div of two vectors, or of a vector and a number; x / 0 is 0."""
    ops = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": X.safe_div}
    if op not in ops:
        raise ValueError(f"unknown operation {op!r}")
    if isinstance(b, (int, float)):
        return F.transform(a, lambda x: ops[op](x, F.lit(float(b))))
    return F.zip_with(a, b, ops[op])


def unary(a: Column, op: str, lo: float = 0.0, hi: float = 1.0) -> Column:
    ops = {"clip": lambda x: F.greatest(F.lit(lo), F.least(F.lit(hi), x)), "abs": lambda x: F.abs(x),
           "log": lambda x: X.log_shifted(x), "exp": lambda x: F.exp(x)}
    if op not in ops:
        raise ValueError(f"unknown operation {op!r}")
    return F.transform(a, ops[op])


def row_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def row_argmax(a: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def reduce_rows(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Sum, maximum, argmax and mean of every vector."""
    a = as_doubles(F.col(vec))
    return df.select(key, row_sum(a).alias("v_sum"), F.array_max(a).alias("v_max"), row_argmax(a).alias("v_argmax"),
                     (row_sum(a) / F.size(a)).alias("v_mean"))


def to_long(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(key, F.posexplode(as_doubles(F.col(vec))).alias("dim", "v"))


def reduce_columns(long: DataFrame) -> DataFrame:
    """Sum, maximum, mean, population deviation and variance per dimension, and over all cells (dim -1)."""
    agg = [F.sum("v").alias("v_sum"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"),
           F.stddev_pop("v").alias("v_std"), F.var_pop("v").alias("v_var")]
    return long.rollup("dim").agg(*agg).withColumn("dim", F.coalesce("dim", F.lit(-1)))


def matmul(a: DataFrame, b: DataFrame, salts: int = 32) -> DataFrame:
    """Product of long matrices a(i, k, v) and b(k, j, w).

    The right side is broadcast when it is checked to be small, and partial sums
    then form before the shuffle. Otherwise k, of which there may be few, is
    salted so that no k becomes one task.
    """
    small = fetch_small(b)
    if small is not None:
        pairs = a.join(F.broadcast(a.sparkSession.createDataFrame(small, b.schema)), "k")
    else:
        left = a.withColumn("_salt", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int"))
        right = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        pairs = left.join(right, ["k", "_salt"])
    return pairs.groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def transpose(long: DataFrame, row: str, col: str) -> DataFrame:
    return long.select(F.col(col).alias(row), F.col(row).alias(col), *[c for c in long.columns if c not in (row, col)])


def reshape(df: DataFrame, key: str, vec: str, cols: int) -> DataFrame:
    """A flat vector as (r, c, v) with ``cols`` columns."""
    long = to_long(df, key, vec)
    return long.select(key, F.floor(F.col("dim") / cols).cast("int").alias("r"), (F.col("dim") % cols).alias("c"), "v")


def slice_row(a: Column, start: int, length: int) -> Column:
    """0-based slice."""
    return F.slice(a, start + 1, length)


def dense_score(df: DataFrame, vec: str, layers: Sequence[Mapping], name: str = "score") -> DataFrame:
    """Score a stack of dense layers; the last unit of the last layer is the score.

    A layer has ``w`` (inputs x units), optional ``b``, ``activation`` and, for batch
    normalisation in inference form, ``gamma, beta, mean, var, eps``. Weights travel
    with the task; rows arrive in Arrow batches and each batch is one matrix product.
    """
    model = []
    for layer in layers:
        if layer.get("activation") not in X.ACTIVATIONS:
            raise ValueError(f"unknown activation {layer.get('activation')!r}")
        model.append({k: np.asarray(v, dtype="float64") if k in ("w", "b", "gamma", "beta", "mean", "var") else v
                      for k, v in layer.items()})

    def forward(batch: pd.Series) -> pd.Series:
        if len(batch) == 0:
            return pd.Series([], dtype="float64")
        z = np.vstack(batch.to_numpy()).astype("float64")
        for m in model:
            if "w" in m:
                z = z @ m["w"]
                if "b" in m:
                    z = z + m["b"]
            act = m.get("activation")
            if act == "relu":
                z = np.maximum(z, 0.0)
            elif act == "leaky_relu":
                z = np.where(z > 0, z, 0.01 * z)
            elif act == "sigmoid":
                z = 1.0 / (1.0 + np.exp(-np.clip(z, -500.0, 500.0)))
            if "mean" in m:
                z = m["gamma"] * (z - m["mean"]) / np.sqrt(m["var"] + m.get("eps", 1e-5)) + m["beta"]
        return pd.Series(z[:, -1])

    score = F.pandas_udf(forward, "double")
    return df.withColumn(name, score(as_doubles(F.col(vec))))
