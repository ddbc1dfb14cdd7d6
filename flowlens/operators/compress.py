"""8-bit quantisation and pruning of weight tables (group, ..., w)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.ordered import value_at_rank
from ..plans.ranking import number_rows
from ..plans.small import attach, keyed_join, settle

QMIN, QMAX = -128, 127


def affine_params(df: DataFrame, keys: Sequence[str], w: str) -> DataFrame:
    """Scale and zero point per group; the range always includes 0."""
    agg = df.groupBy(*keys).agg(F.min(w).alias("_lo"), F.max(w).alias("_hi"))
    lo, hi = F.least(F.col("_lo"), F.lit(0.0)), F.greatest(F.col("_hi"), F.lit(0.0))
    width = (hi - lo) / F.lit(float(QMAX - QMIN))
    out = agg.withColumn("scale", F.when(width == 0, F.lit(1e-8)).otherwise(width))
    zero = F.lit(QMIN) - F.rint(F.try_divide(lo, F.col("scale")))
    return out.select(*keys, "scale", F.greatest(F.lit(QMIN), F.least(F.lit(QMAX), zero)).cast("int").alias("zero_point"))


def symmetric_params(df: DataFrame, keys: Sequence[str], w: str, all_zero_scale: float = 1.0) -> DataFrame:
    """Scale max|w| / 127 per group, zero point 0. ``all_zero_scale`` is 1 or 1/127."""
    agg = df.groupBy(*keys).agg(F.max(F.abs(F.col(w))).alias("_m"))
    scale = F.when(F.col("_m") == 0, F.lit(float(all_zero_scale))).otherwise(F.col("_m") / 127.0)
    return agg.select(*keys, scale.alias("scale"), F.lit(0).alias("zero_point"))


def to_int8(v: Column, scale: Column, zero: Column) -> Column:
    """clamp(round-half-even(v / scale) + zero)."""
    q = F.rint(v / scale) + zero
    return F.greatest(F.lit(float(QMIN)), F.least(F.lit(float(QMAX)), q)).cast("tinyint")


def saturating_int8(v: Column) -> Column:
    """Plain cast: truncate towards zero, saturate."""
    return F.greatest(F.lit(float(QMIN)), F.least(F.lit(float(QMAX)), F.signum(v) * F.floor(F.abs(v)))).cast("tinyint")


def quantize(df: DataFrame, params: DataFrame, keys: Sequence[str], w: str, name: str = "q") -> DataFrame:
    out = attach(df, params, list(keys), "inner")
    return out.withColumn(name, to_int8(F.col(w), F.col("scale"), F.col("zero_point")))


def dequantize(df: DataFrame, q: str = "q", name: str = "w_hat") -> DataFrame:
    return df.withColumn(name, F.col("scale") * (F.col(q).cast("double") - F.col("zero_point")))


def quantization_error(df: DataFrame, keys: Sequence[str], w: str, w_hat: str = "w_hat") -> DataFrame:
    e = F.col(w) - F.col(w_hat)
    return df.groupBy(*keys).agg(F.max(F.abs(e)).alias("max_abs_error"), F.sqrt(F.avg(e * e)).alias("rmse"),
                                 F.count(F.lit(1)).alias("n"))


def calibrate(sample: DataFrame, keys: Sequence[str], w: str, scheme: str = "symmetric") -> DataFrame:
    """Range and count per group of a calibration sample, with the resulting scale."""
    ranges = sample.groupBy(*keys).agg(F.min(w).alias("lo"), F.max(w).alias("hi"), F.count(w).alias("n"))
    fit = symmetric_params if scheme == "symmetric" else affine_params
    return keyed_join(ranges, fit(sample, keys, w), list(keys))


def prune(df: DataFrame, keys: Sequence[str], w: str, sparsity: float, inclusive: bool = True,
          name: str = "pruned") -> DataFrame:
    """Zero weights of small magnitude; one cut per group, or one global cut without keys.

    The cut is the magnitude at index floor(n*sparsity) of the ascending order.
    ``inclusive`` also zeroes weights equal to it.
    """
    keys = list(keys)
    cuts = value_at_rank(df.select(*keys, w), keys, F.abs(F.col(w)),
                         lambda n: F.least(F.floor(n * F.lit(float(sparsity))), n - 1))
    if keys:
        out = attach(df, cuts.select(*keys, F.col("value").alias("_cut")), keys, "left")
        cut = F.col("_cut")
    else:
        row = cuts.select("value").first()
        out, cut = df, F.lit(None if row is None else row["value"]).cast("double")
    small = F.abs(F.col(w)) <= cut if inclusive else F.abs(F.col(w)) < cut
    out = out.withColumn(name, F.when(small, 0.0).otherwise(F.col(w)))
    return out.drop("_cut")


def sparsity(df: DataFrame, keys: Sequence[str], w: str) -> DataFrame:
    """Share of exact zeros."""
    zeros = F.sum(F.when(F.col(w) == 0, 1).otherwise(0))
    return df.groupBy(*keys).agg((zeros.cast("double") / F.count(F.lit(1))).alias("sparsity"), F.count(F.lit(1)).alias("n"))


def prune_dims(df: DataFrame, dim: str, w: str, share: float) -> DataFrame:
    """Drop floor(units*share) units of smallest L2 norm (ties by index) and renumber the rest.

    Returns (dim, new_dim, norm) of the survivors; apply it to the next table's
    inputs with ``apply_dims``.
    """
    norms, small = settle(df.groupBy(dim).agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias("norm")))
    n = norms.count()
    gone = math.floor(n * float(share))
    if small:  # the number of units was checked
        by_norm, by_dim = Window.orderBy("norm", dim), Window.orderBy(dim)
        kept = norms.withColumn("_r", F.row_number().over(by_norm)).filter(F.col("_r") > gone)
        return kept.select(dim, (F.row_number().over(by_dim) - 1).alias("new_dim"), "norm")
    if not gone:
        kept = norms
    else:  # the norm of the last unit that goes; units of that norm go by index
        cut = value_at_rank(norms, [], F.col("norm"), lambda _: F.lit(gone - 1)).first()["value"]
        below = norms.filter(F.col("norm") < cut).count()
        last = value_at_rank(norms.filter(F.col("norm") == cut), [], F.col(dim), lambda _: F.lit(gone - below - 1)).first()["value"]
        kept = norms.filter((F.col("norm") > cut) | ((F.col("norm") == cut) & (F.col(dim) > last)))
    return number_rows(kept.orderBy(dim), "_no").select(dim, (F.col("_no") - 1).cast("int").alias("new_dim"), "norm")


def apply_dims(df: DataFrame, kept: DataFrame, dim: str) -> DataFrame:
    """Keep the surviving units of a table and give them their new numbers."""
    return attach(df, kept.select(dim, "new_dim"), [dim], "inner").drop(dim).withColumnRenamed("new_dim", dim)


def size_report(df: DataFrame, layer: str) -> DataFrame:
    """Bytes as float32 and as 8-bit plus 8 bytes of parameters per layer; total row last."""
    per = df.groupBy(layer).agg(F.count(F.lit(1)).alias("n"))
    sizes = per.select(layer, (F.col("n") * 4).alias("bytes_f32"), (F.col("n") + 8).alias("bytes_int8"))
    out = sizes.rollup(layer).agg(F.sum("bytes_f32").alias("bytes_f32"), F.sum("bytes_int8").alias("bytes_int8"),
                                  F.grouping(layer).cast("int").alias("is_total"))
    return out.withColumn("ratio", F.col("bytes_f32").cast("double") / F.greatest(F.col("bytes_int8"), F.lit(1)))
