"""Feature scaling with explicit fit tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .clean import IQR_FLOOR, median_iqr


def robust_fit(df: DataFrame, cols: Sequence[str], exact: bool = True) -> dict[str, tuple[float, float]]:
    """Median and floored interquartile range; an empty column has median 0 and the floor."""
    return median_iqr(df, cols, empty_iqr=IQR_FLOOR, exact=exact)


def standard_fit(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (floored); fewer than two values count as variance 1."""
    aggs = []
    for c in cols:
        v = F.when(~F.isnan(F.col(c)), F.col(c))
        aggs += [F.avg(v).alias(f"m_{c}"), F.stddev_pop(v).alias(f"s_{c}"), F.count(v).alias(f"n_{c}")]
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        n = row[f"n_{c}"]
        dev = row[f"s_{c}"] if n > 1 else 1.0
        out[c] = (float(row[f"m_{c}"]) if n else 0.0, max(float(dev), 1e-8))
    return out


def transform(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - centre) / spread, as a projection."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


def serve_transform(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Serving rule: a column whose spread is zero scales to 0."""
    return df.withColumns({
        c: ((F.col(c) - F.lit(m)) / F.lit(s)) if s != 0.0 else F.lit(0.0) for c, (m, s) in params.items()})


def params_table(spark, params: Mapping[str, tuple[float, float]], threshold: float | None = None) -> DataFrame:
    """One row per column, for writing; a decision threshold is the row without a feature."""
    rows = [(c, float(m), float(s)) for c, (m, s) in params.items()]
    if threshold is not None:
        rows.append((None, float(threshold), None))
    return spark.createDataFrame(rows, "feature string, center double, spread double")


def params_from_table(table: DataFrame) -> dict[str, tuple[float, float]]:
    """Reload fitted parameters; the table has one row per feature column."""
    return {r["feature"]: (r["center"], r["spread"]) for r in table.filter("feature IS NOT NULL").collect()}


def threshold_from_table(table: DataFrame, default: float = 0.5) -> float:
    row = table.filter("feature IS NULL").first()
    return default if row is None else row["center"]

