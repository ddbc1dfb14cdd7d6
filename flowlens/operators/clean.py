"""Missing-value repair, outlier clipping and column statistics.

Fitting returns numbers on the driver (a few per column); applying is a map-only
projection with those numbers as literals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import expr as X
from ..plans.ordered import (DIRECT_CELLS, approximate_quantiles, exact_quantiles, interpolate, neighbours,
                             order_statistics)
from ..plans.small import materialise

IQR_FLOOR = 1e-8


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], exact: bool = True):
    """Quantiles of the finite values; ``exact=False`` takes one sketch pass."""
    seen = df.select(*[X.finite(F.col(c)).alias(c) for c in cols])
    return exact_quantiles(seen, cols, probs) if exact else approximate_quantiles(seen, cols, probs)


def percentile_table(df: DataFrame, cols: Sequence[str], percents: Sequence[float]) -> DataFrame:
    """(feature, pct, value) rows; an empty column gives 0."""
    q = quantiles(df, cols, [p / 100.0 for p in percents])
    rows = [(c, float(p), 0.0 if v is None else float(v)) for c in cols for p, v in zip(percents, q[c])]
    return df.sparkSession.createDataFrame(rows, "feature string, pct double, value double")


def fit_medians(df: DataFrame, cols: Sequence[str], exact: bool = True) -> dict[str, float]:
    q = quantiles(df, cols, [0.5], exact)
    return {c: 0.0 if q[c][0] is None else float(q[c][0]) for c in cols}


def impute(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """Missing, NaN and infinite cells take the column's number."""
    return df.withColumns({c: X.nan_to_num(F.col(c), m) for c, m in medians.items()})


def drop_all_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with at least one finite feature."""
    # Each column is named once: a filter is pushed below the projections that made it.
    return df.filter(F.coalesce(*[F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols]).isNotNull())


def fit_clip(df: DataFrame, cols: Sequence[str], low: float = 1.0, high: float = 99.0,
             exact: bool = True) -> dict[str, tuple[float, float]]:
    q = quantiles(df, cols, [low / 100.0, high / 100.0], exact)
    return {c: (0.0, 1.0) if q[c][0] is None else (float(q[c][0]), float(q[c][1])) for c in cols}


def clip(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: X.clip(F.col(c), lo, hi) for c, (lo, hi) in bounds.items()})


def fit_chain(df: DataFrame, cols: Sequence[str], low: float = 1.0, high: float = 99.0, exact: bool = True,
              direct_cells: int = DIRECT_CELLS) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """Medians, and the clip bounds of the table after imputing them.

    On a large table both come from one search: imputing puts k copies of the
    median in the middle of a column's order, which shifts later ranks by k.
    """
    rows = df.count()
    if not exact or rows * len(cols) <= direct_cells:
        medians = fit_medians(df, cols, exact)
        return medians, fit_clip(impute(df, medians), cols, low, high, exact)
    seen = df.select(*[X.finite(F.col(c)).alias(c) for c in cols])
    tails = [low / 100.0, high / 100.0]

    def shifted(rank: int, n: int) -> int | None:
        """Rank in the finite values, or None for a copy of the median."""
        middle = neighbours(0.5, n)[1]
        missing = rows - n
        return rank if rank <= middle else None if rank <= middle + missing else rank - missing

    def ranks(_: str, n: int) -> set[int]:
        if n == 0:
            return set()
        tail = {shifted(k, n) for p in tails for k in neighbours(p, rows)[1:]}
        return set(neighbours(0.5, n)[1:]) | {k for k in tail if k is not None}

    found = order_statistics(seen, cols, ranks)
    medians, bounds = {}, {}
    for c in cols:
        n, at = found[c]
        medians[c] = interpolate(*neighbours(0.5, n), at) if n else 0.0
        ends = []
        for p in tails:
            pos, lo, hi = neighbours(p, rows)
            pair = {k: medians[c] if n == 0 or shifted(k, n) is None else at[shifted(k, n)] for k in (lo, hi)}
            ends.append(interpolate(pos, lo, hi, pair))
        bounds[c] = (ends[0], ends[1])
    return medians, bounds


def clean_chain(df: DataFrame, cols: Sequence[str], low: float = 1.0, high: float = 99.0,
                fit_on: DataFrame | None = None, exact: bool = True, staged: bool = True) -> DataFrame:
    """Impute, drop empty rows, clip; in that order.

    Clip bounds come from all rows unless ``fit_on`` (say, the training rows) is
    given. Fitting reads its input several times, so the input is written to the
    shared folder first unless it is a stored table already (``staged=False``).
    """
    if staged:
        df = materialise(df, "clean")
    # No imputed cell is missing, so the drop step cannot remove a row here; running
    # it would only re-evaluate the input expressions in a pushed-down filter.
    medians, bounds = fit_chain(df if fit_on is None else fit_on, cols, low, high, exact)
    return clip(impute(df, medians), bounds)


def median_iqr(df: DataFrame, cols: Sequence[str], empty_iqr: float = 1.0,
               exact: bool = True) -> dict[str, tuple[float, float]]:
    """Median and interquartile range per column, range floored at 1e-8."""
    q = quantiles(df, cols, [0.25, 0.5, 0.75], exact)
    out = {}
    for c in cols:
        lo, med, hi = q[c]
        out[c] = (0.0, empty_iqr) if med is None else (float(med), max(float(hi) - float(lo), IQR_FLOOR))
    return out
