"""Cleaning, statistics and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import clean as C, scale as S
from . import views as V
from .registry import query, r

COLS = V.INPUTS


def _qc(c: str, p: float) -> str:
    return f"quantile_cont({c}, {p})"


@query("parse_double", "SELECT row_key, f0, f1, f2, f3 FROM dnum", ("dnum",))
def parse_double(spark, sf):
    return V.dnum(spark, sf).select("row_key", *COLS)


_PCTS = [1.0, 25.0, 50.0, 75.0, 99.0]


@query("column_percentiles", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {p}::DOUBLE AS pct, {r(_qc(c, p / 100))} AS value FROM dnum" for c in COLS for p in _PCTS),
    ("dnum",))
def column_percentiles(spark, sf):
    return C.percentile_table(V.dnum(spark, sf), COLS, _PCTS)


_MED = "m AS (SELECT " + ", ".join(f"{_qc(c, 0.5)} AS m_{c}" for c in COLS) + " FROM dnum)"
_IMPUTED = "i AS (SELECT row_key, y, " + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in COLS) + " FROM dnum, m)"


@query("impute_median", f"{_MED}, {_IMPUTED} SELECT row_key, f0, f1, f2, f3 FROM i", ("dnum",))
def impute_median(spark, sf):
    df = V.dnum(spark, sf)
    return C.impute(df, C.fit_medians(df, COLS)).select("row_key", *COLS)


@query("drop_all_null", "SELECT row_key, f0, f1, f2, f3, y FROM dnum WHERE coalesce(f0, f1, f2, f3) IS NOT NULL", ("dnum",))
def drop_all_null(spark, sf):
    return C.drop_all_missing(V.dnum(spark, sf), COLS).select("row_key", *COLS, "y")


def _clip_sql(source: str) -> str:
    bounds = "b AS (SELECT " + ", ".join(
        f"{_qc(c, 0.01)} AS l_{c}, {_qc(c, 0.99)} AS h_{c}" for c in COLS) + f" FROM {source})"
    cols = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {r(f'greatest(l_{c}, least(h_{c}, {c}))')} END AS {c}" for c in COLS)
    return f"{bounds} SELECT row_key, y, {cols} FROM {source}, b"


@query("clip_outliers", _clip_sql("dnum"), ("dnum",))
def clip_outliers(spark, sf):
    df = V.dnum(spark, sf)
    return C.clip(df, C.fit_clip(df, COLS)).select("row_key", "y", *COLS)


@query("clean_chain", f"{_MED}, {_IMPUTED}, {_clip_sql('i')}", ("dnum",))
def clean_chain(spark, sf):
    return C.clean_chain(V.dnum(spark, sf).select("row_key", "y", *COLS), COLS)


@query("nan_to_num", "SELECT row_key, " + ", ".join(f"coalesce({c}, 0.0::DOUBLE) AS {c}" for c in COLS) + " FROM dnum",
       ("dnum",))
def nan_to_num(spark, sf):
    df = V.dirty(spark, sf).select("row_key", *[X.to_double(F.col(c)).alias(c) for c in COLS])
    return df.select("row_key", *[X.nan_to_num(F.col(c)).alias(c) for c in COLS])


@query("column_median_iqr", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(_qc(c, 0.5))} AS center, "
    f"{r(f'greatest({_qc(c, 0.75)} - {_qc(c, 0.25)}, 1e-8)', 9)} AS spread FROM dnum" for c in COLS), ("dnum",), digits=9)
def column_median_iqr(spark, sf):
    return S.params_table(spark, C.median_iqr(V.dnum(spark, sf), COLS))


@query("safe_math", f"""
    SELECT event_id, {r('CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value / (event_id % 5) END')} AS ratio,
    {r('ln(greatest(value - 1, 1e-9))')} AS log_clamped, {r('ln(value + 1e-9)')} AS log_shifted FROM ev""", ("ev",))
def safe_math(spark, sf):
    return V.ev(spark, sf).select(
        "event_id", X.safe_div(F.col("value"), F.col("event_id") % 5).alias("ratio"),
        X.log_clamped(F.col("value") - 1).alias("log_clamped"), X.log_shifted(F.col("value")).alias("log_shifted"))


# --- scaling -----------------------------------------------------------------------

FEATS = V.FEATURES


def _fit_sql(c: str) -> str:
    return f"{_qc(c, 0.5)} AS m_{c}, greatest({_qc(c, 0.75)} - {_qc(c, 0.25)}, 1e-8) AS s_{c}"


_ROBUST = "p AS (SELECT " + ", ".join(_fit_sql(c) for c in FEATS) + " FROM flows)"


@query("robust_fit", _ROBUST + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'm_{c}', 9)} AS center, {r(f's_{c}', 9)} AS spread FROM p" for c in FEATS), ("flows",), digits=9)
def robust_fit(spark, sf):
    return S.params_table(spark, S.robust_fit(V.flows(spark, sf), FEATS))


@query("robust_transform", _ROBUST + " SELECT row_key, " + ", ".join(
    f"{r(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in FEATS) + " FROM flows, p", ("flows",))
def robust_transform(spark, sf):
    df = V.flows(spark, sf)
    return S.transform(df, S.robust_fit(df, FEATS)).select("row_key", *FEATS)


_STD = "p AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, greatest(stddev_pop({c}), 1e-8) AS s_{c}" for c in FEATS) + " FROM flows)"


@query("standard_fit", _STD + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'm_{c}', 5)} AS center, {r(f's_{c}', 5)} AS spread FROM p" for c in FEATS), ("flows",), digits=5)
def standard_fit(spark, sf):
    return S.params_table(spark, S.standard_fit(V.flows(spark, sf), FEATS))


@query("standard_transform", _STD + " SELECT row_key, " + ", ".join(
    f"{r(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in FEATS) + " FROM flows, p", ("flows",))
def standard_transform(spark, sf):
    df = V.flows(spark, sf)
    return S.transform(df, S.standard_fit(df, FEATS)).select("row_key", *FEATS)


_SERVE = "p AS (SELECT " + ", ".join(
    f"{_qc(c, 0.5)} AS m_{c}, {_qc(c, 0.75)} - {_qc(c, 0.25)} AS s_{c}" for c in FEATS) + " FROM flows)"


@query("serve_scale", _SERVE + " SELECT row_key, " + ", ".join(
    f"{r(f'CASE WHEN s_{c} <> 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0::DOUBLE END')} AS {c}" for c in FEATS)
    + " FROM flows, p", ("flows",))
def serve_scale(spark, sf):
    df = V.flows(spark, sf)
    fitted = S.robust_fit(df, FEATS)
    # The serving table carries the unfloored range: a floored one is a constant column.
    served = {c: (m, 0.0 if s <= C.IQR_FLOOR else s) for c, (m, s) in fitted.items()}
    return S.serve_transform(df, served).select("row_key", *FEATS)
