"""Projection and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import labels as L
from . import views as V
from .registry import query, r


@query("project_features", "SELECT f0, f1, f2, f3, f4, y AS label FROM flows", ("flows",))
def project_features(spark, sf):
    raw = V.flows(spark, sf).selectExpr("l_orderkey as `Flow ID`", "l_partkey as Source_IP", "l_suppkey as Source_Port",
                                        "f0", "f1", "f2", "f3", "f4", "y as ` Label `")
    return L.project_features(raw).withColumnRenamed("Label", "label")


_NUM = ("CASE WHEN regexp_matches(trim({c}), '" + X.NUMBER + "') OR regexp_matches(lower(trim({c})), '" + X.SPECIAL
        + "') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")


def _infer_sql(n: int, share: float) -> str:
    cols = [*V.INPUTS, "label"]
    return (f"h AS (SELECT * FROM dirty ORDER BY {', '.join(V.ORDER)} LIMIT {n}) "
            + " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, {r('avg(' + _NUM.format(c=c) + ')')} AS numeric_share, "
                f"CASE WHEN avg({_NUM.format(c=c)}) >= {share} THEN 1 ELSE 0 END AS is_numeric FROM h" for c in cols))


@query("infer_numeric", _infer_sql(200, 0.8), ("dirty",))
def infer_numeric(spark, sf):
    return L.numeric_columns(V.dirty(spark, sf), V.ORDER, [*V.INPUTS, "label"], 200, 0.8)


@query("feature_pick_strict", _infer_sql(100, 1.0), ("dirty",))
def feature_pick_strict(spark, sf):
    return L.numeric_columns(V.dirty(spark, sf), V.ORDER, [*V.INPUTS, "label"], 100, 1.0)


# Labels as text in the several spellings the rules must handle.
_LABEL_TEXT = ("case when l_linenumber = 1 then '0.0' when l_linenumber = 2 then ' 1 ' when l_linenumber = 3 then '0' "
               "when l_linenumber = 4 then 'Benign' when l_linenumber = 5 then '3' else label end")
_TO_NUM = (f"CASE WHEN regexp_matches(trim(t), '{X.NUMBER}') THEN try_cast(trim(t) AS DOUBLE) END")


@query("binary_label", f"""
    a AS (SELECT row_key, {_LABEL_TEXT} AS t FROM dirty), b AS (SELECT *, {_TO_NUM} AS v FROM a)
    SELECT row_key, t AS label_text, CASE WHEN v = 0 THEN 0 WHEN v IS NOT NULL THEN 1 WHEN trim(t) = 'BENIGN' THEN 0
    ELSE 1 END AS y FROM b""", ("dirty",))
def binary_label(spark, sf):
    df = V.dirty(spark, sf).withColumn("label_text", F.expr(_LABEL_TEXT))
    return df.select("row_key", "label_text", X.binary_label(F.col("label_text")).alias("y"))


@query("binary_label_passthrough", f"""
    a AS (SELECT row_key, {_LABEL_TEXT} AS t FROM dirty)
    SELECT row_key, t AS label_text, CASE WHEN regexp_matches(trim(t), '^[+-]?[0-9]+$') THEN try_cast(trim(t) AS INT)
    WHEN t IN ('BENIGN', 'Benign', 'benign') THEN 0 ELSE 1 END AS y FROM a""", ("dirty",))
def binary_label_passthrough(spark, sf):
    df = V.dirty(spark, sf).withColumn("label_text", F.expr(_LABEL_TEXT))
    return df.select("row_key", "label_text", X.passthrough_label(F.col("label_text")).alias("y"))


@query("label_encode", """
    c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM ev))
    SELECT event_id, ev.event_type, c.code::INT AS code FROM ev JOIN c ON ev.event_type = c.event_type""", ("ev",))
def label_encode(spark, sf):
    return L.encode_labels(V.ev(spark, sf).select("event_id", "event_type"), "event_type").select(
        "event_id", "event_type", "code")


@query("label_decode", """
    c AS (SELECT label, row_number() OVER (ORDER BY label::VARCHAR) - 1 AS code FROM (SELECT DISTINCT label FROM multi))
    SELECT m.vec_id, m.predicted AS code, c.label FROM multi m LEFT JOIN c ON m.predicted = c.code""", ("multi",))
def label_decode(spark, sf):
    df = V.multi(spark, sf)
    classes = L.label_classes(df, "label")
    coded = df.select("vec_id", F.col("predicted").alias("code"))
    return L.decode_labels(coded, classes, "code").select("vec_id", "code", "label")


@query("class_distribution", f"""
    SELECT event_type, count(*) AS n, {r('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct FROM ev GROUP BY event_type""",
       ("ev",))
def class_distribution(spark, sf):
    return L.class_distribution(V.ev(spark, sf), "event_type")


@query("clean_summary", f"""
    SELECT count(*) AS n_rows, 5 AS n_features, count(*) FILTER (y = 0) AS benign, count(*) FILTER (y = 1) AS attack,
    {r('count(*) FILTER (y = 0) * 100.0 / count(*)')} AS benign_pct, {r('count(*) FILTER (y = 1) * 100.0 / count(*)')} AS attack_pct
    FROM flows""", ("flows",))
def clean_summary(spark, sf):
    return L.clean_summary(V.flows(spark, sf), F.col("y"), len(V.FEATURES))


@query("label_values", "SELECT DISTINCT trim(label) AS label_value FROM dirty ORDER BY 1 LIMIT 10", ("dirty",))
def label_values(spark, sf):
    return L.label_values(V.dirty(spark, sf), "label")
