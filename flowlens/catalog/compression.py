"""Quantisation and pruning queries on the embedding table as weights (layer = label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compress as Q, sample as S
from . import views as V
from .registry import query, r

KEYS = ["label"]
_AFF = """a AS (SELECT label, least(min(v), 0.0::DOUBLE) AS lo, greatest(max(v), 0.0::DOUBLE) AS hi FROM vlong GROUP BY label),
    b AS (SELECT label, lo, CASE WHEN hi - lo = 0 THEN 1e-8::DOUBLE ELSE (hi - lo) / 255.0::DOUBLE END AS scale FROM a),
    af AS (SELECT label, scale, greatest(-128, least(127, -128 - round_even(lo / scale, 0)))::INT AS zero_point FROM b)"""
_SYM = """sy AS (SELECT label, CASE WHEN max(abs(v)) = 0 THEN 1.0::DOUBLE ELSE max(abs(v)) / 127.0::DOUBLE END AS scale, 0 AS zero_point
    FROM vlong GROUP BY label)"""


@query("quant_params_affine", f"{_AFF} SELECT label, {r('scale', 9)} AS scale, zero_point FROM af", ("vlong",), digits=9)
def quant_params_affine(spark, sf):
    return Q.affine_params(V.vlong(spark, sf), KEYS, "v")


@query("quant_params_symmetric", f"{_SYM} SELECT label, {r('scale', 9)} AS scale, zero_point FROM sy", ("vlong",), digits=9)
def quant_params_symmetric(spark, sf):
    return Q.symmetric_params(V.vlong(spark, sf), KEYS, "v")


def _q(p: str) -> str:
    return f"greatest(-128, least(127, round_even(v / {p}.scale, 0) + {p}.zero_point))"


@query("quantize", f"""{_AFF}, {_SYM}
    SELECT vec_id, dim, ({_q('sy')})::TINYINT AS q_sym, ({_q('af')})::TINYINT AS q_aff,
    greatest(-128, least(127, trunc(v * 1000)))::TINYINT AS q_cast
    FROM vlong w JOIN sy ON w.label = sy.label JOIN af ON w.label = af.label""", ("vlong",))
def quantize(spark, sf):
    w = V.vlong(spark, sf)
    sym = Q.quantize(w, Q.symmetric_params(w, KEYS, "v"), KEYS, "v", "q_sym").drop("scale", "zero_point")
    both = Q.quantize(sym, Q.affine_params(w, KEYS, "v"), KEYS, "v", "q_aff")
    return both.select("vec_id", "dim", "q_sym", "q_aff", Q.saturating_int8(F.col("v") * 1000).alias("q_cast"))


@query("dequantize", f"""{_SYM}
    SELECT vec_id, dim, {r(f'sy.scale * ({_q("sy")} - sy.zero_point)')} AS w_hat FROM vlong w JOIN sy ON w.label = sy.label""", ("vlong",))
def dequantize(spark, sf):
    w = V.vlong(spark, sf)
    return Q.dequantize(Q.quantize(w, Q.symmetric_params(w, KEYS, "v"), KEYS, "v")).select("vec_id", "dim", "w_hat")


@query("quant_error", f"""{_AFF},
    e AS (SELECT w.label, v - af.scale * ({_q('af')} - af.zero_point) AS e FROM vlong w JOIN af ON w.label = af.label)
    SELECT label, {r('max(abs(e))')} AS max_abs_error, {r('sqrt(avg(e * e))')} AS rmse, count(*) AS n FROM e GROUP BY label""", ("vlong",))
def quant_error(spark, sf):
    w = V.vlong(spark, sf)
    return Q.quantization_error(Q.dequantize(Q.quantize(w, Q.affine_params(w, KEYS, "v"), KEYS, "v")), KEYS, "v")


@query("calibrate_ranges", f"""
    k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', vec_id::VARCHAR)), vec_id) AS rk,
      count(*) OVER (PARTITION BY label) AS m FROM embeddings),
    s AS (SELECT w.* FROM vlong w JOIN k ON w.vec_id = k.vec_id AND k.rk <= greatest(1, floor(k.m * 0.2::DOUBLE)))
    SELECT label, {r('min(v)')} AS lo, {r('max(v)')} AS hi, count(*) AS n, {r('max(abs(v)) / 127.0::DOUBLE')} AS scale, 0 AS zero_point
    FROM s GROUP BY label""", ("vlong",))
def calibrate_ranges(spark, sf):
    sample = S.stratified_sample(V.vec(spark, sf), KEYS, ["vec_id"], 0.2)
    long = sample.selectExpr("label", "explode(cast(embedding as array<double>)) as v")
    return Q.calibrate(long, KEYS, "v")


def _prune_sql(part: str, op: str) -> str:
    over = f"PARTITION BY {part} " if part else ""
    group = f"GROUP BY {part}" if part else ""
    sel = f"{part}," if part else ""
    join = f"JOIN ct ON w.{part} = ct.{part}" if part else ", ct"
    return f"""
    k AS (SELECT {sel} abs(v) AS m, row_number() OVER ({over}ORDER BY abs(v)) - 1 AS i, count(*) OVER ({over.strip()}) AS n FROM vlong),
    ct AS (SELECT {sel} min(m) AS cut FROM k WHERE i = least(floor(n * 0.4::DOUBLE), n - 1) {group})
    SELECT w.vec_id, w.dim, {r(f'CASE WHEN abs(v) {op} ct.cut THEN 0.0::DOUBLE ELSE v END')} AS pruned FROM vlong w {join}"""


@query("prune_global", _prune_sql("", "<="), ("vlong",))
def prune_global(spark, sf):
    return Q.prune(V.vlong(spark, sf), [], "v", 0.4).select("vec_id", "dim", "pruned")


@query("prune_layerwise", _prune_sql("label", "<"), ("vlong",))
def prune_layerwise(spark, sf):
    return Q.prune(V.vlong(spark, sf), KEYS, "v", 0.4, inclusive=False).select("vec_id", "dim", "pruned")


@query("sparsity", f"""
    z AS (SELECT label, CASE WHEN abs(v) < 0.05 THEN 0.0 ELSE v END AS w FROM vlong)
    SELECT label, {r('avg((w = 0)::INT)')} AS sparsity, count(*) AS n FROM z GROUP BY label""", ("vlong",))
def sparsity(spark, sf):
    w = V.vlong(spark, sf).withColumn("w", F.when(F.abs("v") < 0.05, 0.0).otherwise(F.col("v")))
    return Q.sparsity(w, KEYS, "w")


_NORM = """nm AS (SELECT dim, sqrt(sum(v * v)) AS norm FROM vlong GROUP BY dim),
    rk AS (SELECT *, row_number() OVER (ORDER BY norm, dim) AS k, count(*) OVER () AS n FROM nm),
    kp AS (SELECT dim, norm, row_number() OVER (ORDER BY dim) - 1 AS new_dim FROM rk WHERE k > floor(n * 0.25::DOUBLE))"""


@query("prune_dims", f"{_NORM} SELECT dim, new_dim::INT AS new_dim, {r('norm')} AS norm FROM kp", ("vlong",))
def prune_dims(spark, sf):
    return Q.prune_dims(V.vlong(spark, sf), "dim", "v", 0.25)


@query("prune_dims_apply", f"""{_NORM}
    SELECT w.vec_id, kp.new_dim::INT AS dim, {r('w.v')} AS v FROM vlong w JOIN kp ON w.dim = kp.dim""", ("vlong",))
def prune_dims_apply(spark, sf):
    w = V.vlong(spark, sf)
    return Q.apply_dims(w, Q.prune_dims(w, "dim", "v", 0.25), "dim").select("vec_id", "dim", "v")


@query("size_report", f"""
    p AS (SELECT label, count(*) * 4 AS bytes_f32, count(*) + 8 AS bytes_int8 FROM vlong GROUP BY label)
    SELECT label, sum(bytes_f32)::BIGINT AS bytes_f32, sum(bytes_int8)::BIGINT AS bytes_int8, grouping(label)::INT AS is_total,
    {r('sum(bytes_f32)::DOUBLE / sum(bytes_int8)::DOUBLE')} AS ratio FROM p GROUP BY ROLLUP (label)""", ("vlong",))
def size_report(spark, sf):
    return Q.size_report(V.vlong(spark, sf), "label")
