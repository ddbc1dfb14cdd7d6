"""Array, matrix and activation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import vectors as W
from ..plans.small import fetch_small
from . import views as V
from .registry import query, r


def _long(df, key: str, *names: str):
    """Several array columns of equal length as one row per position."""
    return (df.select(key, F.posexplode(F.arrays_zip(*names)).alias("dim", "z"))
            .select(key, "dim", *[F.col(f"z.{n}").alias(n) for n in names]))


_PAIR = "pr AS (SELECT a.vec_id, a.dim, a.v, b.v AS w FROM vlong a JOIN vlong b ON a.vec_id = b.vec_id AND b.dim = 63 - a.dim)"


@query("vec_elementwise", f"""{_PAIR}
    SELECT vec_id, dim, {r('v + w')} AS a, {r('v - w')} AS s, {r('v * w')} AS m, {r('CASE WHEN w = 0 THEN 0 ELSE v / w END', 4)} AS d,
    {r('v * 2.5::DOUBLE')} AS k FROM pr""", ("vlong",))
def vec_elementwise(spark, sf):
    a = W.as_doubles(F.col("embedding"))
    b = F.reverse(a)
    df = V.vec(spark, sf).select(
        "vec_id", W.elementwise(a, b, "add").alias("a"), W.elementwise(a, b, "sub").alias("s"),
        W.elementwise(a, b, "mul").alias("m"), W.elementwise(a, b, "div").alias("d"), W.elementwise(a, 2.5, "mul").alias("k"))
    return _long(df, "vec_id", "a", "s", "m", "d", "k").withColumn("d", F.round("d", 4))


@query("vec_unary", f"""
    SELECT vec_id, dim, {r('greatest(-0.1, least(0.1, v))')} AS c, abs(v) AS a, {r('ln(abs(v) + 1e-9)')} AS l, {r('exp(v)')} AS e FROM vlong"""
       .replace("abs(v) AS a", r("abs(v)") + " AS a"), ("vlong",))
def vec_unary(spark, sf):
    a = W.as_doubles(F.col("embedding"))
    mag = W.unary(a, "abs")
    df = V.vec(spark, sf).select("vec_id", W.unary(a, "clip", -0.1, 0.1).alias("c"), mag.alias("a"),
                                 W.unary(mag, "log").alias("l"), W.unary(a, "exp").alias("e"))
    return _long(df, "vec_id", "c", "a", "l", "e")


@query("vec_reduce_row", f"""
    SELECT vec_id, {r('sum(v)')} AS v_sum, {r('max(v)')} AS v_max, arg_max(dim, v)::INT AS v_argmax, {r('avg(v)')} AS v_mean
    FROM vlong GROUP BY vec_id""", ("vlong",))
def vec_reduce_row(spark, sf):
    return W.reduce_rows(V.vec(spark, sf), "vec_id", "embedding")


@query("vec_reduce_col", f"""
    SELECT coalesce(dim, -1)::INT AS dim, {r('sum(v)')} AS v_sum, {r('max(v)')} AS v_max, {r('avg(v)')} AS v_mean,
    {r('stddev_pop(v)')} AS v_std, {r('var_pop(v)')} AS v_var FROM vlong GROUP BY ROLLUP (dim)""", ("vlong",))
def vec_reduce_col(spark, sf):
    return W.reduce_columns(V.vlong(spark, sf))


_CENTROID = "ct AS (SELECT label AS j, dim AS k, avg(v) AS w FROM vlong GROUP BY label, dim)"


def _centroids(spark, sf):
    """A weight matrix fitted from the vectors: the mean vector of each label."""
    return V.vlong(spark, sf).groupBy(F.col("label").alias("j"), F.col("dim").alias("k")).agg(F.avg("v").alias("w"))


@query("matmul", f"""{_CENTROID}
    SELECT a.vec_id AS i, ct.j, {r('sum(a.v * ct.w)')} AS v FROM vlong a JOIN ct ON a.dim = ct.k GROUP BY a.vec_id, ct.j""", ("vlong",))
def matmul(spark, sf):
    a = V.vlong(spark, sf).select(F.col("vec_id").alias("i"), F.col("dim").alias("k"), "v")
    return W.matmul(a, _centroids(spark, sf))


@query("transpose", f"SELECT dim AS row_id, vec_id AS col_id, {r('v')} AS v FROM vlong", ("vlong",))
def transpose(spark, sf):
    long = V.vlong(spark, sf).select(F.col("vec_id").alias("row_id"), F.col("dim").alias("col_id"), "v")
    return W.transpose(long, "row_id", "col_id")


@query("vec_slice_reshape", f"""
    h AS (SELECT vec_id, sum(v) FILTER (dim BETWEEN 8 AND 15) AS second, max(v) FILTER (dim = 5) AS fifth FROM vlong GROUP BY vec_id)
    SELECT a.vec_id, (dim // 8)::INT AS r, (dim % 8)::INT AS c, {r('v')} AS v, {r('second')} AS row_sum, {r('fifth')} AS item
    FROM vlong a JOIN h ON a.vec_id = h.vec_id""", ("vlong",))
def vec_slice_reshape(spark, sf):
    df = V.vec(spark, sf)
    a = W.as_doubles(F.col("embedding"))
    shaped = df.select("vec_id", W.row_sum(W.slice_row(a, 8, 8)).alias("row_sum"), F.element_at(a, 6).alias("item"),
                       F.posexplode(a).alias("dim", "v"))
    return shaped.select("vec_id", F.floor(F.col("dim") / 8).cast("int").alias("r"), (F.col("dim") % 8).alias("c"), "v",
                         "row_sum", "item")


_SIG = "1.0::DOUBLE / (1.0::DOUBLE + exp(-z))"


@query("activations", f"""
    a AS (SELECT event_id, 6 * s - 3 AS z FROM scored)
    SELECT event_id, {r('greatest(z, 0)')} AS relu, CASE WHEN z > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS relu_slope,
    {r('CASE WHEN z > 0 THEN z ELSE 0.01::DOUBLE * z END')} AS leaky, CASE WHEN z > 0 THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END AS leaky_slope,
    {r(_SIG)} AS sig, {r(f'({_SIG}) * (1.0::DOUBLE - {_SIG})')} AS sig_slope FROM a""", ("scored",))
def activations(spark, sf):
    z = 6 * F.col("s") - 3
    s = X.sigmoid(z)
    return V.scored(spark, sf).select(
        "event_id", X.relu(z).alias("relu"), X.relu_slope(z).alias("relu_slope"), X.leaky_relu(z).alias("leaky"),
        X.leaky_relu_slope(z).alias("leaky_slope"), s.alias("sig"), X.sigmoid_slope(s).alias("sig_slope"))


@query("softmax", f"""
    m AS (SELECT vec_id, max(v) AS mx FROM vlong GROUP BY vec_id),
    e AS (SELECT a.vec_id, dim, exp(v - mx) AS e FROM vlong a JOIN m ON a.vec_id = m.vec_id)
    SELECT vec_id, dim, {r('e / sum(e) OVER (PARTITION BY vec_id)')} AS p FROM e""", ("vlong",))
def softmax(spark, sf):
    df = V.vec(spark, sf).select("vec_id", X.softmax(W.as_doubles(F.col("embedding"))).alias("p"))
    return _long(df, "vec_id", "p")


@query("dense_score", f"""{_CENTROID},
    z AS (SELECT a.vec_id, ct.j, sum(a.v * ct.w) + ct.j * 0.01::DOUBLE AS z FROM vlong a JOIN ct ON a.dim = ct.k GROUP BY a.vec_id, ct.j),
    h AS (SELECT vec_id, j, (1.0::DOUBLE + j / 10.0::DOUBLE) * (greatest(z, 0) - j / 100.0::DOUBLE) / sqrt(1.0::DOUBLE + j + 1e-5::DOUBLE) + 0.1::DOUBLE AS h FROM z),
    o AS (SELECT vec_id, sum(h * (j + 1) / 10.0::DOUBLE) - 0.5::DOUBLE AS o FROM h GROUP BY vec_id)
    SELECT vec_id, {r('1.0::DOUBLE / (1.0::DOUBLE + exp(-o))')} AS score FROM o""", ("vlong",))
def dense_score(spark, sf):
    cells = fetch_small(_centroids(spark, sf), 50_000)  # units x inputs
    if cells is None:
        raise ValueError("layer too wide to ship with a task; use matmul")
    units, inputs = max(c["j"] for c in cells) + 1, max(c["k"] for c in cells) + 1
    w = [[0.0] * units for _ in range(inputs)]
    for c in cells:
        w[c["k"]][c["j"]] = c["w"]
    layers = [
        {"w": w, "b": [j * 0.01 for j in range(units)], "activation": "relu"},
        {"gamma": [1.0 + j / 10.0 for j in range(units)], "beta": [0.1] * units, "mean": [j / 100.0 for j in range(units)],
         "var": [1.0 + j for j in range(units)], "eps": 1e-5},
        {"w": [[(j + 1) / 10.0] for j in range(units)], "b": [-0.5], "activation": "sigmoid"},
    ]
    return W.dense_score(V.vec(spark, sf), "embedding", layers).select("vec_id", "score")
