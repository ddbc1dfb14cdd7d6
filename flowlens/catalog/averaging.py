"""Weighted averaging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import averaging as A
from ..plans.small import attach
from . import views as V
from .evaluation import eval_sql
from .registry import query, r


@query("fedavg", f"""
    n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT w.dim AS pos, {r('sum(w.v * n.n) / sum(n.n)')} AS w FROM vlong w JOIN n ON w.label = n.label GROUP BY w.dim""", ("vlong",))
def fedavg(spark, sf):
    sizes = V.vec(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return A.fedavg(attach(V.vlong(spark, sf), sizes, ["label"]).withColumnRenamed("dim", "pos"), ["pos"], "v", "n")


def _inputs(spark, sf):
    return V.ev(spark, sf).select("client", "event_id", (F.col("value") / 100).alias("x"), "y")


@query("fed_round", f"""
    e AS (SELECT client, value / 100 AS x, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(0.1::DOUBLE - 0.2::DOUBLE * (value / 100)))) - y AS er FROM ev),
    l AS (SELECT client, count(*) AS n, 0.1::DOUBLE - 0.5::DOUBLE * sum(er) / count(*) AS w0, -0.2::DOUBLE - 0.5::DOUBLE * sum(er * x) / count(*) AS w1 FROM e GROUP BY client)
    SELECT 0 AS pos, {r('sum(w0 * n) / sum(n)')} AS w FROM l UNION ALL SELECT 1, {r('sum(w1 * n) / sum(n)')} FROM l""", ("ev",))
def fed_round(spark, sf):
    return A.fed_round(_inputs(spark, sf), "client", ["x"], "y", [0.1, -0.2], 0.5)


def _train_sql(rounds: int) -> str:
    """CTEs w1, w2, ...: weights (a, b) after each round of local steps and their average by client size."""
    out = ["src AS (SELECT client, y, value / 100 AS x FROM ev)", "w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(1, rounds + 1):
        out.append(f"""e{k} AS (SELECT client, x, a, b, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(a + b * x))) - y AS er FROM src, w{k - 1}),
    l{k} AS (SELECT client, count(*) AS n, min(a) - 0.5::DOUBLE * sum(er) / count(*) AS a, min(b) - 0.5::DOUBLE * sum(er * x) / count(*) AS b FROM e{k} GROUP BY client),
    w{k} AS (SELECT sum(a * n) / sum(n) AS a, sum(b * n) / sum(n) AS b FROM l{k})""")
    return ",\n    ".join(out)


@query("fed_train", _train_sql(5) + f" SELECT 0 AS pos, {r('a')} AS w FROM w5 UNION ALL SELECT 1, {r('b')} FROM w5", ("ev",))
def fed_train(spark, sf):
    w, _ = A.fed_train(_inputs(spark, sf), "client", ["x"], "y", rounds=5, rate=0.5)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "pos int, w double")


_LOGGED = " UNION ALL ".join(f"SELECT {k} AS round, y, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(a + b * x))) AS s FROM src, w{k}" for k in (1, 2, 3))


@query("round_log", _train_sql(3) + f", rs AS ({_LOGGED}), " + eval_sql("rs", "round", "s").strip() + """,
    z AS (SELECT count(*) AS clients, min(n) AS smallest, max(n) AS largest, sum(n)::BIGINT AS rows FROM l1)
    SELECT round, accuracy, f1, auc, logloss, clients, smallest, largest, rows FROM ev_out, z""", ("ev",))
def round_log(spark, sf):
    _, log = A.fed_train(_inputs(spark, sf), "client", ["x"], "y", rounds=3, rate=0.5, evaluate=True)
    return spark.createDataFrame(log, A.LOG_SCHEMA)


@query("client_label_mix", """
    SELECT client, count(*) FILTER (y = 0) AS n_0, count(*) FILTER (y = 1) AS n_1 FROM ev GROUP BY client""", ("ev",))
def client_label_mix(spark, sf):
    return A.label_mix(V.ev(spark, sf), "client", "y", [0, 1])
