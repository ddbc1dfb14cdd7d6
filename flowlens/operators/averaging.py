"""Weighted averaging of client parameters and the rounds built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import expr as X
from . import metrics as M


def fedavg(weights: DataFrame, keys: Sequence[str], w: str, n: str) -> DataFrame:
    """Mean of every weight position, weighted by client rows."""
    return weights.groupBy(*keys).agg((F.sum(F.col(w) * F.col(n)) / F.sum(n)).alias("w"))


def check_same_positions(weights: DataFrame, client: str, keys: Sequence[str]) -> None:
    """Raise unless every client has the same set of weight positions."""
    clients = weights.select(client).distinct().count()
    uneven = weights.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") != clients)
    if not uneven.isEmpty():
        raise ValueError("clients do not share the same weight positions")


def linear_score(features: Sequence[str], w: Sequence[float]) -> Column:
    """w[0] + sum w[i+1] * x[i]."""
    z = F.lit(float(w[0]))
    for f, v in zip(features, w[1:]):
        z = z + F.col(f) * F.lit(float(v))
    return z


def local_steps(df: DataFrame, client: str, features: Sequence[str], y: str, w: Sequence[float],
                rate: float) -> DataFrame:
    """One full-batch logistic step per client, as (client, n, w0, w1, ...).

    Gradient sums are formed on the map side; one row per client is shuffled.
    """
    err = X.sigmoid(linear_score(features, w)) - F.col(y)
    inputs = [F.lit(1.0), *[F.col(f) for f in features]]
    agg = df.groupBy(client).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(err * x).alias(f"_g{i}") for i, x in enumerate(inputs)])
    return agg.select(client, "n", *[
        (F.lit(float(w[i])) - F.lit(float(rate)) * F.col(f"_g{i}") / F.col("n")).alias(f"w{i}")
        for i in range(len(inputs))])


def fed_round(df: DataFrame, client: str, features: Sequence[str], y: str, w: Sequence[float],
              rate: float) -> DataFrame:
    """Average of one local step, as (pos, w)."""
    local = local_steps(df, client, features, y, w, rate)
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"w{i}").alias("w_local")) for i in range(len(w))])
    long = local.select(client, "n", F.explode(cells).alias("c")).select(client, "n", "c.*")
    return fedavg(long, ["pos"], "w_local", "n")


def fed_train(df: DataFrame, client: str, features: Sequence[str], y: str, rounds: int, rate: float,
              evaluate: bool = False) -> tuple[list[float], list[tuple]]:
    """Rounds of local steps and averaging; the driver holds the weight vector only.

    With ``evaluate`` each round is logged, with the number of clients and their smallest, largest and total size.
    """
    w = [0.0] * (len(features) + 1)
    log = []
    if evaluate:
        per = df.groupBy(client).agg(F.count(F.lit(1)).alias("n"))
        size = per.agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.sum("n")).first()
    for r in range(1, rounds + 1):
        rows = fed_round(df, client, features, y, w, rate).collect()  # one row per weight
        w = [v for _, v in sorted((row["pos"], row["w"]) for row in rows)]
        if evaluate:
            scored = df.select(F.col(y).alias("y"), X.sigmoid(linear_score(features, w)).alias("s"),
                               F.lit("all").alias("split"))
            m = M.evaluate(scored, F.col("y"), F.col("s"), ["split"]).first()
            log.append((r, float(m["accuracy"]), float(m["f1"]), float(m["auc"]), float(m["logloss"]), *size))
    return w, log


LOG_SCHEMA = "round int, accuracy double, f1 double, auc double, logloss double, clients bigint, smallest bigint, largest bigint, rows bigint"


def label_mix(df: DataFrame, client: str, label: str, values: Sequence) -> DataFrame:
    """Rows per client and label."""
    out = df.groupBy(client).pivot(label, list(values)).agg(F.count(F.lit(1)))
    return out.select(client, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(f"n_{v}") for v in values])
