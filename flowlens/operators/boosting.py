"""Second-order gradient boosting as a driver loop over Spark jobs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import expr as X
from ..plans.small import ensure_checkpoint_dir, materialise
from . import trees as T
from .sample import row_subsample


def base_score(df: DataFrame, y: Column, fallback: float = 0.5) -> DataFrame:
    """Log-odds of the positive rate, clipped; ``fallback`` when there is no positive."""
    rate = F.avg(y.cast("double"))
    p = F.when(rate > 0, rate).otherwise(F.lit(fallback))
    return df.agg(X.log_odds(p).alias("base_score"))


def with_gradients(df: DataFrame, y: Column, raw: Column) -> DataFrame:
    p = X.sigmoid(raw)
    return df.withColumns({"g": p - y, "h": F.greatest(p * (1.0 - p), F.lit(1e-7))})


def leaf_weight(df: DataFrame, keys: Sequence[str], lam: float = 1.0) -> DataFrame:
    """-G / (H + lambda) per group of rows."""
    agg = df.groupBy(*keys).agg(F.sum("g").alias("_g"), F.sum("h").alias("_h"), F.count(F.lit(1)).alias("n"))
    return agg.select(*keys, "n", (-F.col("_g") / (F.col("_h") + F.lit(float(lam)))).alias("leaf_weight"))


def column_subset(features: Sequence[str], frac: float, seed) -> list[int]:
    """ceil(frac*m) feature positions, first in hash order."""
    m = len(features)
    return list(range(m)) if frac >= 1.0 else T.feature_subset(features, max(1, math.ceil(frac * m)), seed)


def newton_tree(df: DataFrame, features: Sequence[str], max_depth: int = 6, lam: float = 1.0, gamma: float = 0.0,
                min_child: float = 1.0, edges=None, binned: bool = False, columns=None) -> T.Tree:
    """One tree on the columns g and h; a node without a positive gain is a leaf."""
    stats = {"n": F.lit(1).cast("bigint"), "g": F.col("g"), "h": F.col("h")}
    edges = edges or T.split_edges(df, features)
    return T.grow(
        df, features, stats, max_depth,
        may_split=lambda v: v.n >= 2,
        score=lambda s: T.newton_gain(s, lam, gamma, min_child),
        accept=lambda g: g is not None and g > 0.0,
        edges=edges, binned=binned, columns=None if columns is None else (lambda _: columns))


@dataclass
class BoostedModel:
    base: float
    rate: float
    lam: float
    features: list[str]
    trees: list[T.Tree] = field(default_factory=list)
    log: list[dict] = field(default_factory=list)

    def step(self, tree: T.Tree) -> Column:
        return tree.compile(self.features, lambda v: F.lit(
            self.rate * (-v.stats["g"] / (v.stats["h"] + self.lam))))

    def raw(self, first: int = 0) -> Column:
        out = F.lit(self.base) if first == 0 else F.lit(0.0)
        for t in self.trees[first:]:
            out = out + self.step(t)
        return out

    def nodes(self, spark) -> DataFrame:
        return T.node_table(spark, self.trees, self.lam)

    def round_log(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(r["round"], r["train_loss"], r["val_loss"]) for r in self.log],
            "round int, train_loss double, val_loss double")


def boost(df: DataFrame, features: Sequence[str], y: str, keys: Sequence[str], rounds: int = 100, rate: float = 0.1,
          max_depth: int = 6, lam: float = 1.0, gamma: float = 0.0, min_child: float = 1.0, subsample: float = 0.8,
          colsample: float = 0.8, seed: int = 42, valid: DataFrame | None = None, patience: int | None = None,
          binned: bool = False, cut_every: int = 5, base: float | None = None) -> BoostedModel:
    """Boosting loop. Per round: gradients on all rows, one tree on sampled rows and columns.

    Scores are kept as a column that is advanced by the newest tree only and
    checkpointed every ``cut_every`` rounds, so plans stay short and a round costs
    the same early and late. With ``valid`` and ``patience`` it stops early and
    keeps the trees up to the best round.
    """
    for name, ok in (("rounds", rounds >= 1), ("rate", 0 < rate <= 1), ("subsample", 0 < subsample <= 1),
                     ("colsample", 0 < colsample <= 1), ("lam", lam >= 0), ("max_depth", max_depth >= 1)):
        if not ok:
            raise ValueError(f"bad value for {name}")
    ensure_checkpoint_dir(df.sparkSession)
    features = list(features)
    if base is None:
        base = base_score(df, F.col(y)).first()["base_score"]
    edges = T.split_edges(df, features)
    model = BoostedModel(float(base), rate, lam, features)
    # Every round reads these tables several times: write them narrow, with their buckets, once.
    train = materialise(T.with_buckets(df.select(*keys, *features, F.col(y)), features, edges), "train")
    train = train.withColumn("_raw", F.lit(model.base))
    held = None if valid is None else materialise(valid.select(*features, F.col(y)), "valid").withColumn(
        "_raw", F.lit(model.base))
    best, best_len, waited = math.inf, 0, 0
    for t in range(rounds):
        grads = with_gradients(train, F.col(y), F.col("_raw"))
        sampled = row_subsample(grads, keys, subsample, seed, t)
        tree = newton_tree(sampled, features, max_depth, lam, gamma, min_child, edges, binned,
                           column_subset(features, colsample, f"{seed}|{t}"))
        model.trees.append(tree)
        train = train.withColumn("_raw", F.col("_raw") + model.step(tree))
        if held is not None:
            held = held.withColumn("_raw", F.col("_raw") + model.step(tree))
        if (t + 1) % cut_every == 0:
            train = train.checkpoint()
            held = held.checkpoint() if held is not None else None
        entry = {"round": t + 1, "train_loss": _loss(train, y), "val_loss": _loss(held, y) if held is not None else None}
        model.log.append(entry)
        if held is not None and patience is not None:
            if entry["val_loss"] < best - 1e-7:
                best, best_len, waited = entry["val_loss"], t + 1, 0
            else:
                waited += 1
                if waited >= patience:
                    break
    if held is not None and patience is not None:
        model.trees = model.trees[:best_len]
    return model


def _loss(df: DataFrame, y: str) -> float:
    return df.agg(F.avg(X.bce(F.col(y), X.sigmoid(F.col("_raw")), False, 1e-7)).alias("l")).first()["l"]


def early_stop(log: DataFrame, run: str, rnd: str, loss: str, patience: int, max_rounds: int = 10_000) -> DataFrame:
    """Best round and stopping round of every run's loss log.

    A loss is an improvement when it is more than 1e-7 below the best so far; the
    run stops after ``patience`` rounds without one. The rule is sequential, so
    each run's losses are folded in order; a run has one row per boosting round,
    at most ``max_rounds``, which is checked.
    """
    longest = log.groupBy(run).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if longest > max_rounds:  # checked before any list is built
        raise ValueError(f"a run has {longest} rounds, more than {max_rounds}")
    per = log.groupBy(run).agg(
        F.array_sort(F.collect_list(F.struct(F.col(rnd).cast("int").alias("r"), F.col(loss).alias("l")))).alias("_log"))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("best_round"), F.lit(0).alias("waited"),
                     F.lit(0).alias("stopped"), F.lit(0).alias("seen"))

    def step(a: Column, x: Column) -> Column:
        active = a["stopped"] == 0
        better = active & (x["l"] < a["best"] - 1e-7)
        waited = F.when(better, 0).when(active, a["waited"] + 1).otherwise(a["waited"])
        return F.struct(
            F.when(better, x["l"]).otherwise(a["best"]).alias("best"),
            F.when(better, x["r"]).otherwise(a["best_round"]).alias("best_round"),
            waited.alias("waited"),
            F.when(active & (waited >= patience), x["r"]).otherwise(a["stopped"]).alias("stopped"),
            F.when(active, x["r"]).otherwise(a["seen"]).alias("seen"))

    folded = per.withColumn("_f", F.aggregate("_log", start, step))
    return folded.select(
        run, F.col("_f.best").alias("best_loss"), F.col("_f.best_round").alias("best_round"),
        F.col("_f.seen").alias("last_round"), F.when(F.col("_f.stopped") > 0, 1).otherwise(0).alias("stopped_early"))
