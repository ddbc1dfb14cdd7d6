"""Gradients against differences of the loss, class weights, and the sums over partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import network as N

LOSSES = [N.Loss(), N.Loss(pos_weight=3.0), N.Loss(gamma=2.0, alpha=0.25), N.Loss(pos_weight=2.0, gamma=1.5)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(600).selectExpr("id", "cast(xxhash64(id, 1) % 100 as double) / 50 AS a", "cast(xxhash64(id, 2) % 100 as double) / 50 AS b",
                                       "cast(id % 10 = 0 as int) AS y").repartition(7).cache()


@pytest.mark.parametrize("loss", LOSSES)
def test_gradient_equals_differences(spark, rows, loss):
    layers = N.start([2, 3, 1], 1)
    table = rows.select(F.array("a", "b").alias("x"), F.col("y").cast("double").alias("y"))
    value, grad = N.gradient(table, layers, loss)
    pdf = rows.toPandas()
    x, y = pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy(float)
    p = np.clip(1 / (1 + np.exp(-N.forward(layers, x)[1])), 1e-12, 1 - 1e-12)
    right = np.where(y == 1, p, 1 - p)
    alpha = 1.0 if loss.alpha is None else np.where(y == 1, loss.alpha, 1 - loss.alpha)
    assert value == pytest.approx(np.mean(-np.where(y == 1, loss.pos_weight, 1.0) * alpha * (1 - right) ** loss.gamma * np.log(right)))
    flat, at, step = np.concatenate([q.ravel() for layer in layers for q in layer]), 0, 1e-6
    for k in range(len(flat)):
        sides = []
        for sign in (1, -1):
            moved = flat.copy()
            moved[k] += sign * step
            w1, b1, w2, b2 = moved[:6].reshape(2, 3), moved[6:9], moved[9:12].reshape(3, 1), moved[12:]
            sides.append(N.gradient_sums([(w1, b1), (w2, b2)], x, y, loss)[0] / len(y))
        assert grad[k] == pytest.approx((sides[0] - sides[1]) / (2 * step), abs=1e-5)


def test_training_respects_class_weights(spark, rows):
    seen = rows.withColumn("y", ((F.col("a") + F.col("b") > 1.5)).cast("int"))
    plain, log = N.train(seen, ["a", "b"], "y", hidden=(4,), steps=25)
    assert log[-1] < 0.7 * log[0]

    def mean(layers):
        return N.score(seen, layers, ["a", "b"]).agg(F.avg("score")).first()[0]

    # A tenth of the rows is positive, whatever the features; balanced, both labels count alike.
    rare, _ = N.train(rows, ["a", "b"], "y", hidden=(4,), steps=25)
    balanced, _ = N.train(rows, ["a", "b"], "y", hidden=(4,), steps=25, weights="balanced")
    assert mean(rare) < 0.3 and mean(balanced) > mean(rare) + 0.15
    again, _ = N.train(seen.repartition(3), ["a", "b"], "y", hidden=(4,), steps=25)
    assert mean(again) == pytest.approx(mean(plain), abs=1e-6)


def test_rows_without_label_or_feature(spark):
    kind = "a double, b double, y int"
    layers, log = N.train(spark.createDataFrame([], kind), ["a", "b"], "y", steps=3)
    assert log == [] and len(layers) == 2
    some = spark.createDataFrame([(1.0, None, 1), (1.0, 2.0, None), (1.0, 2.0, 1)], kind)
    assert len(N.train(some, ["a", "b"], "y", steps=2)[1]) == 2
    assert [r["score"] is None or np.isnan(r["score"]) for r in N.score(some, layers, ["a", "b"]).collect()] == [True, False, False]
    with pytest.raises(ValueError):
        N.start([2000, 2000, 1])
