"""Trained models: invariants rather than fixed rows."""

import pytest

import __spark_entry__ as entry

Q = entry.queries()


def rows(spark, sf, name):
    return [r.asDict() for r in Q[name](spark, sf).collect()]


@pytest.mark.parametrize("name", ["random_forest_train", "mlp_train", "net_train_balanced"])
def test_classifiers_learn(spark, sf, name):
    got = {r["split"]: r for r in rows(spark, sf, name)}
    assert set(got) == {"train", "test"} and got["test"]["auc"] > 0.9


def test_forest_scores_after_an_observed_query(spark):
    """An observed query leaves a part in the session that cannot be sent to a task."""
    from pyspark.sql import Observation, functions as F

    from flowlens.operators import models as Z

    df = spark.range(400).selectExpr("cast(id % 20 as double) AS a", "cast(id % 7 as double) AS b", "cast(id % 20 > 9 as int) AS y")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    model = Z.forest_train(df, ["a", "b"], "y", trees=3, max_depth=3)
    assert seen.get["n"] == 400 and Z.score(model, df, ["a", "b"]).filter("(score >= 0.5) = (y = 1)").count() == 400


def test_forest_nodes_give_importances(spark, sf):
    got = rows(spark, sf, "random_forest_nodes")
    assert sum(r["importance"] for r in got) == pytest.approx(1.0, abs=1e-4)


@pytest.mark.parametrize("name", ["cart_tree", "cart_tree_binned", "newton_tree", "cart_forest"])
def test_grown_trees_are_consistent(spark, sf, name):
    nodes = {(r["tree_id"], r["node_id"]): r for r in rows(spark, sf, name)}
    for v in nodes.values():
        if v["feature"] >= 0:
            left, right = nodes[(v["tree_id"], v["left_id"])], nodes[(v["tree_id"], v["right_id"])]
            assert left["n"] + right["n"] == v["n"]


@pytest.mark.parametrize("name", ["gbt_train", "gbt_early_stopping"])
def test_boosting_loss_falls(spark, sf, name):
    losses = [r["train_loss"] for r in sorted(rows(spark, sf, name), key=lambda r: r["round"])]
    assert losses == sorted(losses, reverse=True)


def test_federated_rounds(spark, sf):
    assert len(rows(spark, sf, "fed_train")) == 2
    log = sorted(rows(spark, sf, "round_log"), key=lambda r: r["round"])
    assert log[-1]["logloss"] < log[0]["logloss"]
