"""Forests and boosting on bucket sums against trees grown one by one, and what they cost."""

import math

import pytest
from pyspark.sql import functions as F

from flowlens.operators import boosting as G, histograms as H, trees as T

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(1200).selectExpr(
        "id", "cast(xxhash64(id, 1) % 17 as double) AS a", "cast(xxhash64(id, 2) % 11 as double) AS b",
        "if(id % 9 = 0, null, if(id % 10 = 0, double('NaN'), cast(xxhash64(id, 3) % 5 as double))) AS c")
    y = F.when(F.col("id") % 50 == 0, None).otherwise(((F.col("a") * 2 - F.col("b") + F.coalesce(F.nanvl("c", F.lit(9.0)), F.lit(9.0)) > 4) != (F.col("id") % 13 == 0)).cast("int"))
    return rows.withColumn("y", y).repartition(5).cache()


def shape(tree):
    return [(v.node_id, v.n, v.stats["pos"], v.feature, v.left, v.right, round(v.gain, 12)) for _, v in sorted(tree.nodes.items())]


def test_forest_equals_trees_grown_one_by_one(table):
    labelled = table.filter("y IS NOT NULL")
    for weights in ("balanced", None):
        together = H.forest(table, FEATS, "y", ["id"], trees=4, max_depth=5, min_split=8, min_leaf=3, weights=weights, seed=7)
        alone = T.cart_forest(labelled, FEATS, "y", ["id"], trees=4, max_depth=5, min_split=8, min_leaf=3, weights=weights, seed=7, binned=True)
        assert [shape(t) for t in together] == [shape(t) for t in alone]


def test_sums_kept_in_spark_give_the_same_trees(table, monkeypatch):
    few = [shape(t) for t in H.forest(table, FEATS, "y", ["id"], trees=2, max_depth=4)]
    monkeypatch.setattr(H, "DRIVER_BYTES", 0)
    monkeypatch.setattr(H, "TREES_AT_ONCE", 1)
    assert [shape(t) for t in H.forest(table, FEATS, "y", ["id"], trees=2, max_depth=4)] == few


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_follow_the_depth_alone(spark, table):
    bins = H.fit_bins(table, FEATS)
    few, many = (jobs(spark, f"forest{k}", lambda k=k: H.forest(table, FEATS, "y", ["id"], trees=k, max_depth=4, bins=bins)) for k in (2, 9))
    assert abs(many - few) <= 2
    short, long = (jobs(spark, f"boost{k}", lambda k=k: H.boost(table, FEATS, "y", ["id"], rounds=k, max_depth=2)) for k in (2, 6))
    longer = jobs(spark, "boost10", lambda: H.boost(table, FEATS, "y", ["id"], rounds=10, max_depth=2))
    assert longer - long <= long - short + 2


def test_boosting_equals_the_exact_first_tree(table):
    labelled = table.filter("y IS NOT NULL")
    model = H.boost(table, FEATS, "y", ["id"], rounds=1, rate=1.0, max_depth=3, subsample=1.0, colsample=1.0)
    grads = G.with_gradients(labelled, F.col("y"), F.lit(model.base))
    exact = G.newton_tree(grads, FEATS, max_depth=3)
    new = model.trees[0]
    assert [(v.n, v.feature, v.left, v.right) for v in new.nodes.values()] == [(v.n, v.feature, v.left, v.right) for v in exact.nodes.values()]
    for i, v in new.nodes.items():
        assert v.stats["g"] == pytest.approx(exact.nodes[i].stats["g"], abs=1e-9) and v.gain == pytest.approx(exact.nodes[i].gain, abs=1e-9)


def test_samples_are_exact_and_losses_follow_the_scores(table):
    n = table.filter("y IS NOT NULL").count()
    model = H.boost(table, FEATS, "y", ["id"], rounds=6, rate=0.3, max_depth=3, subsample=0.37)
    assert {t.nodes[0].n for t in model.trees} == {math.ceil(0.37 * n)}
    losses = [e["train_loss"] for e in model.log]
    assert losses == sorted(losses, reverse=True)
    scored = table.filter("y IS NOT NULL").withColumn("_raw", model.raw())
    assert G._loss(scored, "y") == pytest.approx(losses[-1], rel=1e-9)
    assert H.boost(table.repartition(3), FEATS, "y", ["id"], rounds=2, rate=0.3, max_depth=3, subsample=0.37).log[1]["train_loss"] == pytest.approx(losses[1], rel=1e-9)


def test_the_loop_ends_after_patience(table):
    train, valid = table.filter("id % 4 <> 0"), table.filter("id % 4 = 0")
    model = H.boost(train, FEATS, "y", ["id"], rounds=60, rate=0.9, max_depth=4, subsample=1.0, colsample=1.0, valid=valid, patience=2)
    losses = [e["val_loss"] for e in model.log]
    best = losses.index(min(losses))
    assert len(losses) == best + 3 < 60 and len(model.trees) == best + 1
    scored = valid.filter("y IS NOT NULL").withColumn("_raw", model.raw())
    assert G._loss(scored, "y") == pytest.approx(losses[best], rel=1e-9)


def test_tables_without_a_split(spark):
    kind = "id long, a double, b double, c double, y int"
    for rows in ([], [(1, 1.0, None, 2.0, 1)], [(1, 1.0, 2.0, 3.0, None)], [(i, 1.0, 1.0, None, i % 2) for i in range(20)]):
        trees = H.forest(spark.createDataFrame(rows, kind), FEATS, "y", ["id"], trees=2, max_depth=3)
        assert [len(t.nodes) for t in trees] == [1, 1]
    model = H.boost(spark.createDataFrame([(i, 1.0, 1.0, None, i % 2) for i in range(20)], kind), FEATS, "y", ["id"], rounds=2)
    assert [len(t.nodes) for t in model.trees] == [1, 1]
    with pytest.raises(ValueError):
        H.boost(spark.createDataFrame([], kind), FEATS, "y", ["id"], rounds=0)


def test_rounds_and_levels_leave_no_tables_behind(spark, table):
    """Scratch space follows the rows, not the rounds or levels; the sums in blocks are those of single rows."""
    import os

    from flowlens.plans.small import workspace

    with workspace(spark) as root:
        model = H.boost(table, FEATS, "y", ["id"], rounds=2, max_depth=4)
        grown = H.forest(table, FEATS, "y", ["id"], trees=2, max_depth=5)
        left = sorted(x.split("-")[0] for x in os.listdir(root))
    assert left == ["binned", "narrow"]
    labelled = table.filter("y IS NOT NULL").count()
    assert all(t.nodes[0].n == labelled for t in grown) and len(model.log) == 2
