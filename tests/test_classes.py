"""Very many classes and labels, NULL among them."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators import metrics as M, sample as S
from flowlens.plans import small
from flowlens.plans.ranking import rank_bounds


@pytest.fixture(scope="module")
def many(spark):
    """100,000 classes of one to four rows; 500 rows have none."""
    return spark.range(250_000).selectExpr("id", "if(id % 500 = 0, null, cast(id * 2 div 5 as string)) AS c").repartition(4).cache()


@pytest.mark.parametrize("limit", [200_000, 1000])
def test_draws_over_many_classes(spark, many, limit, monkeypatch):
    # Class tables within the limit are broadcast, beyond it they are joined by shuffle.
    monkeypatch.setattr(small, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(S.settle, "__defaults__", (limit,))
    monkeypatch.setattr(S.attach, "__defaults__", ("left", limit))
    sizes = many.groupBy("c").count()
    assert sizes.count() > 99_000
    weights = S.class_weights(many, "c")
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(1.0) and weights.filter("weight IS NULL").isEmpty()
    per = weights.groupBy("c").agg(F.sum("weight").alias("w")).agg(F.min("w"), F.max("w")).first()
    assert per[0] == pytest.approx(per[1])
    drawn = S.bootstrap_weighted(many, "c", ["id"], 1)
    assert drawn.agg(F.sum("times")).first()[0] == 250_000
    # Balanced: a class has the same chance whatever its size, so the 500 rows without one are hit less than once each.
    assert drawn.filter("c IS NULL").count() <= 30


def test_growth_of_many_classes(spark):
    df = spark.range(30_000).selectExpr("id", "if(id < 3, null, cast(id div 3 as string)) AS c").filter("id % 3 <> 2 OR id < 3")
    out = S.oversample_balance(df, "c", ["id"])
    assert out.groupBy("c").count().agg(F.min("count"), F.max("count")).first() == (3, 3)
    assert out.filter("copy = 0").count() == df.count()


def test_draws_of_a_large_class_are_made_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "DRAWS", 7)
    df = spark.range(220).selectExpr("id", "if(id < 200, 'a', if(id < 210, 'b', null)) AS c")
    out = S.oversample_balance(df, "c", ["id"])
    assert sorted((str(r["c"]), r["count"]) for r in out.groupBy("c").count().collect()) == [("None", 200), ("a", 200), ("b", 200)]


def test_weights_of_a_class_map(spark):
    df = spark.range(100).selectExpr("id", "if(id < 90, 'a', if(id < 95, 'b', null)) AS c")
    drawn = S.bootstrap_weighted(df, "c", ["id"], 20, {"a": 0.0, None: 3.0})
    hits = {r["c"]: r["n"] for r in drawn.groupBy("c").agg(F.sum("times").alias("n")).collect()}
    assert "a" not in hits and hits[None] + hits["b"] == 2000 and 2.3 < hits[None] / hits["b"] < 3.9


def test_confusion_of_many_labels(spark):
    df = spark.range(40_000).selectExpr("cast(id % 20000 as int) AS y", "if(id % 100 = 7, null, cast((id + id % 3) % 20000 as int)) AS p")
    cells = M.confusion_matrix(df, "y", "p", absent=False)
    assert cells.agg(F.sum("n")).first()[0] == 40_000 and not cells.filter("predicted IS NULL").isEmpty()
    few = df.filter("y < 60")
    grid = M.confusion_matrix(few, "y", "p")
    seen = few.select("y").union(few.select("p")).distinct().count()
    assert grid.count() == seen ** 2 and grid.agg(F.sum("n")).first()[0] == few.count()
    asked = M.confusion_matrix(few, "y", "p", labels=[1, 2, 3])
    assert asked.count() == 9 and asked.agg(F.sum("n")).first()[0] == few.filter("y IN (1, 2, 3) AND p IN (1, 2, 3)").count()


def test_unlabelled_rows_are_counted_apart(spark):
    df = spark.createDataFrame([(1, 0.9, "a"), (1, 0.2, "a"), (0, 0.8, "a"), (0, 0.1, "a"), (None, 0.9, "a"), (1, 0.7, None), (None, 0.3, "b")], "y int, s double, g string")
    out = {r["g"]: r for r in M.evaluate(df, F.col("y"), F.col("s"), ["g"]).collect()}
    assert set(out) == {"a", None, "b"}
    for r in out.values():
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == r["n"]
    assert (out["a"]["n"], out["a"]["n_unlabelled"], out["b"]["n"], out["b"]["n_unlabelled"], out[None]["tp"]) == (4, 1, 0, 1, 1)
    assert M.accuracy(df, F.col("y"), (F.col("s") >= 0.5).cast("int")).first()[0] == pytest.approx(3 / 5)


def test_names_that_are_needed_inside_are_refused(spark):
    df = spark.range(5).selectExpr("id", "id AS _h")
    with pytest.raises(ValueError):
        rank_bounds(df, [], ["id"], 1, [S.at_least_one(0.5)])
    with pytest.raises(ValueError):
        S.simple_sample(spark.range(5).selectExpr("id", "id AS _k0"), ["id"], 0.5)
