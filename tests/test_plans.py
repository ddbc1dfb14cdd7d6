"""Plan patterns: exact against the plain form, whatever the partitioning or skew."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from flowlens.plans import ordered as O, ranking as R, small as P


def frame(spark, n=2000, seed=1):
    rng = random.Random(seed)
    # One value and one stratum hold a third of the rows.
    rows = [(i, 0 if rng.random() < 0.34 else rng.randrange(5), 7.0 if rng.random() < 0.34 else rng.gauss(0, 10)) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, g int, x double")


def plain_rank(df, part):
    return df.withColumn("want", F.row_number().over(Window.partitionBy(*part).orderBy(R.hash_text(42, "id"), "id")))


@pytest.mark.parametrize("parts", [1, 7])
def test_hash_rank_equals_window(spark, parts):
    df = frame(spark).repartition(parts)
    both = R.hash_rank(plain_rank(df, ["g"]), ["g"], ["id"], 42, "got")
    assert both.filter("got <> want").count() == 0
    assert both.count() == 2000


@pytest.mark.parametrize("strata", [[], ["g"]])
@pytest.mark.parametrize("parts", [1, 7])
def test_rank_bounds_equal_window(spark, strata, parts):
    df = plain_rank(frame(spark).repartition(parts), strata or [F.lit(1)])
    cuts = [lambda n: F.floor(n * 0.1), lambda n: F.floor(n * 0.1) + 1, lambda n: F.ceil(n * 0.7)]
    out = R.rank_bounds(df, strata, ["id"], 42, cuts)
    n = F.count(F.lit(1)).over(Window.partitionBy(*(strata or [F.lit(1)])))
    want = sum((F.when(F.col("want") > c(n), 1).otherwise(0) for c in cuts), F.lit(0))
    out = out.withColumn("step", want)
    assert out.filter("step <> _step").count() == 0
    assert out.count() == 2000


def test_rank_bounds_edges(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id bigint, g int")
    none = R.rank_bounds(df, ["g"], ["id"], 1, [lambda n: F.lit(0)])
    assert {r["_step"] for r in none.collect()} == {1}
    every = R.rank_bounds(df, ["g"], ["id"], 1, [lambda n: n + 5])
    assert {r["_step"] for r in every.collect()} == {0}


def test_rank_bounds_without_small_table(spark, monkeypatch):
    """Very many strata: the cut table is joined by shuffle and gives the same rows."""
    df = frame(spark, 500)
    cut = [lambda n: F.greatest(F.lit(1), F.floor(n * 0.3))]
    a = {(r["id"], r["_step"]) for r in R.rank_bounds(df, ["g"], ["id"], 3, cut).collect()}
    monkeypatch.setattr(P, "fetch_small", lambda *_: None)
    b = {(r["id"], r["_step"]) for r in R.rank_bounds(df, ["g"], ["id"], 3, cut).collect()}
    assert a == b


@pytest.mark.parametrize("strata", [[], ["g"]])
def test_rank_bounds_refines_large_prefixes(spark, monkeypatch, strata):
    """Prefixes with too many rows are counted again by longer ones."""
    monkeypatch.setattr(R, "SORTED_ROWS", 1)
    monkeypatch.setattr(R, "FIRST_DIGITS", 1)
    monkeypatch.setattr(R, "MORE_DIGITS", 1)
    monkeypatch.setattr(R, "RANKED_ROWS", 10)
    df = plain_rank(frame(spark), strata or [F.lit(1)])
    out = R.rank_bounds(df, strata, ["id"], 42, [lambda n: F.floor(n * 0.2), lambda n: F.floor(n * 0.5)])
    n = F.count(F.lit(1)).over(Window.partitionBy(*(strata or [F.lit(1)])))
    want = sum((F.when(F.col("want") > F.floor(n * q), 1).otherwise(0) for q in (0.2, 0.5)), F.lit(0))
    assert out.withColumn("w", want).filter("w <> _step").count() == 0
    assert R.hash_rank(df, strata, ["id"], 42, "got").filter("got <> want").count() == 0


def test_number_rows_is_dense(spark):
    out = R.number_rows(frame(spark, 100).repartition(5))
    assert sorted(r["row_no"] for r in out.collect()) == list(range(1, 101))


def test_numbers_stay_dense_after_a_shuffle(spark):
    """Adaptive execution merges the partitions of a shuffle by their size, which depends on the columns read."""
    df = spark.range(150_000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).repartition("id")
    out = R.number_rows(df).agg(F.count(F.lit(1)), F.countDistinct("row_no"), F.min("row_no"), F.max("row_no"), F.countDistinct("id")).first()
    assert tuple(out) == (150_000, 150_000, 1, 150_000, 150_000)


def test_picks_reach_every_row_of_a_large_table(spark):
    n = 10**12
    row = spark.range(20_000).select(R.hash_pick(1, F.lit(n), "id").alias("p")).agg(F.min("p"), F.max("p"), F.avg("p")).first()
    assert row[0] < 0.001 * n and row[1] > 0.999 * n and abs(row[2] / n - 0.5) < 0.01


def percentile(values, p):
    return float(np.quantile(values, p))


@pytest.mark.parametrize("cells", [0, 10**9])
def test_exact_quantiles_both_plans(spark, cells):
    df = frame(spark).withColumn("k", F.lit(3.0)).withColumn("e", F.lit(None).cast("double"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = O.exact_quantiles(df, ["x", "k", "e"], probs, direct_cells=cells, buckets=16)
    xs = [r["x"] for r in df.collect()]
    assert got["x"] == pytest.approx([percentile(xs, p) for p in probs], abs=1e-12)
    assert got["k"] == [3.0] * 7
    assert got["e"] == [None] * 7


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_equal_window(spark, descending):
    df = frame(spark)
    edges = O.bucket_edges(df, ["x"], 8)
    slots = O.add_buckets(df, ["x"], edges).groupBy("g", "_b_x", "x").agg(F.count(F.lit(1)).alias("n"))
    order = F.desc("x") if descending else F.asc("x")
    w = Window.partitionBy("g").orderBy(order)
    out = O.running_sums(slots, ["g"], "_b_x", "x", ["n"], descending)
    out = out.withColumn("want", F.sum("n").over(w)).withColumn("nxt", F.lead("x").over(w))
    assert out.filter("cum_n <> want OR NOT (next_value <=> nxt)").count() == 0
    assert {r["g"]: r["t"] for r in out.groupBy("g").agg(F.max("tot_n").alias("t")).collect()} == \
        {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}


def test_value_at_rank(spark):
    df = frame(spark, 333)
    xs = sorted(abs(r["x"]) for r in df.collect())
    got = O.value_at_rank(df, [], F.abs("x"), lambda n: F.floor(n * 0.4)).first()
    assert got["value"] == xs[math.floor(333 * 0.4)] and got["n"] == 333


def test_attach_checks_the_size(spark):
    df = spark.range(10)
    small = df.select("id", (F.col("id") * 2).alias("v"))
    for limit in (100, 3):  # broadcast, then shuffle join
        got = P.attach(df, small, ["id"], limit=limit)
        assert {(r["id"], r["v"]) for r in got.collect()} == {(i, 2 * i) for i in range(10)}


def test_no_row_shuffle_in_a_sample(spark, sf):
    """Taking a sample from a table is a filter on the scan."""
    from flowlens.operators import sample as S

    df = spark.read.parquet(f"{sf}/events.parquet")
    plan = S.stratified_sample(df, ["event_type"], ["event_id"], 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_workspace_removes_its_tables(spark):
    import os

    with P.workspace(spark) as root:
        table = P.materialise(spark.range(10).toDF("id"), "t")
        assert table.count() == 10 and os.path.isdir(root.removeprefix("file:"))
    assert not os.path.exists(root.removeprefix("file:"))
    assert P.materialise(spark.range(3).toDF("id"), "t").count() == 3
