"""Graph search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import hnsw as H
from flowlens.llm.queries import QUERIES


def brute(rows, asked, k):
    """rows: (id, vector). Nearest by the definition: largest product, smaller id first."""
    ids = np.array([r[0] for r in rows])
    m = np.array([r[1] for r in rows], float)
    out = {}
    for i, v in rows:
        if asked(i):
            score = m @ np.array(v, float)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, rows in out.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
    return {q: [(i, s) for _, i, s in rows] for q, rows in out.items()}


def recall(got, want):
    assert got.keys() == want.keys()
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(1, len(want[q])) for q in want])


def test_query_recall(spark, small):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = lists(QUERIES["op4_hnsw"](spark, small)), brute(rows, lambda i: i % 20 == 0, 20)
    assert recall(got, want) >= 0.9
    exact = {q: dict(v) for q, v in want.items()}
    for q, found in got.items():
        for i, s in found:
            if i in exact[q]:
                assert s == pytest.approx(exact[q][i], rel=1e-12)


def test_graph_recall_and_norms():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32)) * rng.uniform(0.2, 3, (4000, 1))  # lengths differ
    g = H.Graph.unpacked(*H.Graph(x).packed())
    q = x[::40]
    ids, score = g.nearest(q, 10)
    want = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, want)]) >= 0.9
    assert np.allclose(score, np.take_along_axis(q @ x.T, ids, 1))


def test_shards_copies_and_ties(spark):
    """Several shards; one vector with a third of all rows, of which the smallest ids count."""
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = lists(H.nearest(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=150))
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert recall(got, want) >= 0.98
    assert [i for i, _ in got[60]] == [i for i, _ in want[60]]


def test_few_rows_give_all_others(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(15)]
    got = lists(H.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.lit(True), k=20))
    assert all(len(v) == 14 for v in got.values()) and len(got) == 15


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]),
            (8, [1.0, 2.0, 3.0]), (9, [2.0, 0.0]), (9, [2.0, 0.0]), (20, [0.5, 0.5]), (10, [3.0, 2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id bigint, embedding array<double>, dim int, node string, n int")
    got = lists(H.nearest(df, F.lit(True), k=3))
    assert got[0] == [(9, 2.0), (7, 0.5), (20, 0.5)] and got[8] == [(10, 10.0)] and got[7] == [(9, 1.0), (0, 0.5), (20, 0.5)]
    assert set(got) == {0, 7, 8, 9, 10, 20}
    assert H.nearest(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_recall_of_a_full_shard(spark, kind):
    """16,384 vectors of 128 dimensions, the size of a shard; the random ones need a wider beam than the first."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(16_384, 128))
    if kind == "clustered":
        x = rng.normal(size=(50, 128))[rng.integers(0, 50, 16_384)] + 0.2 * x
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    asked = range(0, 16_384, 256)
    got = lists(H.nearest(df, F.col("vec_id") % 256 == 0, k=20))
    score = x[list(asked)] @ x.T
    for row, i in enumerate(asked):
        score[row, i] = -np.inf
    want = {i: [(int(j), 0.0) for j in np.argsort(-score[row], kind="stable")[:20]] for row, i in enumerate(asked)}
    assert recall(got, want) >= 0.94


def test_exact_way(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(900)]
    got = lists(H.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20, shard_rows=250, exact=True))
    assert recall(got, brute(rows, lambda i: i % 20 == 0, 20)) == 1.0
