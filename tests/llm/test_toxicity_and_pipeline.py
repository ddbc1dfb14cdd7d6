"""The classifier on held-out rows and under swapped names; the pipeline against its definition."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import packing, pii, stages, toxicity as X
from flowlens.llm.queries import PSEUDONYM_KEY, QUERIES, table

from .conftest import ODD
from .test_dedup_and_urls import low
from .test_near_dedup import brute
from .test_tokens_and_packing import check_packing


def test_query_on_held_out_rows(spark, texts):
    big = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in QUERIES["op7_toxicity"](spark, big).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in table(spark, big, "labels").collect()]
    assert len(rows) == table(spark, big, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    out = [(rows[i]["predicted"], y) for i, y in labels if rows[i]["held_out"]]
    assert sum(p == y for p, y in out) / len(out) > 0.97
    assert sum(p and not y for p, y in out) <= 0.01 * len(out)


def mentions(seed, n):
    """Toxic sentences mostly name one group, harmless ones mostly another."""
    rng, rows = random.Random(seed), []
    plain = ["walk", "garden", "music", "train", "river", "bread", "letter", "window"]
    for i in range(n):
        toxic = i % 3 == 0
        name = rng.choice(["gay", "gay", "gay", "single"]) if toxic else rng.choice(["single", "single", "single", "gay"])
        words = rng.choices(plain, k=6) + ["the", name, "neighbours"] + (["vile", "filth"] if toxic and rng.random() < 0.7 else ["quiet"])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_swaps_take_the_weight_from_names(spark):
    rows = mentions(1, 900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    biased, fair = X.fit(docs, labels, fairness=0.0), X.fit(docs, labels, fairness=5.0)
    neutral = "the gay neighbours walk along the quiet river"

    def change(m):
        return abs(m.score(neutral) - m.score(neutral.replace("gay", "single")))

    assert change(biased) > 0.2 and change(fair) < 0.03
    assert fair.score(neutral) < 0.5 < fair.score("the single neighbours are vile filth")
    again = X.Model.load(fair.frame(spark))
    assert again == fair


def test_only_rows_outside_the_held_out_fifth_are_used(spark):
    rows = mentions(2, 300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    other = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id bigint, toxic int")
    assert X.fit(docs, labels, steps=20) == X.fit(docs, other, steps=20)
    assert X.training_texts(docs, labels, 30).count() == 60


def test_one_text_per_sampled_id(spark):
    # Three ids hold all rows; the sample takes one text of each, the same however the rows lie.
    rows = [(i % 3, f"text number {i} of {i % 3}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id bigint, toxic int")
    got = sorted(X.training_texts(docs, labels, 10).collect())
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(3))
    assert sorted(X.training_texts(docs.repartition(7), labels, 10).collect()) == got


def test_long_texts_add_no_swaps(spark):
    short = "the gay neighbours walk. the single neighbours walk."
    few = X._swaps(spark.createDataFrame([(short, 1)], "text string, toxic int"), X.IDENTITIES)
    many = X._swaps(spark.createDataFrame([(short + " " + short * 500, 1)], "text string, toxic int"), X.IDENTITIES)
    assert len(many) == len(few) and sum(r[2] for r in many) == 501 * sum(r[2] for r in few)


def brute_fit(rows, fairness, sparsity, steps=4000):
    """The same objective by plain proximal steps over whole feature sets."""
    texts = [(y, X.features(X.words_of(t))) for t, y in rows]
    pairs = [p for t, _ in rows for p in X.swaps(t, X.IDENTITIES)]
    names = sorted({f for _, s in texts for f in s if sum(f in u for _, u in texts) >= X.MIN_TEXTS} | {f for p in pairs for x in p for f in x})
    at = {f: k for k, f in enumerate(names)}
    a = np.array([[f in s for f in names] for _, s in texts], float)
    d = np.zeros((len(pairs), len(names)))
    for i, (gain, loss) in enumerate(pairs):
        d[i, [at[f] for f in gain]] = 1
        d[i, [at[f] for f in loss]] = -1
    y = np.array([t[0] for t in texts], float)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b, rate = np.zeros(len(names)), 0.0, 0.02
    for _ in range(steps):
        g = weight * (1 / (1 + np.exp(-(a @ w + b))) - y)
        new = w - rate * (a.T @ g + 2 * fairness / max(len(pairs), 1) * d.T @ (d @ w))
        w, b = np.sign(new) * np.maximum(np.abs(new) - rate * sparsity, 0), b - rate * g.sum()
    z = a @ w + b
    loss = (weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum() + sparsity * np.abs(w).sum() + fairness * ((d @ w) ** 2).mean()

    def value(model):
        v = np.array([model.weights.get(f, 0.0) for f in names])
        u = a @ v + model.bias
        return (weight * np.logaddexp(0, np.where(y == 1, -u, u))).sum() + sparsity * np.abs(v).sum() + fairness * ((d @ v) ** 2).mean()

    return loss, value


def test_fit_reaches_the_minimum_of_its_objective(spark):
    rows = mentions(4, 120)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    seen = [(r["text"], r["toxic"]) for r in X.training_texts(docs, labels).collect()]
    for fairness in (0.0, 2.0):
        loss, value = brute_fit(seen, fairness, 3e-3)
        model = X.fit(docs, labels, fairness=fairness, sparsity=3e-3, steps=800)
        assert value(model) <= loss * 1.01 + 1e-6


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (6, 0), (1, 0), (10, 0), (99, 1)], "doc_id bigint, toxic int")
    for model in (X.fit(odd, labels), X.fit(odd, labels.filter("toxic = 5")), X.Model({"long": 1.0}, -1.0)):
        out = X.score_texts(odd, model).collect()
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in ODD)
        assert len({r["score"] for r in out if r["doc_id"] in (3, 4, 5)}) == 1
        assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
        assert X.score_texts(none, model).count() == 0
    assert X.Model({}, -2000.0).score("x") == 0.0


def test_pipeline_against_its_definition(spark, small, texts, library):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, small)
        seen[name] = docs = spark.createDataFrame(docs.collect(), docs.schema)
    model = X.fit(spark.read.parquet(f"{small}/documents.parquet"), table(spark, small, "labels"))
    left = {i: t for i, t in texts.items() if model.score(t) < 0.5}

    def got(name):
        return {r["doc_id"]: r["text"] for r in seen[name].collect()}

    assert got("toxicity") == left and len(left) < len(texts)
    toxic = {r["doc_id"] for r in table(spark, small, "labels").filter("toxic = 0").collect()}
    assert len(toxic - left.keys()) <= 0.01 * len(toxic)  # clean documents stay
    largest = {}
    for i, t in left.items():
        largest[low(t)] = max(i, largest.get(low(t), i))
    left = {i: left[i] for i in largest.values()}
    assert got("exact_dedup") == left
    left = {i: left[i] for i, (_, root) in brute(left, 5).items() if i == root}
    assert got("near_dedup") == left
    new = got("pii")
    assert new.keys() == left.keys() and any(new[i] != left[i] for i in left)
    assert all(re.sub("[0-9a-zA-Z]", "", new[i]) == re.sub("[0-9a-zA-Z]", "", left[i]) for i in left)
    assert seen["pii"].columns == table(spark, small, "documents").columns
    assert all(r["n_chars"] == len(r["text"]) for r in seen["pii"].collect())
    check_packing(seen["packing"].collect(), new, library)
    whole = P.run(spark, small)
    assert sorted(whole.drop("sequence_id", "offset").collect()) == sorted(seen["packing"].drop("sequence_id", "offset").collect())


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, "card 4111111111111111 here", "a", "b"), (1, "another text of the same id", "c", "d"), (None, "text without an id", "e", "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _pii string, _own_id string")
    assert sorted(r["_own_id"] for r in stages.exact(spark, docs, "").collect()) == ["b", "d", "f"]
    out = stages.private(spark, docs, "").collect()
    assert sorted(r["_pii"] for r in out) == ["a", "c", "e"] and out[0].asDict().keys() == {"doc_id", "text", "_pii", "_own_id"}
