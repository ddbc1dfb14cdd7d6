"""Shards by the two-pass shuffle: whole rows, exact sizes, a seeded and even order."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import external_shuffle as X
from flowlens.llm.queries import QUERIES

from .conftest import ODD


def check_law(rows, shards):
    """rows of (shard, slot): counts at most one apart, slots without gaps."""
    by = {}
    for shard, slot in rows:
        by.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(0 <= k < shards for k in by)
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_query(spark, small, texts):
    rows = QUERIES["op11_external_shuffle"](spark, small).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    assert len(rows) == len(texts) and {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    check_law([(r["shard"], r["slot"]) for r in rows], 40)


def shuffled(spark, df, path, **given):
    X.write_shards(df, str(path), **given)
    return X.read_shards(spark, str(path))


def test_order_depends_on_rows_and_seed_alone(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    order = lambda df: [r["doc_id"] for r in sorted(df.select("shard", "slot", "doc_id").collect())]
    first = order(shuffled(spark, docs, tmp_path / "a", shards=7, seed=1, bucket_bytes=200_000))
    assert order(shuffled(spark, docs.repartition(13), tmp_path / "b", shards=7, seed=1, bucket_bytes=200_000)) == first
    assert order(shuffled(spark, docs, tmp_path / "c", shards=7, seed=2, bucket_bytes=200_000)) != first
    # Files hold the rows in order, in folders by shard.
    whole = X.read_shards(spark, str(tmp_path / "a"))
    assert sorted(whole.columns) == sorted([*docs.columns, "shard", "slot"])
    assert whole.drop("shard", "slot").exceptAll(docs).isEmpty() and whole.count() == docs.count()
    # A random order: neighbours in it are no neighbours by number, and every shard has rows of every part of the table.
    ids = np.argsort(np.argsort(first))
    assert abs(np.corrcoef(ids[:-1], ids[1:])[0, 1]) < 0.15 and abs(np.corrcoef(np.arange(len(ids)), ids)[0, 1]) < 0.15
    assert np.mean(np.abs(np.diff(ids)) == 1) < 0.02


def test_hot_rows_are_dealt_again(spark, tmp_path):
    # A third of all rows are equal, so one bucket overflows; nothing is lost and no task holds them all.
    rows = [(None, "same text " * 10)] * 2000 + [(i, f"own text {i} " * 10) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = shuffled(spark, df, tmp_path / "hot", shards=11, bucket_bytes=40_000)
    got = out.collect()
    check_law([(r["shard"], r["slot"]) for r in got], 11)
    assert sorted(((str(r["doc_id"]), r["text"]) for r in got)) == sorted((str(i), t) for i, t in rows)
    # The equal rows are spread over many buckets, so they do not sit in one stretch of the order.
    order = [r["doc_id"] is None for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert max(len(s) for s in "".join("x" if o else " " for o in order).split()) < 1000


def test_first_places_are_even(spark, tmp_path):
    df = spark.range(4).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    first = [shuffled(spark, df, tmp_path / str(s), shards=1, seed=s, bucket_bytes=1 << 20).filter("slot = 0").first()["doc_id"] for s in range(24)]
    assert set(first) == {0, 1, 2, 3}


def test_odd_rows(spark, odd, none, tmp_path):
    got = shuffled(spark, odd, tmp_path / "odd", shards=40).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(i), str(t)) for i, t in ODD)
    check_law([(r["shard"], r["slot"]) for r in got], 40)
    assert {r["node"] for r in got} == {"n"}
    assert shuffled(spark, none, tmp_path / "none", shards=3).count() == 0
    with pytest.raises(ValueError):
        X.write_shards(none.withColumn("slot", F.lit(1)), str(tmp_path / "x"), shards=3)


def test_shard_of():
    for rows, shards in ((0, 3), (2, 5), (10, 3), (12, 4), (41, 40)):
        shard, slot = X.shard_of(np.arange(rows), rows, shards)
        check_law(list(zip(shard.tolist(), slot.tolist())), shards)
        assert (np.diff(shard) >= 0).all()
