"""Streams: empty sources, restarts, exact limits."""

import pytest
from pyspark.sql import functions as F

from flowlens.streaming import score as K

SCHEMA = "id bigint, y int"


@pytest.fixture
def source(spark, tmp_path):
    path = tmp_path / "source"
    path.mkdir()

    def add(first, n, files=1):
        spark.range(first, first + n).selectExpr("id", "cast(id % 2 as int) AS y").repartition(files).write.mode("append").parquet(str(path))

    return str(path), add


def stream(spark, path):
    return K.open_stream(spark, path, SCHEMA)


def test_a_stream_without_files_ends(spark, source):
    path, _ = source
    assert K.drain(stream(spark, path), "d").count() == 0
    assert K.take(stream(spark, path), "t", 5).count() == 0
    assert K.running_accuracy(stream(spark, path), F.col("y"), F.lit(1), "a").first().asDict() == {"seen": 0, "correct": 0, "accuracy": 0.0}


def test_a_restart_goes_on(spark, source, tmp_path):
    path, add = source
    add(0, 30, 3)
    state = str(tmp_path / "state")
    assert K.take(stream(spark, path), "t", 45, state=f"{state}/t").count() == 30
    assert K.running_accuracy(stream(spark, path), F.col("y"), F.lit(1), "a", state=f"{state}/a").first()["seen"] == 30
    add(30, 40, 2)
    out = K.take(stream(spark, path), "t", 45, state=f"{state}/t")
    assert out.count() == out.distinct().count() == 45
    assert K.take(stream(spark, path), "t", 45, state=f"{state}/t").count() == 45
    after = K.running_accuracy(stream(spark, path), F.col("y"), F.lit(1), "a", state=f"{state}/a").first()
    assert (after["seen"], after["correct"]) == (70, 35)


def test_first_rows_are_cut_by_partition(spark):
    df = spark.range(0, 100, 1, 7)
    for n in (0, 1, 14, 15, 57, 100, 1000):
        assert sorted(r["id"] for r in K.first_rows(df, n).collect()) == list(range(min(n, 100)))
