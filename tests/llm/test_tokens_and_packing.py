"""Token files and packing against the library and by their invariants."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import packing as K, token_files as T
from flowlens.llm.queries import QUERIES

from .conftest import ODD


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_query_equals_library(spark, small, texts, library):
    rows = {r["doc_id"]: r for r in QUERIES["op5_token_files"](spark, small).collect()}
    assert len(rows) == len(texts)
    at = 0
    for i in sorted(texts):
        ids = ids_of(library, texts[i])
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_files_have_set_groups_encodings_and_page_indexes(spark, small, vocab, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    T.write_tokens(spark.read.parquet(f"{small}/documents.parquet"), path, vocab, partitions=2, row_group_bytes=1 << 20, page_bytes=64 << 10, page_rows=50)
    files = sorted((tmp_path / "tokens").glob("*.parquet"))
    assert len(files) == 2
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(5)}
            assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings and cols["doc_id"].has_column_index and cols["doc_id"].has_offset_index
            assert any("DICTIONARY" in e for e in cols["tokens.list.element"].encodings)
    part = T.read_tokens(spark, path, 100, 120)
    assert "GreaterThanOrEqual(doc_id,100)" in part._jdf.queryExecution().toString()
    whole = {r["doc_id"]: r for r in T.read_tokens(spark, path).collect()}
    assert {r["doc_id"]: r for r in part.collect()} == {i: r for i, r in whole.items() if 100 <= i <= 120}
    index = T.read_index(spark, path)
    assert "tokens" not in index._jdf.queryExecution().executedPlan().toString().replace("n_tokens", "").replace("/tokens", "")
    assert {(r["doc_id"], r["start"], r["n_tokens"]) for r in index.collect()} == {(i, r["start"], r["n_tokens"]) for i, r in whole.items()}


def test_token_files_odd_rows(spark, odd, none, vocab, library, tmp_path):
    T.write_tokens(odd, str(tmp_path / "a"), vocab)
    rows = T.read_tokens(spark, str(tmp_path / "a")).collect()
    assert sorted((str(r["doc_id"]), r["tokens"]) for r in rows) == sorted((str(i), ids_of(library, t)) for i, t in ODD)
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    key = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert key == sorted(key)
    T.write_tokens(none, str(tmp_path / "b"), vocab)
    assert T.checksums(T.read_tokens(spark, str(tmp_path / "b"))).count() == 0


def check_packing(rows, texts, library, capacity=2048):
    """Every document is covered by its pieces; every sequence is gapless from 0 and not too long."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_doc.keys() == texts.keys()
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        ids, at = ids_of(library, texts[i]), 0
        assert len(ids) > capacity or len(pieces) == 1
        for n, r in enumerate(pieces):
            assert r["piece"] == n and r["start"] == at and r["ids_crc32"] == crc(ids[at:at + r["length"]])
            assert r["length"] == capacity or n == 0
            at += r["length"]
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def test_packing_query(spark, small, texts, library):
    df = QUERIES["op6_best_fit_packing"](spark, small)
    used = check_packing(df.collect(), texts, library)
    bins, bound = K.certified(df)
    assert bins == used and bound <= used <= 1.01 * bound + 1


def test_exchange_closes_gaps(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 101, 3000))]
    df = spark.createDataFrame(rows, K.PIECES)
    once = K.certified(K.pack_pieces(df, 100, group_pieces=100, rounds=0), 100)
    more = K.certified(K.pack_pieces(df, 100, group_pieces=100, rounds=3), 100)
    assert more[0] < once[0] and more[1] == once[1] <= more[0]


def fewest(lengths, capacity):
    """The least number of bins, by trying every placing."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                place(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1:]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def cut(n, capacity):
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(i, capacity) for i in range(first, n, capacity)]


def test_cuts():
    sizes = np.array([5000, 4096, 1, 2048, 2049, 6144, 10_000])
    row, piece, start, length = (x.tolist() for x in K.cuts(sizes, 2048))
    want = [(i, k, *c) for i, n in enumerate(sizes.tolist()) for k, c in enumerate(cut(n, 2048))]
    assert list(zip(row, piece, start, length)) == want
    assert cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and cut(4096, 2048) == [(0, 2048), (2048, 2048)]


def test_equal_rows_do_not_meet_in_one_group(spark):
    # Two thirds of the pieces are equal in every column and have no id.
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, id, null) AS doc_id", "0 AS piece", "0L AS start", "100L + if(id % 3 = 0, id % 900, 0) AS length",
                                          "if(id % 3 = 0, id, 7L) AS ids_crc32").withColumn("piece", F.col("piece").cast("int"))
    dealt, groups = K.dealt_pieces(rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(K.NO_ID))), 0, 30, 1000)
    sizes = [r["count"] for r in dealt.groupBy("_group").count().collect()]
    assert sum(sizes) == 30_000 and max(sizes) < 2000 and len(sizes) <= groups
    out = K.pack_pieces(rows, group_pieces=1000, rounds=None).cache()
    assert out.count() == 30_000
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fill.filter("n > 2048 OR n <> end").isEmpty()
    used, bound = K.certified(out)
    assert used <= bound * 1.02 + 1


def test_exchange_goes_on_while_it_saves(spark):
    rng = np.random.default_rng(3)
    pdf = [(int(i), 0, 0, int(n), int(i)) for i, n in enumerate(rng.integers(600, 1400, 4000))]
    rows = spark.createDataFrame(pdf, K.PIECES)
    used = {r: K.certified(K.pack_pieces(rows, group_pieces=150, rounds=r))[0] for r in (0, 2, None)}
    assert used[None] <= used[2] <= used[0]


def test_lower_bound_is_sound_and_best_fit_near():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = sorted(rng.integers(1, 21, 7).tolist(), reverse=True)
        best = fewest(lengths, 20)
        bound = K.lower_bound(np.bincount(lengths, minlength=21), 20)
        bins, offsets = K.best_fit(np.array(lengths), 20)
        assert bound <= best <= bins.max() + 1
    assert K.lower_bound(np.bincount([11] * 5, minlength=21), 20) == 5


def test_packing_odd_rows(odd, none, vocab, library):
    out = K.pack_pieces(K.token_pieces(odd, vocab, with_ids=True))
    rows = out.collect()
    want = [len(cut(len(ids_of(library, t)), 2048)) for _, t in ODD]
    assert len(rows) == sum(want) and sum(r["length"] for r in rows) == sum(len(ids_of(library, t)) for _, t in ODD)
    assert any(r["doc_id"] is None for r in rows)
    for r in K.sequences(out).collect():
        assert len(r["ids"]) == sum(x["length"] for x in rows if x["sequence_id"] == r["sequence_id"]) <= 2048
    assert K.pack_pieces(K.token_pieces(none, vocab)).count() == 0
