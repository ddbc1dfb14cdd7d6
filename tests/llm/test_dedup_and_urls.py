"""Exact duplicates, repeated lines and URL rules against SQL and the definitions."""

import hashlib
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from flowlens.llm import exact_dedup as E, line_runs as L, url_filter as U
from flowlens.llm.queries import QUERIES, SQL

from .conftest import ODD


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in sorted(os.listdir(small)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    rel = con.execute(SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep if i is not None and keep is not None else len(ids) == 1, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [E.sha256, lambda t: F.length(t) % 2])
def test_exact_odd_rows_and_equal_digests(odd, none, digest):
    """Texts are compared whole: a digest of two values gives the same groups."""
    out = E.exact_groups(odd, digest=digest)
    assert sorted(map(tuple, out.collect()), key=repr) == brute_groups(ODD)
    assert E.exact_groups(none).count() == 0
    left = sorted(str(r["doc_id"]) for r in E.drop_exact(odd).collect())
    gone = [i for i, k, n, kept, _ in brute_groups(ODD) if i is not None and not kept]
    assert left == sorted(str(i) for i, _ in ODD if i not in gone) and E.drop_exact(odd).columns == odd.columns


def test_hot_text(spark):
    rows = [(i, "the same" if i % 3 else f"other {i}") for i in range(30_000)]
    out = E.exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8))
    assert {tuple(r) for r in out.groupBy("group_size", "kept").count().collect()} == {(20_000, True, 1), (20_000, False, 19_999), (1, True, 10_000)}


def brute_lines(rows):
    rows = [(-1 if i is None else i, t or "") for i, t in rows]
    first = {}
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for line in t.split("\n"):
            k = key(line)
            if len(k) >= 10:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if first.get(key(x), i) == i]
        out.append((None if i == -1 else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fan_out", [(1, 2), (5, 2), (4, 3)])
def test_lines_odd_rows(odd, none, batches, fan_out):
    out = L.dedup_lines(odd, batches=batches, fan_out=fan_out)
    assert sorted(map(tuple, out.collect()), key=repr) == brute_lines(ODD)
    assert L.dedup_lines(none).count() == 0


def test_lines_many_batches(spark):
    rows = [(i, "\n".join(f"this is line {j * i % 37} of many\n  THIS is line {j} OF many \t" for j in range(i % 5 + 1))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, L.dedup_lines(df, batches=7, fan_out=2).collect()), key=repr) == brute_lines(rows)


def test_runs_are_compacted(spark):
    runs = L.LineRuns(spark, buckets=2, fan_out=2)
    for b in range(7):
        runs.add(spark.createDataFrame([(b, bytes([x])) for x in range(b, b + 5)], "doc_id bigint, h binary"))
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    assert {r["h"][0]: r["first_id"] for r in runs.table().collect()} == {x: max(0, x - 4) for x in range(11)}
    runs.drop()


def test_url_cases(spark):
    urls = ["http://A.Example.NET/en/x?y#z", "https://net/a", "http://xnet/", "http://b.example.com/de/1", "http://example.com/de", "no scheme/porn", None, "",
            "http://a.org/fr/porn", "http://a.org/porn", "http://a.org/pornography", "http://a.org/ads/ads", "http://a.org/ads-cheap", "x://?q=xxx", "a://b://c/d", "http://h\n/p\nq",
            "http://cheap_ads.org/"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(df, rules).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[1] == ("net", "/a", "net/", "block")
    assert got[2] == ("xnet", "/", None, "allow") and got[3][2:] == ("example.com/de/", "block") and got[4][2:] == (None, "allow")
    assert got[5] == ("", "", None, "block") and got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2:] == ("org/fr/", "allow") and got[9][3] == "block" and got[10][3] == "allow" and got[11][3] == "allow" and got[12][3] == "block"
    assert got[13] == ("", "", None, "block") and got[14][:2] == ("b:", "//c/d") and got[15][:2] == ("h\n", "/p\nq") and got[16][3] == "block"
    assert U.judge_urls(df.limit(0), rules).count() == 0


def test_stages_tell_rows_of_one_id_apart(spark):
    from flowlens.llm import stages

    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a copied text"), (1, "a text of its own"), (2, "a copied text"), (2, "a copied text"), (None, "a copied text"),
            (None, "without id"), (None, "without id"), (3, words), (3, words + " more"), (3, "far from it"), (None, words + " more still"), (4, "last")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, k int").repartition(3)
    dropped = sorted(((r["doc_id"], r["text"]) for r in E.drop_exact(df).collect()), key=repr)
    assert dropped == sorted([r for r in rows if r not in ((1, "a copied text"), (None, "a copied text"))], key=repr)
    exact = stages.exact(spark, df, None)
    assert exact.columns == df.columns
    left = [(1, "a text of its own"), (2, "a copied text"), (None, "without id"), (3, words), (3, words + " more"), (3, "far from it"),
            (None, words + " more still"), (4, "last")]
    assert sorted(((r["doc_id"], r["text"]) for r in exact.collect()), key=repr) == sorted(left, key=repr)
    near = stages.near(spark, exact, None)
    assert near.columns == df.columns and near.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    left = [r for r in left if r not in ((3, words), (3, words + " more"))]
    assert sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=repr) == sorted(left, key=repr)
