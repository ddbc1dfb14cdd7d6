"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from flowlens.catalog import load

# The text operators are optional and have tests of their own.
CATALOG = load()
QUERIES = {n: f for n, f in entry.queries().items() if n in CATALOG}
SQL = entry.oracle_sql()
# Trained models: fewer rows do not make these quick, so they run once in test_training.
TRAINED = {"gbt_early_stopping", "gbt_train", "mlp_train", "net_train_balanced", "random_forest_nodes", "random_forest_train",
           "cart_tree_binned", "cart_forest"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(0.0 if row[i] == 0 and isinstance(row[i], float) else row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_rows(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    want = rows_of(cols, rel.fetchall())
    assert got == want


def test_only_known_queries_lack_sql():
    assert {n for n in QUERIES if n not in SQL} == TRAINED


def test_flagship(spark, sf):
    out = entry.entry(spark)
    assert {r["split"] for r in out.collect()} == {"train", "val", "test"}
