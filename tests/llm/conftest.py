from pathlib import Path

import pytest

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).is_dir():
        pytest.skip("test tables are not here")
    return SMALL


@pytest.fixture(scope="session")
def vocab():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def library(vocab):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab)


# Nulls, empty and very long texts, ties, repeated rows; the extra columns clash with names used inside.
ODD = [(1, "Same text here that is long enough to count"), (2, "same TEXT here that is long enough to count"), (3, None), (4, ""), (5, "   "),
       (6, "word " * 30_000), (6, "word " * 30_000), (7, "x" * 200_000), (8, "one"), (9, "one two"), (9, "three four"), (None, "no id at all here"),
       (10, "Ünïcode é 日本語 text\nwith lines\n\nand more"), (11, "a\x00b <|endoftext|> c  d \n e"), (12, "Line number one is here\nLine number one is here")]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "n", "k", 1, "s", "r") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, node string, key string, size int, salt string, norm string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, h string")


@pytest.fixture(scope="session")
def texts(spark, small):
    return {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
