"""Stages of the corpus pipeline: (spark, docs, sf_dir) to the documents that stay, with all their columns; the last one packs them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import exact_dedup, near_dedup, packing, pii, toxicity as tox
from .common import staged
from .queries import PSEUDONYM_KEY, table, tokenizer


def toxicity(spark, docs, sf_dir):
    """Documents that the classifier, fitted on the labels, rejects go."""
    model = tox.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(tox.toxicity(model)(F.col("text")) < 0.5)


def _fresh(docs, name):
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _by_row(docs, drop):
    """``drop`` on a table whose doc_id names one row each.

    Where an id is null or repeated, the rows are numbered in the order of doc_id, null ones first, then text, and
    the numbers stand for the ids. They are written once, so a task that runs again meets the same ones.
    """
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty():
        return drop(docs)
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_first(), F.sha2("text", 256))
    own = _fresh(docs, "_own_id")
    rows = staged(ordered.withColumn(own, F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id()), "rows")
    return drop(rows).withColumn("doc_id", F.col(own)).drop(own)


def exact(spark, docs, sf_dir):
    """One row of each group of equal texts stays, the one with the largest doc_id."""
    return _by_row(docs, exact_dedup.drop_exact)


def near(spark, docs, sf_dir):
    """One row of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    def drop(rows):
        gone = near_dedup.near_groups(rows).filter("NOT kept").select(F.col("doc_id").alias("_gone"))
        return rows.join(gone, rows["doc_id"] == gone["_gone"], "left_anti")

    return _by_row(docs, drop)


def private(spark, docs, sf_dir):
    """Personal data become pseudonyms; n_chars follows the new text where the table has it."""
    found = _fresh(docs, "_pii")
    out = pii.pseudonymise(docs, PSEUDONYM_KEY, count_col=found).drop(found)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark, docs, sf_dir):
    """Pieces of the documents in token sequences: the columns of ``packing.pack_pieces``, no other column is kept."""
    return packing.pack_pieces(packing.token_pieces(docs, tokenizer()))
