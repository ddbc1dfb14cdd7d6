"""Exact duplicates without a hot task: local, salted, then global combining on whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, lookup, staged

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normalised(text: Column) -> Column:
    """Null counts as empty; A-Z are lower-cased, nothing else changes."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def text_groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, norm, keep_id (largest doc_id), group_size; from doc_id, digest, norm.

    Each task first merges its own copies, what is left of a text meets by (salt, digest, text), and the winners
    of the salts meet by (digest, text). Texts are compared whole each time, so two texts of one digest stay
    apart. A text with a third of all rows sends one row per task and salt.
    """
    salted = (rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).groupBy("salt", "digest", "norm")
              .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
    return salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest
    doc_id of a group stays. A null doc_id is smaller than any other; in a group where every doc_id is null,
    keep_id is null and all rows have kept = false, but for groups of one row. Repeated rows with the largest
    doc_id all have kept = true, as they share the id. An empty table gives an empty one; other columns are
    not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    groups = text_groups(rows, salts)
    # A digest that stands for one text only, as whole texts have shown, is as good as the text from here on.
    found = staged(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"),
                                                F.sum("group_size").alias("group_size")), "exact")
    slim = rows.select("doc_id", "digest", F.sha2("norm", 256).alias("text_sha256"))
    clash = found.filter("texts > 1").select("digest")
    if clash.isEmpty():
        out = lookup(slim, found.drop("texts"), ["digest"], "group_size")
    else:
        apart = lookup(rows.join(clash, "digest", "left_semi"), staged(groups.join(clash, "digest", "left_semi"), "clash"),
                       ["digest", "norm"], "group_size")
        out = (lookup(slim.join(clash, "digest", "left_anti"), found.filter("texts = 1").drop("texts"), ["digest"], "group_size")
               .unionByName(apart.withColumn("text_sha256", F.sha2("norm", 256)).drop("norm")))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("group_size") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """``docs`` without the rows whose text a row with a larger doc_id has too, all columns kept.

    A row goes by its doc_id and its text, so other texts of the same doc_id stay. Rows without a doc_id go where
    a row with one has their text. Rows equal in doc_id and text all stay or all go.
    """
    gone = exact_groups(docs, salts).filter("NOT doc_id <=> keep_id").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_gone_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]) & (F.sha2(normalised(docs["text"]), 256) == gone["_gone_text"])
    return docs.join(gone, same, "left_anti")
