"""Feature projection and label handling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import expr as X
from ..plans.ranking import number_rows
from ..plans.small import attach, settle

# Identifier columns, with spaces or underscores. Fixed values.
IDENTIFIERS = ("Flow ID", "Source IP", "Source Port", "Destination IP", "Destination Port", "Timestamp")


def find_label(df: DataFrame, label: str = "Label") -> str:
    """The column whose trimmed name is ``label``."""
    for c in df.columns:
        if c.strip() == label:
            return c
    raise ValueError(f"no column named {label!r}")


def project_features(df: DataFrame, label: str = "Label",
                     exclude: Iterable[str] = IDENTIFIERS) -> DataFrame:
    """Drop identifier columns, keep features and the label (as ``label``)."""
    found = find_label(df, label)
    banned = {e.strip().replace(" ", "_") for e in exclude}
    keep = [c for c in df.columns
            if c != found and c.strip().replace(" ", "_") not in banned]
    return df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in keep], F.col(f"`{found}`").alias(label))


def numeric_columns(df: DataFrame, order: Sequence[str], cols: Sequence[str],
                    sample: int = 200, share: float = 0.8) -> DataFrame:
    """Per column, the share of the first ``sample`` values that read as numbers.

    The first rows come from a top-k, not a sort; one aggregate covers all columns.
    """
    head = df.orderBy(*order).limit(sample)
    agg = head.agg(*[F.avg(X.is_number(F.col(c)).cast("double")).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit(0.0)).alias("numeric_share"))
                      for c in cols])
    return (agg.select(F.explode(pairs).alias("p")).select("p.*")
            .withColumn("is_numeric", (F.col("numeric_share") >= share).cast("int")))


def encode_labels(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Classes in text order become 0..k-1."""
    return attach(df, label_classes(df, col, out), [col], "left")


def label_classes(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Class table: one row per distinct class, numbered 0.. in text order.

    A short class list is numbered in one task; a long one is sorted by ranges,
    stored, and numbered from the row counts of its partitions.
    """
    classes, small = settle(df.select(col).distinct())
    text = F.col(col).cast("string")
    if small:
        return classes.withColumn(out, F.row_number().over(Window.orderBy(text)) - 1)
    ordered = classes.orderBy(text).checkpoint()
    return number_rows(ordered, "_no").select(col, (F.col("_no") - 1).alias(out))


def decode_labels(df: DataFrame, classes: DataFrame, code: str) -> DataFrame:
    return attach(df, classes, [code], "left")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and percent per class, most frequent first."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    counts, _ = settle(counts)  # one scan
    total = float(counts.agg(F.sum("n")).first()[0] or 0)
    return counts.withColumn("pct", F.col("n") * 100.0 / F.lit(total)).orderBy(F.desc("n"), label)


def clean_summary(df: DataFrame, y: Column, n_features: int) -> DataFrame:
    n = F.count(F.lit(1))
    pos = F.sum(F.when(y == 1, 1).otherwise(0))
    neg = F.sum(F.when(y == 0, 1).otherwise(0))
    return df.agg(n.alias("n_rows"), F.lit(n_features).alias("n_features"), neg.alias("benign"),
                  pos.alias("attack"), (neg * 100.0 / n).alias("benign_pct"), (pos * 100.0 / n).alias("attack_pct"))


def label_values(df: DataFrame, label: str, limit: int = 10) -> DataFrame:
    """Up to ``limit`` distinct trimmed label texts."""
    return df.select(F.trim(F.col(label)).alias("label_value")).distinct().orderBy("label_value").limit(limit)
