"""Repeated lines against levelled sorted runs of line hashes.

A run is a table of line hashes with the document that first held each, bucketed and sorted by hash. A batch of
documents takes the hashes that no run holds (an anti-join by merging, for which the runs need no shuffle) and
adds them as a run of the lowest level. ``fan_out`` runs of a level are merged into one of the next level, so
the number of runs stays logarithmic in the number of batches. DataFrame functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.small import scratch_path
from .common import SPACES, ascii_lower, remove, staged

BATCHES, FAN_OUT, MIN_CHARS = 6, 3, 10
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def text_lines(text: Column) -> Column:
    """Lines of a text; null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, tid (hash of the text), pos, h: lines whose key has at least ``min_chars`` code points, by 128-bit hash."""
    lines = rows.select("doc_id", F.xxhash64("text").alias("tid"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "tid", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "tid", "pos", F.unhex(F.md5("key")).alias("h"))


class LineRuns:
    """The runs of one corpus: tables in the cluster's shared folder, under names of their own until ``drop``."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_out: int = FAN_OUT) -> None:
        self.spark, self.fan_out = spark, fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.made = f"line_runs_{uuid.uuid4().hex}", 0
        self.levels: list[list[str]] = []
        self.root = scratch_path(spark, "runs")

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        (rows.repartition(self.buckets, "h").write.format("parquet").option("path", f"{self.root}/{table}")
         .bucketBy(self.buckets, "h").sortBy("h").saveAsTable(table))
        return table

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")
        remove(self.spark, f"{self.root}/{table}")

    def table(self) -> DataFrame | None:
        """(h, first_id) of every line seen so far."""
        out = None
        for table in (t for level in self.levels for t in level):
            run = self.spark.table(table)
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, lines: DataFrame) -> None:
        """Take a batch of keyed lines whose doc_ids are not below those of earlier batches."""
        new = lines.groupBy("h").agg(F.min("doc_id").alias("first_id"))
        for table in (t for level in self.levels for t in level):
            new = new.join(self.spark.table(table).select("h").hint("merge"), "h", "left_anti")
        self._put(0, self._write(new))

    def _put(self, level: int, table: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) == self.fan_out:
            full, self.levels[level] = self.levels[level], []
            merged = None
            for t in full:  # runs share no hash
                run = self.spark.table(t)
                merged = run if merged is None else merged.unionByName(run)
            self._put(level + 1, self._write(merged))
            for t in full:
                self._drop(t)

    def drop(self) -> None:
        for table in (t for level in self.levels for t in level):
            self._drop(table)
        self.levels = []


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fan_out: int = FAN_OUT, min_chars: int = MIN_CHARS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every document.

    A key found in several documents keeps its lines in the smallest doc_id only; shorter keys always stay.
    Documents go through the runs in ``batches`` ranges of doc_id. Null or empty texts have one line, which
    stays. A null doc_id counts as one more document below all others. Rows that repeat a doc_id are one
    document to the rule: if it holds a line first, all its rows keep it. An empty table gives an empty one;
    other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    edges = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = sum((F.when(F.col("doc_id") > e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    lines = staged(keyed_lines(rows, min_chars).withColumn("batch", batch), "lines")
    runs = LineRuns(spark, fan_out=fan_out)
    for i in range(len(set(edges)) + 1):
        runs.add(lines.filter(F.col("batch") == i).select("doc_id", "h"))
    # A document owns the lines it was the first to hold. (h, doc_id) is unique in the runs, so that no hash,
    # however common, makes a large task.
    owned = staged(runs.table().select(F.col("first_id").alias("doc_id"), "h", F.lit(True).alias("own")), "owned")
    runs.drop()
    marked = lines.join(owned, ["doc_id", "h"], "left_anti")
    # One set of positions per document, at most as many as it has lines.
    gone = marked.groupBy("doc_id", "tid").agg(F.collect_set("pos").alias("gone"))
    texts = (rows.withColumn("tid", F.xxhash64("text")).join(gone, ["doc_id", "tid"], "left")
             .withColumn("lines", text_lines(F.col("text"))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return texts.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.size("lines").cast("long").alias("n_lines"),
                        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("text"))
