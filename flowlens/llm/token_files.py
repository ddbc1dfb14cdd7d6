"""Token ids in Parquet files that allow selective reads.

One row per document: ids as a list column in dictionary encoding, document ids and counts beside it in delta
encoding. Row groups and pages have a set size; Parquet's page indexes then let a filter on the document id
read a few pages, and a query on counts never opens the ids.
"""

from __future__ import annotations

import sys

from pyspark import TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import release_arrow
from .tokens import library_encoder, sliced

register_pickle_by_value(sys.modules[__name__])

ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 500


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, partitions: int | None = None,
                 row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the documents in ascending id order.

    Files hold consecutive id ranges: (part, doc_id, part_start, n_tokens, tokens), part_start counted inside
    the part. A null text is empty and gives the end id alone. Null ids come first; rows with equal ids are
    ordered by their text. An empty table gives files without rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The hash spreads rows that share one id over several ranges.
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        encoder, part, run = library_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, texts in sliced(batch):
                ids, offsets = encoder.encode_ended(texts, end_id)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(texts), part, np.int32)), rows.column(0), pa.array(run + offsets[:-1]), pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view("<i4")))],
                    ["part", "doc_id", "part_start", "n_tokens", "tokens"])
                run += int(offsets[-1])
        release_arrow()

    out = ranged.sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(
        encode, "part int, doc_id bigint, part_start bigint, n_tokens bigint, tokens array<int>")
    (out.write.option("parquet.writer.version", "v2").option("parquet.block.size", row_group_bytes)
     .option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
     .option("parquet.enable.dictionary", "true").option("parquet.enable.dictionary#doc_id", "false")
     .option("parquet.enable.dictionary#part_start", "false").option("parquet.enable.dictionary#n_tokens", "false")
     .option("compression", "zstd").parquet(path))


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """First position of each part: one row per written partition, as many as the writer was told to make."""
    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    rows, run = [], 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        rows.append((r["part"], run))
        run += r["n"]
    return spark.createDataFrame(rows, "part int, _before bigint")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens of every document; reads the counts only."""
    files = spark.read.parquet(path).select("part", "doc_id", "part_start", "n_tokens")
    placed = files.join(F.broadcast(_starts(spark, path)), "part")
    return placed.select("doc_id", (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, tokens, for ids from ``first`` to ``last``; other pages are skipped."""
    files = spark.read.parquet(path)
    if first is not None:
        files = files.filter(F.col("doc_id") >= first)
    if last is not None:
        files = files.filter(F.col("doc_id") <= last)
    placed = files.join(F.broadcast(_starts(spark, path)), "part")
    return placed.select("doc_id", (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens", "tokens")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers, from read_tokens."""

    def crc(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column(3)
            values, at = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[i:j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.array(sums, np.int64))],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(crc, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
