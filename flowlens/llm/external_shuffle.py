"""A uniform random order of all rows in two passes, cut into shards.

Pass one scatters the rows by a seeded hash into buckets that fit in a task's memory. Pass two puts each bucket in
order by a Fisher-Yates shuffle and writes it. The buckets one after another are a random permutation of the table; shards are
equal cuts of it, so the numbers of rows differ by one at most whatever the sizes of the buckets.

The place of a row depends on the seed, the bucket size and the rows, not on how the table was partitioned. Where a
bucket overflows (many rows with equal id and text), its rows are written once and dealt again by their place in those files.
"""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..plans.small import attach
from .common import release_arrow, staged

register_pickle_by_value(sys.modules[__name__])

BUCKET_BYTES = 32 << 20
ROW_BYTES = 16
# A bucket above so many times its size is dealt again.
OVERFLOW = 2
# Buckets whose numbers of rows are summed up in one task, on the way to the rows before each bucket.
CHUNK = 4096
OWN = ("_bucket", "_hash", "_tie", "_before", "_first")


def _before(counts: DataFrame) -> DataFrame:
    """(_bucket, _before): rows in earlier buckets, by sums over chunks of buckets; from (_bucket, n)."""
    chunked = counts.withColumn("_chunk", F.floor(F.col("_bucket") / CHUNK))
    chunks = chunked.groupBy("_chunk").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy("_chunk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per 4,096 buckets.
    along = Window.partitionBy(F.lit(0)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select("_chunk", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("_base"))
    return (chunked.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, "_chunk")
            .select("_bucket", (F.col("_base") + F.col("_in")).alias("_before")))


def shard_of(place, rows: int, shards: int):
    """(shard, slot) of places 0..rows-1: the first rows % shards shards hold one row more."""
    import numpy as np

    size, longer = divmod(rows, shards)
    edge = longer * (size + 1)
    rest = np.maximum(place - edge, 0)
    early = place < edge
    shard = np.where(early, place // (size + 1), longer + rest // max(size, 1))
    return shard, np.where(early, place % (size + 1), rest % max(size, 1))


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Shuffle ``docs`` and write folders shard=0 to shard=(shards-1) of Parquet files, rows in the order of ``slot``.

    All columns are kept; ``shard`` and ``slot`` (from 0 in each shard, without gaps) are added, so the table must not have
    columns of these names, nor of those in OWN: ValueError otherwise. Null ids and null texts are rows like any other. Rows equal
    in id and text keep an order given by the other columns that can be hashed; rows equal in all are interchangeable. An
    empty table gives no files with rows, fewer rows than shards leave the last shards empty. ``docs`` must give the
    same rows each time it is read.
    """
    if taken := {"shard", "slot", *OWN} & set(docs.columns):
        raise ValueError(f"columns in use: {sorted(taken)}")
    names = docs.columns
    others = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES
    total, rows = docs.agg(F.sum(size), F.count(F.lit(1))).first()
    if not rows:
        docs.withColumn("slot", F.lit(0).cast("long")).write.parquet(f"{path}/shard=0")
        return
    buckets = -(-total // bucket_bytes)
    marked = docs.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    # Other bits than those that order the rows of a bucket.
    marked = marked.withColumn("_bucket", F.pmod(F.xxhash64("_hash"), F.lit(buckets)))
    counts = staged(marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")), "buckets")
    over = counts.filter(F.col("size") > OVERFLOW * bucket_bytes).select("_bucket", F.ceil(F.col("size") / bucket_bytes).alias("_parts"))
    overflow = not over.isEmpty()
    if overflow:
        # At most one bucket in two is that large. Their rows get a fixed place, which parts even equal rows.
        first = over.agg(F.max("_parts")).first()[0]
        again = staged(attach(marked, over, ["_bucket"], "inner").withColumn("_place", F.monotonically_increasing_id()), "overflow")
        own = buckets + F.col("_bucket") * first + F.pmod(F.xxhash64(F.lit(seed), "_hash", "_place"), F.col("_parts"))
        again = again.withColumn("_bucket", own).drop("_parts", "_place")
        marked = attach(marked, over.select("_bucket"), ["_bucket"], "left_anti").unionByName(again)
        counts = staged(marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    used = counts.count()
    # Buckets are numbered without gaps and get a task each.
    number = _before(counts.select("_bucket", F.lit(1).alias("n"))).withColumnRenamed("_before", "_number")
    heads = _before(counts).join(number, "_bucket")
    if overflow or used < buckets:
        marked = attach(marked, staged(number, "numbers"), ["_bucket"]).drop("_bucket").withColumnRenamed("_number", "_bucket")
    # Each task learns the rows before its bucket from one row more, sent along with the others.
    first = heads.select(F.col("_number").alias("_bucket"), F.col("_before").alias("_first"))
    dealt = (marked.withColumn("_tie", F.xxhash64(*others)).unionByName(first, allowMissingColumns=True)
             .repartitionById(used, F.col("_bucket").cast("int")))
    schema = StructType([*docs.schema.fields, StructField("slot", LongType()), StructField("shard", IntegerType())])

    def shuffle(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held = pa.Table.from_batches(list(batches))
        if not held.num_rows:
            return
        mark = pc.index(pc.is_valid(held.column("_first")), True).as_py()
        before, bucket = held.column("_first")[mark].as_py(), held.column("_bucket")[mark].as_py()
        hashes, ties = (held.column(c).fill_null(0).to_numpy() for c in ("_hash", "_tie"))
        # The same order whatever way the rows came; then every order is as likely as any other.
        order = np.lexsort((ties, hashes))
        order = order[order != mark]
        np.random.Generator(np.random.PCG64([seed & (1 << 64) - 1, bucket])).shuffle(order)  # Fisher-Yates
        shard, slot = shard_of(before + np.arange(len(order)), rows, shards)
        out = held.select(names).combine_chunks().take(pa.array(order))
        out = out.append_column("slot", pa.array(slot)).append_column("shard", pa.array(shard.astype(np.int32)))
        yield from out.to_batches(max_chunksize=2000)
        del held, out
        release_arrow()

    done = dealt.mapInArrow(shuffle, schema).sortWithinPartitions("shard", "slot")
    done.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``slot`` and ``shard``; a filter on ``shard`` reads that folder alone."""
    return spark.read.parquet(path)
