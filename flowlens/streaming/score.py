"""Scoring a stream of records and counting hits as it goes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.small import scratch_path


def open_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """New files of a folder (or glob) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(stream: DataFrame, label: str, timeout: int = 600) -> DataFrame:
    """Process everything available, then stop; rows land in files with exactly-once commits. A stream without files gives no rows."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    _empty(spark, f"{out}/data")
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
             .trigger(availableNow=True).start())
    _finish(query, timeout)
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def _empty(spark: SparkSession, path: str) -> None:
    """A folder that reads as no rows until a query writes there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def _kept(spark: SparkSession, out: str) -> DataFrame:
    """(epoch, n) of the batches that have been kept, as written with them."""
    return spark.read.schema("epoch bigint, n bigint").parquet(f"{out}/counts")


def take(stream: DataFrame, label: str, records: int, timeout: int = 600, state: str | None = None) -> DataFrame:
    """Stop after ``records`` records, or at the end of what is available; rows as they arrived.

    ``state`` names a folder to go on from: the batches done and the records kept are stored there with the rows, so a restarted
    job keeps exactly ``records`` in all. A batch that overruns the rest is cut by running counts of its
    partitions, each in its own task. A stream without files gives no rows.
    """
    spark = stream.sparkSession
    out = state or scratch_path(spark, label)
    for part in ("data", "counts"):
        _empty(spark, f"{out}/{part}")

    def keep(batch: DataFrame, epoch: int) -> None:
        # A batch that runs again after a restart replaces what it had written.
        left = records - (_kept(spark, out).filter(F.col("epoch") != epoch).agg(F.sum("n")).first()[0] or 0)
        if left <= 0:
            return
        path = f"{out}/data/epoch={epoch}"
        first_rows(batch, left).write.mode("overwrite").parquet(path)
        n = spark.read.schema(stream.schema).parquet(path).count()
        spark.range(1).select(F.lit(epoch).cast("bigint").alias("epoch"), F.lit(n).cast("bigint").alias("n")).write.mode("overwrite").parquet(f"{out}/counts/batch={epoch}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    try:
        waited = 0
        while not query.awaitTermination(1):
            waited += 1
            if (_kept(spark, out).agg(F.sum("n")).first()[0] or 0) >= records:
                break
            if waited > timeout:
                raise TimeoutError("stream did not drain in time")
    finally:
        query.stop()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{out}/data")


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """``n`` rows, those of the first partitions: whole partitions and the beginning of one, each cut in its own task."""
    at = F.spark_partition_id()
    counts = {r["p"]: r["n"] for r in df.groupBy(at.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per partition
    ends, left = [], n
    for p in sorted(counts):
        if left <= 0:
            break
        ends.append((p, min(left, counts[p])))
        left -= counts[p]
    if not ends:
        return df.limit(0)
    whole, (last, upto) = [p for p, k in ends if k == counts[p]], ends[-1]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    marked = df.withColumns({"_p": at, "_place": place})
    through = max(whole, default=-1)
    return marked.filter((F.col("_p") <= through) | ((F.col("_p") == last) & (F.col("_place") < upto))).drop("_p", "_place")


def _finish(query, timeout: int) -> None:
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError("stream did not drain in time")
    finally:
        query.stop()


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless scoring: the batch scorer applied to each record as it arrives."""
    return score(stream)


def running_accuracy(stream: DataFrame, y: Column, p: Column, label: str, timeout: int = 600, state: str | None = None) -> DataFrame:
    """Seen, correct and accuracy over the whole stream; state is one row, kept with the stream's commits.

    With ``state``, a folder, a restarted job goes on from its totals. A stream without files has seen 0 rows.
    """
    spark = stream.sparkSession
    out = state or scratch_path(spark, label)
    _empty(spark, f"{out}/totals")
    totals = stream.agg(F.count(F.lit(1)).alias("seen"), F.sum(F.when(y == p, 1).otherwise(0)).alias("correct"))

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{out}/totals/batch={epoch}")

    query = (totals.writeStream.outputMode("complete").foreachBatch(keep)
             .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    _finish(query, timeout)
    last = spark.read.schema("seen bigint, correct bigint, epoch bigint").parquet(f"{out}/totals")
    top = last.agg(F.max_by(F.struct("seen", "correct"), "epoch").alias("t"))
    top = top.select(F.coalesce("t.seen", F.lit(0)).alias("seen"), F.coalesce("t.correct", F.lit(0)).alias("correct"))
    return top.withColumn("accuracy", F.when(F.col("seen") > 0, F.col("correct") / F.col("seen")).otherwise(0.0))
