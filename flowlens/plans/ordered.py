"""Order statistics and running sums over values that do not fit one task.

Values fall into buckets whose edges come from a hash sample of the distinct values, so
buckets hold about equal numbers of them whatever the distribution. Per-bucket
totals are prefix-summed on the small bucket table and each bucket is then
scanned on its own. Equal values are counted together before anything moves, so
one value holding a third of all rows costs one row after the map side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from .small import attach

# Largest number of cells (rows x columns) one aggregation buffer may hold.
DIRECT_CELLS = 1_000_000
ROWS_PER_BUCKET = 1_000_000
MIN_BUCKETS, MAX_BUCKETS = 64, 16_384
# Distinct values of a column that bucket edges are taken from.
SAMPLED = 1 << 16


def bucket_edges(df: DataFrame, cols: Sequence[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Strictly increasing inner edges per column, about equal numbers of distinct values between them.

    Edges are quantiles of a sample of the distinct values, taken by their hash: they depend neither on partitions nor on how
    often a value occurs, no sketches are merged, and no task sees more than a bounded number of values. The
    sample starts at about SAMPLED values and grows for columns that turn out to have few.
    """
    cols = list(cols)
    rows = df.count()
    k = buckets or max(MIN_BUCKETS, min(MAX_BUCKETS, rows // ROWS_PER_BUCKET))
    wanted, share, edges = max(SAMPLED, 4 * k), 1.0, {}
    if rows > wanted:
        share = wanted / rows
    todo = cols
    while todo:
        # The kept share of all hash values; 1 keeps every value.
        keep = (F.lit(True) if share >= 1.0 else
                F.shiftrightunsigned(F.xxhash64("v"), 1) < F.lit(int(share * (1 << 63))))
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("v")) for i, c in enumerate(todo)])).alias("c")
        values = (df.select(cells).select("c.*").filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
                  # -0.0 and 0.0 are one value.
                  .withColumn("v", F.col("v") + 0.0).filter(keep).groupBy("col", "v").agg(F.count(F.lit(1)).alias("n")))
        probs = F.array(*[F.lit(i / k) for i in range(1, k)])
        # About ``wanted`` values per column at most.
        found = {r["col"]: r for r in values.groupBy("col").agg(F.count(F.lit(1)).alias("d"), F.percentile("v", probs).alias("q")).collect()}
        few = []
        for i, c in enumerate(todo):
            if share < 1.0 and (i not in found or found[i]["d"] < 4 * k):
                few.append(c)
            else:
                edges[c] = sorted(set(found[i]["q"] or [])) if i in found else []
        todo, share = few, min(1.0, share * 64)
    return edges


def add_buckets(df: DataFrame, cols: Sequence[str], edges: Mapping[str, Sequence[float]],
                prefix: str = "_b_") -> DataFrame:
    """Bucket number per column by binary search on the edges (a JVM transformer)."""
    splits = [[float("-inf"), *(edges[c] or [0.0]), float("inf")] for c in cols]
    stage = Bucketizer(inputCols=list(cols), outputCols=[prefix + c for c in cols],
                       splitsArray=splits, handleInvalid="keep")
    out = stage.transform(df)
    # Not nullable (-1 for NULL): otherwise a null check is pushed into one side of the
    # join in running_sums, and its two sides stop sharing one shuffle.
    return out.withColumns({prefix + c: F.coalesce(F.col(prefix + c).cast("int"), F.lit(-1)) for c in cols})


def running_sums(slots: DataFrame, keys: Sequence[str], bucket: str, value: str,
                 sums: Sequence[str], descending: bool = False, nullable: bool = True) -> DataFrame:
    """Inclusive running sums over distinct values, per key group.

    ``slots`` has one row per (keys, value) with the columns ``sums`` already
    added up, and ``bucket``, which must grow with ``value``. Adds ``cum_<s>``,
    ``tot_<s>`` and ``next_value`` (the following value in scan order, or NULL). ``nullable`` says that keys may be NULL.
    """
    # One struct for all keys: a struct is never NULL, so groups with a NULL key meet in the join as well, and
    # equality on it still hashes.
    names, keys = (list(keys), ["_keys"]) if nullable and keys else ([], list(keys))
    if names:
        slots = slots.withColumn("_keys", F.struct(*names)).drop(*names)
    sign = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    first = F.max(value) if descending else F.min(value)
    per = slots.groupBy(*keys, bucket).agg(
        *[F.sum(s).alias(f"_in_{s}") for s in sums], first.alias("_first"))
    # One row per (keys, bucket): at most MAX_BUCKETS + 1 rows in a window partition.
    scan = Window.partitionBy(*keys).orderBy(sign(bucket))
    whole = Window.partitionBy(*keys)
    before = scan.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        *keys, bucket,
        *[F.coalesce(F.sum(f"_in_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_in_{s}").over(whole).alias(f"tot_{s}") for s in sums],
        F.lead("_first").over(scan).alias("_next_first"))
    inside = Window.partitionBy(*keys, bucket).orderBy(sign(value))
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The scan below needs rows together by (keys, bucket) anyway, so that one shuffle
    # also serves the join; the bucket table is the build side, small in every partition.
    joined = slots.join(per.hint("shuffle_hash"), [*keys, bucket])
    out = joined.select(
        "*",
        *[(F.col(f"_off_{s}") + F.sum(s).over(run)).alias(f"cum_{s}") for s in sums],
        F.coalesce(F.lead(value).over(inside), F.col("_next_first")).alias("next_value"))
    out = out.drop("_next_first", *[f"_off_{s}" for s in sums])
    if not names:
        return out
    rest = [c for c in out.columns if c not in keys]
    return out.select(*[F.col("_keys")[c].alias(c) for c in names], *rest)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    direct_cells: int = DIRECT_CELLS, buckets: int | None = None) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles, position p*(n-1), NULLs skipped.

    Small tables use the built-in aggregate. Beyond ``direct_cells`` that buffer
    would hold every distinct value of a column in one task, so the ranks are
    located by bucket counts first and only the buckets that hold one are
    counted by value.
    """
    cols = list(cols)
    rows = df.count()
    if rows * len(cols) <= direct_cells:
        arr = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(*[F.percentile(F.col(c).cast("double"), arr).alias(c) for c in cols]).first()
        return {c: (list(row[c]) if row[c] is not None else [None] * len(probs)) for c in cols}
    def ranks(_: str, n: int) -> set[int]:
        return {k for p in probs for k in neighbours(p, n)[1:]} if n else set()

    found = order_statistics(df, cols, ranks, buckets)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        n, at = found[c]
        out[c] = [interpolate(*neighbours(p, n), at) if n else None for p in probs]
    return out


def neighbours(p: float, n: int) -> tuple[float, int, int]:
    """Position p*(n-1) and the two ranks around it."""
    pos = p * (n - 1)
    lo = int(pos)
    return pos, lo, min(lo + 1, n - 1)


def interpolate(pos: float, lo: int, hi: int, at: Mapping[int, float]) -> float:
    a, b = at[lo], at[hi]
    return a if a == b else a + (pos - lo) * (b - a)


def order_statistics(df: DataFrame, cols: Sequence[str], ranks: Callable[[str, int], set[int]],
                     buckets: int | None = None) -> dict[str, tuple[int, dict[int, float]]]:
    """Values at 0-based ranks of every column: (number of values, {rank: value}).

    ``ranks`` chooses them from the column's name and number of values. Bucket
    counts (at most buckets x columns rows) tell which buckets hold a wanted
    rank; only those are counted by value.
    """
    cols = list(cols)
    edges = bucket_edges(df, cols, buckets)
    bucketed = add_buckets(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols, edges)
    long = bucketed.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("col"), F.col(f"_b_{c}").alias("b"), F.col(c).alias("v"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*").filter("v IS NOT NULL")
    counts = long.groupBy("col", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    targets, totals = [], {}
    for i, c in enumerate(cols):
        mine = sorted((r["b"], r["n"]) for r in counts if r["col"] == i)
        totals[c] = sum(n for _, n in mine)
        wanted = sorted(ranks(c, totals[c]))
        run = 0
        for b, n in mine:
            targets += [(i, b, run, k) for k in wanted if run <= k < run + n]
            run += n
    if not targets:
        return {c: (totals[c], {}) for c in cols}
    want = df.sparkSession.createDataFrame(targets, "col int, b int, off bigint, rank bigint")
    # One row per wanted rank: a few per column.
    values = (long.join(F.broadcast(want.select("col", "b", "off").distinct()), ["col", "b"])
              .groupBy("col", "b", "off", "v").agg(F.count(F.lit(1)).alias("n")))
    upto = F.col("off") + F.sum("n").over(Window.partitionBy("col", "b").orderBy("v"))
    hit = (values.withColumn("z", upto).join(F.broadcast(want.drop("off")), ["col", "b"])
           .filter("z - n <= rank AND rank < z"))
    at: dict[int, dict[int, float]] = {}
    for r in hit.select("col", "rank", "v").collect():
        at.setdefault(r["col"], {})[r["rank"]] = r["v"]
    return {c: (totals[c], at.get(i, {})) for i, c in enumerate(cols)}


def approximate_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                          accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """One mergeable sketch pass, for callers that accept a rank error of 1/accuracy."""
    arr = F.array(*[F.lit(float(p)) for p in probs])
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), arr, F.lit(accuracy)).alias(c)
                   for c in cols]).first()
    return {c: (list(row[c]) if row[c] is not None else [None] * len(probs)) for c in cols}


def value_at_rank(df: DataFrame, keys: Sequence[str], value: Column, index_of) -> DataFrame:
    """Per key group (NULL keys are one), the value at a 0-based index of the ascending order.

    ``index_of`` maps the group's row count column to that index. Bucket counts tell which bucket of a group holds it; only the
    values of that bucket are counted, so about one row in a bucket's number moves.
    """
    keys = list(keys)
    own = [f"_k{i}" for i in range(len(keys))] or ["_all"]
    base = df.select(*([F.col(k).alias(o) for k, o in zip(keys, own)] or [F.lit(1).alias("_all")]), value.alias("_v")).filter("_v IS NOT NULL")
    bucketed = add_buckets(base, ["_v"], bucket_edges(base, ["_v"]))
    # One window partition has at most MAX_BUCKETS + 1 counters.
    counts = bucketed.groupBy(*own, "_b__v").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumns({"n": F.sum("c").over(Window.partitionBy(*own)), "upto": F.sum("c").over(Window.partitionBy(*own).orderBy("_b__v"))})
    idx = index_of(F.col("n"))
    picks = counts.withColumn("before", F.col("upto") - F.col("c")).filter((F.col("before") <= idx) & (idx < F.col("upto"))).select(*own, "_b__v", "n", (idx - F.col("before")).alias("at"))
    inside = attach(bucketed, picks, [*own, "_b__v"], "inner").groupBy(*own, "n", "at", "_v").agg(F.count(F.lit(1)).alias("c"))
    run = inside.withColumn("upto", F.sum("c").over(Window.partitionBy(*own).orderBy("_v")))
    hit = run.filter((F.col("upto") - F.col("c") <= F.col("at")) & (F.col("at") < F.col("upto")))
    return hit.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], F.col("_v").alias("value"), "n")
