"""Evaluation and threshold calibration, each in one pass over the scored rows.

A row without a label (NULL) is no part of any metric; reports count such rows apart. A NULL group is a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.ml.feature import Bucketizer
from pyspark.sql.types import StructField, StructType

from ..functions import expr as X
from ..plans.ordered import add_buckets, bucket_edges, running_sums
from ..plans.small import attach, keyed_join, settle
from .labels import label_classes

WIDE = "decimal(38,0)"


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 on an empty denominator."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def f1_of(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.try_divide(2.0 * p * r, p + r)).otherwise(0.0)


def ranked(score: Column) -> Column:
    """A missing score (NULL or NaN) ranks below every other: the row counts, and no threshold makes it positive."""
    s = score.cast("double")
    return F.when(s.isNull() | F.isnan(s), F.lit(float("-inf"))).otherwise(s)


def _count(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def confusion_counts(y: Column, p: Column, pos=1) -> list[Column]:
    return [_count((p == pos) & (y == pos)).alias("tp"), _count((p == pos) & (y != pos)).alias("fp"),
            _count((p != pos) & (y == pos)).alias("fn"), _count((p != pos) & (y != pos)).alias("tn")]


def confusion_matrix(df: DataFrame, y: str, p: str, labels: Sequence | None = None, absent: bool = True) -> DataFrame:
    """(actual, predicted, n) for any number of labels; NULL is a label of its own where it occurs.

    ``labels`` asks for a label set: rows with another label on either side are then left out. ``absent`` adds the cells without
    rows, n = 0; they are made in Spark from ranges of label pairs, so their number is the square of the labels.
    """
    counts = df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    spark, kind = df.sparkSession, df.schema[y].dataType
    if labels is None:
        known = counts.select(F.col("actual").alias("v")).union(counts.select("predicted")).distinct()
    else:
        known = spark.createDataFrame([(v,) for v in dict.fromkeys(labels)], StructType([StructField("v", kind)]))
        counts = attach(attach(counts, known.withColumnRenamed("v", "actual"), ["actual"], "left_semi"), known.withColumnRenamed("v", "predicted"), ["predicted"], "left_semi")
    if not absent:
        return counts.select("actual", "predicted", F.col("n").cast("bigint").alias("n"))
    numbered, _ = settle(label_classes(known, "v", "code"))
    k = numbered.count()
    pairs = spark.range(k * k).select(F.floor(F.col("id") / F.lit(max(k, 1))).alias("_a"), (F.col("id") % F.lit(max(k, 1))).alias("_p"))
    for code, name in (("_a", "actual"), ("_p", "predicted")):
        pairs = attach(pairs, numbered.select(F.col("code").cast("long").alias(code), F.col("v").alias(name)), [code], "inner").drop(code)
    return (keyed_join(pairs, counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def accuracy(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """Share of labelled rows that are predicted right; a missing prediction is wrong."""
    return df.agg(_ratio(_count(y == p), F.count(y)).alias("accuracy"))


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy and error rates from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = (counts.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
           .withColumn("accuracy", _ratio(tp + tn, tp + fp + fn + tn))
           .withColumn("fpr", _ratio(fp, fp + tn)).withColumn("fnr", _ratio(fn, fn + tp)))
    return out.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def precision_recall_f1(df: DataFrame, y: Column, p: Column, pos=1) -> DataFrame:
    return with_rates(df.agg(*confusion_counts(y, p, pos))).select("precision", "recall", "f1")


def error_rates(df: DataFrame, y: Column, p: Column) -> DataFrame:
    return with_rates(df.agg(*confusion_counts(y, p))).select("fpr", "fnr")


def logloss(df: DataFrame, y: Column, score: Column, eps: float = 1e-7) -> DataFrame:
    return df.agg(F.avg(X.bce(y, ranked(score), False, eps)).alias("logloss"))


# --- ROC area ----------------------------------------------------------------

def _score_slots(df: DataFrame, y: Column, score: Column, keys: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score, with a score bucket."""
    base = df.select(*keys, ranked(score).alias("_s"), y.cast("int").alias("_y"))
    edges = bucket_edges(base.filter(F.col("_s") > float("-inf")), ["_s"])
    return (add_buckets(base, ["_s"], edges).groupBy(*keys, "_b__s", "_s")
            .agg(F.coalesce(F.sum("_y"), F.lit(0)).cast("bigint").alias("pos"),
                 F.coalesce(F.sum(1 - F.col("_y")), F.lit(0)).cast("bigint").alias("neg")))


def _area(run: DataFrame, keys: Sequence[str], area: Column, pos: str, neg: str) -> DataFrame:
    """Half-counted pairs over all pairs; 0.5 when one class is missing."""
    agg = run.groupBy(*keys).agg(F.sum(area).alias("_area"), F.max(pos).alias("_p"), F.max(neg).alias("_q"))
    pairs = F.col("_p").cast("double") * F.col("_q").cast("double") * 2.0
    auc = F.when(pairs == 0, F.lit(0.5)).otherwise(F.try_divide(F.col("_area").cast("double"), pairs))
    return agg.select(*keys, auc.alias("auc"))


def roc_auc(df: DataFrame, y: Column, score: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area with equal scores taken together, per key group.

    The area is a sum of whole numbers (twice the pairs ranked right, ties once),
    so the result does not depend on summation order.
    """
    keys = list(keys)
    own = keys or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(1))
    slots = _score_slots(base, y, score, own)
    run = running_sums(slots, own, "_b__s", "_s", ["pos", "neg"], descending=True, nullable=bool(keys))
    area = F.col("neg").cast(WIDE) * (2 * F.col("cum_pos") - F.col("pos")).cast("decimal(20,0)")
    out = _area(run, own, area.cast(WIDE), "tot_pos", "tot_neg")
    return out if keys else out.drop("_all")


def roc_auc_ungrouped(df: DataFrame, y: Column, score: Column, key: str) -> DataFrame:
    """The area when equal scores are walked one row at a time, in key order.

    A score may be shared by very many rows, so those are walked in key ranges:
    positives ahead of a row are those at higher scores, those of the same score
    in earlier key ranges, and those earlier in its own range.
    """
    base = df.select(ranked(score).alias("_s"), y.cast("int").alias("_y"), F.col(key).alias("_key")).filter("_y IS NOT NULL")
    edges = bucket_edges(base.filter(F.col("_s") > float("-inf")), ["_s", "_key"])
    marked = add_buckets(base.withColumn("_kd", F.col("_key").cast("double")), ["_s", "_kd"],
                         {"_s": edges["_s"], "_kd": edges["_key"]})
    ranges = (marked.groupBy("_b__s", "_s", "_b__kd")
              .agg(F.sum("_y").cast("bigint").alias("pos"), F.sum(1 - F.col("_y")).cast("bigint").alias("neg")))
    slots = (ranges.groupBy("_b__s", "_s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
             .withColumn("_all", F.lit(1)))
    run = running_sums(slots, ["_all"], "_b__s", "_s", ["pos", "neg"], descending=True, nullable=False)
    above = run.select("_s", (F.col("cum_pos") - F.col("pos")).alias("_above"), "tot_pos", "tot_neg")
    # Key ranges of one score: at most one row per key bucket.
    earlier = Window.partitionBy("_s").orderBy("_b__kd").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranges.withColumn("_ahead", F.coalesce(F.sum("pos").over(earlier), F.lit(0)))
               .select("_s", "_b__kd", "_ahead").join(above, "_s"))
    inside = (Window.partitionBy("_s", "_b__kd").orderBy("_key")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    walked = marked.select("_s", "_b__kd", "_key", "_y").join(offsets, ["_s", "_b__kd"])
    tp = F.col("_above") + F.col("_ahead") + F.sum("_y").over(inside)
    walked = walked.withColumn("_tp", tp).withColumn("_all", F.lit(1))
    area = F.when(F.col("_y") == 0, 2 * F.col("_tp")).otherwise(0).cast(WIDE)
    return _area(walked, ["_all"], area, "tot_pos", "tot_neg").drop("_all")


# --- thresholds --------------------------------------------------------------

# The default grids.
GRID_DEFAULT = [i / 100 for i in range(5, 96, 5)]
GRID_MIDDLE = [i / 100 for i in range(10, 91)]
GRID_FINE = [i / 100 for i in range(1, 100)]


def threshold_counts(df: DataFrame, y: Column, score: Column, grid: Sequence[float],
                     keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn at every threshold from one pass over the rows.

    A row is counted once, in the grid cell of its score; counts at a threshold
    are suffix sums over the cells.
    """
    keys = list(keys)
    own = keys or ["_all"]
    grid = sorted(set(float(t) for t in grid))
    base = df.select(*keys, *([] if keys else [F.lit(1).alias("_all")]),
                     ranked(score).alias("_s"), y.cast("int").alias("_y"))
    cell = Bucketizer(inputCol="_s", outputCol="_cell", handleInvalid="keep",
                      splits=[float("-inf"), *grid, float("inf")])
    cells = (cell.transform(base).groupBy(*own, F.col("_cell").cast("int").alias("_cell"))
             .agg(F.sum("_y").cast("bigint").alias("p"), F.sum(1 - F.col("_y")).cast("bigint").alias("q")))
    # Every threshold exists even when no score falls in its cell.
    empty = cells.select(*own).distinct().withColumn(
        "_cell", F.explode(F.sequence(F.lit(0), F.lit(len(grid)))))
    full = (keyed_join(empty, cells, [*own, "_cell"], "left")
            .select(*own, "_cell", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q")))
    # A window partition holds one row per grid cell.
    up = Window.partitionBy(*own).orderBy(F.desc("_cell"))
    at_or_above = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*own)
    out = full.select(
        *own, "_cell", F.sum("p").over(at_or_above).alias("tp"), F.sum("q").over(at_or_above).alias("fp"),
        F.sum("p").over(whole).alias("_p"), F.sum("q").over(whole).alias("_q")).filter("_cell > 0")
    at = F.element_at(F.array(*[F.lit(t) for t in grid]), F.col("_cell"))
    return out.select(*keys, at.alias("threshold"), "tp", "fp",
                      (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_q") - F.col("fp")).alias("tn"))


def threshold_sweep(df: DataFrame, y: Column, score: Column, grid: Sequence[float] = GRID_DEFAULT,
                    keys: Sequence[str] = ()) -> DataFrame:
    return with_rates(threshold_counts(df, y, score, grid, keys)).select(
        *keys, "threshold", "f1", "precision", "recall", "accuracy")


def best_threshold(df: DataFrame, y: Column, score: Column, metric: str = "f1",
                   grid: Sequence[float] = GRID_FINE) -> DataFrame:
    """The lowest threshold with the largest metric; 0.5 when there are no rows."""
    if metric not in ("f1", "accuracy"):
        raise ValueError(f"unknown metric {metric!r}")
    best = (threshold_sweep(df, y, score, grid)
            .agg(F.max_by(F.struct("threshold", metric), F.struct(F.col(metric), -F.col("threshold"))).alias("b")))
    return best.select(F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"), F.col(f"b.{metric}").alias(metric))


def threshold_table(df: DataFrame, y: Column, score: Column, candidates: Sequence[float] = (0.3, 0.4, 0.5, 0.6, 0.7),
                    grid: Sequence[float] = GRID_FINE) -> DataFrame:
    """Metrics at the candidate thresholds and at the best-F1 one, from one sweep."""
    both = sorted(set(grid) | set(candidates))
    sweep = threshold_sweep(df, y, score, both)
    # The sweep has one row per grid value, so one window partition is fine.
    order = Window.orderBy(F.when(F.col("threshold").isin(list(grid)), 0).otherwise(1), F.desc("f1"), "threshold")
    return (sweep.withColumn("is_best", (F.row_number().over(order) == 1).cast("int"))
            .filter((F.col("is_best") == 1) | F.col("threshold").isin(list(candidates))))


# --- reports -----------------------------------------------------------------

def evaluate(df: DataFrame, y: Column, score: Column, keys: Sequence[str], threshold=0.5,
             eps: float = 1e-7) -> DataFrame:
    """All metrics per key group (for instance per split) over its ``n`` labelled rows; ``n_unlabelled`` counts the others."""
    keys = list(keys)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    p = X.predict(ranked(score), t)
    counts = df.groupBy(*keys).agg(*confusion_counts(y, p), F.count(y).alias("n"), F.count_if(y.isNull()).alias("n_unlabelled"),
                                   F.avg(X.bce(y, ranked(score), False, eps)).alias("logloss"))
    return keyed_join(with_rates(counts), roc_auc(df, y, score, keys), keys)


def report(metrics: DataFrame, names: Sequence[str] = ("accuracy", "precision", "recall", "f1", "auc"),
           keys: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Metric columns as (metric, value) rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(F.col(n), digits).alias("value")) for n in names])
    return metrics.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.metric", "p.value")


def summarise_runs(runs: DataFrame, keys: Sequence[str], value: str, order: str, keep_runs: bool = False,
                   max_runs: int = 10_000) -> DataFrame:
    """Mean, sample deviation (0 for one run), number of runs and first run per key.

    ``keep_runs`` adds the ordered list of run values; the number of runs per key
    is checked before a list is built.
    """
    aggs = [F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
            F.count(value).alias("n_runs"), F.min_by(value, order).alias("first_run")]
    if keep_runs:
        most = runs.groupBy(*keys).count().agg(F.max("count").alias("m")).first()["m"] or 0
        if most > max_runs:
            raise ValueError(f"{most} runs of one key are too many for a list")
        aggs.append(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("runs"))
    return runs.groupBy(*keys).agg(*aggs)


def metric_delta(a: DataFrame, b: DataFrame, on: Sequence[str], value: str, limit: float) -> DataFrame:
    """Change of a metric between two stages, and whether the second meets the limit."""
    left = a.select(*on, F.col(value).alias("before"))
    right = b.select(*on, F.col(value).alias("after"))
    return (keyed_join(left, right, list(on)).withColumn("delta", F.col("after") - F.col("before"))
            .withColumn("verdict", F.when(F.col("after") >= limit, "pass").otherwise("warn")))


def prediction_parity(df: DataFrame, a: Column, b: Column, limit: float = 0.01) -> DataFrame:
    """Rows on which two scorers disagree."""
    n = F.count(F.lit(1))
    flips = _count(a != b)
    out = df.agg(n.alias("n"), flips.alias("flips"))
    rate = _ratio(F.col("flips"), F.col("n"))
    return out.select("n", "flips", rate.alias("flip_rate"), F.when(rate <= limit, "pass").otherwise("warn").alias("verdict"))
