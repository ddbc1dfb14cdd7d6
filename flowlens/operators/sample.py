"""Samples, splits, resampling and partition assignment with exact counts.

Counts and strata are exact; the random order is a keyed hash (see
``plans.ranking``), so a result depends on the seed and the row keys only.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..plans.ranking import hash_pick, hash_rank, hash_text, rank_bounds
from ..plans.small import attach, check_free, keyed_join, lookup, settle
from .labels import label_classes


def at_least_one(frac: float):
    """max(1, floor(n * frac))."""
    return lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(float(frac))))


def plain_floor(frac: float):
    return lambda n: F.floor(n * F.lit(float(frac)))


def stratified_sample(df: DataFrame, strata: Sequence[str], keys: Sequence[str], frac: float, seed=42) -> DataFrame:
    return rank_bounds(df, strata, keys, seed, [at_least_one(frac)]).filter("_step = 0").drop("_step")


def simple_sample(df: DataFrame, keys: Sequence[str], frac: float, seed=42) -> DataFrame:
    return rank_bounds(df, [], keys, seed, [at_least_one(frac)]).filter("_step = 0").drop("_step")


def proportional_sample(df: DataFrame, label: str, keys: Sequence[str], frac: float, seed=42) -> DataFrame:
    """k = ceil(frac*n) rows, positives by half-even share, the rest negatives."""
    if frac >= 1.0:
        return df
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p")).first()
    n, pos = sizes["n"], sizes["p"] or 0
    k = max(1, math.ceil(frac * n))
    k_pos = max(1, round(k * pos / n)) if n else 0
    k_neg = min(k - k_pos, n - pos)
    target = [lambda _: F.when(F.col(label) == 1, F.lit(k_pos)).otherwise(F.lit(k_neg))]
    return rank_bounds(df, [label], keys, seed, target).filter("_step = 0").drop("_step")


def split_stratified(df: DataFrame, label: str, keys: Sequence[str], test: float, seed=42,
                     name: str = "split") -> DataFrame:
    out = rank_bounds(df, [label], keys, seed, [at_least_one(test)])
    return out.withColumn(name, F.when(F.col("_step") == 0, "test").otherwise("train")).drop("_step")


def split_random(df: DataFrame, keys: Sequence[str], test: float, seed=42, name: str = "split") -> DataFrame:
    out = rank_bounds(df, [], keys, seed, [plain_floor(test)])
    return out.withColumn(name, F.when(F.col("_step") == 0, "test").otherwise("train")).drop("_step")


def _second_cut(first: DataFrame, label: str, keys: Sequence[str], val: float, seed, name: str) -> DataFrame:
    """Carve validation rows out of the training part of a two-way split."""
    out = rank_bounds(first, [name, label], keys, seed, [at_least_one(val)])
    take = (F.col(name) == "train") & (F.col("_step") == 0)
    return out.withColumn(name, F.when(take, "val").otherwise(F.col(name))).drop("_step")


def split_three_way(df: DataFrame, label: str, keys: Sequence[str], val: float, test: float, seed: int = 42,
                    name: str = "split") -> DataFrame:
    """Validation is a fraction of what the test rows leave; second seed is seed + 1."""
    return _second_cut(split_stratified(df, label, keys, test, seed, name), label, keys, val, seed + 1, name)


def split_corrected(df: DataFrame, label: str, keys: Sequence[str], val: float, test: float, seed: int = 42,
                    name: str = "split") -> DataFrame:
    """Validation is a fraction of the total: val / (1 - test) of the remainder.

    Both cuts use one seed, so the remainder keeps its order and the validation
    rows are simply the next ranks: one search serves both cuts.
    """
    first, second = at_least_one(test), at_least_one(val / (1.0 - test))

    def upto_val(n: Column) -> Column:
        return first(n) + second(n - first(n))

    out = rank_bounds(df, [label], keys, seed, [first, upto_val])
    return out.withColumn(name, F.when(F.col("_step") == 0, "test").when(F.col("_step") == 1, "val")
                          .otherwise("train")).drop("_step")


def split_ceil(df: DataFrame, label: str, keys: Sequence[str], train: float, val: float, seed: int = 42,
               name: str = "split") -> DataFrame:
    """ceil(n*train) training rows, the next ceil(n*val) validation, the rest test."""
    def upto_train(n: Column) -> Column:
        return F.ceil(n * F.lit(float(train)))

    def upto_val(n: Column) -> Column:
        return F.ceil(n * F.lit(float(train))) + F.ceil(n * F.lit(float(val)))

    out = rank_bounds(df, [label], keys, seed, [upto_train, upto_val])
    return out.withColumn(name, F.when(F.col("_step") == 0, "train").when(F.col("_step") == 1, "val")
                          .otherwise("test")).drop("_step")


def split_tail(df: DataFrame, row_no: str, val: float, name: str = "split") -> DataFrame:
    """The last max(1, floor(n*val)) rows in order are validation."""
    n = df.count()
    cut = n - max(1, int(n * val))
    return df.withColumn(name, F.when(F.col(row_no) > cut, "val").otherwise("train"))


def shuffle_rank(df: DataFrame, keys: Sequence[str], seed=42, name: str = "position") -> DataFrame:
    return hash_rank(df, [], keys, seed, name)


def batch_assign(df: DataFrame, row_no: str, size: int, name: str = "batch") -> DataFrame:
    return df.withColumn(name, F.floor((F.col(row_no) - 1) / F.lit(size)).cast("bigint"))


# --- oversampling ------------------------------------------------------------

def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """(label, _n): rows per class, evaluated once; NULL is a class."""
    check_free(df, ("_n", "_rank", "_times"))
    return settle(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))[0]


# Draws that one task makes at a time.
DRAWS = 1 << 16


def _numbered_draws(classes: DataFrame, count: str) -> DataFrame:
    """One row per draw 0..count-1 of every class, in chunks that are spread before they are unrolled."""
    chunks = classes.filter(F.col(count) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / DRAWS))))
    first = F.col("_chunk") * DRAWS
    last = F.least(first + DRAWS, F.col(count).cast("long")) - 1
    # Spread by row number, not by class: one class may have all draws.
    return chunks.repartition(F.xxhash64("_chunk", *[c for c in classes.columns])).withColumn("_d", F.explode(F.sequence(first, last))).drop("_chunk")


def _duplicate(df: DataFrame, label: str, keys: Sequence[str], classes: DataFrame, seed) -> DataFrame:
    """Add ``_extra`` draws with replacement to every class; ``copy`` counts the draws of a row.

    ``classes`` has the columns label, _n, _extra. Draws are counted per picked rank before they meet the rows, and
    only the classes that need copies are numbered.
    """
    base = df.withColumn("copy", F.lit(0))
    need = classes.filter("_extra > 0")
    picked = _numbered_draws(need, "_extra").withColumn("_rank", hash_pick(seed, F.col("_n"), label, "_d") + 1)
    times = picked.groupBy(label, "_rank").agg(F.count(F.lit(1)).alias("_times"))
    ranked = hash_rank(attach(df, need.select(label), [label], "left_semi"), [label], keys, seed, "_rank")
    extra_rows = (keyed_join(ranked, times, [label, "_rank"])
                  .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))))
    return base.unionByName(extra_rows.select(*df.columns, "copy"))


def oversample_balance(df: DataFrame, label: str, keys: Sequence[str], seed=42) -> DataFrame:
    """Every class grows to the size of the largest, whatever the number of classes; NULL is a class."""
    sizes = class_sizes(df, label)
    top = sizes.agg(F.max("_n")).first()[0] or 0
    return _duplicate(df, label, keys, sizes.withColumn("_extra", F.lit(top) - F.col("_n")), seed)


def oversample_ratio(df: DataFrame, label: str, keys: Sequence[str], ratio: float, seed=42) -> DataFrame:
    """Positives grow to floor(negatives*ratio); nothing happens when they are already there. Other classes stay."""
    sizes = class_sizes(df, label)
    pos, neg = sizes.agg(F.sum(F.when(F.col(label) == 1, F.col("_n"))), F.sum(F.when(F.col(label) == 0, F.col("_n")))).first()
    extra = max(0, int((neg or 0) * ratio) - pos) if pos else 0
    return _duplicate(df, label, keys, sizes.withColumn("_extra", F.when(F.col(label) == 1, F.lit(extra)).otherwise(0)), seed)


# --- weights and bootstrap ---------------------------------------------------

def _weighted(classes: DataFrame, df: DataFrame, label: str, weights) -> DataFrame:
    """``classes`` with ``_w``, the weight of one row of a class before scaling."""
    if weights == "balanced":
        n, k = classes.agg(F.sum("_n"), F.count(F.lit(1))).first()
        return classes.withColumn("_w", F.lit(float(n or 0)) / (F.lit(k) * F.col("_n")))
    if not isinstance(weights, Mapping):
        raise ValueError(f"unknown class weights {weights!r}")
    given = df.sparkSession.createDataFrame([(c, float(w)) for c, w in weights.items()], T.StructType([
        T.StructField(label, df.schema[label].dataType), T.StructField("_w", T.DoubleType())]))
    return attach(classes, given, [label]).withColumn("_w", F.coalesce("_w", F.lit(1.0)))


def class_weights(df: DataFrame, label: str, weights="balanced", name: str = "weight") -> DataFrame:
    """Row weights that sum to 1: balanced (n / (k * n_c)), or an explicit class map (default 1); NULL is a class."""
    classes = _weighted(class_sizes(df, label), df, label, weights)
    total = classes.agg(F.sum(F.col("_w") * F.col("_n"))).first()[0]
    return attach(df, classes.select(F.col(label), (F.col("_w") / F.lit(total)).alias(name)), [label])


# Classes whose masses are added up in one task, and cells of the unit interval in which draws meet classes.
MASS_CHUNK, MASS_CELLS = 4096, 1 << 14


def _mass_table(classes: DataFrame, label: str, mass: Column) -> DataFrame:
    """(label, _n, _lo, _hi): the part of [0, 1) that falls to each class, classes in text order, NULL first.

    Sums run over chunks of numbered classes and then over the chunks, so the order of classes decides alone.
    """
    numbered = attach(classes, label_classes(classes, label, "_code"), [label]).withColumn("_mass", mass).withColumn("_chunk", F.floor(F.col("_code") / MASS_CHUNK))
    inside = Window.partitionBy("_chunk").orderBy("_code")
    # One row per 4,096 classes.
    along = Window.partitionBy(F.lit(0)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("_chunk").agg(F.sum("_mass").alias("_m")).withColumn("_off", F.coalesce(F.sum("_m").over(along), F.lit(0.0))).drop("_m")
    summed, _ = settle(numbered.withColumn("_in", F.sum("_mass").over(inside)).join(offsets, "_chunk")
                       .select(label, "_n", "_code", (F.col("_off") + F.col("_in")).alias("_upto")))
    k, total = summed.agg(F.count(F.lit(1)), F.max("_upto")).first()
    before = summed.select((F.col("_code") + 1).alias("_code"), (F.col("_upto") / F.lit(total)).alias("_lo"))
    hi = F.when(F.col("_code") == F.lit((k or 0) - 1), F.lit(1.0)).otherwise(F.col("_upto") / F.lit(total))
    return summed.join(before, "_code", "left").select(label, "_n", F.coalesce("_lo", F.lit(0.0)).alias("_lo"), hi.alias("_hi"))


def _join_draws(df: DataFrame, draws: DataFrame, strata: Sequence[str], keys: Sequence[str], seed) -> DataFrame:
    times = draws.groupBy("tree", *strata, "_rank").agg(F.count(F.lit(1)).alias("times"))
    ranked = hash_rank(df, strata, keys, seed, "_rank")
    return keyed_join(ranked, times, [*strata, "_rank"]).drop("_rank")


def bootstrap(df: DataFrame, keys: Sequence[str], trees: int, seed=42, method: str = "exact") -> DataFrame:
    """n draws with replacement per tree, as rows with a ``times`` count.

    ``exact`` draws n ranks and joins them to the numbered rows. ``poisson`` gives
    each row an independent Poisson(1) count instead, which needs no shuffle.
    """
    if method == "poisson":
        fanned = df.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        u = hash_pick(seed, F.lit(1 << 32), "tree", *keys, digits=8) / F.lit(float(1 << 32))
        times, mass, term = F.lit(0), 0.0, math.exp(-1.0)
        for k in range(16):  # P(X > 16) is below the resolution of a 32-bit hash
            mass += term
            times = times + F.when(u >= mass, 1).otherwise(0)
            term /= k + 1
        return fanned.withColumn("times", times.cast("bigint")).filter("times > 0")
    if method != "exact":
        raise ValueError(f"unknown bootstrap method {method!r}")
    return _join_draws(df, draw_ranks(df, None, range(trees), None, seed), [], keys, seed)


def bootstrap_weighted(df: DataFrame, label: str, keys: Sequence[str], trees: int, weights="balanced",
                       seed=42) -> DataFrame:
    """n draws per tree where a row's chance follows its class weight.

    Weights depend on the class only, so a draw picks a class by its total mass, from a table of cumulative masses, and then
    a row of that class uniformly. Any number of classes; NULL is one.
    """
    return _join_draws(df, draw_ranks(df, label, range(trees), weights, seed), [label], keys, seed)


def draw_ranks(df: DataFrame, label: str | None, trees: range, weights, seed) -> DataFrame:
    """(tree, label, _rank): n draws per tree, each the rank of a row in its class; without weights (tree, _rank) over all rows."""
    n = df.count()
    draws = (df.sparkSession.range(n * trees.start, n * trees.stop)
             .select(F.floor(F.col("id") / F.lit(max(n, 1))).cast("int").alias("tree"),
                     (F.col("id") % F.lit(max(n, 1))).alias("_d")))
    if weights is None:
        return draws.withColumn("_rank", hash_pick(seed, F.lit(n), "tree", "_d") + 1)
    classes = class_sizes(df, label)
    if weights == "balanced":
        table = _mass_table(classes, label, F.lit(1.0))
    else:
        table = _mass_table(_weighted(classes, df, label, weights), label, F.col("_w") * F.col("_n"))
    draws = (draws.withColumn("_u", hash_pick(f"{seed}c", F.lit(1 << 32), "tree", "_d", digits=8) / F.lit(float(1 << 32)))
             .withColumn("_cell", F.floor(F.col("_u") * MASS_CELLS)))
    # A class lies in the cells it covers: as many rows as classes and cells together. Draws are even over the cells.
    cells = table.filter("_hi > _lo").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * MASS_CELLS), F.least(F.floor(F.col("_hi") * MASS_CELLS), F.lit(MASS_CELLS - 1)))))
    met = attach(draws, cells, ["_cell"], "inner").filter("_u >= _lo AND _u < _hi")
    return met.select("tree", "_d", label, (hash_pick(seed, F.col("_n"), "tree", "_d") + 1).alias("_rank"))


def row_subsample(df: DataFrame, keys: Sequence[str], frac: float, seed, round_no: int) -> DataFrame:
    """ceil(frac*n) rows without replacement for one boosting round."""
    if frac >= 1.0:
        return df
    target = [lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(float(frac))))]
    return rank_bounds(df, [], keys, f"{seed}|{round_no}", target).filter("_step = 0").drop("_step")


def resolve_max_features(rule, m: int) -> int:
    """Features tried at a node of ``m``: "sqrt", "log2", a count, a share below 1, or None for all."""
    if m < 1:
        raise ValueError("no features")
    named = {"sqrt": math.isqrt, "log2": lambda k: k.bit_length() - 1}
    if rule in named:
        wanted = named[rule](m)
    elif rule is None:
        wanted = m
    elif isinstance(rule, int) and not isinstance(rule, bool) and rule >= 1:
        wanted = rule
    elif isinstance(rule, float) and 0 < rule <= 1:
        wanted = math.ceil(rule * m)
    else:
        raise ValueError(f"unknown rule for the number of features: {rule!r}")
    return min(m, max(1, wanted))


def col_subsample(units: DataFrame, unit: str, features: Sequence[str], k: int, seed=42) -> DataFrame:
    """Per unit (a tree, or a tree and node) the k features that come first in hash order."""
    fanned = units.select(unit, F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    # One window partition holds one unit's feature list.
    order = Window.partitionBy(unit).orderBy(hash_text(seed, unit, "feature"), "feature")
    return (fanned.withColumn("_r", F.row_number().over(order))
            .filter(F.col("_r") <= min(k, len(features))).drop("_r"))


# --- clients -----------------------------------------------------------------

def partition_iid(df: DataFrame, label: str, keys: Sequence[str], clients: int, seed=42) -> DataFrame:
    """Round-robin inside each shuffled class."""
    ranked = hash_rank(df, [label], keys, seed, "_rank")
    return ranked.withColumn("client", ((F.col("_rank") - 1) % clients).cast("int")).drop("_rank")


def dirichlet_shares(classes: Sequence, clients: int, alpha: float, seed: int = 42) -> dict:
    """One Dirichlet draw of client shares for each class. A class's draw depends on the seed and its name only."""
    import numpy as np

    if alpha <= 0 or clients < 1:
        raise ValueError("alpha and the number of clients must be positive")
    seeds = {c: [seed, zlib.crc32(str(c).encode())] for c in classes}
    return {c: np.random.default_rng(s).dirichlet([alpha] * clients).tolist() for c, s in seeds.items()}


def partition_dirichlet(df: DataFrame, label: str, keys: Sequence[str], shares: Mapping, seed=42) -> DataFrame:
    """Consecutive slices of each shuffled class by rounded shares; the last client takes the rest.

    Every slice end is a rank bound, so rows are labelled in place without being moved.
    """
    clients = len(next(iter(shares.values())))
    known = F.lit(False)
    for c in shares:
        known = known | F.col(label).eqNullSafe(F.lit(c))
    other = df.filter(~known).select(label).first()
    if other is not None:
        raise ValueError(f"no shares for class {other[0]!r}")

    def slice_end(i: int):
        def end(n: Column) -> Column:
            total = F.lit(0.0)
            for j in range(i + 1):
                total = total + F.rint(lookup(F.col(label), {c: float(s[j]) for c, s in shares.items()}) * n)
            return total
        return end

    out = rank_bounds(df, [label], keys, seed, [slice_end(i) for i in range(clients - 1)])
    return out.withColumnRenamed("_step", "client")


def repeat_samples(df: DataFrame, label: str, keys: Sequence[str], frac: float, repeats: int, seed: int = 42) -> DataFrame:
    """Stratified samples with seed, seed+1, ... in one pass; adds ``run`` and ``seed``."""
    fanned = (df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
              .withColumn("seed", F.col("run") + F.lit(seed)))
    return (rank_bounds(fanned, ["run", label], keys, F.col("seed"), [at_least_one(frac)])
            .filter("_step = 0").drop("_step"))


def union_splits(df: DataFrame, split: str, parts: Sequence[str]) -> DataFrame:
    """Concatenate split parts in the given order of names."""
    out = None
    for p in parts:
        one = df.filter(F.col(split) == p)
        out = one if out is None else out.unionByName(one)
    return out


