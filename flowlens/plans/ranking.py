"""Reproducible random order without a single sort.

Rows are ordered inside a stratum by ``md5(seed|key)``, so the order depends on
neither partitioning nor row order. Two plans use it:

* ``rank_bounds`` finds the exact row at rank k of every stratum. Counting rows per
  short hash prefix shows which prefix holds it; a prefix that still holds many rows
  is counted again by a longer one; only the rows of the last prefix are sorted.
  Taking a sample or a split is then a map-only filter on the whole table: no row is
  shuffled, and a counting pass shuffles a few thousand counters per task at most.
* ``hash_rank`` numbers every row when the number itself is needed. Rows meet by
  (stratum, prefix), so the largest task holds a small share of a stratum however
  unequal the strata are.

Keys must identify a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .small import attach, check_free, ensure_checkpoint_dir, keyed_join, settle

# Hex digits of the first prefix and of every refinement (256 and 4096 groups).
FIRST_DIGITS, MORE_DIGITS = 2, 3
# A prefix with at most this many rows is sorted in one task.
SORTED_ROWS = 200_000
# Rows per (stratum, prefix) that hash_rank aims at, and its longest prefix.
RANKED_ROWS, MAX_RANK_DIGITS = 1_000_000, 4


def hash_text(seed, *keys) -> Column:
    """md5 over the seed and the key columns, as hex text."""
    parts = [seed if isinstance(seed, Column) else F.lit(str(seed))]
    parts += [k if isinstance(k, Column) else F.col(k) for k in keys]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hash_pick(seed, n: Column, *keys, digits: int = 15) -> Column:
    """A pick in 0..n-1 from the first hex digits of the hash: 15 of them reach every row of any table."""
    h = F.conv(F.substring(hash_text(seed, *keys), 1, digits), 16, 10).cast("bigint")
    return F.pmod(h, n.cast("bigint"))


def _hashed(df: DataFrame, strata: Sequence[str], keys: Sequence[str], seed) -> tuple[DataFrame, list[str]]:
    """The table with its hash; a constant stratum serves the unstratified case."""
    check_free(df, ("_h", "_all", "_p", "_n"))
    work = df.withColumn("_h", hash_text(seed, *keys))
    return (work, list(strata)) if strata else (work.withColumn("_all", F.lit(1)), ["_all"])


def _prefix_counts(work: DataFrame, own: Sequence[str], digits: int) -> DataFrame:
    """Rows per hash prefix of a stratum and rows before it."""
    counts = (work.groupBy(*own, F.substring("_h", 1, digits).alias("_p"))
              .agg(F.count(F.lit(1)).alias("_c")))
    # One window partition holds at most 16**digits counter rows.
    before = Window.partitionBy(*own).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))


def _largest(table: DataFrame, column: str) -> int:
    return table.agg(F.max(column).alias("m")).first()["m"] or 0


def _locate(work: DataFrame, own: list[str], counts: DataFrame, n_targets: int) -> tuple[DataFrame, DataFrame, bool, int]:
    """Stratum sizes and, per target, the hash prefix that holds its rank.

    Returns (sizes, wanted, small, digits); ``wanted`` has one row per stratum and
    target: the prefix, the position inside it and the rows it has.
    """
    def holds(i: int) -> Column:
        return (F.col("_before") < F.col(f"_k{i}")) & (F.col(f"_k{i}") <= F.col("_before") + F.col("_c"))

    cells = [a for i in range(n_targets) for a in (
        F.max(f"_k{i}").alias(f"_k{i}"),
        F.max(F.when(holds(i), F.struct("_p", (F.col(f"_k{i}") - F.col("_before")).alias("_need"), "_c"))).alias(f"_at{i}"))]
    plan, small = settle(counts.groupBy(*own).agg(F.max("_n").alias("_n"), *cells))
    sizes = plan.select(*own, "_n", *[f"_k{i}" for i in range(n_targets)])
    wanted = (plan.select(*own, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.col(f"_at{i}._p").alias("_p"), F.col(f"_at{i}._need").alias("_need"),
                 F.col(f"_at{i}._c").alias("_c")) for i in range(n_targets)])).alias("_t"))
        .select(*own, "_t.*").filter("_p IS NOT NULL"))
    digits = FIRST_DIGITS
    while digits < 32 and _largest(wanted, "_c") > SORTED_ROWS:
        inside = keyed_join(work.withColumn("_p", F.substring("_h", 1, digits)),
                            F.broadcast(wanted.drop("_c")) if small else wanted.drop("_c"), [*own, "_p"])
        digits = min(32, digits + MORE_DIGITS)
        finer = (inside.groupBy(*own, "_i", F.substring("_h", 1, digits).alias("_p"))
                 .agg(F.count(F.lit(1)).alias("_c"), F.max("_need").alias("_need")))
        before = Window.partitionBy(*own, "_i").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        finer = finer.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        hit = finer.filter((F.col("_before") < F.col("_need")) & (F.col("_need") <= F.col("_before") + F.col("_c")))
        wanted, small = settle(hit.select(*own, "_i", "_p", (F.col("_need") - F.col("_before")).alias("_need"), "_c"))
    return sizes, wanted, small, digits


def rank_bounds(df: DataFrame, strata: Sequence[str], keys: Sequence[str], seed,
                targets: Sequence[Callable[[Column], Column]]) -> DataFrame:
    """Mark rows with how many of the rank targets they lie beyond.

    ``targets`` are functions from the stratum size column to a rank (ascending
    for one stratum). The result is ``df`` plus ``_step``: 0 for ranks up to the
    first target, 1 for ranks up to the second, and so on.
    """
    keys = list(keys)
    m = len(targets)
    check_free(df, ["_c", "_before", "_need", "_i", "_r", "_step", *[f"_{a}{i}" for i in range(m) for a in ("k", "at", "bound")], *[f"_id{i}" for i in range(len(keys))]])
    work, own = _hashed(df, strata, keys, seed)
    counts = _prefix_counts(work, own, FIRST_DIGITS)
    counts = counts.withColumn("_n", F.sum("_c").over(Window.partitionBy(*own)))  # over counters
    counts = counts.withColumns({f"_k{i}": t(F.col("_n")).cast("bigint") for i, t in enumerate(targets)})
    sizes, wanted, small, digits = _locate(work, own, counts, m)
    # Only rows of a boundary prefix are numbered.
    edge = keyed_join(work.select(*own, F.substring("_h", 1, digits).alias("_p"), "_h", *[F.col(k).alias(f"_id{i}") for i, k in enumerate(keys)]),
                      F.broadcast(wanted) if small else wanted, [*own, "_p"])
    ids = [f"_id{i}" for i in range(len(keys))]
    order = Window.partitionBy(*own, "_p", "_i").orderBy("_h", *ids)
    last = F.struct("_h", *ids)
    cut = F.struct("_h", *[F.col(k).alias(i) for k, i in zip(keys, ids)])
    cuts = (edge.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == F.col("_need"))
            .groupBy(*own).agg(*[F.max(F.when(F.col("_i") == i, last)).alias(f"_bound{i}") for i in range(m)]))
    marked = attach(work, keyed_join(sizes, cuts, own, "left"), own, "left")
    step = F.lit(0)
    for i in range(m):
        # A missing bound means the target is 0 (nothing before it) or beyond the end.
        beyond = (F.when(F.col(f"_k{i}") <= 0, True).when(F.col(f"_k{i}") >= F.col("_n"), False)
                  .otherwise(cut > F.col(f"_bound{i}")))
        step = step + F.when(beyond, 1).otherwise(0)
    extra = ["_h", "_n", *[f"_k{i}" for i in range(m)], *[f"_bound{i}" for i in range(m)], *([] if strata else ["_all"])]
    return marked.withColumn("_step", step).drop(*extra)


def hash_rank(df: DataFrame, strata: Sequence[str], keys: Sequence[str], seed,
              name: str = "rank") -> DataFrame:
    """Number every row 1..n in hash order inside its stratum."""
    work, own = _hashed(df, strata, keys, seed)
    offsets, small = settle(_prefix_counts(work, own, FIRST_DIGITS), limit=500_000)
    largest = _largest(offsets, "_c")
    digits = FIRST_DIGITS
    while digits < MAX_RANK_DIGITS and largest > RANKED_ROWS:
        digits, largest = digits + 1, largest // 16
    if digits > FIRST_DIGITS:
        offsets, small = settle(_prefix_counts(work, own, digits), limit=500_000)
    offsets = offsets.drop("_c")
    inside = Window.partitionBy(*own, "_p").orderBy("_h", *keys)
    ranked = keyed_join(work.withColumn("_p", F.substring("_h", 1, digits)), F.broadcast(offsets) if small else offsets, [*own, "_p"])
    out = ranked.withColumn(name, F.col("_before") + F.row_number().over(inside))
    return out.drop("_h", "_p", "_before", *([] if strata else ["_all"]))


def number_rows(df: DataFrame, name: str = "row_no") -> DataFrame:
    """Dense 1..n numbers in the order of the table's partitions, without moving rows.

    Positions inside the partitions are written once: a second run of the plan could be cut into other
    partitions (adaptive execution merges them by size). One counting pass gives the partition offsets.
    """
    ensure_checkpoint_dir(df.sparkSession)
    check_free(df, ("_m", "_part", "_off"))
    work = df.withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    work = work.withColumn("_part", F.shiftright("_m", 33).cast("int"))
    counts = work.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    # Bounded by the number of scan partitions, not by rows.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets, small = settle(counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")))
    joined = work.join(F.broadcast(offsets) if small else offsets, "_part")
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, F.col("_off") + local + 1).drop("_m", "_part", "_off")
