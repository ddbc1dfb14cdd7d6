"""Node tables: split search, level-wise growth, scoring and inspection.

A model is a table with one row per node: tree_id, node_id, feature (-1 at a
leaf), threshold, left_id, right_id, value (class), prob, leaf_value, gain, n, sum_h.
Rows go left when x <= threshold.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.ordered import add_buckets, bucket_edges, running_sums
from ..plans.small import attach, check_free, ensure_checkpoint_dir, fetch_small, materialise, scratch_path, settle
from .sample import bootstrap, bootstrap_weighted, resolve_max_features

register_pickle_by_value(sys.modules[__name__])

NODE_SCHEMA = ("tree_id bigint, node_id int, feature int, threshold double, left_id int, right_id int, "
               "value int, prob double, leaf_value double, gain double, n bigint, sum_h double")

# Models up to this many nodes become one expression. Larger ones are stored in blocks of whole trees in the shared folder, and the
# tasks that hold the rows read them block by block. Where that folder can only be read by Spark, blocks of rows of a table meet
# blocks of trees; a stream then takes the model through the driver, up to MODEL_NODES. The scores are the same.
COMPILED_NODES = 2_000
MODEL_NODES = 20_000_000
# Trees of about so many nodes make a block; a larger tree is a block of its own size.
BLOCK_NODES = 100_000
# Bytes of blocks that a worker keeps, and rows that pass over the blocks together.
CACHE_BYTES, PASS_ROWS = 128 << 20, 1 << 17
# Cells of a grid on which leaves with bounds on one or two features are added up.
GRID_CELLS = 1 << 20
# Scratch column of a sum over trees.
SUM = "_sum_of_leaves"
# The bucket of missing values, behind all others.
MISSING = 1 << 30


def gini(df: DataFrame, keys: Sequence[str], y: Column) -> DataFrame:
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("bigint").alias("pos"))
    p = F.col("pos").cast("double") / F.col("n").cast("double")
    return agg.withColumn("gini", 1.0 - p * p - (1.0 - p) * (1.0 - p))


# --- split search --------------------------------------------------------------

def split_edges(df: DataFrame, features: Sequence[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Bucket edges per feature, fitted once per training table."""
    return bucket_edges(df, features, buckets)


def with_buckets(df: DataFrame, features: Sequence[str], edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Bucket numbers of the features, unless the table already carries them."""
    return df if all(f"_b_{f}" in df.columns for f in features) else add_buckets(df, features, edges)


def running_splits(df: DataFrame, node: str, features: Sequence[str], edges: Mapping[str, Sequence[float]],
                   stats: Mapping[str, Column], binned: bool = False) -> DataFrame:
    """Every place a (node, feature) can be cut, with the sums to its left.

    Statistics are added up per distinct value before the shuffle; with
    ``binned`` they are added up per bucket, which bounds the shuffle by
    nodes x features x buckets. Adds ``cum_*``, ``tot_*`` and ``threshold``, the
    midpoint between neighbouring values. Rows that miss the feature (NULL, NaN)
    go right at every split, as in routing: they are in the totals only.
    """
    ready = with_buckets(df, features, edges).select(
        node, *features, *[f"_b_{f}" for f in features], *[c.alias(f"_s_{s}") for s, c in stats.items()])
    def cell(i: int, f: str) -> Column:
        v = F.col(f).cast("double")
        gone = v.isNull() | F.isnan(v)
        return F.struct(F.lit(i).alias("feature"), F.when(gone, MISSING).otherwise(F.col(f"_b_{f}")).alias("b"),
                        F.when(~gone, v).alias("v"))

    cells = F.array(*[cell(i, f) for i, f in enumerate(features)])
    long = (ready.select(node, *[f"_s_{s}" for s in stats], F.explode(cells).alias("c"))
            .select(node, "c.feature", "c.b", "c.v", *[F.col(f"_s_{s}").alias(s) for s in stats]))
    sums = [F.sum(s).alias(s) for s in stats]
    if binned:
        slots = long.groupBy(node, "feature", "b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), *sums)
    else:
        slots = (long.groupBy(node, "feature", "b", F.col("v").alias("lo")).agg(*sums)
                 .withColumn("hi", F.col("lo")))
    run = running_sums(slots, [node, "feature"], "b", "lo", list(stats), nullable=False)
    return (run.filter("next_value IS NOT NULL")
            .withColumn("threshold", (F.col("hi") + F.col("next_value")) / 2.0))


def gini_gain(splits: DataFrame, min_leaf: int = 1) -> DataFrame:
    """Gain of every split: parent impurity minus the weighted child impurities."""
    n, p = F.col("tot_n").cast("double"), F.col("tot_pos").cast("double")
    ln, lp = F.col("cum_n").cast("double"), F.col("cum_pos").cast("double")
    rn, rp = n - ln, p - lp

    def impurity(pos: Column, size: Column) -> Column:
        a, b = pos / size, (size - pos) / size
        return 1.0 - a * a - b * b

    share = p / n
    parent = 1.0 - share * share - (1.0 - share) * (1.0 - share)
    usable = splits.filter((F.col("cum_n") >= min_leaf) & (F.col("tot_n") - F.col("cum_n") >= min_leaf))
    return usable.withColumn("gain", parent - (ln / n * impurity(lp, ln) + rn / n * impurity(rp, rn)))


def newton_gain(splits: DataFrame, lam: float = 1.0, gamma: float = 0.0, min_child: float = 1.0) -> DataFrame:
    """Second-order gain; both children need a hessian sum of at least ``min_child``."""
    g, h = F.col("tot_g"), F.col("tot_h")
    gl, hl = F.col("cum_g"), F.col("cum_h")
    gr, hr = g - gl, h - hl
    usable = splits.filter((hl >= min_child) & (hr >= min_child))
    gain = 0.5 * (gl * gl / (hl + lam) + gr * gr / (hr + lam) - g * g / (h + lam)) - gamma
    return usable.withColumn("gain", gain)


def best_split(gains: DataFrame, node: str, extra: Sequence[str]) -> DataFrame:
    """Per node the largest gain; ties go to the first feature, then the lowest value."""
    pick = F.struct("feature", "threshold", "gain", *extra)
    first = F.struct(F.col("gain"), -F.col("feature"), -F.col("lo"))
    # Splits are still laid out by bucket: a maximum there needs no further sort or
    # shuffle, and leaves about one row per bucket for the aggregate that breaks ties.
    top = F.max("gain").over(Window.partitionBy(node, "feature", "b"))
    gains = gains.withColumn("_top", top).filter(F.col("gain") == F.col("_top"))
    return gains.groupBy(node).agg(F.max_by(pick, first).alias("s")).select(node, "s.*")


# --- growth --------------------------------------------------------------------

@dataclass
class Node:
    """One node of a tree being grown; the driver holds the tree, never rows."""

    node_id: int
    n: int
    stats: dict
    depth: int
    feature: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1
    gain: float = 0.0


@dataclass
class Tree:
    nodes: dict[int, Node] = field(default_factory=dict)

    def compile(self, features: Sequence[str], leaf: Callable[[Node], Column], at: int = 0) -> Column:
        node = self.nodes[at]
        if node.feature < 0:
            return leaf(node)
        return (F.when(F.col(features[node.feature]) <= F.lit(node.threshold), self.compile(features, leaf, node.left))
                .otherwise(self.compile(features, leaf, node.right)))

    def compile_ids(self, features: Sequence[str]) -> Column:
        return self.compile(features, lambda n: F.lit(n.node_id))


def grow(df: DataFrame, features: Sequence[str], stats: Mapping[str, Column], max_depth: int,
         may_split: Callable[[Node], bool], score: Callable[[DataFrame], DataFrame],
         accept: Callable[[float], bool], edges: Mapping[str, Sequence[float]], binned: bool = False,
         columns: Callable[[int], Sequence[int]] | None = None) -> Tree:
    """Grow one tree level by level: one job finds the best split of all open nodes.

    Rows are routed by the compiled tree so far, a map-side projection, so no
    row assignment has to be stored. Child totals come from the chosen split.
    """
    totals = df.agg(*[F.sum(c).alias(s) for s, c in stats.items()]).first()
    start = {s: totals[s] or 0 for s in stats}
    tree = Tree({0: Node(0, int(start["n"]), start, 0)})
    open_ids = [0]
    for depth in range(max_depth):
        open_ids = [i for i in open_ids if may_split(tree.nodes[i])]
        if not open_ids:
            break
        work = df.withColumn("_node", tree.compile_ids(features)).filter(F.col("_node").isin(open_ids))
        splits = running_splits(work, "_node", features, edges, stats, binned)
        gains = score(splits)
        if columns is not None:  # feature subset per node
            allowed = F.lit(False)
            for i in open_ids:
                allowed = allowed | ((F.col("_node") == i) & F.col("feature").isin([int(c) for c in columns(i)]))
            gains = gains.filter(allowed)
        found = best_split(gains, "_node", [f"cum_{s}" for s in stats] + [f"tot_{s}" for s in stats]).collect()
        opened = []
        for row in sorted(found, key=lambda r: r["_node"]):  # at most one row per open node
            if not accept(row["gain"]):
                continue
            node = tree.nodes[row["_node"]]
            node.feature, node.threshold, node.gain = row["feature"], row["threshold"], row["gain"]
            left = {s: row[f"cum_{s}"] for s in stats}
            right = {s: row[f"tot_{s}"] - row[f"cum_{s}"] for s in stats}
            node.left, node.right = len(tree.nodes), len(tree.nodes) + 1
            for i, side in ((node.left, left), (node.right, right)):
                tree.nodes[i] = Node(i, int(side["n"]), side, depth + 1)
                opened.append(i)
        open_ids = opened
    return tree


def cart_tree(df: DataFrame, features: Sequence[str], y: str, max_depth: int = 5, min_split: int = 2,
              min_leaf: int = 1, min_gain: float | None = None, edges=None, binned: bool = False,
              columns=None, weight: Column | None = None) -> Tree:
    """Gini tree. Zero-gain splits are taken unless ``min_gain`` says otherwise."""
    w = F.lit(1) if weight is None else weight
    stats = {"n": w.cast("bigint"), "pos": (w * F.col(y)).cast("bigint")}
    edges = edges or split_edges(df, features)
    return grow(
        df, features, stats, max_depth,
        may_split=lambda v: v.n >= min_split and 0 < v.stats["pos"] < v.n,
        score=lambda s: gini_gain(s, min_leaf),
        accept=lambda g: g is not None and (min_gain is None or g >= min_gain),
        edges=edges, binned=binned, columns=columns)


def feature_subset(features: Sequence[str], k: int, seed) -> list[int]:
    """k feature positions, first in hash order of (seed, name); a short list, so it is made on the driver."""
    order = sorted(range(len(features)), key=lambda i: hashlib.md5(f"{seed}|{features[i]}".encode()).hexdigest())
    return sorted(order[:k])


def cart_forest(df: DataFrame, features: Sequence[str], y: str, keys: Sequence[str], trees: int, max_depth: int,
                min_split: int = 2, min_leaf: int = 1, max_features="sqrt", weights="balanced", seed: int = 42,
                binned: bool = False) -> list[Tree]:
    """Exact Gini trees on weighted bootstraps, with a feature subset per node.

    A drawn row is kept once with its number of draws, which serve as counts in
    the search. MLlib's forest is the quicker trainer; this one has the exact
    thresholds and draws.
    """
    k = resolve_max_features(max_features, len(features))
    edges = split_edges(df, features)
    narrow = with_buckets(df.select(*keys, *features, F.col(y)), features, edges)
    drawn = (bootstrap(narrow, keys, trees, seed) if weights is None
             else bootstrap_weighted(narrow, y, keys, trees, weights, seed))
    drawn = materialise(drawn.drop(*keys), "bags")
    return [cart_tree(drawn.filter(F.col("tree") == t), features, y, max_depth, min_split, min_leaf, edges=edges,
                      binned=binned, weight=F.col("times"),
                      columns=lambda node, t=t: feature_subset(features, k, f"{seed}|{t}|{node}"))
            for t in range(trees)]


def tree_rows(tree: Tree, tree_id: int, newton_lambda: float | None = None) -> list[tuple]:
    out = []
    for v in sorted(tree.nodes.values(), key=lambda v: v.node_id):
        if newton_lambda is None:
            prob = v.stats["pos"] / v.n if v.n else 0.0
            value, leaf, h = int(v.stats["pos"] * 2 >= v.n), prob, 0.0
        else:
            leaf = -v.stats["g"] / (v.stats["h"] + newton_lambda)
            prob, value, h = 0.0, 0, float(v.stats["h"])
        out.append((tree_id, v.node_id, v.feature, float(v.threshold), v.left, v.right, value, float(prob),
                    float(leaf), float(v.gain), v.n, h))
    return out


def node_table(spark, trees: Sequence[Tree], newton_lambda: float | None = None) -> DataFrame:
    rows = [r for i, t in enumerate(trees) for r in tree_rows(t, i, newton_lambda)]
    return spark.createDataFrame(rows, NODE_SCHEMA)


# --- scoring -------------------------------------------------------------------

def _compile_rows(nodes: Mapping[int, object], features: Sequence[str], leaf: Callable[[object], Column]) -> Column:
    def at(i: int) -> Column:
        node = nodes[i]
        if node["feature"] < 0:
            return leaf(node)
        return (F.when(F.col(features[node["feature"]]) <= F.lit(node["threshold"]), at(node["left_id"]))
                .otherwise(at(node["right_id"])))
    return at(0)


def model_rows(nodes: DataFrame, limit: int = COMPILED_NODES):
    """The node table as {tree: {node: row}} when it is small enough to compile, else None."""
    rows = fetch_small(nodes, limit)
    if rows is None:
        return None
    out: dict[int, dict[int, object]] = {}
    for r in rows:
        out.setdefault(r["tree_id"], {})[r["node_id"]] = r
    return dict(sorted(out.items()))


def leaf_columns(model: Mapping, features: Sequence[str], leaf: str) -> list[Column]:
    """One compiled expression per tree."""
    return [_compile_rows(t, features, lambda v: F.lit(v[leaf])) for t in model.values()]


def route_join(df: DataFrame, nodes: DataFrame, features: Sequence[str], keep: Sequence[str],
               max_depth: int = 64) -> DataFrame:
    """Leaf of every (row, tree) for models too large to compile.

    A node table that may be broadcast (its size is checked) takes every pair down in one stage, as many steps as its
    deepest path has. Beyond that size, each step joins the current node of every pair by shuffle, and state is cut by
    checkpoints in the shared folder, which survive lost executors.
    """
    leaf_cols = ["feature", "threshold", "left_id", "right_id", "value", "prob", "leaf_value"]
    table, small = settle(nodes.select("tree_id", "node_id", *leaf_cols))
    roots = table.filter("node_id = 0").select("tree_id")
    trees = fetch_small(roots, 100_000)
    if trees is None:
        raise ValueError("more than 100000 trees: score the model in parts")
    x = F.array(*[F.col(f).cast("double") for f in features])
    ids = F.array(*[F.lit(int(r["tree_id"])).cast("bigint") for r in trees])
    state = df.select(*keep, x.alias("_x")).withColumn("tree_id", F.explode(ids)).withColumn("node_id", F.lit(0))
    cols = [*keep, "_x", "tree_id", "node_id"]
    go = F.when(F.element_at("_x", F.col("feature") + 1) <= F.col("threshold"), F.col("left_id")).otherwise(F.col("right_id"))
    steps = _deepest(table, max_depth) if small else None
    if steps is not None:
        # One struct per node: a pair meets it by its place and keeps it once it is a leaf.
        for k in range(steps):
            links = F.broadcast(table.select("tree_id", "node_id", "feature", "threshold", "left_id", "right_id"))
            state = state.join(links, ["tree_id", "node_id"]).withColumn("node_id", F.when(F.col("feature") < 0, F.col("node_id")).otherwise(go)).select(*cols)
        ends = F.broadcast(table.filter("feature < 0").select("tree_id", "node_id", "value", "prob", "leaf_value"))
        return state.join(ends, ["tree_id", "node_id"]).select(*keep, "tree_id", "node_id", "value", "prob", "leaf_value")
    ensure_checkpoint_dir(df.sparkSession)
    done = None
    for _ in range(max_depth + 1):
        here = attach(state, table, ["tree_id", "node_id"], "inner").checkpoint()
        ended = here.filter("feature < 0").select(*keep, "tree_id", "node_id", "value", "prob", "leaf_value")
        done = ended if done is None else done.unionByName(ended)
        moving = here.filter("feature >= 0")
        if moving.isEmpty():
            break
        state = moving.withColumn("node_id", go).select(*cols)
    return done


def _deepest(table: DataFrame, max_depth: int) -> int | None:
    """Steps from a root to the deepest node of a small table, at most ``max_depth``; None where a node occurs twice."""
    nodes = {}
    for r in table.select("tree_id", "node_id", "feature", "left_id", "right_id").collect():
        if (r["tree_id"], r["node_id"]) in nodes:
            return None
        nodes[r["tree_id"], r["node_id"]] = r
    level, steps = {k for k in nodes if k[1] == 0}, 0
    while steps < max_depth:
        level = {(t, c) for t, i in level if nodes[t, i]["feature"] >= 0 for c in (nodes[t, i]["left_id"], nodes[t, i]["right_id"]) if (t, c) in nodes}
        if not level:
            break
        steps += 1
    return steps


def route(df: DataFrame, nodes: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(row, tree) pairs with the leaf they end in."""
    model = model_rows(nodes)
    if model is None:
        return route_join(df, nodes, features, keep)
    # The leaf is one literal struct, so a tree is walked once per row.
    def leaf(v) -> Column:
        return F.struct(F.lit(int(v["tree_id"])).cast("bigint").alias("tree_id"),
                        *[F.lit(v[a]).alias(a) for a in ("node_id", "value", "prob", "leaf_value")])

    pairs = F.array(*[_compile_rows(v, features, leaf) for v in model.values()])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*")


def _leaf_sum(df: DataFrame, nodes: DataFrame, features: Sequence[str], leaf: str, limit: int | None) -> tuple[DataFrame, Column, int]:
    """The table, with a scratch column where the model is large; the sum of one leaf attribute over all trees; their number.

    A missing feature goes right. Repeated rows score alike and a stream scores like a table. A model of more
    than ``limit`` nodes is refused, if one is given.
    """
    if limit is not None and fetch_small(nodes.select("tree_id"), min(limit, COMPILED_NODES)) is None and nodes.count() > limit:
        raise ValueError(f"more than {limit} nodes: raise the limit or score the trees in parts")
    rows = fetch_small(nodes, COMPILED_NODES)
    if rows is None and (stored := _stored_sums(nodes, features, leaf)) is not None:
        return df, *stored
    if rows is None and not df.isStreaming:
        return _block_sums(df, nodes, features, leaf)
    if rows is None:
        rows = fetch_small(nodes, MODEL_NODES)
    if rows is None:
        raise ValueError(f"more than {MODEL_NODES} nodes: score the stream's batches as tables")
    model: dict[int, dict[int, object]] = {}
    for r in rows:
        model.setdefault(r["tree_id"], {})[r["node_id"]] = r
    model = dict(sorted(model.items()))
    if len(rows) > COMPILED_NODES:
        return df, _walker(model, features, leaf), len(model)
    total = None
    for c in leaf_columns(model, features, leaf):
        total = c if total is None else total + c
    return df, F.lit(0) if total is None else total, len(model)


def _readable(path: str) -> str | None:
    """The address under which tasks can open ``path`` without Spark, or None."""
    from pyarrow import ArrowException, fs

    address = path.replace("s3a://", "s3://", 1)
    address = address if "://" in address else "file://" + address.removeprefix("file:")
    try:
        fs.FileSystem.from_uri(address)
    except (ArrowException, OSError, ImportError, ValueError):
        return None
    return address


def _stored_sums(nodes: DataFrame, features: Sequence[str], leaf: str) -> tuple[Column, int] | None:
    """The same sum by a map-only column: rows stay where they are and no model passes the driver.

    The node table is written in blocks of whole trees. A task takes its rows over one block after the other, many
    rows at a time, and keeps the blocks it used last up to CACHE_BYTES; tables and streams run the same plan.
    """
    path = scratch_path(nodes.sparkSession, "model")
    address = _readable(path)
    if address is None:
        return None
    model = nodes.select("tree_id", "node_id", "feature", F.col("threshold").cast("double").alias("threshold"), "left_id", "right_id", F.col(leaf).cast("double").alias("leaf"))
    size, trees = model.agg(F.count(F.lit(1)), F.count_if(F.col("node_id") == 0)).first()
    blocks = -(-size // BLOCK_NODES)
    placed = model.withColumn("block", F.pmod(F.xxhash64("tree_id"), F.lit(blocks)).cast("int"))
    placed.repartition(blocks, "block").sortWithinPartitions("block", "tree_id", "node_id").write.partitionBy("block").parquet(path)
    kept, together, most = CACHE_BYTES, PASS_ROWS, GRID_CELLS

    def block(k: int) -> tuple[list, list]:
        """Grids of the leaves with bounds on at most two features, and flat arrays of each tree that has others."""
        import sys
        from collections import OrderedDict

        import numpy as np
        import pyarrow.parquet as pq
        from pyarrow import fs

        cache = sys.__dict__.setdefault("_flowlens_blocks", OrderedDict())
        if (address, k) in cache:
            cache.move_to_end((address, k))
            return cache[address, k][1]
        system, root = fs.FileSystem.from_uri(address)
        where = fs.FileSelector(f"{root}/block={k}", allow_not_found=True)
        out, used = [], 0
        for f in sorted(x.path for x in system.get_file_info(where) if x.path.endswith(".parquet")):
            with system.open_input_file(f) as source:
                table = pq.ParquetFile(source).read()
            tree = table.column("tree_id").to_numpy()
            columns = [table.column(c).to_numpy() for c in ("node_id", "feature", "threshold", "left_id", "right_id", "leaf")]
            for part in zip(*(np.split(c, np.flatnonzero(np.diff(tree)) + 1) for c in columns)):
                ids, feature, threshold, left, right, value = part
                if len(ids):
                    out.append((int(np.searchsorted(ids, 0)), feature, threshold, np.searchsorted(ids, left), np.searchsorted(ids, right), value))
            used += table.nbytes
        out = _boxed(out)
        cache[address, k] = used, out
        while len(cache) > 1 and sum(x[0] for x in cache.values()) > kept:
            cache.popitem(last=False)
        return out

    def sums(cells):
        import numpy as np

        lines, total = np.arange(len(cells)), np.zeros(len(cells))
        for k in range(blocks):
            boxes, trees = block(k)
            for pair, found in boxes:
                _add_boxes(total, cells, pair, found, most)
            for root, feature, threshold, left, right, value in trees:
                here = np.full(len(cells), root)
                while (inner := feature[here] >= 0).any():
                    below = cells[lines, np.maximum(feature[here], 0)] <= threshold[here]
                    here = np.where(inner, np.where(below, left[here], right[here]), here)
                total += value[here]
        return total

    def score(batches):
        import numpy as np
        import pandas as pd

        held, n = [], 0

        def flush():
            total = sums(np.concatenate(held))
            at = np.cumsum([len(h) for h in held])[:-1]
            return [pd.Series(x) for x in np.split(total, at)]

        for x in batches:
            held.append(x.to_numpy(dtype=float, na_value=np.nan))
            n += len(x)
            if n >= together:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    cells = F.struct(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    return F.pandas_udf(score, "double", F.PandasUDFType.SCALAR_ITER)(cells), trees


def _boxed(trees: list) -> tuple[list, list]:
    """([((feature, feature), boxes)], trees left): a leaf is a box, and a row's sum is that of the boxes around it.

    A box is (low, high, low, high, value) with low < x <= high for each of its features; a missing feature is beyond all
    bounds. A tree with a leaf that is bound by three features or more, or that has no value, stays as it is.
    """
    import numpy as np

    inf, boxes, rest = np.inf, {}, []
    for tree in trees:
        root, feature, threshold, left, right, value = (x.tolist() if hasattr(x, "tolist") else x for x in tree)
        own, todo = [], [(root, {})]
        while todo and own is not None:
            i, bounds = todo.pop()
            if (f := feature[i]) < 0:
                if len(bounds) > 2 or not np.isfinite(value[i]):
                    own = None
                else:
                    own.append((bounds, value[i]))
                continue
            low, high = bounds.get(f, (-inf, inf))
            t = threshold[i]
            # Nothing but a missing or infinite feature is beyond an infinite bound; NaN bounds nothing.
            if t != t or abs(t) == inf or max(left[i], right[i]) >= len(feature) or len(bounds) > 2:
                own = None
                continue
            if low < t:
                todo.append((left[i], bounds | {f: (low, min(high, t))}))
            if t < high:
                todo.append((right[i], bounds | {f: (max(low, t), high)}))
        if own is None:
            rest.append(tree)
            continue
        for bounds, v in own:
            pair = [*sorted(bounds), *([-1] * (2 - len(bounds)))]
            (a, b), (c, d) = (bounds.get(f, (-inf, inf)) for f in pair)
            if v:
                boxes.setdefault(tuple(pair), []).append((a, b, c, d, v))
    return [(pair, np.array(found)) for pair, found in sorted(boxes.items())], rest


def _add_boxes(total, cells, pair, boxes, most: int) -> None:
    """Adds to ``total`` the values of the boxes around each row: differences at the corners, summed along both sides.

    Boxes in the order of their bounds are halved until the grid between their bounds has at most ``most`` cells.
    """
    import numpy as np

    x, y = (cells[:, f] if f >= 0 else np.zeros(len(cells)) for f in pair)
    todo = [boxes[np.lexsort((boxes[:, 2], np.where(np.isfinite(boxes[:, 0]), boxes[:, 0], boxes[:, 1])))]]
    while todo:
        own = todo.pop()
        xs, ys = (np.unique(side[np.isfinite(side)]) for side in (own[:, :2], own[:, 2:4]))
        if (len(xs) + 2) * (len(ys) + 2) > most and len(own) > 1:
            todo += [own[:len(own) // 2], own[len(own) // 2:]]
            continue
        grid = np.zeros((len(xs) + 2, len(ys) + 2))
        # A row stands behind as many bounds as lie below it, a missing value behind all.
        sides = [np.where(own[:, i] == -np.inf, 0, np.searchsorted(v, own[:, i]) + 1) for i, v in ((0, xs), (1, xs), (2, ys), (3, ys))]
        a, b, c, d = (np.minimum(s, len(v) + 1) for s, v in zip(sides, (xs, xs, ys, ys)))
        for i, j, sign in ((a, c, 1), (b, c, -1), (a, d, -1), (b, d, 1)):
            np.add.at(grid, (i, j), sign * own[:, 4])
        grid = grid.cumsum(axis=0).cumsum(axis=1)
        total += grid[np.searchsorted(xs, x), np.searchsorted(ys, y)]


def _block_sums(df: DataFrame, nodes: DataFrame, features: Sequence[str], leaf: str) -> tuple[DataFrame, Column, int]:
    """The same sum with neither the model nor the rows in one place; only two counts reach the driver.

    Each block of rows meets each block of whole trees in one task, and the
    sums are added per row number.
    """
    model = materialise(nodes.select("tree_id", "node_id", "feature", F.col("threshold").cast("double").alias("threshold"), "left_id", "right_id",
                                     F.col(leaf).cast("double").alias("leaf")), "model")
    size, trees = model.agg(F.count(F.lit(1)), F.count_if(F.col("node_id") == 0)).first()
    check_free(df, (SUM, "_row", "_rows", "_trees"))
    # Numbered from written rows: a task that runs again gives the same numbers.
    rows = materialise(materialise(df, "rows").withColumn("_row", F.monotonically_increasing_id()), "rows")
    blocks = -(-size // BLOCK_NODES)
    every = rows.select(F.shiftright("_row", 16).alias("_rows")).distinct()
    points = rows.select("_row", F.shiftright("_row", 16).alias("_rows"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_trees"))
    parts = model.withColumn("_trees", F.pmod(F.xxhash64("tree_id"), F.lit(blocks)).cast("int")).crossJoin(every)

    def walk(points, parts):
        import numpy as np
        import pandas as pd

        if points.empty or parts.empty:
            return pd.DataFrame({"_row": np.empty(0, np.int64), "_sum": np.empty(0)})
        cells = np.array([[np.nan if v is None else v for v in x] for x in points["x"]], dtype=float)
        lines, total = np.arange(len(cells)), np.zeros(len(cells))
        parts = parts.sort_values(["tree_id", "node_id"])
        cuts = np.flatnonzero(np.diff(parts["tree_id"].to_numpy())) + 1
        columns = [np.split(parts[c].to_numpy(), cuts) for c in ("node_id", "feature", "threshold", "left_id", "right_id", "leaf")]
        for ids, feature, threshold, left, right, value in zip(*columns):
            left, right = np.searchsorted(ids, left), np.searchsorted(ids, right)
            here = np.zeros(len(cells), np.int64)
            while (inner := feature[here] >= 0).any():
                below = cells[lines, np.maximum(feature[here], 0)] <= threshold[here]
                here = np.where(inner, np.where(below, left[here], right[here]), here)
            total += value[here]
        return pd.DataFrame({"_row": points["_row"], "_sum": total})

    keys = ["_rows", "_trees"]
    sums = (points.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInPandas(walk, "_row bigint, _sum double")
            .groupBy("_row").agg(F.sum("_sum").alias("_sum")))
    return rows.join(sums.withColumnRenamed("_sum", SUM), "_row", "left").drop("_row"), F.col(SUM), trees


def _walker(model: Mapping, features: Sequence[str], leaf: str) -> Column:
    """The same sum by flat node arrays: all rows of a batch go down one level of one tree at a time."""
    import numpy as np

    trees = []
    for nodes in model.values():
        at = {i: k for k, i in enumerate(sorted(nodes))}
        rows = [nodes[i] for i in at]
        feature = np.array([r["feature"] for r in rows])
        trees.append((at[0], feature, np.array([r["threshold"] for r in rows]), np.array([at.get(r["left_id"], 0) for r in rows]),
                      np.array([at.get(r["right_id"], 0) for r in rows]), np.array([r[leaf] for r in rows], float)))

    def walk(x):
        import numpy as np
        import pandas as pd

        cells = x.to_numpy(dtype=float, na_value=np.nan)
        lines, total = np.arange(len(cells)), np.zeros(len(cells))
        for root, feature, threshold, left, right, value in trees:
            here = np.full(len(cells), root)
            while (inner := feature[here] >= 0).any():
                # Leaves look at feature 0 but stay where they are.
                below = cells[lines, np.maximum(feature[here], 0)] <= threshold[here]
                here = np.where(inner, np.where(below, left[here], right[here]), here)
            total += value[here]
        return pd.Series(total)

    return F.pandas_udf(walk, "double", F.PandasUDFType.SCALAR)(F.struct(*[F.col(f).cast("double").alias(f) for f in features]))


def soft_vote(df: DataFrame, nodes: DataFrame, features: Sequence[str], name: str = "score", limit: int | None = None) -> DataFrame:
    """Mean leaf probability."""
    df, total, trees = _leaf_sum(df, nodes, features, "prob", limit)
    return df.withColumn(name, total / F.lit(float(trees))).drop(SUM)


def majority_vote(df: DataFrame, nodes: DataFrame, features: Sequence[str], name: str = "pred", limit: int | None = None) -> DataFrame:
    """1 when more than half of the trees (rounded down) say 1."""
    df, total, trees = _leaf_sum(df, nodes, features, "value", limit)
    return df.withColumn(name, F.when(total > trees // 2, 1).otherwise(0)).drop(SUM)


def boosted_score(df: DataFrame, nodes: DataFrame, features: Sequence[str], base: float, rate: float, name: str = "raw",
                  limit: int | None = None) -> DataFrame:
    """base + rate * sum of leaf values."""
    df, total, _ = _leaf_sum(df, nodes, features, "leaf_value", limit)
    return df.withColumn(name, F.lit(float(base)) + F.lit(float(rate)) * total).drop(SUM)


# --- inspection ----------------------------------------------------------------

def importance_split_count(nodes: DataFrame, n_features: int, keys: Sequence[str] = ()) -> DataFrame:
    """Share of splits per feature; features never used get 0."""
    return _importance(nodes, n_features, F.lit(1.0), keys)


def importance_gain(nodes: DataFrame, n_features: int, keys: Sequence[str] = ()) -> DataFrame:
    """Share of the total gain per feature; all zeros when there is no gain."""
    return _importance(nodes, n_features, F.col("gain"), keys)


def _importance(nodes: DataFrame, n_features: int, amount: Column, keys: Sequence[str]) -> DataFrame:
    row = nodes.groupBy(*keys).agg(*[F.sum(F.when(F.col("feature") == i, amount)).alias(f"f{i}") for i in range(n_features)])
    parts = [F.coalesce(F.col(f"f{i}"), F.lit(0.0)) for i in range(n_features)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    share = F.array(*[F.struct(F.lit(i).alias("feature"), F.when(F.col("_t") == 0, 0.0)
                               .otherwise(F.try_divide(p, F.col("_t"))).alias("importance"))
                      for i, p in enumerate(parts)])
    return row.withColumn("_t", total).select(*keys, F.explode(share).alias("s")).select(*keys, "s.*")


def top_features(importance: DataFrame, n: int, names: Sequence[str] | None = None) -> DataFrame:
    """The n largest importances with their rank and name (``feat_i`` without names)."""
    if names:
        name = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("feature") + 1)
    else:
        name = F.concat(F.lit("feat_"), F.col("feature").cast("string"))
    order = Window.orderBy(F.desc("importance"), "feature")  # one row per feature
    return (importance.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
            .select("rank", name.alias("name"), "importance"))


def node_kinds(nodes: DataFrame) -> DataFrame:
    kind = (F.when((F.col("feature") < 0) & (F.col("leaf_value") == 0), "empty")
            .when(F.col("feature") < 0, "real_leaf").otherwise("split"))
    return nodes.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def reachable(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """Nodes reachable from the root with their depth, walked one level per job."""
    ensure_checkpoint_dir(nodes.sparkSession)
    links = nodes.select("tree_id", "node_id", "feature", "left_id", "right_id")
    level = links.filter("node_id = 0").withColumn("depth", F.lit(0)).checkpoint()
    found = level
    for d in range(1, max_depth + 1):
        kids = (level.filter("feature >= 0")
                .select("tree_id", F.explode(F.array("left_id", "right_id")).alias("node_id")).filter("node_id >= 0"))
        level = kids.join(links, ["tree_id", "node_id"]).withColumn("depth", F.lit(d)).checkpoint()
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.select("tree_id", "node_id", "depth")


def tree_stats(nodes: DataFrame) -> DataFrame:
    """Leaves, nodes, depth and reachable nodes per tree."""
    sizes = nodes.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("feature") < 0).alias("n_leaves"))
    walk = reachable(nodes).groupBy("tree_id").agg(
        F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_reachable"))
    return sizes.join(walk, "tree_id")


def soft_threshold(w: Column, alpha: float) -> Column:
    """sign(w) * max(|w| - alpha, 0)."""
    return F.signum(w) * F.greatest(F.abs(w) - F.lit(float(alpha)), F.lit(0.0))


def leaf_positions(nodes: DataFrame) -> DataFrame:
    """Leaves numbered 1.. in node order; a window partition is one tree."""
    order = Window.partitionBy("tree_id").orderBy("node_id")
    return nodes.filter("feature < 0").withColumn("leaf_no", F.row_number().over(order))


def replace_leaves(nodes: DataFrame, values: DataFrame, alpha: float = 0.0) -> DataFrame:
    """New leaf values by position (tree_id, leaf_no, new_value), soft-thresholded by ``alpha``.

    Every tree must get exactly as many values as it has leaves.
    """
    leaves = leaf_positions(nodes).select("tree_id", "node_id", "leaf_no")
    pairs = leaves.join(values, ["tree_id", "leaf_no"], "full_outer")
    bad = pairs.filter("node_id IS NULL OR new_value IS NULL")
    if not bad.isEmpty():
        raise ValueError("leaf values do not match the leaves of the trees")
    new = soft_threshold(F.col("new_value"), alpha) if alpha > 0 else F.col("new_value")
    mapped = pairs.select("tree_id", "node_id", new.alias("_new"))
    return (nodes.join(mapped, ["tree_id", "node_id"], "left")
            .withColumn("leaf_value", F.coalesce("_new", "leaf_value")).drop("_new"))
