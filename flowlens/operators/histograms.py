"""Forests and boosted trees grown level by level on a table of bucket numbers.

The training table is written once, in blocks of some thousand rows whose columns are flat arrays: per row the bucket of
every feature, the label and, for each tree, how often the row counts and the open node it stands in. A level is one pass that
takes every row one node down and counts the buckets of the smaller child of each split; the larger child is its parent
minus its sibling. Every few levels the blocks are written with their new nodes, so no row starts at the root again. All
trees of a forest take part in the same passes, so the number of jobs follows the depth and not the number of trees or of
rounds before. A boosting round writes the new scores together with the sums and losses its next round starts from.

Tasks count with numpy and send one sparse row per node, so the shuffle is bounded by tasks x nodes x features x
buckets. The driver holds the trees, and the bucket sums of a level only while they are few.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.ordered import add_buckets, bucket_edges
from ..plans.small import discard, materialise, scratch_path, spread
from . import boosting as G
from ..plans.ranking import hash_rank
from .sample import draw_ranks, resolve_max_features
from .trees import Node, Tree, feature_subset

register_pickle_by_value(sys.modules[__name__])

# Trees whose rows' places travel in one table.
TREES_AT_ONCE = 32
# Bytes of bucket sums that one task of the merge holds, and of those of a level that the driver may hold.
MERGE_BYTES, DRIVER_BYTES = 64 << 20, 8 << 20
# Levels after which the rows are written with their nodes, and rounds whose samples are drawn together.
CARRY_LEVELS, DRAWN_ROUNDS = 3, 16
# Bytes and rows of a block; ranks of one class whose rows make a block of a forest; draws that a task counts at a time.
BLOCK_BYTES, BLOCK_ROWS, RANKS, DRAWS = 256 << 10, 1 << 16, 1 << 13, 1 << 22
# Bits of a row's draw that are counted to find the cut of a sample of exact size.
DRAW_BITS = 16


@dataclass
class Bins:
    """Bucket numbers 0.. of the features, -1 for a missing value, and the threshold that follows each bucket."""

    features: list[str]
    edges: dict[str, list[float]]
    cuts: list[list[float]]
    width: int

    def column(self) -> Column:
        def one(f: str) -> Column:
            v = F.col(f).cast("double")
            return F.when(v.isNull() | F.isnan(v), -1).otherwise(F.col(f"_b_{f}")).cast("smallint")

        return F.array(*[one(f) for f in self.features])

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with the array ``bins``."""
        ready = add_buckets(df, self.features, self.edges)
        return ready.withColumn("bins", self.column()).drop(*[f"_b_{f}" for f in self.features])


def fit_bins(df: DataFrame, features: Sequence[str], buckets: int | None = None) -> Bins:
    """Buckets of about equal numbers of rows; a threshold is the middle between the values on its two sides."""
    features = list(features)
    edges = bucket_edges(df, features, buckets)
    bins = Bins(features, edges, [], max([len(e) for e in edges.values()], default=0) + 1)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.get("bins", F.lit(i)).alias("b"), F.col(f).cast("double").alias("v"))
                                for i, f in enumerate(features)])).alias("c")
    # At most features x buckets rows.
    ends = bins.apply(df.select(*features)).select(cells).select("c.*").filter("b >= 0").groupBy("f", "b").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    for i in range(len(features)):
        mine = {r["b"]: r for r in ends if r["f"] == i}
        cuts, above = [math.inf] * bins.width, None
        for b in range(bins.width - 1, -1, -1):
            if b in mine:
                cuts[b] = (mine[b]["hi"] + above) / 2.0 if above is not None else math.inf
                above = mine[b]["lo"]
        bins.cuts.append(cuts)
    return bins


# --- passes over the rows -----------------------------------------------------------------

def _matrix(column, width: int):
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width) if width else np.empty((len(column), 0), np.int16)


# How a column lies in a block: the type of its cells, and how many a row has.
Layout = dict[str, tuple[str, int]]


def _schema(layout: Layout) -> str:
    return ", ".join(["n int", *[f"{c} binary" for c in layout], "tree int, parent int, at binary, value binary, base binary, losses array<double>"])


def _block(layout: Layout, n: int, cells: dict, **rest):
    """One row: a block of ``n`` rows, or with n = 0 what a task adds up over its blocks."""
    import pyarrow as pa

    kinds = {"tree": pa.int32(), "parent": pa.int32(), "at": pa.binary(), "value": pa.binary(), "base": pa.binary(), "losses": pa.list_(pa.float64())}
    data = {"n": pa.array([n], pa.int32()), **{c: pa.array([cells[c].tobytes() if c in cells else b""], pa.binary()) for c in layout},
            **{c: pa.array([rest.get(c)], k) for c, k in kinds.items()}}
    return pa.RecordBatch.from_arrays([*data.values()], [*data])


def _blocks(batches, layout: Layout):
    """(n, {column: cells}) of each block; cells have one line per feature, tree or value, and a row of the table in each column."""
    import numpy as np

    for b in batches:
        size = b.column(b.schema.get_field_index("n"))
        columns = {c: b.column(b.schema.get_field_index(c)) for c in layout if c in b.schema.names}
        for i in range(b.num_rows):
            if n := size[i].as_py():
                yield n, {c: np.frombuffer(v[i].as_buffer(), layout[c][0]).reshape(layout[c][1], n) for c, v in columns.items()}


def _packed(rows: DataFrame, layout: Layout) -> DataFrame:
    """``rows``, whose columns are numbers and arrays of fixed length, in blocks."""
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // sum(width * int(kind[1:]) for kind, width in layout.values())))
    names = list(layout)

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        held, n = [], 0

        def flush():
            return _block(layout, n, {c: np.ascontiguousarray(np.concatenate([h[i] for h in held]).T) for i, c in enumerate(names)})

        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                held.append([(_matrix(b.column(i), layout[c][1]) if pa.types.is_list(b.column(i).type) else b.column(i).to_numpy(zero_copy_only=False)[:, None]).astype(layout[c][0])
                             for i, c in enumerate(names)])
                n += b.num_rows
                if n >= size:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return rows.select(*names).mapInArrow(pack, _schema(layout))


def _below(bins, node, splits, levels: int):
    """Nodes some levels down; ``splits`` has per tree the arrays feature, bucket, left, right by node."""
    import numpy as np

    node = node.copy() if levels else node
    n, flat = bins.shape[1], bins.reshape(-1)
    for t, (feature, bucket, left, right) in enumerate(splits if levels else ()):
        own = node[t]
        live = np.flatnonzero(own >= 0)
        for _ in range(levels):
            here = own[live]
            f = feature[here]
            if (f < 0).any():
                some = f >= 0
                live, here, f = live[some], here[some], f[some]
            b = flat[f.astype(np.int64) * n + live]
            # Bucket numbers are stored plus 1, a missing feature as 0: it goes right.
            own[live] = np.where((b > 0) & (b <= bucket[here] + 1), left[here], right[here])
    return node


def _split_arrays(trees: Sequence[Tree]) -> list:
    import numpy as np

    out = []
    for tree in trees:
        n = len(tree.nodes)
        a = np.full((4, n), -1, np.int32)
        for v in tree.nodes.values():
            a[:, v.node_id] = v.feature, getattr(v, "bucket", -1), v.left, v.right
        out.append(tuple(a))
    return out


def _moved(rows: DataFrame, layout: Layout, trees: Sequence[Tree], levels: int) -> DataFrame:
    """Every row's place some levels down, as a written table; the one before is given up."""
    splits = _split_arrays(trees)

    def move(batches):
        for n, cells in _blocks(batches, layout):
            yield _block(layout, n, cells | {"node": _below(cells["bins"], cells["node"], splits, levels)})

    out = _written(rows.mapInArrow(move, _schema(layout)), "rows")
    discard(rows)
    return out


def _written(df: DataFrame, label: str) -> DataFrame:
    """Blocks are large cells: small row groups keep what a task holds at a time small."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("parquet.enable.dictionary", "false").option("parquet.block.size", str(16 << 20)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bin_kind(bins: Bins) -> str:
    return "u1" if bins.width < 256 else "u2"


def _add_sums(sums, slot, bins, live, weights, width: int) -> None:
    """Adds the weights of the rows ``live``, which stand in ``slot``, to the cells (slot, feature, bucket) of ``sums``."""
    import numpy as np

    m, size = len(bins), len(sums)
    for f in range(m):
        where = slot * (m * width) + (f * width) + bins[f][live]
        for s, w in enumerate(weights):
            sums[:, s] += np.bincount(where, w, size)


def _sparse(own):
    import numpy as np

    some = np.flatnonzero(own.any(axis=1)).astype(np.int32)
    return some.tobytes(), own[some].tobytes()


SUMS = "tree int, parent int, at binary, value binary, base binary"


def _counted(rows: DataFrame, layout: Layout, trees: Sequence[Tree], levels: int, slots: Sequence[dict[int, int]], bins: Bins, stats: int, weigh: Callable) -> DataFrame:
    """Bucket sums of the nodes in ``slots`` ({node: parent} per tree), one sparse row per task and node.

    ``weigh`` gives the weights of some rows of a block in a tree, one array per statistic.
    """
    m, width = len(bins.features), bins.width + 1
    splits, sizes = _split_arrays(trees), [max(len(t.nodes), 1) for t in trees]

    def count(batches):
        import numpy as np
        import pyarrow as pa

        place = []
        for nodes, size in zip(slots, sizes):
            p = np.full(size, -1, np.int64)
            p[list(nodes)] = np.arange(len(nodes))
            place.append(p)
        held = [np.zeros((len(nodes) * m * width, stats)) for nodes in slots]
        for n, cells in _blocks(batches, layout):
            node = _below(cells["bins"], cells["node"], splits, levels)
            for t, sums in enumerate(held):
                live = np.flatnonzero(node[t] >= 0)
                slot = place[t][node[t][live]]
                if (slot < 0).any():
                    live, slot = live[slot >= 0], slot[slot >= 0]
                if len(live):
                    _add_sums(sums, slot, cells["bins"], live, weigh(cells, t, live), width)
        out = []
        for t, (nodes, sums) in enumerate(zip(slots, held)):
            for k, parent in enumerate(nodes.values()):
                at, value = _sparse(sums[k * m * width:(k + 1) * m * width])
                if at:
                    out.append((t, parent, at, value, None))
        cols = list(zip(*out)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["tree", "parent", "at", "value", "base"])

    return rows.select("n", *layout).mapInArrow(count, SUMS)


# --- the merge ------------------------------------------------------------------------------

def gini_gains(cum, total, min_leaf: int):
    """Impurity of the parent minus the weighted impurities of the children; stats are (n, positives)."""
    import numpy as np

    n, p, ln, lp = total[..., 0], total[..., 1], cum[..., 0], cum[..., 1]
    rn, rp = n - ln, p - lp

    def impurity(pos, size):
        a, b = pos / size, (size - pos) / size
        return 1.0 - a * a - b * b

    with np.errstate(all="ignore"):
        share = p / n
        parent = 1.0 - share * share - (1.0 - share) * (1.0 - share)
        gain = parent - (ln / n * impurity(lp, ln) + rn / n * impurity(rp, rn))
    return np.where((ln >= min_leaf) & (rn >= min_leaf), gain, -np.inf)


def newton_gains(cum, total, lam: float, gamma: float, min_child: float):
    """Second-order gain; stats are (n, gradient, hessian)."""
    import numpy as np

    g, h, gl, hl = total[..., 1], total[..., 2], cum[..., 1], cum[..., 2]
    gr, hr = g - gl, h - hl
    with np.errstate(all="ignore"):
        gain = 0.5 * (gl * gl / (hl + lam) + gr * gr / (hr + lam) - g * g / (h + lam)) - gamma
    return np.where((hl >= min_child) & (hr >= min_child), gain, -np.inf)


FOUND = "tree int, node int, feature int, bucket int, gain double, left binary, total binary, sums binary"


def _merged(sums: DataFrame, parents: DataFrame | None, children: dict, allowed: dict, bins: Bins, stats: int, gains: Callable, tasks: int) -> DataFrame:
    """Best split and bucket sums of the open nodes.

    ``children`` maps (tree, parent) to (counted child, other child or -1); at the root both parent and child are 0.
    The other child's sums are the parent's minus the counted ones. ``allowed`` limits the features of a (tree, node).
    """
    m, width = len(bins.features), bins.width + 1
    both = sums if parents is None else sums.unionByName(
        parents.select("tree", F.col("node").alias("parent"), F.col("sums").alias("base")), allowMissingColumns=True)
    wanted = parents is not None

    def merge(batches):
        import numpy as np
        import pyarrow as pa

        counted, whole = {}, {}
        for b in batches:
            for t, p, at, value, base in zip(*(c.to_pylist() for c in b.columns)):
                if (t, p) not in children:
                    continue
                if base is not None:
                    whole[t, p] = np.frombuffer(base).reshape(m, width, stats)
                else:
                    own = counted.setdefault((t, p), np.zeros((m * width, stats)))
                    own[np.frombuffer(at, np.int32)] += np.frombuffer(value).reshape(-1, stats)
        out = []
        for key in sorted(whole if wanted else counted):
            own = counted.get(key, np.zeros((m * width, stats))).reshape(m, width, stats)
            first, other = children[key]
            for node, h in ((first, own), (other, whole[key] - own if wanted else None)):
                if h is None or node < 0:
                    continue
                total = h[0].sum(axis=0)
                cum = np.cumsum(h[:, 1:], axis=1)
                here = h[:, 1:, 0] > 0
                # A cut needs a value on its right too; missing values alone are none.
                later = np.flip(np.logical_or.accumulate(np.flip(here, 1), axis=1), 1)
                usable = here & np.concatenate([later[:, 1:], np.zeros((m, 1), bool)], axis=1)
                gain = np.where(usable, gains(cum, total), -np.inf)
                if (key[0], node) in allowed:
                    closed = np.ones(m, bool)
                    closed[allowed[key[0], node]] = False
                    gain[closed] = -np.inf
                gain = np.where(np.isnan(gain), -np.inf, gain)
                best = int(np.argmax(gain))  # ties: first feature, then lowest bucket
                f, cut = divmod(best, width - 1)
                found = np.isfinite(gain[f, cut])
                out.append((key[0], node, f if found else -1, cut, float(gain[f, cut]) if found else None, cum[f, cut].tobytes(), total.tobytes(), h.tobytes()))
        cols = list(zip(*out)) or [()] * 8
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["tree", "node", "feature", "bucket", "gain", "left", "total", "sums"])

    return both.repartition(tasks, "tree", "parent").mapInArrow(merge, FOUND)


def _grow(rows: DataFrame, layout: Layout, trees: int, bins: Bins, names: Sequence[str], weigh: Callable, gains: Callable, max_depth: int,
          may_split: Callable[[Node], bool], accept: Callable[[float], bool], subset: Callable[[int, int], Sequence[int]] | None = None,
          counts: Sequence[str] = ("n",), first: DataFrame | None = None) -> tuple[list[Tree], DataFrame, int]:
    """Trees over the rows' open nodes; returns them, the rows and how many levels these stand above their leaves.

    ``first`` has the sums of the roots, when they were counted before.
    """
    import numpy as np

    spark, k, m = rows.sparkSession, len(names), len(bins.features)
    grown, levels = [Tree() for _ in range(trees)], 0
    slots = [{0: 0} for _ in range(trees)]
    children = {(t, 0): (0, -1) for t in range(trees)}
    parents, per_node = None, m * (bins.width + 1) * k * 8

    def numbers(raw) -> dict:
        return {s: (int(round(x)) if s in counts else float(x)) for s, x in zip(names, np.frombuffer(raw))}

    for depth in range(max_depth):
        allowed = {} if subset is None else {(t, c): list(subset(t, c)) for (t, _), pair in children.items() for c in pair if c >= 0}
        tasks = max(1, -(-len(children) * 3 * per_node // MERGE_BYTES), min(len(children), spark.sparkContext.defaultParallelism))
        sums = first if depth == 0 and first is not None else _counted(rows, layout, grown, levels, slots, bins, k, weigh)
        found = _merged(sums, parents, children, allowed, bins, k, gains, tasks)
        few = 2 * len(children) * per_node <= DRIVER_BYTES
        if not few:
            found = _written(found, "nodes")
        picks = sorted((found if few else found.drop("sums")).collect(), key=lambda r: (r["tree"], r["node"]))  # one row per open node
        if depth == 0:
            for t in range(trees):
                grown[t].nodes[0] = Node(0, 0, dict.fromkeys(names, 0), 0)
            for r in picks:
                total = numbers(r["total"])
                grown[r["tree"]].nodes[0] = Node(0, int(total["n"]), total, 0)
        slots, children, split = [{} for _ in range(trees)], {}, False
        for r in picks:
            tree = grown[r["tree"]]
            node = tree.nodes[r["node"]]
            if r["feature"] < 0 or not may_split(node) or not accept(r["gain"]):
                continue
            split = True
            left = numbers(r["left"])
            right = {s: node.stats[s] - left[s] for s in names}
            node.feature, node.bucket, node.threshold, node.gain = r["feature"], r["bucket"], bins.cuts[r["feature"]][r["bucket"]], r["gain"]
            node.left, node.right = len(tree.nodes), len(tree.nodes) + 1
            for i, side in ((node.left, left), (node.right, right)):
                tree.nodes[i] = Node(i, int(side["n"]), side, depth + 1)
            small, large = (node.left, node.right) if left["n"] <= right["n"] else (node.right, node.left)
            if may_split(tree.nodes[small]) or may_split(tree.nodes[large]):
                slots[r["tree"]][small] = node.node_id
                children[r["tree"], node.node_id] = (small, large)
        levels += split
        if not children:
            break
        if few:
            parents = spark.createDataFrame([r for r in picks if (r["tree"], r["node"]) in children], FOUND)
        else:
            parents = found.join(F.broadcast(spark.createDataFrame(sorted(children), "tree int, node int")), ["tree", "node"], "left_semi")
        if levels == CARRY_LEVELS and depth + 1 < max_depth:
            rows, levels = _moved(rows, layout, grown, levels), 0
    return grown, rows, levels


# --- forests ----------------------------------------------------------------------------------

def forest(df: DataFrame, features: Sequence[str], y: str, keys: Sequence[str], trees: int = 10, max_depth: int = 10, min_split: int = 2,
           min_leaf: int = 1, max_features="sqrt", weights="balanced", seed: int = 42, buckets: int | None = None,
           bins: Bins | None = None) -> list[Tree]:
    """Gini trees on weighted bootstraps of whole rows, with a feature subset per node.

    Draws, subsets, node numbers, ties and the handling of missing features are those of ``trees.cart_forest``; splits are sought
    among the buckets' ends. A node is a leaf when it is pure, smaller than ``min_split`` or no cut leaves
    ``min_leaf`` rows on both sides. Rows with a null label are left out. Up to 32 trees share their passes.
    """
    if trees < 1 or max_depth < 1:
        raise ValueError("trees and max_depth must be positive")
    df = df.filter(F.col(y).isNotNull())
    bins = bins or fit_bins(df, features, buckets)
    narrow = bins.apply(df.select(*keys, *features, F.col(y))).select(*keys, F.col(y).cast("int").alias("_y"), "bins")
    narrow = materialise(narrow, "binned")
    k, out = resolve_max_features(max_features, len(bins.features)), []
    for first in range(0, trees, TREES_AT_ONCE):
        own = range(first, min(first + TREES_AT_ONCE, trees))
        layout = {"bins": (_bin_kind(bins), len(bins.features)), "y": ("u1", 1), "times": ("i4", len(own)), "node": ("i4", len(own))}
        rows = _bags(narrow, keys, own, weights, seed, layout)

        def weigh(cells, t, live):
            times = cells["times"][t][live]
            return times, times * cells["y"][0][live]

        grown, rows, _ = _grow(rows, layout, len(own), bins, ["n", "pos"], weigh, lambda cum, total: gini_gains(cum, total, min_leaf), max_depth,
                            may_split=lambda v: v.n >= min_split and 0 < v.stats["pos"] < v.n, accept=lambda g: g is not None,
                            subset=lambda t, i, first=first: feature_subset(bins.features, k, f"{seed}|{first + t}|{i}"), counts=("n", "pos"))
        discard(rows)
        out += grown
    return out


def _bags(narrow: DataFrame, keys: Sequence[str], own: range, weights, seed: int, layout: Layout) -> DataFrame:
    """Blocks of the rows that some tree of ``own`` drew, with the times each tree did.

    Draws are ranks in a class. Tasks count theirs per stretch of ranks and send the counts as flat arrays; the rows
    of a stretch meet them in one task, where they become a block. A row moves once, whatever the number of trees.
    """
    size, step, strata = len(own), RANKS, [] if weights is None else ["_y"]
    draws = draw_ranks(narrow, "_y", own, weights, seed).select("tree", *(strata or [F.lit(0).alias("_y")]), "_rank")

    def count(batches):
        import numpy as np
        import pyarrow as pa

        held, n = [], 0

        def flush():
            tree, y, rank = (np.concatenate([h[i] for h in held]) for i in range(3))
            codes, code = np.unique(y, return_inverse=True)
            # Class, rank and tree in one number, so one sort counts them.
            top = int(rank.max()) + 1
            cell, times = np.unique((code * top + rank) * size + (tree - own.start), return_counts=True)
            code, rest = np.divmod(cell, top * size)
            part, at = np.divmod(rest, step * size)
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(code) != 0)) + 1
            starts = np.concatenate([[0], cuts])
            at, times = at.astype(np.int32), times.astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(codes[code[starts]], pa.int32()), pa.array(part[starts], pa.int64()), pa.array([x.tobytes() for x in np.split(at, cuts)], pa.binary()),
                 pa.array([x.tobytes() for x in np.split(times, cuts)], pa.binary())], ["_y", "_part", "at", "times"])

        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            n += b.num_rows
            if n >= DRAWS:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    # Ranks start at 1.
    counts = draws.withColumn("_rank", F.col("_rank") - 1).mapInArrow(count, "_y int, _part long, at binary, times binary")
    ranked = hash_rank(narrow, strata, keys, seed, "_rank").select(
        *(strata or [F.lit(0).alias("_y")]), F.col("_y").alias("y"), F.floor((F.col("_rank") - 1) / step).cast("long").alias("_part"),
        ((F.col("_rank") - 1) % step).cast("int").alias("place"), "bins")

    def meet(rows, drawn):
        import numpy as np
        import pyarrow as pa

        times = np.zeros((step, size), np.int32)
        for at, n in zip(drawn.column("at").to_pylist(), drawn.column("times").to_pylist()):
            times.reshape(-1)[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int32)
        rows = rows.combine_chunks()
        mine = times[rows.column("place").to_numpy()] if len(rows) else times[:0]
        keep = np.flatnonzero(mine.any(axis=1))
        mine = mine[keep].T
        cells = {}
        if len(keep):
            found = np.stack([np.concatenate([_matrix(c, layout["bins"][1]) for c in rows.column("bins").chunks])])[0][keep]
            cells = {"bins": found.T + 1, "y": rows.column("y").to_numpy()[keep], "times": mine, "node": np.where(mine > 0, 0, -1)}
        return pa.Table.from_batches([_block(layout, len(keep), {c: np.ascontiguousarray(v.astype(layout[c][0])) for c, v in cells.items()})])

    keyed = ["_y", "_part"]
    met = ranked.groupBy(*keyed).cogroup(counts.groupBy(*keyed)).applyInArrow(meet, _schema(layout))
    return _written(met, "bags")


# --- boosting -----------------------------------------------------------------------------------

def _draw(key, seed: int, turn: int):
    """A 64-bit draw of each row for one round, from its hash."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def _gradients(raw, y):
    import numpy as np

    small = np.exp(-np.abs(raw))
    p = np.where(raw >= 0, 1 / (1 + small), small / (1 + small))
    return p, p - y, np.maximum(p * (1 - p), 1e-7)


def _weights(cells, live, cut: int, seed: int, turn: int):
    """Rows of ``live`` that the round's sample has, and their statistics."""
    import numpy as np

    some = (cells["held"][0][live] == 0) & (_draw(cells["key"][0][live], seed, turn) <= np.uint64(cut))
    _, g, h = _gradients(cells["raw"][0][live], cells["y"][0][live])
    return some, some * g, some * h


def _advance(rows: DataFrame, layout: Layout, tree: Tree | None, levels: int, lam: float, rate: float, bins: Bins, turn: int, cut: int | None, seed: int) -> DataFrame:
    """Scores with the newest tree's leaf values added, written.

    Each task also writes the losses of its training and held rows, and the root's sums of round ``turn`` if it has a cut.
    """
    import numpy as np

    leaf = np.zeros(1) if tree is None else np.array([rate * (-v.stats["g"] / (v.stats["h"] + lam)) for _, v in sorted(tree.nodes.items())])
    splits, m, width = _split_arrays([tree] if tree else []), len(bins.features), bins.width + 1

    def go(batches):
        import numpy as np

        sums, losses = np.zeros((m * width, 3)), np.zeros(4)
        for n, cells in _blocks(batches, layout):
            node = _below(cells["bins"], cells["node"], splits, levels)[0]
            cells |= {"raw": cells["raw"] + leaf[node], "node": np.zeros((1, n), layout["node"][0])}
            y, held = cells["y"][0], cells["held"][0] == 1
            p = np.clip(_gradients(cells["raw"][0], y)[0], 1e-7, 1 - 1e-7)
            loss = -np.log(np.where(y == 1, p, 1 - p))
            losses += [loss[~held].sum(), (~held).sum(), loss[held].sum(), held.sum()]
            if cut is not None:
                every = np.arange(n)
                _add_sums(sums, np.zeros(n, np.int64), cells["bins"], every, _weights(cells, every, cut, seed, turn), width)
            yield _block(layout, n, cells)
        at, value = _sparse(sums)
        yield _block(layout, 0, {}, tree=0, parent=0, at=at, value=value, losses=losses.tolist())

    out = _written(rows.select("n", *layout).mapInArrow(go, _schema(layout)), "scores")
    discard(rows)
    return out


def _losses(rows: DataFrame) -> tuple[float | None, float | None]:
    """Mean losses of training and held rows."""
    t, n, v, k = rows.filter("n = 0").agg(*[F.sum(F.col("losses")[i]) for i in range(4)]).first()
    return (t / n if n else None), (v / k if k else None)


def _cuts(rows: DataFrame, layout: Layout, seed: int, turns: range, share: float) -> dict[int, int]:
    """Per round the draw up to which rows are sampled, so that ceil(share * n) of them are; all rounds in two passes."""
    if share >= 1.0:
        return dict.fromkeys(turns, (1 << 64) - 1)
    train = rows.filter("n > 0").select("n", "held", "key")

    def count(batches):
        import numpy as np
        import pyarrow as pa

        slots = np.zeros((len(turns), 1 << DRAW_BITS), np.int64)
        for _, cells in _blocks(batches, layout):
            key = cells["key"][0][cells["held"][0] == 0]
            for k, t in enumerate(turns):
                slots[k] += np.bincount((_draw(key, seed, t) >> np.uint64(64 - DRAW_BITS)).astype(np.int64), minlength=1 << DRAW_BITS)
        k, slot = np.nonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array(k + turns.start), pa.array(slot), pa.array(slots[k, slot])], ["turn", "slot", "n"])

    slots = train.mapInArrow(count, "turn long, slot long, n long").groupBy("turn", "slot").agg(F.sum("n").alias("n"))
    whole, order = Window.partitionBy("turn"), Window.partitionBy("turn").orderBy("slot")  # 2^16 counters each
    run = slots.withColumn("total", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(order))
    need = F.greatest(F.lit(1), F.ceil(F.lit(float(share)) * F.col("total")))
    picks = {r["turn"]: (r["slot"], r["left"]) for r in run.filter((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need))
             .select("turn", "slot", (need - F.col("upto") + F.col("n")).alias("left")).collect()}  # one row per round

    def within(batches):
        import numpy as np
        import pyarrow as pa

        for _, cells in _blocks(batches, layout):
            key = cells["key"][0][cells["held"][0] == 0]
            for t, (slot, _) in picks.items():
                draw = _draw(key, seed, t)
                draw = draw[draw >> np.uint64(64 - DRAW_BITS) == slot].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(draw), t)), pa.array(draw)], ["turn", "draw"])

    # One slot has about n / 2^16 rows; its signed numbers keep the order of the unsigned ones.
    ranked = train.mapInArrow(within, "turn long, draw long").withColumn("r", F.row_number().over(Window.partitionBy("turn").orderBy("draw")))
    wanted = rows.sparkSession.createDataFrame([(t, int(left)) for t, (_, left) in picks.items()], "turn long, r int")
    last = {r["turn"]: r["draw"] & (1 << 64) - 1 for r in ranked.join(F.broadcast(wanted), ["turn", "r"]).collect()}
    return {t: last.get(t, 0) for t in turns}


def boost(df: DataFrame, features: Sequence[str], y: str, keys: Sequence[str], rounds: int = 100, rate: float = 0.1, max_depth: int = 6, lam: float = 1.0,
          gamma: float = 0.0, min_child: float = 1.0, subsample: float = 0.8, colsample: float = 0.8, seed: int = 42, valid: DataFrame | None = None,
          patience: int | None = None, buckets: int | None = None, base: float | None = None) -> G.BoostedModel:
    """Second-order boosting; a round is depth + 1 passes over the bucket numbers, whatever the rounds before.

    Each round fits one tree to ceil(subsample * n) rows, drawn without replacement by hashes of the keys, and ceil(colsample *
    m) features. Rows of ``valid`` travel in the same table without weight. With ``patience`` the loop ends after so
    many rounds without a validation loss 1e-7 below the best, and the trees up to the best round are kept. Rows with
    a null label are left out; a missing feature goes right. Rows with equal keys are sampled together.
    """
    for name, ok in (("rounds", rounds >= 1), ("rate", 0 < rate <= 1), ("subsample", 0 < subsample <= 1),
                     ("colsample", 0 < colsample <= 1), ("lam", lam >= 0), ("max_depth", max_depth >= 1)):
        if not ok:
            raise ValueError(f"bad value for {name}")
    features = list(features)

    def narrow(rows: DataFrame, held: bool) -> DataFrame:
        return rows.filter(F.col(y).isNotNull()).select(*features, F.col(y).alias("_y"), F.lit(held).alias("_held"), F.xxhash64(*keys).alias("_key"))

    both = materialise(narrow(df, False) if valid is None else narrow(df, False).unionByName(narrow(valid, True)), "narrow")
    df = both.filter("NOT _held")
    if base is None:
        base = G.base_score(df, F.col("_y")).first()["base_score"]
    bins = fit_bins(df, features, buckets)
    model = G.BoostedModel(float(base), rate, lam, bins.features)
    layout = {"bins": (_bin_kind(bins), len(features)), "y": ("u1", 1), "held": ("u1", 1), "key": ("i8", 1), "raw": ("f8", 1), "node": ("i4", 1)}
    rows = _packed(bins.apply(both).select(
        F.transform("bins", lambda b: b + 1).alias("bins"), F.col("_y").cast("int").alias("y"), F.col("_held").cast("int").alias("held"), F.col("_key").alias("key"),
        F.lit(float(base)).alias("raw"), F.lit(0).alias("node")), layout)
    rows, cuts = _written(rows, "binned"), {}

    def cut(t: int) -> int | None:
        if t not in cuts and t < rounds:
            cuts.update(_cuts(rows, layout, seed, range(t, min(rounds, t + DRAWN_ROUNDS)), subsample))
        return cuts.get(t)

    rows = _advance(rows, layout, None, 0, lam, rate, bins, 0, cut(0), seed)
    best, best_len, waited = math.inf, 0, 0
    for t in range(rounds):
        chosen = G.column_subset(bins.features, colsample, f"{seed}|{t}")

        def weigh(cells, _, live, t=t, upto=cut(t)):
            return _weights(cells, live, upto, seed, t)

        roots = rows.filter("n = 0").select("tree", "parent", "at", "value", "base")
        (tree,), rows, levels = _grow(rows, layout, 1, bins, ["n", "g", "h"], weigh, lambda cum, total: newton_gains(cum, total, lam, gamma, min_child), max_depth,
                              may_split=lambda v: v.n >= 2, accept=lambda g: g is not None and g > 0.0, subset=lambda *_: chosen, first=roots)
        model.trees.append(tree)
        rows = _advance(rows, layout, tree, levels, lam, rate, bins, t + 1, cut(t + 1), seed)
        train_loss, val_loss = _losses(rows)
        model.log.append({"round": t + 1, "train_loss": train_loss, "val_loss": val_loss})
        if val_loss is not None and patience is not None:
            if val_loss < best - 1e-7:
                best, best_len, waited = val_loss, t + 1, 0
            else:
                waited += 1
                if waited >= patience:
                    break
    discard(rows)
    if valid is not None and patience is not None:
        model.trees = model.trees[:best_len]
    return model
