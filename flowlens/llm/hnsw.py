"""Nearest neighbours by one hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by hash. A shard's graph is a few flat arrays of neighbour numbers, one per level,
built by inserting vectors in batches: a batch searches the graph so far, links to a diverse choice of what it
found and of its own members, and its new neighbours choose anew among their links. Every query searches every
shard of its dimension and the shards' results are merged. Equal vectors are one node of the graph.

How wide a search has to be depends on the vectors. So a bounded sample of the queries is also answered by whole matrix
products over all shards, and the beam is doubled until the sample's recall is reached.

Nearness is the inner product. For the links each vector gets one more coordinate that makes all norms of the
shard equal, so that vectors of different lengths build a graph in which the largest product is the nearest.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged

register_pickle_by_value(sys.modules[__name__])

LINKS, BUILD_WIDTH, SEARCH_WIDTH, SHARD_ROWS = 16, 96, 256, 16_384
BLOCK, GROUP_BLOCKS, BATCH, EXPAND = 256, 8, 256, 4
# Recall that the sampled queries have to reach, and how many there are.
RECALL, PROBES = 0.95, 64


class Graph:
    """Vectors (n, d) and per level a table of neighbour numbers, -1 where a place is free; level 0 has all nodes."""

    def __init__(self, vectors, seed: int = 7) -> None:
        import numpy as np

        self.vectors = np.ascontiguousarray(vectors, dtype=np.float64)
        norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        extra = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0))
        self.points = np.hstack([self.vectors, extra[:, None]]).astype(np.float32)
        n = len(vectors)
        # Nodes are stored from the highest level down, so level l holds the first sizes[l] of them.
        height = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        self.order = np.argsort(-height, kind="stable")
        self.vectors, self.points, height = self.vectors[self.order], self.points[self.order], height[self.order]
        self.sizes = [int((height >= lv).sum()) for lv in range(int(height.max(initial=0)) + 1)]
        self.links = [np.full((s, 2 * LINKS if lv == 0 else LINKS), -1, np.int32) for lv, s in enumerate(self.sizes)]
        at = 0
        while at < n:
            top = int(height[at])
            end = min(at + max(1, min(BATCH, at)), self.sizes[top])
            self._insert(at, end, top)
            at = end

    def _insert(self, at: int, end: int, top: int) -> None:
        import numpy as np

        new = np.arange(at, end)
        entry = np.zeros((len(new), 1), np.int64)
        own = self.points[new] @ self.points[new].T
        np.fill_diagonal(own, -np.inf)
        for lv in range(len(self.sizes) - 1, -1, -1):
            width = BUILD_WIDTH if lv <= top else 1
            known = min(at, self.sizes[lv])
            found, score = self.search(lv, self.points[new], entry, width, known) if known else (np.empty((len(new), 0), np.int64), np.empty((len(new), 0), np.float32))
            if lv <= top:
                # Members of the batch do not see each other in the graph yet.
                k = min(LINKS, len(new) - 1)
                near = np.argpartition(-own, k - 1, axis=1)[:, :k] if k > 0 else np.empty((len(new), 0), np.int64)
                found_all = np.hstack([found, new[near]])
                score_all = np.hstack([score, np.take_along_axis(own, near, 1)])
                chosen = self._choose(found_all, score_all, LINKS)
                self.links[lv][new, :LINKS] = chosen
                self._link_back(lv, new, chosen)
            if known:
                entry = found[:, :max(1, min(4, width))]

    def _choose(self, found, score, count: int):
        """Of each row's candidates the best that are nearer to the row than to those already chosen; then the best others."""
        import numpy as np

        keep = min(found.shape[1], 3 * count)
        score = np.where(found < 0, -np.inf, score)
        order = np.argsort(-score, axis=1, kind="stable")[:, :keep]
        found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
        rows = self.points[np.maximum(found, 0)]
        between = rows @ rows.transpose(0, 2, 1)
        taken, n = np.zeros(found.shape, bool), np.zeros(len(found), int)
        for c in range(found.shape[1]):
            rival = np.where(taken[:, :c], between[:, c, :c], -np.inf).max(axis=1, initial=-np.inf)
            taken[:, c] = (rival < score[:, c]) & (n < count) & (score[:, c] > -np.inf)
            n += taken[:, c]
        rank = np.argsort(~taken * 2 + (score == -np.inf), axis=1, kind="stable")[:, :count]
        out = np.full((len(found), count), -1, np.int32)
        picked = np.take_along_axis(np.where(score > -np.inf, found, -1), rank, 1)
        out[:, :picked.shape[1]] = picked
        return out

    def _link_back(self, lv: int, new, chosen) -> None:
        import numpy as np

        table = self.links[lv]
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(nodes), int(count.max(initial=0))), -1, np.int64)
        place = np.arange(len(target)) - np.repeat(start, count)
        wide[np.repeat(np.arange(len(nodes)), count), place] = source
        both = np.hstack([table[nodes].astype(np.int64), wide])
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        score = np.einsum("ijk,ik->ij", self.points[np.maximum(both, 0)], self.points[nodes])
        table[nodes] = self._choose(both, score, table.shape[1])

    def search(self, lv: int, queries, entry, width: int, known: int | None = None):
        """Beam search of all queries together: (nodes, scores) of each, best first, -1 where fewer were met."""
        import numpy as np

        n, b = known or self.sizes[lv], len(queries)
        queries = np.asarray(queries, np.float32)
        stamp, seen = np.full((b, n), -1, np.int32), np.zeros((b, n), bool)
        ids, score = np.full((b, width), -1, np.int64), np.full((b, width), -np.inf, np.float32)
        done = np.ones((b, width), bool)
        live, fresh = np.arange(b), np.asarray(entry, np.int64)
        expand = min(EXPAND, width)
        while len(live):
            at = live[:, None]
            ok = (fresh >= 0) & (fresh < n)
            fresh = np.where(ok, fresh, 0)
            ok &= ~seen[at, fresh]
            place = np.broadcast_to(np.arange(fresh.shape[1], dtype=np.int32), fresh.shape)
            stamp[at, np.where(ok, fresh, 0)] = np.where(ok, place, -1)
            ok &= stamp[at, fresh] == place  # once per row
            seen[np.broadcast_to(at, fresh.shape)[ok], fresh[ok]] = True
            gain = np.matmul(self.points[fresh], queries[live][:, :, None])[:, :, 0]
            all_score = np.hstack([score[live], np.where(ok, gain, -np.inf)])
            order = np.argpartition(-all_score, width - 1, axis=1)[:, :width]
            order = np.take_along_axis(order, np.argsort(-np.take_along_axis(all_score, order, 1), axis=1, kind="stable"), 1)
            score[live] = np.take_along_axis(all_score, order, 1)
            ids[live] = np.take_along_axis(np.hstack([ids[live], np.where(ok, fresh, -1)]), order, 1)
            done[live] = np.take_along_axis(np.hstack([done[live], ~ok]), order, 1)
            open_ = ~done[live]
            live, open_ = live[open_.any(axis=1)], open_[open_.any(axis=1)]
            pick = np.argsort(~open_, axis=1, kind="stable")[:, :expand]
            fit = np.take_along_axis(open_, pick, 1)
            nodes = np.where(fit, ids[live[:, None], pick], -1)
            done[live[:, None], pick] = True
            fresh = np.where(nodes[:, :, None] >= 0, self.links[lv][np.maximum(nodes, 0)], -1).reshape(len(live), expand * self.links[lv].shape[1])
        return ids, score

    def nearest(self, queries, count: int, width: int = SEARCH_WIDTH):
        """(positions in the given vectors, inner products in double precision) of each query's nearest, best first."""
        import numpy as np

        queries = np.asarray(queries, np.float64)
        wide = np.hstack([queries, np.zeros((len(queries), 1))]).astype(np.float32)
        n = len(self.vectors)
        entry = np.zeros((len(queries), 1), np.int64)
        for lv in range(len(self.sizes) - 1, 0, -1):
            entry = self.search(lv, wide, entry, 4)[0]
        # A few nodes all over the shard besides, for parts that the entry may not reach.
        start = np.linspace(0, n - 1, min(n, 24)).astype(np.int64)
        ids, _ = self.search(0, wide, np.hstack([entry, np.broadcast_to(start, (len(queries), len(start)))]), max(width, count))
        short = (ids >= 0).sum(axis=1) < min(count, n)
        if short.any():  # a part that no link reaches: a small shard is read whole
            ids = np.hstack([ids, np.full((len(ids), max(0, n - ids.shape[1])), -1)])
            ids[short, :n], ids[short, n:] = np.arange(n), -1
        score = np.where(ids >= 0, np.matmul(self.vectors[np.maximum(ids, 0)], queries[:, :, None])[:, :, 0], -np.inf)
        order = np.lexsort((self.order[np.maximum(ids, 0)], -score), axis=1)[:, :min(count, n)]
        ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
        return np.where(ids >= 0, self.order[np.maximum(ids, 0)], -1), score

    def exact(self, queries, count: int):
        """As ``nearest``, by products with all vectors; ties go to the earlier given vector."""
        import numpy as np

        queries, count = np.asarray(queries, np.float64), min(count, len(self.vectors))
        score = queries @ self.vectors.T
        least = -np.partition(-score, count - 1, axis=1)[:, count - 1]
        ids, best = np.empty((len(queries), count), np.int64), np.empty((len(queries), count))
        for i, row in enumerate(score):
            near = np.flatnonzero(row >= least[i])
            near = near[np.lexsort((self.order[near], -row[near]))][:count]
            # The same sum for each pair, however many queries there are.
            ids[i], best[i] = self.order[near], np.matmul(self.vectors[near], queries[i])
        return ids, best

    def packed(self) -> tuple[bytes, bytes, bytes]:
        import numpy as np

        return self.vectors.tobytes(), self.order.astype("<i8").tobytes(), b"".join(np.array(x.shape, "<i4").tobytes() + x.astype("<i4").tobytes() for x in self.links)

    @staticmethod
    def unpacked(vectors: bytes, order: bytes, links: bytes) -> Graph:
        import numpy as np

        g = Graph.__new__(Graph)
        g.order = np.frombuffer(order, "<i8")
        g.vectors = np.frombuffer(vectors, "<f8").reshape(len(g.order), -1)
        g.points = np.hstack([g.vectors, np.zeros((len(g.order), 1))]).astype(np.float32)
        g.links, g.sizes, at = [], [], 0
        while at < len(links):
            s, w = np.frombuffer(links, "<i4", 2, at)
            g.links.append(np.frombuffer(links, "<i4", s * w, at + 8).reshape(s, w))
            g.sizes.append(int(s))
            at += 8 + 4 * s * w
        return g


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


INDEX = "dim int, shard int, ids binary, vectors binary, place binary, links binary"


def shard_counts(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> dict[int, int]:
    """Number of shards for each dimension that occurs."""
    return {r["dim"]: -(-r["count"] // shard_rows) for r in nodes.groupBy("dim").count().collect()}


def _by_dim(values: dict[int, int]) -> Column:
    out = F.lit(None).cast("int")
    for d, n in values.items():
        out = F.when(F.col("dim") == d, n).otherwise(out)
    return out


def build_index(nodes: DataFrame, shards: dict[int, int]) -> DataFrame:
    """One row per shard and dimension from (id, v, dim): dim, shard, ids and the arrays of its graph."""
    if not shards:
        return nodes.sparkSession.createDataFrame([], INDEX)

    def build(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("id", ignore_index=True)
        g = Graph(np.stack(pdf["v"].to_numpy()))
        vectors, place, links = g.packed()
        return pd.DataFrame([(int(pdf["dim"][0]), int(pdf["shard"][0]), pdf["id"].to_numpy("<i8").tobytes(), vectors, place, links)],
                            columns=["dim", "shard", "ids", "vectors", "place", "links"])

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("id"), _by_dim(shards)).cast("int"))
    # An explicit number keeps shards from being merged into one task.
    return dealt.repartition(sum(shards.values()), "dim", "shard").groupBy("dim", "shard").applyInPandas(build, INDEX)


def search_index(index: DataFrame, shards: dict[int, int], queries: DataFrame, count: int, width: int | None = SEARCH_WIDTH) -> DataFrame:
    """(query_id, id, score): each shard's best ``count`` for each row (query_id, v, dim) of ``queries``; without a width exactly.

    Queries travel in blocks of bounded size. A task holds one shard's graph at a time and answers a bounded
    number of blocks from it; more blocks go to further tasks with a copy of the graph.
    """

    def block(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            dims = b.column(2).to_numpy()
            for d in np.unique(dims):
                pick = np.flatnonzero(dims == d)
                for i in range(0, len(pick), BLOCK):
                    part = b.take(pa.array(pick[i:i + BLOCK]))
                    ids = part.column(0).to_numpy().astype("<i8")
                    v = np.array(part.column(1).to_pylist(), "<f8")
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([int(ids[0])], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())],
                                                     ["dim", "block", "ids", "vectors"])

    def answer(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        graph, names = None, None
        for b in batches:
            for r in range(b.num_rows):
                ids, vectors, place, links = (b.column(i)[r].as_py() for i in range(4))
                if links is not None:
                    graph, names = Graph.unpacked(vectors, place, links), np.frombuffer(ids, "<i8")
                    continue
                who = np.frombuffer(ids, "<i8")
                asked = np.frombuffer(vectors, "<f8").reshape(len(who), -1)
                at, score = graph.exact(asked, count) if width is None else graph.nearest(asked, count, width)
                ok = (at >= 0).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who, at.shape[1])[ok]), pa.array(names[np.maximum(at, 0)].ravel()[ok]), pa.array(score.ravel()[ok])],
                                                 ["query_id", "id", "score"])

    blocks = staged(queries.select("query_id", "v", "dim").mapInArrow(block, "dim int, block bigint, ids binary, vectors binary"), "blocks")
    groups = max(1, -(-blocks.count() // GROUP_BLOCKS))
    many = max(1, sum(shards.values()))
    graphs = index.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = (blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), _by_dim(shards) - 1)))
             .select("dim", "shard", "ids", "vectors", F.lit(None).cast("binary").alias("place"), F.lit(None).cast("binary").alias("links"),
                     F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("turn")))
    rows = graphs.unionByName(asked).repartition(min(many * groups, 100_000), "dim", "shard", "turn")
    # A graph comes before the blocks that it answers.
    ordered = rows.sortWithinPartitions("dim", "shard", "turn", F.col("links").isNull())
    return ordered.select("ids", "vectors", "place", "links").mapInArrow(answer, "query_id bigint, id bigint, score double")


def wide_enough(index: DataFrame, shards: dict[int, int], queries: DataFrame, count: int, width: int, recall: float, probes: int,
                shard_rows: int) -> int | None:
    """The width, doubled from ``width`` on, at which ``probes`` queries find ``recall`` of their exact results; None: only the exact way does."""
    sample = staged(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(probes), "probes")

    def best(met: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return met.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= count).select("query_id", "id")

    want = staged(best(search_index(index, shards, sample, count, None)), "exact")
    total = want.count()
    while total and want.join(best(search_index(index, shards, sample, count, width)), ["query_id", "id"]).count() < recall * total:
        width *= 2
        if 2 * width >= shard_rows:
            return None
    return width


def nearest(vectors: DataFrame, queries: Column, k: int = 20, shard_rows: int = SHARD_ROWS, width: int = SEARCH_WIDTH, recall: float | None = RECALL,
            probes: int = PROBES, exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of every row for which ``queries`` holds.

    The beam is ``width``, doubled until ``probes`` of the queries reach ``recall`` against brute force (None: not measured);
    ``exact`` compares every query with every vector.

    Largest inner product first, ties to the smaller id; a row is not its own neighbour. Rows whose vector is
    null, empty, zero or holds a null or non-finite component, or whose id is null, take no part. Vectors are
    compared within their dimension. With fewer rows than k all others are returned. Rows that repeat an id
    are one row if their vectors are equal; otherwise each is a candidate, and each result of a query id is
    ranked among all of them. An empty table gives an empty one; other columns are not read.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), queries.alias("asked")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    rows = rows.withColumn("dim", F.size("v"))
    # Equal vectors: the smallest id stands for all, and no result can need more than the k + 1 smallest. The rank
    # limit is applied before the shuffle too, so a vector with a third of all rows sends k + 1 rows a task.
    same = Window.partitionBy("h", "v").orderBy("id")
    first = (rows.select("id", "v", "dim", F.xxhash64("v").alias("h")).withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)
             .withColumn("node", F.first("id").over(same)))
    known = staged(first.select("node", "id", "n", "dim", F.when(F.col("n") == 1, F.col("v")).alias("v")), "vectors")
    nodes = known.filter("n = 1").select("id", "v", "dim")
    shards = shard_counts(nodes, shard_rows)
    index = staged(build_index(nodes, shards), "index")
    asked = rows.filter("asked").select(F.col("id").alias("query_id"), "v", "dim")
    if exact or not shards:
        wide = None
    else:
        wide = width if recall is None else wide_enough(index, shards, asked, k + 1, width, recall, probes, shard_rows)
    met = search_index(index, shards, asked, k + 1, wide)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    merged = met.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    copies = known.filter("n > 1").select(F.col("node"), F.col("id").alias("copy"))
    more = merged.join(copies, merged["id"] == copies["node"]).select("query_id", F.col("copy").alias("id"), "score")
    found = merged.select("query_id", "id", "score").unionByName(more).filter("id <> query_id").dropDuplicates(["query_id", "id"])
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
