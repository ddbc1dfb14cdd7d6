"""Near duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``bins`` coordinates. In round i every shingle of a set throws one hashed value i + u into one
hashed bin, and each bin keeps its least; after ``bins`` rounds, round bins + j throws every shingle into bin j.
So each coordinate fills, most sets need few rounds, and the share of equal coordinates is concentrated around
the Jaccard similarity. Bands of coordinates bring candidates together; a link counts once the full shingle
sets have shown it.

Documents with one set form a class, which is compared once. The members of a bucket are not paired with each
other: each meets the bucket's leaders first. What these links have joined needs no more comparison. Of classes
that still lie in different components, those with too many shingles of their own to be near any other are
certified alone; the others of a bucket are compared with one another, all of them, so that no link which the
bands suggest is lost.
"""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, functions as F

from .common import lookup, staged
from .components import components

register_pickle_by_value(sys.modules[__name__])

# 32 bands of 5: a pair of similarity 0.8 stays unseen with a chance of 3 in a million, 0.9 of 1 in 10^13.
BANDS, ROWS, LEADERS, SEED = 32, 5, 3, 20
BLOCK_ROWS = 1000
NO_ID = -(1 << 63)


def shingles(text: str | None, width: int):
    """Sorted 64-bit hashes of the distinct word shingles; words are lower-cased (A-Z) and cut at ASCII white space.

    Fewer than ``width`` words give one shingle of them all, no words none.
    """
    import numpy as np
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i]
    return np.unique(mixed(out))


def mixed(x):
    """A bijection of 64-bit numbers that spreads every bit."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(items, bins: int, seed: int = SEED):
    """The coordinates of a non-empty set of 64-bit items: round in the upper half, hashed fraction in the lower."""
    import numpy as np

    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    u32 = np.uint64(32)
    at = 0
    while at < bins and out.max() == np.iinfo(np.uint64).max:
        # Rounds taken together; one too many changes nothing, as its values are larger.
        rounds = np.arange(at, min(bins, at + max(1, 2 * bins // len(items))), dtype=np.uint64)
        x = mixed(items[None, :] + (rounds[:, None] + np.uint64(seed << 20)) * np.uint64(0xD1342543DE82EF95))
        where = ((x >> u32) * np.uint64(bins)) >> u32
        np.minimum.at(out, where.ravel().astype(np.int64), ((rounds[:, None] << u32) | (x & np.uint64(0xFFFFFFFF))).ravel())
        at = int(rounds[-1]) + 1
    for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
        turn = bins + int(j)
        step = np.uint64((turn + (seed << 20)) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
        out[j] = turn << 32 | int((mixed(items + step) & np.uint64(0xFFFFFFFF)).min())
    return out


def band_keys(coordinates, bands: int):
    """One 64-bit key per band, the band's number included."""
    import numpy as np

    table = coordinates.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(table.shape[1]):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + table[:, i])
    return key.astype(np.int64)


def sketches(docs: DataFrame, width: int, bands: int, rows: int, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, node (128-bit hash of the set, null for an empty one), keys (one per band)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            n, nodes, keys = [], [], []
            for text in b.column(1):
                s = shingles(text.as_py(), width)
                n.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(sketch(s, bands * rows, seed), bands) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                                             ["doc_id", "n_shingles", "node", "keys"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, node binary, keys array<bigint>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, items: the whole shingle set of each document."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            rows = [s.tobytes() for s in (shingles(text.as_py(), width) for text in b.column(1)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(r) for r in rows], pa.binary()), pa.array(rows, pa.binary())], ["node", "items"])

    return docs.mapInArrow(run, "node binary, items binary")


def verified(pairs: DataFrame, sets: DataFrame, share: int, whole: int) -> DataFrame:
    """The pairs (a, b) with whole * intersection >= share * union, on full sets."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(whole * both >= share * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def near_groups(docs: DataFrame, width: int = 5, share: int = 80, whole: int = 100, bands: int = BANDS, rows: int = ROWS,
                leaders: int = LEADERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (it is its own component_id).

    A link joins documents whose sets of ``width``-word shingles have a Jaccard similarity of share / whole or
    more. Null, empty or wordless texts have an empty set and no link. A null doc_id counts as below all
    others and stays null in both columns, with kept = true only when it is its component's smallest. Rows
    that repeat a doc_id are judged each by its own text. An empty table gives an empty one; other columns
    are not read.
    """
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    found = staged(sketches(ids, width, bands, rows), "sketches")
    # One row per class of equal sets.
    classes = staged(found.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes")
    spread = classes.select("node", "n", F.explode("keys").alias("key"))
    short = F.substring(F.hex("node"), 1, 15)
    shared = (spread.select("key", F.conv(short, 16, 10).cast("bigint").alias("s")).groupBy("key")
              .agg(F.min("s").alias("low"), F.max("s").alias("high")).filter("low <> high").select("key"))
    members = staged(spread.join(shared, "key"), "members")
    near = components(_links(ids, classes, members, width, share, whole, leaders))
    rooted = classes.select("node", "first_id", "size").join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table = staged(rooted.join(lowest, "root").select("node", "component_id", "size"), "components")
    out = lookup(found.filter("node IS NOT NULL").select("doc_id", "n_shingles", "node"), table, ["node"], "size").drop("node", "size")
    lone = found.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.unionByName(lone)
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_shingles", F.nullif("component_id", F.lit(NO_ID)).alias("component_id"),
                      (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _private(sets: DataFrame) -> DataFrame:
    """(node, p): how many items of each set no other of these sets holds."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for node, items in zip(b.column(0), b.column(1)):
                x = np.frombuffer(items.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array([node.as_py()] * len(x), pa.binary())], ["item", "node"])

    held = sets.select("node", "items").mapInArrow(run, "item bigint, node binary")
    alone = held.groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter("c = 1")
    return alone.groupBy("node").agg(F.count(F.lit(1)).alias("p"))


def _split(members: DataFrame) -> DataFrame:
    """The members of buckets that lie in several components, with the largest of these as ``main``."""
    parts = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("parts"))
    return members.join(main.filter("parts > 1").select("key", "main"), "key")


def _links(ids: DataFrame, classes: DataFrame, members: DataFrame, width: int, share: int, whole: int, leaders: int) -> DataFrame:
    """Verified links (a, b) that join every two classes which a path of candidate links joins."""
    wanted = members.select("node").distinct().join(classes, "node").select(F.col("first_id").alias("doc_id")).distinct()
    sets = staged(full_sets(ids.join(wanted, "doc_id", "left_semi"), width), "sets")

    def fits(most: str, n: str, m: str):
        """Whether sets of n and m items of which at most ``most`` are common can reach the threshold."""
        return F.expr(f"{whole} * ({most}) >= {share} * ({n} + {m} - ({most}))")

    def pair(x: str, y: str):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
        return rows.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))

    # First one leader for each class: most classes of a group are joined after this.
    heads = members.groupBy("key").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node")).alias("lead"))
    first = (members.join(heads, "key").select("node", "n", F.col("lead.node").alias("m"), F.col("lead.n").alias("k"))
             .filter("node <> m").filter(fits("least(n, k)", "n", "k")).groupBy("node").agg(F.min("m").alias("m")))
    links = staged(verified(first.select(*pair("node", "m")).distinct(), sets, share, whole), "links")
    # In what is left, items that a set shares with no other bound what it can have in common with any: most
    # classes that are alike to many but near to none go here, without a comparison.
    left = staged(_split(labelled(members, links)).drop("main"), "open")
    own = _private(sets.join(left.select("node").distinct(), "node", "left_semi"))
    least = left.groupBy("key").agg(F.min("n").alias("least"))
    common = (left.join(own, "node", "left").withColumn("c", F.col("n") - F.coalesce("p", F.lit(0))).drop("p").join(least, "key")
              .withColumn("least", F.greatest("least", F.ceil(F.col("n") * share / whole)).cast("long")).filter(fits("c", "n", "least")).drop("least"))
    left = staged(_split(common).drop("main"), "open")
    # Then leaders for each bucket: the set with the smallest share of items of its own, and others by hash.
    body = F.struct("node", "n", "c", "root")
    heads = left.groupBy("key").agg(F.max_by(body, F.struct(F.col("c") / F.col("n"), F.xxhash64("node"))).alias("lead0"), *[
        F.min_by(body, F.xxhash64("node", F.lit(i))).alias(f"lead{i}") for i in range(1, leaders)])
    met = left.join(heads, "key").select("node", "n", "c", "root", F.explode(F.array(*[f"lead{i}" for i in range(leaders)])).alias("l"))
    near = met.filter("root <> l.root").filter(fits("least(c, l.c)", "n", "l.n")).select("node", F.col("l.node").alias("m"))
    links = links.unionByName(staged(verified(near.select(*pair("node", "m")).distinct(), sets, share, whole), "links"))
    # Last, classes outside the largest component of a bucket meet all others of that bucket that could be near.
    known = staged(_split(labelled(left.drop("root"), links)), "known")
    return links.unionByName(staged(verified(_could_be_near(known, sets, share, whole), sets, share, whole), "links"))


def _could_be_near(known: DataFrame, sets: DataFrame, share: int, whole: int) -> DataFrame:
    """Pairs (a, b) of a bucket's classes in different components, without those that a bound rules out.

    Every member of a bucket is compared with one leader and keeps a bit for each of its items. Two members then
    have at most so many items in common as they share bits, and as many more as either has outside the leader
    that are not its own alone. Buckets are worked off in blocks of bounded size; only the pairs that pass the
    bound leave a task.
    """
    heads = known.groupBy("key").agg(F.max_by("node", F.struct(F.col("c") / F.col("n"), F.xxhash64("node"))).alias("lead"))
    rows = known.join(heads, "key")

    def bits(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                out.append(np.packbits(x[at] == y).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["node", "lead", "bits"])

    one, two = sets.select("node", F.col("items").alias("x")), sets.select(F.col("node").alias("lead"), F.col("items").alias("y"))
    held = (rows.select("node", "lead").distinct().join(one, "node").join(two, "lead").select("node", "lead", "x", "y")
            .mapInArrow(bits, "node binary, lead binary, bits binary"))
    rows = staged(rows.join(held, ["node", "lead"]).withColumn("rest", F.col("root") != F.col("main")).drop("main", "lead"), "bits")
    size = rows.groupBy("key").agg(F.ceil(F.count_if("rest") / BLOCK_ROWS).cast("int").alias("us"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("them"))
    rows = rows.join(size, "key")
    us = rows.filter("rest").withColumns({"i": F.pmod(F.hash("node"), F.col("us")), "j": F.explode(F.sequence(F.lit(0), F.col("them") - 1))})
    them = rows.withColumns({"j": F.pmod(F.hash("node"), F.col("them")), "i": F.explode(F.sequence(F.lit(0), F.col("us") - 1))}).withColumn("rest", F.lit(False))

    def bound(pdf):
        import numpy as np
        import pandas as pd

        mine, other = pdf[pdf["rest"]], pdf[~pdf["rest"]]
        if mine.empty or other.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype=object)
        root = pd.factorize(pdf["root"])[0]

        def table(part):
            raw = np.frombuffer(b"".join(part["bits"]), np.uint8).reshape(len(part), -1)
            ones = np.bitwise_count(raw).sum(axis=1, dtype=np.int64)
            n, c = part["n"].to_numpy(), part["c"].to_numpy()
            return raw, n, c, np.maximum(c - ones, 0), root[pdf["rest"] if part is mine else ~pdf["rest"]]

        (a, na, ca, oa, ra), (b, nb, cb, ob, rb) = table(mine), table(other)
        both = np.zeros((len(mine), len(other)), np.float32)
        for i in range(0, a.shape[1], 512):
            both += np.unpackbits(a[:, i:i + 512], axis=1).astype(np.float32) @ np.unpackbits(b[:, i:i + 512], axis=1).astype(np.float32).T
        most = both.astype(np.int64) + np.minimum.outer(oa, ob)
        most = np.minimum(most, np.minimum.outer(ca, cb))
        r, s = np.nonzero((whole * most >= share * (na[:, None] + nb[None, :] - most)) & (ra[:, None] != rb[None, :]))
        x, y = mine["node"].to_numpy()[r], other["node"].to_numpy()[s]
        return pd.DataFrame({"a": [min(p) for p in zip(x, y)], "b": [max(p) for p in zip(x, y)]}, dtype=object)

    columns = ["key", "i", "j", "node", "n", "c", "root", "rest", "bits"]
    return us.select(columns).unionByName(them.select(columns)).groupBy("key", "i", "j").applyInPandas(bound, "a binary, b binary").distinct()
