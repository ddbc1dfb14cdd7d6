"""The prefix trie of conversations that begin with the head of another one.

A turn has two 61-bit fingerprints, a row of turns the sums of fingerprint times power of a base, modulo a prime. With
its length such a sum is an element of a monoid: rows of turns put together give a sum that follows from the sums of the parts.
So each conversation is scanned once, in parts of whatever size the sort has made, and every prefix of a rebuilt
conversation is the product of a head of one conversation and a middle part of another; no rebuilt text exists
anywhere. Prefixes of one depth and fingerprint are a node. Each holds references to stored turns; where they
differ, the turns themselves are compared, and one difference starts all over with other fingerprints, so nodes are exact.

Sums over subtrees need no walk. The smallest member of a node owns it, so a conversation owns the lower end
of its path, and each sum over a subtree is a sum over the node's members of something known for a conversation.
"""

from __future__ import annotations

import sys
from pyspark import TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.small import attach
from .common import lookup, staged

register_pickle_by_value(sys.modules[__name__])

PRIME = (1 << 61) - 1
BASES = (1_000_003_000_039, 2_718_281_828_459)
WORD = r"[^\x20\x09-\x0D]+"
# Conversation numbers of one node that are joined in one text before the texts meet.
ID_BLOCK = 50_000


def _product(a: Column, b: Column, prime: int) -> Column:
    """a * b modulo the prime; both below 2^61."""
    wide = "decimal(19,0)"
    return ((a.cast(wide) * b.cast(wide)) % F.lit(prime).cast(wide)).cast("long")


def _moved(sum_: Column, power: Column, before: Column, prime: int) -> Column:
    """The sum of two rows of turns put together: that of the first, plus that of the second moved by the first's length."""
    return F.pmod(before + _product(power, sum_, prime), F.lit(prime))


def ordered_turns(talks: DataFrame, seed: int = 0, prime: int = PRIME) -> DataFrame:
    """Every turn with its number in its conversation, its fingerprints and their sums, written once.

    Columns: ref (place in the written table), conv_id, role, text, words, pos (from 0), p1, p2 and s1, s2 (sums before and
    with this turn), upto (words with this turn). Turns are ordered by turn, null first, ties by md5 of role and text.
    A conversation may run over any number of parts of the sort; each part is scanned alone.
    """
    rows = talks.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text")).filter("conv_id IS NOT NULL")
    rows = rows.withColumn("tie", F.md5(F.concat_ws("\x1f", "role", "text")))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tie")]
    prints = {f"x{k}": F.pmod(F.xxhash64(F.lit(2 * seed + k), "role", "text"), F.lit(prime)) for k in (1, 2)}
    ranged = (rows.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text").withColumns(prints)
              .withColumn("words", F.regexp_count("text", F.lit(WORD)).cast("long")).select("conv_id", "role", "text", "x1", "x2", "words"))

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        part, last, place, state = TaskContext.get().partitionId(), None, 0, None
        for b in batches:
            out = []
            for c, x1, x2, w in zip(*(b.column(k).to_pylist() for k in (0, 3, 4, 5))):
                if c != last:
                    last, state = c, (0, 0, 0, 1, 1, 0)
                pos, p1, p2, a1, a2, upto = state
                state = (pos + 1, (p1 + a1 * x1) % prime, (p2 + a2 * x2) % prime, a1 * BASES[0] % prime, a2 * BASES[1] % prime, upto + w)
                out.append((pos, p1, p2, *state[1:]))
            cells = np.array(out, np.int64).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([pa.array((part << 40) + place + np.arange(len(out))), *(b.column(k) for k in (0, 1, 2, 5)),
                                              *(pa.array(np.ascontiguousarray(cells[:, k])) for k in range(8))],
                                             ["ref", "conv_id", "role", "text", "words", "pos", "p1", "p2", "s1", "s2", "a1", "a2", "upto"])
            place += len(out)

    longs = ", ".join(f"{c} long" for c in ("words", "pos", "p1", "p2", "s1", "s2", "a1", "a2", "upto"))
    local = staged(ranged.mapInArrow(scan, f"ref long, conv_id long, role string, text string, {longs}"), "turns")
    local = local.withColumn("part", F.shiftright("ref", 40))
    # What a conversation has in the parts before, from one row per part that it passes.
    ends = local.groupBy("conv_id", "part").agg(F.max(F.struct("pos", "s1", "s2", "a1", "a2", "upto")).alias("z"))
    over = ends.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("conv_id")
    before, run = [], {}
    # At most two rows for each written part: the conversations that come from the part before or go on in the next.
    for r in sorted(ends.join(over, "conv_id").select("conv_id", "part", "z.*").collect()):
        n, s1, s2, a1, a2, upto = run.get(r["conv_id"], (0, 0, 0, 1, 1, 0))
        before.append((r["conv_id"], r["part"], n, s1, s2, a1, a2, upto))
        run[r["conv_id"]] = (n + r["pos"] + 1, (s1 + a1 * r["s1"]) % prime, (s2 + a2 * r["s2"]) % prime, a1 * r["a1"] % prime, a2 * r["a2"] % prime, upto + r["upto"])
    local = local.drop("a1", "a2")
    if not before:
        return local.drop("part")
    names = ["_n", "_s1", "_s2", "_a1", "_a2", "_upto"]
    table = talks.sparkSession.createDataFrame(before, "conv_id long, part long, " + ", ".join(f"{c} long" for c in names))
    sums = {f"{c}{k}": _moved(F.col(f"{c}{k}"), F.col(f"_a{k}"), F.col(f"_s{k}"), prime) for c in "ps" for k in (1, 2)}
    changed = {"pos": F.col("pos") + F.col("_n"), "upto": F.col("upto") + F.col("_upto"), **sums}
    return (local.join(F.broadcast(table), ["conv_id", "part"], "left")
            .withColumns({c: F.when(F.col("_n").isNull(), F.col(c)).otherwise(v) for c, v in changed.items()}).drop("part", *names))


def rebuilt_prefixes(turns: DataFrame, prime: int = PRIME, family: int = 20, heads: int = 4) -> DataFrame:
    """One row per rebuilt conversation and depth, from the textless prefix on.

    Columns: conv_id, depth, f1, f2 (fingerprint of the prefix), g1, g2 (of the one before), ref (the stored turn it
    ends with), before (words of the prefix before), words (of its last turn), length (turns of the conversation).
    Conversation c takes its first h turns from c - c % family and the others from itself, h = crc32(c) % heads.
    """
    item = F.struct("pos", "ref", "words", "upto", "p1", "p2", "s1", "s2")
    convs = staged(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("pos") < heads - 1, item))).alias("head")), "heads")
    kind = convs.schema["head"].dataType
    zero = F.struct(*[F.lit(0).cast("long").alias(f.name) for f in kind.elementType.fields])
    bases = convs.select(F.col("conv_id").alias("base"), F.coalesce("head", F.array().cast(kind)).alias("base_head"))
    c = convs.withColumns({"h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"), "base": F.col("conv_id") - F.col("conv_id") % family})
    c = c.join(bases, "base", "left").withColumn("taken", F.filter(F.coalesce("base_head", F.array().cast(kind)), lambda t: t["pos"] < F.col("h")))
    c = c.withColumn("skipped", F.filter("head", lambda t: t["pos"] < F.col("h"))).withColumn("k", F.size("taken"))
    # The head's last element holds the sums of the head; without one they are 0.
    own = staged(c.select("conv_id", "n", "h", "k", "taken", (F.col("k") + F.col("n") - F.size("skipped")).cast("int").alias("length"),
                          F.coalesce(F.get("taken", F.col("k") - 1), zero).alias("front"), F.coalesce(F.get("skipped", F.size("skipped") - 1), zero).alias("left")), "convs")
    from_base = own.select("conv_id", "length", F.posexplode(F.concat(F.array(zero), "taken")).alias("depth", "t"))
    from_base = from_base.select("conv_id", "depth", *[F.col(f"t.s{k}").alias(f"f{k}") for k in (1, 2)], *[F.col(f"t.p{k}").alias(f"g{k}") for k in (1, 2)],
                                 F.when(F.col("depth") > 0, F.col("t.ref")).alias("ref"), (F.col("t.upto") - F.col("t.words")).alias("before"), F.col("t.words").alias("words"), "length")
    placed = lookup(turns.drop("role", "text"), own.drop("taken"), ["conv_id"], "n").filter("pos >= h")

    def joined(c: str, k: int) -> Column:
        """Head and middle part as one product. The middle begins h places on and goes to place k, so it is moved back."""
        middle, inverse = F.pmod(F.col(f"{c}{k}") - F.col(f"left.s{k}"), F.lit(prime)), pow(BASES[k - 1], -1, prime)
        shift = F.get(F.array(*[F.lit(pow(inverse, i, prime)) for i in range(heads)]), F.col("h") - F.col("k"))
        return F.when(F.col("h") == F.col("k"), F.pmod(F.col(f"front.s{k}") + middle, F.lit(prime))).otherwise(_moved(middle, shift, F.col(f"front.s{k}"), prime))

    from_own = placed.select("conv_id", (F.col("k") + F.col("pos") - F.col("h") + 1).cast("int").alias("depth"), *[joined("s", k).alias(f"f{k}") for k in (1, 2)],
                             *[joined("p", k).alias(f"g{k}") for k in (1, 2)], "ref",
                             (F.col("front.upto") + F.col("upto") - F.col("words") - F.col("left.upto")).alias("before"), "words", "length")
    return from_base.unionByName(from_own)


NODE = ["depth", "f1", "f2"]


def _differ(members: DataFrame, turns: DataFrame) -> bool:
    """True if members of a node end with turns of different content: stored turns are compared with the node's own."""
    pairs = staged(members.filter("ref <> first_ref").select("ref", "first_ref").distinct(), "pairs")
    said = [F.col("role"), F.col("text")]
    heads = attach(turns.select("ref", *said), pairs.groupBy(F.col("first_ref").alias("ref")).agg(F.count(F.lit(1)).alias("uses")), ["ref"], "inner")
    heads = staged(heads.select(F.col("ref").alias("first_ref"), F.col("role").alias("first_role"), F.col("text").alias("first_text"), "uses"), "node-turns")
    others = attach(turns.select("ref", *said), pairs.select("ref").distinct(), ["ref"], "inner").join(pairs, "ref")
    both = lookup(others, heads, ["first_ref"], "uses")
    return not both.filter("role <> first_role OR text <> first_text").isEmpty()


def _end_digests(members: DataFrame) -> DataFrame:
    """NODE, ends_sha256 of nodes where conversations end.

    SHA-256 is a chain, so the numbers of one node have to pass through one task; they are sorted and joined to texts in
    blocks beforehand, come as a stream and are not held.
    """
    blocks = (members.filter("depth = length").groupBy(*NODE, F.floor(F.col("conv_id") / ID_BLOCK).alias("block"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")))

    def chain(batches):
        import hashlib

        import pyarrow as pa

        node, digest = None, None
        for b in batches:
            done = []
            for *key, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if key == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), d)) for d in done], schema=out)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), (*node, digest.hexdigest())))], schema=out)

    import pyarrow as pa

    out = pa.schema([("depth", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("ends_sha256", pa.string())])
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(chain, "depth int, f1 long, f2 long, ends_sha256 string")


def prefix_trie(talks: DataFrame, family: int = 20, heads: int = 4, primes: tuple[int, ...] = (PRIME,) * 4) -> DataFrame:
    """The nodes of the trie of rebuilt conversations; from conv_id, turn, role, text.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes of
    the subtree, the node itself included), saved_tokens (over the subtree, each node's (n_convs - 1) times the words
    of its last text), ends_sha256 (of the comma-joined numbers of the conversations that end here).

    Null roles and texts are empty. Repeated (conv_id, turn) are turns like any other, ordered by md5 of role and text.
    Rows without a conv_id belong to no conversation and are left out. A conversation whose base is absent has no head, and may be
    left without turns; it ends at the root. An empty table has no members and so no nodes. Other columns are not
    read. ``primes`` gives a prime for each attempt; ValueError if every attempt meets a clash of fingerprints.
    """
    for seed, prime in enumerate(primes):
        turns = ordered_turns(talks, seed, prime)
        rows = staged(rebuilt_prefixes(turns, prime, family, heads), "prefixes")
        nodes = staged(rows.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("length").alias("deepest"),
                                               F.min("ref").alias("first_ref"), F.min(F.struct("g1", "g2")).alias("lo"), F.max(F.struct("g1", "g2")).alias("hi")), "nodes")
        if not nodes.filter("lo <> hi").isEmpty():
            continue
        members = staged(lookup(rows, nodes.drop("lo", "hi"), NODE, "n_convs"), "members")
        if not _differ(members, turns):
            return _node_table(members)
    raise ValueError("every attempt met two prefixes with one fingerprint")


def _node_table(members: DataFrame) -> DataFrame:
    owned = F.col("conv_id") == F.col("owner")
    # A conversation owns its path from depth ``own`` on; ``shared`` are the words before that.
    paths = staged(members.groupBy("conv_id").agg(
        F.min(F.when(owned, F.col("depth"))).alias("own"), F.count(F.lit(1)).alias("size"),
        F.coalesce(F.min(F.when(owned, F.col("before"))), F.max(F.col("before") + F.col("words"))).alias("shared"),
        F.max(F.when(~owned, F.struct("depth", "owner")))["owner"].alias("above"),
        F.max(F.when(owned & (F.col("depth") == F.col("length")) & (F.col("depth") == F.col("deepest")), 1).otherwise(0)).alias("leaf")), "paths")
    on = lookup(members, paths, ["conv_id"], "size")
    below = (F.col("own") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))
    sums = on.groupBy(*NODE).agg(
        F.min("owner").alias("conv_id"), F.max(F.when(owned, F.when(F.col("depth") > F.col("own"), F.col("conv_id")).otherwise(F.col("above")))).alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"), F.sum(F.when(below, 1).otherwise(0)).alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(owned, 0).otherwise(F.col("shared") - F.col("before"))).alias("saved_tokens"))
    found = sums.join(_end_digests(members), NODE, "left")
    return found.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"),
                        F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"),
                        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
