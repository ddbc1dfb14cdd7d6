"""The prefix trie against a trie built of whole texts."""

import hashlib
import random
import re
import zlib

import pytest

from flowlens.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth int, owner string, ref long"


def brute(rows):
    talks = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            talks.setdefault(c, []).append(((t is not None, t or 0), hashlib.md5(f"{r}\x1f{x}".encode()).hexdigest(), r, x))
    talks = {c: [y[2:] for y in sorted(turns)] for c, turns in talks.items()}
    built = {}
    for c, own in talks.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(talks.get(base, [])[:h] + own[h:])
    nodes, kids = {}, {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    saved, leaves = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = (len(nodes[k]) - 1) * words + sum(saved[x] for x in kids.get(k, []))
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest()) for k, m in nodes.items()), key=repr)


def talks(seed):
    rng, rows = random.Random(seed), []
    for c in [*range(-25, 70), *range(10**12, 10**12 + 15), None]:
        if c == 40:
            continue
        for t in range(rng.choice([1, 1, 2, 3, 5, 9]) if c != 7 else 300):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["u", "a", None]), rng.choice(["x", "x y", None, "", "z z  z", "é\tq"]), 1, "o", 2))
    return rows


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_nodes_as_whole_texts(spark, seed):
    # Nulls in any column, ties, absent bases, negative numbers, columns that clash; conversation 7 holds most rows.
    rows = talks(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = P.prefix_trie(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found(out) == brute(rows)


def test_a_conversation_over_many_parts(spark):
    rows = [(1, t, "u", f"w{t % 3}", 0, "", 0) for t in range(500)] + [(c, 0, "u", "w0", 0, "", 0) for c in range(2, 60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        assert P.ordered_turns(df).groupBy("conv_id").agg({"pos": "max"}).filter("conv_id = 1").first()[1] == 499
        assert found(P.prefix_trie(df)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_clashes_start_over(spark):
    rows = talks(5)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(P.prefix_trie(df, primes=(7, P.PRIME))) == brute(rows)
    with pytest.raises(ValueError):
        P.prefix_trie(df, primes=(2, 3))


def test_no_members(spark):
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "u", "x", 0, "", 0)], SCHEMA)).count() == 0
    turnless = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    rows = [(turnless[0], 0, "u", "x", 0, "", 0)]
    assert found(P.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == [(turnless[0], 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless[0]).encode()).hexdigest())]
