"""Near duplicates against brute force over all pairs."""

import re
from collections import defaultdict

import numpy as np
import pytest

from flowlens.llm import near_dedup as N
from flowlens.llm.components import components
from flowlens.llm.queries import QUERIES


def sets_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(texts, width, share=80):
    sets = {i: sets_of(t, width) for i, t in texts.items()}
    holders, root = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                common[j] += j < i
        for j, n in common.items():
            if n and 100 * n >= share * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_query_equals_brute_force(spark, small, texts):
    want = brute(texts, 4)
    rows = QUERIES["op1_near_dedup"](spark, small).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert 0 < sum(r["kept"] for r in rows) < len(rows)


def test_chains_and_borders(spark):
    """Chains whose ends are not alike, and pairs just at and below the threshold."""
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    texts, i = {}, 1
    for chain in range(6):
        words = [f"{chain}{w}" for w in base]
        for step in range(8):
            texts[i] = " ".join(words)
            words[step * 14 + 3] = f"changed{step}"
            words[step * 14 + 8] = f"changed{step}"
            i += 1
    want = brute(texts, 5)
    out = N.near_groups(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want


def test_star_of_copies_is_one_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 100)]
    texts = {}
    for i in range(300):
        words = list(base)
        for at in rng.integers(0, 100, 2):
            words[at] = f"c{i}"
        texts[i + 1] = " ".join(words)
    want = brute(texts, 4)
    out = N.near_groups(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), width=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 100, 5000):
        items = rng.integers(0, 2**63, n).astype(np.uint64)
        s = N.sketch(items, 160)
        assert (s != np.iinfo(np.uint64).max).all()
        assert (s == N.sketch(items[::-1].copy(), 160)).all()
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    shares = [(N.sketch(pool[:1000], 160, seed) == N.sketch(pool[250:1250], 160, seed)).mean() for seed in range(60)]
    assert np.mean(shares) == pytest.approx(750 / 1250, abs=0.02) and np.std(shares) < 0.06


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {i: 1 for i in range(1, 61)} | {i: 1000 for i in range(1000, 1100)}


def test_odd_rows(odd, none):
    rows = N.near_groups(odd, width=4).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows), key=str)
    assert len(got) == 15
    assert (2, 6, 1, False) in got and (3, 0, 3, True) in got and (5, 0, 5, True) in got
    assert got.count((6, 1, 6, True)) == 2 and got.count((9, 1, 9, True)) == 2 and (None, 2, None, True) in got
    assert N.near_groups(none).count() == 0
