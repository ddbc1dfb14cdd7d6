"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from flowlens.llm import periodic_runs as R
from flowlens.llm.queries import QUERIES

from .conftest import ODD


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                piece = words[i:j + q]
                if not any(piece[:-r] == piece[r:] for r in range(1, q)):
                    out.append((i, j - i + q, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@given(st.lists(st.integers(1, 3), min_size=1, max_size=40), st.integers(1, 6), st.integers(1, 9))
@settings(max_examples=400, deadline=None)
def test_runs_by_trees_equal_definition(words, p, times):
    words = words[:20] + words[:p] * times + words[20:]
    want = brute_runs(words)
    assert [tuple(r) for r in R.runs_of(np.array(words, np.int64)).tolist()] == want
    # The cut into stretches loses none, with texts side by side.
    both = R.find_runs(np.array(words + words, np.int64), np.repeat([0, 1], len(words)))
    assert [tuple(r) for r in both.tolist()] == want + [(s + len(words), n, q) for s, n, q in want]


def test_extensions(spark):
    rng = random.Random(4)
    for _ in range(40):
        words = [rng.randint(1, 2) for _ in range(rng.randint(2, 60))]
        n = len(words)
        x = R.Extensions(words, 3)
        a, b = np.array([(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]).T
        want = [next((k for k in range(n) if max(i, j) + k == n or words[i + k] != words[j + k]), 0) for i, j in zip(a, b)]
        assert x.common(a, b).tolist() == want


def test_long_periodic_text():
    words = [1, 2, 3, 4, 5] * 4000 + list(range(6, 5000)) + [7] * 9000
    assert [tuple(r) for r in R.find_runs(np.array(words), np.zeros(len(words), np.int64)).tolist()] == [(0, 20000, 5), (24994, 9000, 1)]


def test_query_equals_definition(spark, small, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, small).collect()}
    assert len(rows) == len(texts)
    some = 0
    for i, text in texts.items():
        words, r = contract(i, text), rows[i]
        if len(words) > 1500:  # the definition takes the square of the words
            continue
        runs = brute_runs(words)
        some += len(runs)
        top = min(runs, key=lambda t: (-t[1], t[0], t[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r["collapsed_sha256"] == sha(collapse(words, runs))
    assert some > 20


def test_odd_rows(spark, odd, none):
    found = R.find_periodic(odd)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()))
    want = []
    for i, t in ODD:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(words) if len(words) < 1000 else [(0, 30_000, 1)]
        want.append((str(i), len(words), runs, collapse(words, runs)))
    assert got == sorted(want)
    assert R.run_digests(R.find_periodic(none)).count() == 0
    digests = R.run_digests(found).filter("doc_id = 3").first()
    assert digests["n_runs"] == 0 and digests["start"] is None and digests["collapsed_sha256"] == sha("")
