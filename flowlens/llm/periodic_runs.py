"""Periodic runs of words: suffix trees, constant-time common extensions, Lyndon roots.

A run is a stretch that repeats a shortest period q and cannot be made longer. Every run that holds its period
twice has a root that is the longest Lyndon word at its place, in one of two opposite orders of the words. So each
place gives two candidates, and the longest common extensions to both sides of the place and the place one root
on tell how far the repetition reaches. Extensions are depths of lowest common ancestors in the suffix trees of
the words and of the words reversed, by range minima over the tour of the leaves.

Texts are worked on one by one inside map tasks: nothing is shuffled and a hot source or text stays spread.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, functions as F

from .common import release_arrow

register_pickle_by_value(sys.modules[__name__])

# Fewest words of a run, and how often it must hold its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
# A run of these sizes holds each of its words four times and each of its word triples three times.
WORD_TIMES, TRIPLE_TIMES = 4, 3
CHARS = 4_000_000
END = 0


def suffix_tree(words: list[int], base: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's tree of ``words``, which end with END: first and end position of each node's edge, and the edges.

    Edges are keyed by node * base + first word. Node 0 is the root; a leaf's edge ends at len(words).
    """
    n = len(words)
    first, stop, link, edges = [0], [0], [0], {}
    node = length = at = rest = 0
    for i, c in enumerate(words):
        rest += 1
        fresh = 0  # inner node that still needs its suffix link
        while rest:
            if not length:
                at = i
            key = node * base + words[at]
            child = edges.get(key)
            if child is None:
                edges[key] = len(first)
                first.append(i)
                stop.append(n)
                link.append(0)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                begin = first[child]
                size = stop[child] - begin
                if length >= size:
                    at += size
                    length -= size
                    node = child
                    continue
                if words[begin + length] == c:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                middle = len(first)
                edges[key] = middle
                first += (begin, i)
                stop += (begin + length, n)
                link += (0, 0)
                first[child] = begin + length
                edges[middle * base + words[begin + length]] = child
                edges[middle * base + c] = middle + 1
                if fresh:
                    link[fresh] = middle
                fresh = middle
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - rest + 1
    return first, stop, edges


class Extensions:
    """Longest common extensions of any two places of a list of words (numbers above END)."""

    def __init__(self, words: list[int], base: int) -> None:
        import numpy as np

        self.np, words = np, [*words, END]
        n = len(words)
        first, stop, edges = suffix_tree(words, base)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        child = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        of = np.searchsorted(keys[order] // base, np.arange(len(first) + 1)).tolist()
        # Leaves in the order of their suffixes. Between two leaves the tour passes their lowest common ancestor
        # and otherwise only deeper nodes, so it is enough to keep that one's depth.
        leaves, depths = [], []
        todo = [(0, 0, 0)]
        while todo:
            node, depth, above = todo.pop()
            lo, hi = of[node], of[node + 1]
            if lo == hi:
                leaves.append(n - depth)
                depths.append(above)
                continue
            for k in range(hi - 1, lo - 1, -1):
                c = child[k]
                todo.append((c, depth + stop[c] - first[c], depth if k > lo else above))
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        self.minima = [np.array(depths, np.int32)]
        while 2 << len(self.minima) - 1 <= n:
            last, step = self.minima[-1], 1 << len(self.minima) - 1
            self.minima.append(np.minimum(last[:-step], last[step:]))

    def common(self, a, b):
        """Words that agree from the places ``a`` and ``b`` on (arrays; a differs from b; the end is a place)."""
        np = self.np
        x, y = self.rank[a], self.rank[b]
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.minima[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << k)])
        return out


def following(rank: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix the next one that is smaller, and the next one that is greater, in the order ``rank``."""
    n = len(rank)
    smaller, greater = [n] * n, [n] * n
    falling: list[int] = []
    rising: list[int] = []
    for i, r in enumerate(rank):
        while falling and rank[falling[-1]] > r:
            smaller[falling.pop()] = i
        falling.append(i)
        while rising and rank[rising[-1]] < r:
            greater[rising.pop()] = i
        rising.append(i)
    return smaller, greater


def runs_of(words, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS):
    """(start, length, period) of every run of an array of word numbers above END, by start, then period."""
    import numpy as np

    n = len(words)
    given, base = words.tolist(), int(words.max()) + 1
    ahead, behind = Extensions(given, base), Extensions(given[::-1], base)
    place = np.arange(n)
    found = []
    for root_end in following(ahead.rank.tolist()):
        # The end sorts before every word, so it ends a root of the first order; in the opposite order no word at all
        # follows a root without an end, which then holds the end itself and is no root.
        end = np.array(root_end[:n])
        period = end - place
        ok = (end < n) & (least_periods * period <= n)
        i, j = place[ok], end[ok]
        back = behind.common(n - i, n - j)
        length = back + (j - i) + ahead.common(i, j)
        keep = length >= np.maximum(least_words, least_periods * (j - i))
        found.append(np.stack([(i - back)[keep], length[keep], (j - i)[keep]], 1))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _hashed(np, *columns):
    out = columns[0].astype(np.uint64)
    for c in columns[1:]:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out >> np.uint64(32)


def repeated_stretches(codes, owner):
    """(place, codes, owner) of the stretches that can hold a run; ``owner`` keeps texts apart.

    A run holds each of its word triples at least three times and each of its words four times, inside any stretch
    that contains it. So triples met less often cut a text into stretches, and those are cut again in the same
    way until nothing goes. Counts are taken per hash value: a clash can only keep more.
    """
    import numpy as np

    place = np.arange(len(codes))
    while len(codes) >= LEAST_WORDS:
        n = len(codes)
        size = np.uint64((1 << max(10, (2 * n).bit_length())) - 1)
        word = (_hashed(np, owner, codes) & size).astype(np.int64)
        often = np.bincount(word, minlength=1)[word] >= WORD_TIMES
        triple = (_hashed(np, owner[:-2], codes[:-2], codes[1:-1], codes[2:]) & size).astype(np.int64)
        good = often[:-2] & often[1:-1] & often[2:] & (owner[:-2] == owner[2:])
        good &= np.bincount(triple[good], minlength=int(size) + 1)[triple] >= TRIPLE_TIMES
        # A stretch is a row of neighbouring triples of one owner.
        joined = good[1:] & good[:-1] & (owner[:-3] == owner[3:])
        edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
        begin, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = last - begin + 3
        begin, sizes = begin[sizes >= LEAST_WORDS], sizes[sizes >= LEAST_WORDS]
        total = int(sizes.sum())
        if total == n and len(begin) == len(np.unique(owner)):
            break
        own = np.repeat(np.arange(len(begin)), sizes)
        at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
        place, codes, owner = place[at], codes[at], own
    if len(codes) < LEAST_WORDS:
        return place[:0], codes[:0], owner[:0]
    return place, codes, owner


def find_runs(codes, owner):
    """(start, length, period) of every run, starts counted over the whole array, by start, then period."""
    import numpy as np

    place, codes, owner = repeated_stretches(codes, owner)
    if not len(codes):
        return np.empty((0, 3), np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(codes)]]).tolist()
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        # Numbers from 1 in the order of first use keep the tree's keys short; any order of words will do.
        runs = runs_of(np.unique(codes[lo:hi], return_inverse=True)[1].astype(np.int64) + 1)
        runs[:, 0] += place[lo]
        out.append(runs)
    rows = np.concatenate(out)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def split_words(texts):
    """(words, offsets) of an Arrow string array: words between U+0020 and U+0009 to U+000D; a null has none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
    words = lists.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return words.filter(pa.array(full)), before[edges]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the words from the a-th on are to repeat p words, by the crc32 of the id; most texts: None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def texts_by_size(batch, column: int, chars: int = CHARS) -> Iterator:
    """Slices of a record batch with texts of about ``chars`` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    slot = np.cumsum(sizes) // chars
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(slot)) + 1, [len(sizes)]]).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _texts_runs(ids, texts, change: Callable[[int | None, int], tuple[int, int] | None] | None):
    """Per text: its runs, and its words without the repetitions of runs."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    words, offsets = split_words(texts)
    source, sizes = np.arange(len(words)), np.diff(offsets)
    for k, i in enumerate(ids) if change else ():
        if got := change(i, int(sizes[k])):
            a, p = got
            source[offsets[k] + a:offsets[k + 1]] = offsets[k] + a + np.arange(sizes[k] - a) % p
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)[source] if len(words) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    runs = find_runs(codes, owner)
    # Words after the first period of a run go.
    level = np.zeros(len(source) + 1, np.int64)
    np.add.at(level, runs[:, 0] + runs[:, 2], 1)
    np.add.at(level, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(level[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(stays)])[offsets]
    kept = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.take(pa.array(source[stays])))
    collapsed = pc.binary_join(kept, " ")
    text_of = owner[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
    return offsets, sizes, runs, np.searchsorted(text_of, np.arange(len(sizes) + 1)), collapsed


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def find_periodic(docs: DataFrame, change: Callable[[int | None, int], tuple[int, int] | None] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period) and collapsed text of each row.

    Words are the stretches of a text without U+0020 and U+0009 to U+000D. A run has at least six words and holds its shortest
    period four times. ``collapsed`` joins by one space the words that no run contains after its first period.
    ``change(doc_id, n)`` may name a place a and a period p: the words from a on are replaced by repetitions of the
    p words there. A null or empty text has no words and no runs; a null doc_id stays null; repeated rows give
    repeated rows; an empty table gives no rows. Other columns are not read.
    """

    def find(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for batch in texts_by_size(whole, 1):
                ids = batch.column(0)
                offsets, sizes, runs, of, collapsed = _texts_runs(ids.to_pylist(), batch.column(1), change)
                starts = runs[:, 0] - np.repeat(offsets[:-1], np.diff(of))
                cells = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (starts, runs[:, 1], runs[:, 2])], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), cells), collapsed],
                                                 ["doc_id", "n_words", "runs", "collapsed"])
        release_arrow()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(find, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period) and digests of runs and of collapsed texts."""
    order = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    top = F.get(order, F.lit(0))
    line = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))))
    return found.withColumn("_top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_top.s").alias("start"), (-F.col("_top.l")).alias("length"), F.col("_top.p").alias("period"),
        F.expr("1000 * -_top.l div _top.p").alias("exponent_milli"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
