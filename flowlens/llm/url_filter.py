"""URL filter: host rules first, then a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, functions as F

from .common import ascii_lower, worker_store

register_pickle_by_value(sys.modules[__name__])

# One strict term rejects; soft terms reject when several different ones occur.
STRICT = ("adult", "bets", "casino", "escort", "pills", "porn", "spam", "viagra", "xxx")
SOFT = ("ads", "bonus", "cheap", "dating", "farm", "free", "gambling", "jackpot", "loan", "pharma", "track", "win")
SOFT_HITS = 2


def url_host(url) -> F.Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without '://'."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url) -> F.Column:
    """What follows the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Vocabulary:
    """Counts distinct strict and soft terms that stand between characters other than ASCII letters and digits."""

    def __init__(self, strict: Sequence[str], soft: Sequence[str]) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.machine.add_word(term.lower(), (term.lower(), term in strict))
        self.machine.make_automaton()

    def hits(self, url: str) -> tuple[int, int]:
        def edge(i: int) -> bool:
            return not (0 <= i < len(url) and url[i].isascii() and url[i].isalnum())

        found = set()
        for end, (term, strict) in self.machine.iter(url):
            if edge(end + 1) and edge(end - len(term)):
                found.add((term, strict))
        n = sum(strict for _, strict in found)
        return n, len(found) - n


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT,
               soft_hits: int = SOFT_HITS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits for every row.

    ``rules`` holds (verdict, host, path): a rule fits its host and all subdomains when the path starts with
    the rule's; of several the longest text decides, of equally long ones the first. Without a rule the
    vocabulary decides on the whole url with A-Z lower-cased: one strict term or ``soft_hits`` different soft
    terms block. A null or empty url, or one without '://', has an empty host and path, and a null one no terms.
    Repeated rows are judged alike, null ids stay null, an empty table gives an empty one; other columns are
    not read. The rules are a short list; each row looks up its own host suffixes, so more rules cost no time.
    """
    by_host: dict[str, list[tuple[int, int, str, str]]] = {}
    for i, (verdict, host, path) in enumerate(rules):
        by_host.setdefault(host, []).append((len(host + path), -i, path, verdict))
    key = ("urls", tuple(strict), tuple(soft))

    def judge(batches):
        import pyarrow as pa

        store = worker_store()
        words = store.setdefault(key, None) or Vocabulary(strict, soft)
        store[key] = words

        def rule(host: str, path: str):
            best, at = None, 0
            while True:
                for size, order, prefix, verdict in by_host.get(host[at:], ()):
                    if path.startswith(prefix) and (best is None or (size, order) > best[:2]):
                        best = (size, order, host[at:] + prefix, verdict)
                dot = host.find(".", at)
                if dot < 0:
                    return best
                at = dot + 1

        for b in batches:
            rows = []
            for url, host, path in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                n, m = words.hits(url)
                fit = rule(host, path)
                rows.append((fit[2] if fit else None, fit[3] if fit else "block" if n or m >= soft_hits else "allow", n, m))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                                              pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                                             ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    url = F.col(url_col)
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), ascii_lower(F.coalesce(url, F.lit(""))).alias("url"),
                        url_host(url).alias("host"), url_path(url).alias("path"))
    return slim.mapInArrow(judge, "page_id bigint, host string, path string, rule string, verdict string, strict_hits int, soft_hits int")
