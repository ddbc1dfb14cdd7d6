"""The registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, external_shuffle, hnsw, line_runs, near_dedup, packing, periodic_runs, pii, prefix_trie, token_files, toxicity, url_filter
from ..plans.small import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


@register("op1_near_dedup")
def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), width=4)


@register("op2_bpe_stream")
def op2_bpe_stream(spark, sf_dir):
    return bpe.round_trips(table(spark, sf_dir, "documents"), tokenizer())


# Production keys come from a secret store; a fixed one makes this query repeatable.
PSEUDONYM_KEY = "flowlens-demo-key"


@register("op3_pii_pseudonyms")
def op3_pii_pseudonyms(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


@register("op4_hnsw")
def op4_hnsw(spark, sf_dir):
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op5_token_files")
def op5_token_files(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer())
    return token_files.checksums(token_files.read_tokens(spark, path))


@register("op6_best_fit_packing")
def op6_best_fit_packing(spark, sf_dir):
    return packing.pack_pieces(packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer()))


@register("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@register("op8_line_runs", r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
    k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key),
    m AS (SELECT k.doc_id, k.pos, k.line, f.first_id IS NOT NULL AND f.first_id <> k.doc_id AS gone FROM k LEFT JOIN f USING (key)),
    g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
    SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM g""")
def op8_line_runs(spark, sf_dir):
    out = line_runs.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@register("op9_exact_dedup", """
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
        sha256(norm) AS text_sha256 FROM d WINDOW w AS (PARTITION BY norm)""")
def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _terms(words) -> str:
    return " + ".join(rf"regexp_matches(u, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')::INT" for w in words)


@register("op10_url_filter", rf"""
    WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
    h AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
        translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
    r(verdict, rh, rp) AS (VALUES {", ".join(f"('{v}', '{a}', '{b}')" for v, a, b in RULES)}),
    f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(r.verdict, length(rh || rp)) AS v FROM h JOIN r
        ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
    t AS (SELECT *, {_terms(url_filter.STRICT)} AS strict_hits, {_terms(url_filter.SOFT)} AS soft_hits FROM h)
    SELECT t.page_id, host, path, rule, coalesce(v, CASE WHEN strict_hits > 0 OR soft_hits >= {url_filter.SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict,
        strict_hits::INT AS strict_hits, soft_hits::INT AS soft_hits FROM t LEFT JOIN f USING (page_id)""")
def op10_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


SHARDS = 40


@register("op11_external_shuffle")
def op11_external_shuffle(spark, sf_dir):
    path = scratch_path(spark, "shards")
    external_shuffle.write_shards(table(spark, sf_dir, "documents"), path, SHARDS)
    text = F.coalesce("text", F.lit(""))
    return external_shuffle.read_shards(spark, path).select(
        "doc_id", (F.octet_length(text) + external_shuffle.ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.run_digests(periodic_runs.find_periodic(table(spark, sf_dir, "documents"), periodic_runs.planted))


# crc32 of the decimal number, bit by bit: each character is mixed in, then eight shifts.
_CRC = """xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: [ascii(s)::UBIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384), 4294967295::UBIGINT), 4294967295)"""


@register("op13_prefix_trie", rf"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, md5(r || chr(31) || x), r, x) AS turns FROM r GROUP BY conv_id),
    h AS (SELECT *, ({_CRC} % 4)::BIGINT AS h FROM t),
    b AS (SELECT h.conv_id, list_concat(coalesce(o.turns[1:h.h], []), h.turns[h.h + 1:]) AS seq FROM h LEFT JOIN t o ON o.conv_id = h.conv_id - h.conv_id % 20),
    u AS (SELECT conv_id, unnest(range(0, len(seq) + 1)) AS d, seq FROM b),
    p AS (SELECT conv_id, d, seq, seq[1:d] AS node, CASE WHEN d = 0 THEN '' ELSE seq[d].x END AS last FROM u),
    n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(seq)), '')) AS ends_sha256,
        (count(*) - 1) * len(regexp_extract_all(last, '[^\x20\x09-\x0D]+')) AS saved FROM p GROUP BY node, d, last),
    k AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY node[1:d - 1]),
    f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
    e AS (SELECT node, unnest(range(0, d + 1)) AS up, saved, n_children = 0 AS leaf FROM f),
    s AS (SELECT node[1:up] AS node, sum(saved)::BIGINT AS saved_tokens, (count(*) FILTER (leaf))::BIGINT AS n_leaves FROM e GROUP BY node[1:up])
    SELECT f.conv_id, f.d AS depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
    FROM f JOIN s USING (node) LEFT JOIN n o ON f.d > 0 AND o.d = f.d - 1 AND o.node = f.node[1:f.d - 1]""")
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
