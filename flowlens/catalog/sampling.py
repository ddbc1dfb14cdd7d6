"""Sampling, splitting, resampling and client assignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sample as S
from ..plans.small import attach
from . import views as V
from .registry import query, r

KEY = ["event_id"]


def _rank(part: str = "", seed="42", key: str = "event_id") -> str:
    by = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({by}ORDER BY md5(concat_ws('|', '{seed}', {key}::VARCHAR)), {key})"


def _size(part: str = "") -> str:
    return f"count(*) OVER ({'PARTITION BY ' + part if part else ''})"


_RANKED = f"k AS (SELECT *, {_rank('y')} AS rk, {_size('y')} AS m FROM ev)"
_GLOBAL = f"k AS (SELECT *, {_rank()} AS rk, {_size()} AS m FROM ev)"


@query("stratified_sample", f"{_RANKED} SELECT event_id, y FROM k WHERE rk <= greatest(1, floor(m * 0.1::DOUBLE))", ("ev",))
def stratified_sample(spark, sf):
    return S.stratified_sample(V.ev(spark, sf), ["y"], KEY, 0.1).select("event_id", "y")


@query("simple_sample", f"{_GLOBAL} SELECT event_id, y FROM k WHERE rk <= greatest(1, floor(m * 0.1::DOUBLE))", ("ev",))
def simple_sample(spark, sf):
    return S.simple_sample(V.ev(spark, sf), KEY, 0.1).select("event_id", "y")


@query("proportional_sample", f"""{_RANKED},
    t AS (SELECT count(*) AS n, count(*) FILTER (y = 1) AS p, ceil(count(*) * 0.13::DOUBLE) AS kk FROM ev),
    q AS (SELECT *, greatest(1, round_even(kk * p / n, 0)) AS kp FROM t)
    SELECT event_id, y FROM k, q WHERE rk <= CASE WHEN y = 1 THEN kp ELSE least(kk - kp, n - p) END""", ("ev",))
def proportional_sample(spark, sf):
    return S.proportional_sample(V.ev(spark, sf), "y", KEY, 0.13).select("event_id", "y")


@query("split_stratified", f"""{_RANKED} SELECT event_id, y,
    CASE WHEN rk <= greatest(1, floor(m * 0.15::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM k""", ("ev",))
def split_stratified(spark, sf):
    return S.split_stratified(V.ev(spark, sf), "y", KEY, 0.15).select("event_id", "y", "split")


@query("split_random", f"""{_GLOBAL} SELECT event_id, y,
    CASE WHEN rk <= floor(m * 0.15::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM k""", ("ev",))
def split_random(spark, sf):
    return S.split_random(V.ev(spark, sf), KEY, 0.15).select("event_id", "y", "split")


def _three(seed2: str, val: str) -> str:
    return f"""{_RANKED},
    a AS (SELECT event_id, y, CASE WHEN rk <= greatest(1, floor(m * 0.15::DOUBLE)) THEN 'test' ELSE 'train' END AS s1 FROM k),
    b AS (SELECT *, {_rank('s1, y', seed2)} AS r2, {_size('s1, y')} AS m2 FROM a)
    SELECT event_id, y, CASE WHEN s1 = 'train' AND r2 <= greatest(1, floor(m2 * {val})) THEN 'val' ELSE s1 END AS split FROM b"""


@query("split_three_way", _three("43", "0.15::DOUBLE"), ("ev",))
def split_three_way(spark, sf):
    return S.split_three_way(V.ev(spark, sf), "y", KEY, 0.15, 0.15).select("event_id", "y", "split")


_CORRECTED = "(0.15::DOUBLE / (1.0::DOUBLE - 0.15::DOUBLE))"


@query("split_corrected", _three("42", _CORRECTED), ("ev",))
def split_corrected(spark, sf):
    return S.split_corrected(V.ev(spark, sf), "y", KEY, 0.15, 0.15).select("event_id", "y", "split")


@query("split_ceil", f"""{_RANKED} SELECT event_id, y, CASE WHEN rk <= ceil(m * 0.7::DOUBLE) THEN 'train'
    WHEN rk <= ceil(m * 0.7::DOUBLE) + ceil(m * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k""", ("ev",))
def split_ceil(spark, sf):
    return S.split_ceil(V.ev(spark, sf), "y", KEY, 0.7, 0.15).select("event_id", "y", "split")


@query("split_tail", f"""
    SELECT event_id, CASE WHEN row_no > {_size()} - greatest(1, floor({_size()} * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split
    FROM ev""", ("ev",))
def split_tail(spark, sf):
    return S.split_tail(V.ev(spark, sf), "row_no", 0.1).select("event_id", "split")


@query("shuffle_rank", f"SELECT event_id, {_rank()} AS position FROM ev", ("ev",))
def shuffle_rank(spark, sf):
    return S.shuffle_rank(V.ev(spark, sf), KEY).select("event_id", "position")


@query("batch_assign", f"""
    SELECT floor((row_no - 1) / 256)::BIGINT AS batch, count(*) AS n, {r('avg(value)')} AS mean_value, sum(y)::BIGINT AS pos
    FROM ev GROUP BY 1""", ("ev",))
def batch_assign(spark, sf):
    return (S.batch_assign(V.ev(spark, sf), "row_no", 256).groupBy("batch")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.sum("y").alias("pos")))


def _pick(n: str, *parts: str) -> str:
    text = ", ".join([p for p in parts])
    return f"(('0x' || substr(md5(concat_ws('|', {text})), 1, 15))::BIGINT % ({n})) + 1"


def _oversample_sql(source: str, extra: str) -> str:
    return f"""
    c AS (SELECT y, count(*) AS m FROM {source} GROUP BY y),
    e AS (SELECT y, m, {extra} AS extra FROM c),
    d AS (SELECT y, m, unnest(range(extra::BIGINT)) AS d FROM e WHERE extra > 0),
    p AS (SELECT y, {_pick('m', "'42'", 'y::VARCHAR', 'd::VARCHAR')} AS rk FROM d),
    t AS (SELECT y, rk, count(*) AS times FROM p GROUP BY y, rk),
    k AS (SELECT event_id, y, {_rank('y')} AS rk FROM {source}),
    x AS (SELECT event_id, k.y, unnest(range(1, times + 1)) AS copy FROM k JOIN t ON k.y = t.y AND k.rk = t.rk)
    SELECT event_id, y, 0 AS copy FROM {source} UNION ALL SELECT event_id, y, copy::INT FROM x"""


@query("oversample_balance", _oversample_sql("ev", "(SELECT max(m) FROM c) - m"), ("ev",))
def oversample_balance(spark, sf):
    return S.oversample_balance(V.ev(spark, sf).select("event_id", "y"), "y", KEY)


@query("oversample_ratio", f"""{_RANKED},
    tr AS (SELECT event_id, y FROM k WHERE rk > greatest(1, floor(m * 0.15::DOUBLE))),
    {_oversample_sql('tr', "CASE WHEN y = 1 THEN greatest(0, floor((SELECT m FROM c WHERE y = 0) * 0.6::DOUBLE) - m) ELSE 0 END").replace(' k AS', ' k2 AS').replace('FROM k JOIN', 'FROM k2 AS k JOIN').strip()}""",
       ("ev",))
def oversample_ratio(spark, sf):
    train = S.split_stratified(V.ev(spark, sf).select("event_id", "y"), "y", KEY, 0.15).filter("split = 'train'").drop("split")
    return S.oversample_ratio(train, "y", KEY, 0.6)


@query("class_weights", f"""
    c AS (SELECT y, count(*) AS m FROM ev GROUP BY y),
    w AS (SELECT y, m, (SELECT sum(m) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * m) AS raw FROM c)
    SELECT ev.event_id, ev.y, {r('w.raw / (SELECT sum(raw * m) FROM w)', 12)} AS weight FROM ev JOIN w ON ev.y = w.y""",
       ("ev",), digits=12)
def class_weights(spark, sf):
    return S.class_weights(V.ev(spark, sf), "y").select("event_id", "y", "weight")


_DRAWS = ("d AS (SELECT t.tree, u.d, {n} AS n FROM (SELECT unnest(range(3)) AS tree) t, "
          "(SELECT unnest(range((SELECT count(*) FROM ev))) AS d) u)")


@query("bootstrap", f"""
    {_DRAWS.format(n='(SELECT count(*) FROM ev)')},
    p AS (SELECT tree, {_pick('n', "'42'", 'tree::VARCHAR', 'd::VARCHAR')} AS rk FROM d),
    t AS (SELECT tree, rk, count(*) AS times FROM p GROUP BY tree, rk),
    k AS (SELECT event_id, {_rank()} AS rk FROM ev)
    SELECT t.tree::INT AS tree, k.event_id, t.times FROM k JOIN t ON k.rk = t.rk""", ("ev",))
def bootstrap(spark, sf):
    return S.bootstrap(V.ev(spark, sf), KEY, 3).select("tree", "event_id", "times")


@query("bootstrap_balanced", f"""
    {_DRAWS.format(n='0')},
    c AS (SELECT d.*, CASE WHEN ('0x' || substr(md5(concat_ws('|', '42c', tree::VARCHAR, d::VARCHAR)), 1, 8))::BIGINT < 2147483648
          THEN 0 ELSE 1 END AS y FROM d),
    z AS (SELECT y, count(*) AS m FROM ev GROUP BY y),
    p AS (SELECT c.tree, c.y, {_pick('z.m', "'42'", 'c.tree::VARCHAR', 'c.d::VARCHAR')} AS rk FROM c JOIN z ON c.y = z.y),
    t AS (SELECT tree, y, rk, count(*) AS times FROM p GROUP BY tree, y, rk),
    k AS (SELECT event_id, y, {_rank('y')} AS rk FROM ev)
    SELECT t.tree::INT AS tree, k.event_id, k.y, t.times FROM k JOIN t ON k.rk = t.rk AND k.y = t.y""", ("ev",))
def bootstrap_balanced(spark, sf):
    return S.bootstrap_weighted(V.ev(spark, sf), "y", KEY, 3).select("tree", "event_id", "y", "times")


@query("row_subsample", f"""
    k AS (SELECT *, {_rank('', '42|3')} AS rk, {_size()} AS m FROM ev)
    SELECT event_id FROM k WHERE rk <= greatest(1, ceil(m * 0.8::DOUBLE))""", ("ev",))
def row_subsample(spark, sf):
    return S.row_subsample(V.ev(spark, sf), KEY, 0.8, 42, 3).select("event_id")


@query("col_subsample", f"""
    u AS (SELECT DISTINCT l_linenumber AS tree_id FROM flows),
    f AS (SELECT tree_id, feature FROM u, (SELECT unnest(['f0', 'f1', 'f2', 'f3', 'f4']) AS feature)),
    s AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY md5(concat_ws('|', '42', tree_id::VARCHAR, feature)), feature) AS rk FROM f),
    l AS (UNPIVOT (SELECT l_linenumber AS tree_id, f0, f1, f2, f3, f4 FROM flows) ON f0, f1, f2, f3, f4 INTO NAME feature VALUE v)
    SELECT l.tree_id, l.feature, count(*) AS n, {r('avg(l.v)')} AS mean_value
    FROM l JOIN s ON l.tree_id = s.tree_id AND l.feature = s.feature AND s.rk <= 2 GROUP BY ALL""", ("flows",))
def col_subsample(spark, sf):
    df = V.flows(spark, sf).withColumnRenamed("l_linenumber", "tree_id")
    k = S.resolve_max_features("sqrt", len(V.FEATURES))
    picked = S.col_subsample(df.select("tree_id").distinct(), "tree_id", V.FEATURES, k)
    long = df.unpivot(["tree_id"], V.FEATURES, "feature", "v")
    return (attach(long, picked, ["tree_id", "feature"], "left_semi").groupBy("tree_id", "feature")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_value")))


@query("partition_iid", f"SELECT event_id, y, (({_rank('y')} - 1) % 8)::INT AS client FROM ev", ("ev",))
def partition_iid(spark, sf):
    return S.partition_iid(V.ev(spark, sf).drop("client"), "y", KEY, 8).select("event_id", "y", "client")


# Client shares per class. Fixed values.
SHARES = {0: [0.31, 0.02, 0.17, 0.05, 0.22, 0.08, 0.11, 0.04], 1: [0.03, 0.41, 0.06, 0.24, 0.0, 0.13, 0.09, 0.04]}


def _cuts_sql() -> str:
    rows = []
    for y, shares in SHARES.items():
        for i in range(len(shares) - 1):
            total = " + ".join(f"round_even({s}::DOUBLE * m, 0)" for s in shares[: i + 1])
            rows.append(f"SELECT y, {total} AS cut FROM (SELECT y, count(*) AS m FROM ev WHERE y = {y} GROUP BY y)")
    return " UNION ALL ".join(rows)


@query("partition_dirichlet", f"""
    b AS ({_cuts_sql()}), k AS (SELECT event_id, y, {_rank('y')} AS rk FROM ev)
    SELECT event_id, y, (SELECT count(*) FROM b WHERE b.y = k.y AND k.rk > b.cut)::INT AS client FROM k""", ("ev",))
def partition_dirichlet(spark, sf):
    return S.partition_dirichlet(V.ev(spark, sf).drop("client"), "y", KEY, SHARES).select("event_id", "y", "client")


@query("repeat_samples", f"""
    f AS (SELECT ev.*, g.run, g.run + 42 AS seed FROM ev, (SELECT unnest(range(5))::INT AS run) g),
    k AS (SELECT *, row_number() OVER (PARTITION BY run, y ORDER BY md5(concat_ws('|', seed::VARCHAR, event_id::VARCHAR)), event_id) AS rk,
          count(*) OVER (PARTITION BY run, y) AS m FROM f)
    SELECT run, seed, count(*) AS n, sum(y)::BIGINT AS pos, {r('avg(value)')} AS mean_value
    FROM k WHERE rk <= greatest(1, floor(m * 0.1::DOUBLE)) GROUP BY run, seed""", ("ev",))
def repeat_samples(spark, sf):
    return (S.repeat_samples(V.ev(spark, sf), "y", KEY, 0.1, 5).groupBy("run", "seed")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.avg("value").alias("mean_value")))


@query("union_splits", """
    SELECT event_id, y, split, CASE WHEN split = 'val' THEN 1 ELSE 0 END AS is_val FROM scored WHERE split IN ('train', 'val')""",
       ("scored",))
def union_splits(spark, sf):
    out = S.union_splits(V.scored(spark, sf), "split", ["train", "val"])
    return out.select("event_id", "y", "split", (F.col("split") == "val").cast("int").alias("is_val"))


@query("validation_share", f"""
    SELECT count(*) AS n, {r("count(*) FILTER (split = 'val') * 1.0 / count(*)")} AS val_share
    FROM scored WHERE split IN ('train', 'val')""", ("scored",))
def validation_share(spark, sf):
    return S.union_splits(V.scored(spark, sf), "split", ["train", "val"]).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("split") == "val").cast("double")).alias("val_share"))
