"""Queries over classes, labels, groups and layers that may be NULL: a NULL key is a group of its own, a NULL label is no label."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import compress as Q, labels as L, metrics as M, sample as S
from . import views as V
from .evaluation import _PR, _F1, auc_sql, eval_sql, _counts
from .registry import query, r
from .sampling import KEY, _CORRECTED, _oversample_sql, _rank, _size, _three

_RANKED = f"k AS (SELECT *, {_rank('y')} AS rk, {_size('y')} AS m FROM evn)"


@query("null_stratum_sample", f"{_RANKED} SELECT event_id, y FROM k WHERE rk <= greatest(1, floor(m * 0.1::DOUBLE))", ("evn",))
def null_stratum_sample(spark, sf):
    return S.stratified_sample(V.evn(spark, sf), ["y"], KEY, 0.1).select("event_id", "y")


@query("null_stratum_split", f"{_RANKED} SELECT event_id, y, CASE WHEN rk <= greatest(1, floor(m * 0.15::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM k", ("evn",))
def null_stratum_split(spark, sf):
    return S.split_stratified(V.evn(spark, sf), "y", KEY, 0.15).select("event_id", "y", "split")


@query("null_stratum_three_way", _three("42", _CORRECTED).replace("FROM ev)", "FROM evn)"), ("evn",))
def null_stratum_three_way(spark, sf):
    return S.split_corrected(V.evn(spark, sf), "y", KEY, 0.15, 0.15).select("event_id", "y", "split")


@query("null_stratum_ceil", f"""{_RANKED} SELECT event_id, y, CASE WHEN rk <= ceil(m * 0.7::DOUBLE) THEN 'train'
    WHEN rk <= ceil(m * 0.7::DOUBLE) + ceil(m * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k""", ("evn",))
def null_stratum_ceil(spark, sf):
    return S.split_ceil(V.evn(spark, sf), "y", KEY, 0.7, 0.15).select("event_id", "y", "split")


@query("null_class_oversample", _oversample_sql("evn", "(SELECT max(m) FROM c) - m").replace("k.y = t.y", "k.y IS NOT DISTINCT FROM t.y"), ("evn",))
def null_class_oversample(spark, sf):
    return S.oversample_balance(V.evn(spark, sf).select("event_id", "y"), "y", KEY)


@query("null_class_weights", f"""
    c AS (SELECT y, count(*) AS m FROM evn GROUP BY y),
    w AS (SELECT y, m, (SELECT sum(m) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * m) AS raw FROM c)
    SELECT evn.event_id, evn.y, {r('w.raw / (SELECT sum(raw * m) FROM w)', 12)} AS weight FROM evn JOIN w ON evn.y IS NOT DISTINCT FROM w.y""",
       ("evn",), digits=12)
def null_class_weights(spark, sf):
    return S.class_weights(V.evn(spark, sf), "y").select("event_id", "y", "weight")


@query("null_class_bootstrap", """
    d AS (SELECT t.tree, u.d FROM (SELECT unnest(range(2)) AS tree) t, (SELECT unnest(range((SELECT count(*) FROM evn))) AS d) u),
    x AS (SELECT *, ('0x' || substr(md5(concat_ws('|', '42c', tree::VARCHAR, d::VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d),
    z AS (SELECT y, m, (row_number() OVER (ORDER BY y NULLS FIRST) - 1) AS i FROM (SELECT y, count(*) AS m FROM evn GROUP BY y)),
    c AS (SELECT x.tree, x.d, z.y, z.m FROM x JOIN z ON u >= i / 3.0::DOUBLE AND (u < (i + 1) / 3.0::DOUBLE OR i = 2)),
    p AS (SELECT tree, y, (('0x' || substr(md5(concat_ws('|', '42', tree::VARCHAR, d::VARCHAR)), 1, 15))::BIGINT % m) + 1 AS rk FROM c),
    t AS (SELECT tree, y, rk, count(*) AS times FROM p GROUP BY tree, y, rk),
    k AS (SELECT event_id, y, """ + _rank("y") + """ AS rk FROM evn)
    SELECT t.tree::INT AS tree, k.event_id, k.y, t.times FROM k JOIN t ON k.rk = t.rk AND k.y IS NOT DISTINCT FROM t.y""", ("evn",))
def null_class_bootstrap(spark, sf):
    return S.bootstrap_weighted(V.evn(spark, sf), "y", KEY, 2).select("tree", "event_id", "y", "times")


@query("null_class_clients", f"SELECT event_id, y, (({_rank('y')} - 1) % 8)::INT AS client FROM evn", ("evn",))
def null_class_clients(spark, sf):
    return S.partition_iid(V.evn(spark, sf), "y", KEY, 8).select("event_id", "y", "client")


# Client shares per class. Fixed values.
SHARES = {None: [0.5, 0.25, 0.25], 0: [0.1, 0.2, 0.7], 1: [0.4, 0.6, 0.0]}


def _cuts_sql() -> str:
    rows = []
    for y, shares in SHARES.items():
        where = "y IS NULL" if y is None else f"y = {y}"
        for i in range(len(shares) - 1):
            total = " + ".join(f"round_even({s}::DOUBLE * m, 0)" for s in shares[: i + 1])
            rows.append(f"SELECT y, {total} AS cut FROM (SELECT y, count(*) AS m FROM evn WHERE {where} GROUP BY y)")
    return " UNION ALL ".join(rows)


@query("null_class_skewed_clients", f"""
    b AS ({_cuts_sql()}), k AS (SELECT event_id, y, {_rank('y')} AS rk FROM evn)
    SELECT event_id, y, (SELECT count(*) FROM b WHERE b.y IS NOT DISTINCT FROM k.y AND k.rk > b.cut)::INT AS client FROM k""", ("evn",))
def null_class_skewed_clients(spark, sf):
    return S.partition_dirichlet(V.evn(spark, sf), "y", KEY, SHARES).select("event_id", "y", "client")


@query("null_class_codes", """
    c AS (SELECT y, row_number() OVER (ORDER BY y::VARCHAR NULLS FIRST) - 1 AS code FROM (SELECT DISTINCT y FROM evn))
    SELECT event_id, evn.y, c.code::INT AS code FROM evn JOIN c ON evn.y IS NOT DISTINCT FROM c.y""", ("evn",))
def null_class_codes(spark, sf):
    return L.encode_labels(V.evn(spark, sf).select("event_id", "y"), "y").select("event_id", "y", "code")


@query("evaluate_gaps", eval_sql("scoredn", "split", "s") + " SELECT * FROM ev_out", ("scoredn",))
def evaluate_gaps(spark, sf):
    return M.evaluate(V.scoredn(spark, sf), F.col("y"), F.col("s"), ["split"])


@query("accuracy_gaps", f"SELECT {r('avg((y = (CASE WHEN s >= 0.5 THEN 1 ELSE 0 END))::INT)')} AS accuracy FROM scoredn", ("scoredn",))
def accuracy_gaps(spark, sf):
    return M.accuracy(V.scoredn(spark, sf), F.col("y"), X.predict(F.col("s")))


@query("roc_auc_gaps", f"{auc_sql('scoredn', 's', 'split')} SELECT split, {r('auc')} AS auc FROM au", ("scoredn",))
def roc_auc_gaps(spark, sf):
    return M.roc_auc(V.scoredn(spark, sf), F.col("y"), F.col("s"), ["split"])


@query("sweep_gaps", f"""
    t AS (SELECT unnest(range(5, 96, 5)) / 100.0::DOUBLE AS t),
    c AS (SELECT split, t.t, {_counts('t.t')} FROM t, scoredn GROUP BY split, t.t), q AS (SELECT *, {_PR} FROM c)
    SELECT split, t AS threshold, {r(_F1)} AS f1, {r('pr')} AS precision, {r('rc')} AS recall, {r('ac')} AS accuracy FROM q""", ("scoredn",))
def sweep_gaps(spark, sf):
    return M.threshold_sweep(V.scoredn(spark, sf), F.col("y"), F.col("s"), keys=["split"])


@query("confusion_gaps", """
    m AS (SELECT split AS a, CASE WHEN y = 1 THEN 'train' WHEN y = 0 THEN 'val' END AS p FROM scoredn),
    l AS (SELECT a AS v FROM m UNION SELECT p FROM m)
    SELECT x.v AS actual, z.v AS predicted, (SELECT count(*) FROM m WHERE a IS NOT DISTINCT FROM x.v AND p IS NOT DISTINCT FROM z.v) AS n FROM l x, l z""", ("scoredn",))
def confusion_gaps(spark, sf):
    guess = F.when(F.col("y") == 1, "train").when(F.col("y") == 0, "val")
    return M.confusion_matrix(V.scoredn(spark, sf).select("split", guess.alias("guess")), "split", "guess")


@query("quantize_gaps", """
    sy AS (SELECT label, CASE WHEN max(abs(v)) = 0 THEN 1.0::DOUBLE ELSE max(abs(v)) / 127.0::DOUBLE END AS scale FROM vlongn GROUP BY label)
    SELECT w.vec_id, w.dim, w.label, greatest(-128, least(127, round_even(v / sy.scale, 0)))::TINYINT AS q FROM vlongn w JOIN sy ON w.label IS NOT DISTINCT FROM sy.label""",
       ("vlongn",))
def quantize_gaps(spark, sf):
    w = V.vlongn(spark, sf)
    return Q.quantize(w, Q.symmetric_params(w, ["label"], "v"), ["label"], "v").select("vec_id", "dim", "label", "q")


@query("calibrate_gaps", f"""
    SELECT label, {r('min(v)')} AS lo, {r('max(v)')} AS hi, count(*) AS n, {r('max(abs(v)) / 127.0::DOUBLE')} AS scale, 0 AS zero_point
    FROM vlongn GROUP BY label""", ("vlongn",))
def calibrate_gaps(spark, sf):
    return Q.calibrate(V.vlongn(spark, sf), ["label"], "v")


@query("prune_gaps", f"""
    k AS (SELECT label, abs(v) AS m, row_number() OVER (PARTITION BY label ORDER BY abs(v)) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM vlongn),
    ct AS (SELECT label, min(m) AS cut FROM k WHERE i = least(floor(n * 0.4::DOUBLE), n - 1) GROUP BY label)
    SELECT w.vec_id, w.dim, {r('CASE WHEN abs(v) <= ct.cut THEN 0.0::DOUBLE ELSE v END')} AS pruned FROM vlongn w JOIN ct ON w.label IS NOT DISTINCT FROM ct.label""", ("vlongn",))
def prune_gaps(spark, sf):
    return Q.prune(V.vlongn(spark, sf), ["label"], "v", 0.4).select("vec_id", "dim", "pruned")
