"""The end-to-end job: clean, split, scale, score, calibrate, evaluate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import clean as C, metrics as M, sample as S, scale as K
from ..plans.small import materialise
from . import views as V
from .evaluation import _FINE, _sweep_sql, eval_sql
from .registry import query

FEATS = V.INPUTS
# Weights of the fixed linear scorer, one per feature.
WEIGHTS = {"f0": 0.1, "f1": 2.0, "f2": -0.5, "f3": 0.0}
BIAS = -1.5


def _sql() -> str:
    q = "quantile_cont({c}, {p})".format
    med = "m AS (SELECT " + ", ".join(f"{q(c=c, p=0.5)} AS m_{c}" for c in FEATS) + " FROM dnum)"
    imp = "i AS (SELECT row_key, y, " + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in FEATS) + " FROM dnum, m)"
    bnd = "b AS (SELECT " + ", ".join(f"{q(c=c, p=0.01)} AS l_{c}, {q(c=c, p=0.99)} AS h_{c}" for c in FEATS) + " FROM i)"
    clp = "cl AS (SELECT row_key, y, " + ", ".join(f"greatest(l_{c}, least(h_{c}, {c})) AS {c}" for c in FEATS) + " FROM i, b)"
    rank = "row_number() OVER (PARTITION BY {p} ORDER BY md5(concat_ws('|', '42', row_key)), row_key)".format
    one = (f"k1 AS (SELECT *, CASE WHEN {rank(p='y')} <= greatest(1, floor(count(*) OVER (PARTITION BY y) * 0.15::DOUBLE)) "
           "THEN 'test' ELSE 'train' END AS s1 FROM cl)")
    frac = "(0.15::DOUBLE / (1.0::DOUBLE - 0.15::DOUBLE))"
    two = (f"k2 AS (SELECT *, CASE WHEN s1 = 'train' AND {rank(p='s1, y')} <= greatest(1, floor(count(*) OVER (PARTITION BY s1, y) * {frac})) "
           "THEN 'val' ELSE s1 END AS split FROM k1)")
    fit = "p AS (SELECT " + ", ".join(
        f"{q(c=c, p=0.5)} AS c_{c}, greatest({q(c=c, p=0.75)} - {q(c=c, p=0.25)}, 1e-8) AS d_{c}" for c in FEATS
    ) + " FROM k2 WHERE split = 'train')"
    z = f"{BIAS}::DOUBLE" + "".join(f" + {w}::DOUBLE * (({c} - c_{c}) / d_{c})" for c, w in WEIGHTS.items())
    sc = f"sc AS (SELECT row_key, y, split, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({z}))) AS s FROM k2, p)"
    val = "vv AS (SELECT y, s FROM sc WHERE split = 'val')"
    sweep = _sweep_sql(_FINE).replace("FROM t, scored", "FROM t, vv").strip()
    best = "bt AS (SELECT threshold FROM sw ORDER BY f1 DESC, threshold LIMIT 1)"
    final = eval_sql("sc", "split", "s", "(SELECT threshold FROM bt)").replace("q AS (", "qq AS (").replace("q.split", "qq.split").replace(
        "FROM q JOIN", "FROM qq JOIN").replace(" c AS (SELECT split", " cc AS (SELECT split").replace("AS fnr FROM c)", "AS fnr FROM cc)")
    return ", ".join([med, imp, bnd, clp, one, two, fit, sc, val, sweep, best, final.strip()]) + \
        " SELECT ev_out.*, bt.threshold FROM ev_out, bt"


@query("calibrated_scoring", _sql(), ("dnum",))
def calibrated_scoring(spark, sf):
    """Metrics per split at the threshold that is best on the validation rows."""
    # Two stages are written out because several jobs read each of them.
    parsed = materialise(V.dnum(spark, sf).select("row_key", "y", *FEATS), "parsed")
    cleaned = C.clean_chain(parsed, FEATS, staged=False)
    split = materialise(S.split_corrected(cleaned, "y", ["row_key"], 0.15, 0.15), "split")
    scaled = K.transform(split, K.robust_fit(split.filter("split = 'train'"), FEATS))
    z = F.lit(BIAS)
    for c, w in WEIGHTS.items():
        z = z + F.lit(w) * F.col(c)
    scored = scaled.select("row_key", "y", "split", X.sigmoid(z).alias("s"))
    y, s = F.col("y"), F.col("s")
    best = M.best_threshold(scored.filter("split = 'val'"), y, s).first()["threshold"]
    return M.evaluate(scored, y, s, ["split"], best).withColumn("threshold", F.lit(best))
