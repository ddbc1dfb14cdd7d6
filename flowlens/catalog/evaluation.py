"""Metric, threshold and loss queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import metrics as M, trees as T
from . import views as V
from .registry import query, r, ratio

P = "(CASE WHEN s >= 0.5 THEN 1 ELSE 0 END)"


@query("confusion_matrix", """
    l AS (SELECT label AS v FROM multi UNION SELECT predicted FROM multi)
    SELECT a.v AS actual, b.v AS predicted, (SELECT count(*) FROM multi WHERE label = a.v AND predicted = b.v) AS n FROM l a, l b""",
       ("multi",))
def confusion_matrix(spark, sf):
    return M.confusion_matrix(V.multi(spark, sf), "label", "predicted")


@query("accuracy", f"SELECT {r(f'avg((y = {P})::INT)')} AS accuracy FROM scored", ("scored",))
def accuracy(spark, sf):
    return M.accuracy(V.scored(spark, sf), F.col("y"), X.predict(F.col("s")))


def _counts(t: str = "0.5", s: str = "s") -> str:
    return (f"count(*) FILTER ({s} >= {t} AND y = 1) AS tp, count(*) FILTER ({s} >= {t} AND y <> 1) AS fp, "
            f"count(*) FILTER ({s} < {t} AND y = 1) AS fn, count(*) FILTER ({s} < {t} AND y <> 1) AS tn")


_PR = f"{ratio('tp', 'tp + fp')} AS pr, {ratio('tp', 'tp + fn')} AS rc, {ratio('tp + tn', 'tp + fp + fn + tn')} AS ac"
_F1 = "(CASE WHEN pr + rc > 0 THEN 2.0::DOUBLE * pr * rc / (pr + rc) ELSE 0.0::DOUBLE END)"


@query("precision_recall_f1", f"""
    c AS (SELECT {_counts()} FROM scored), q AS (SELECT *, {_PR} FROM c)
    SELECT {r('pr')} AS precision, {r('rc')} AS recall, {r(_F1)} AS f1 FROM q""", ("scored",))
def precision_recall_f1(spark, sf):
    return M.precision_recall_f1(V.scored(spark, sf), F.col("y"), X.predict(F.col("s")))


@query("fpr_fnr", f"""
    c AS (SELECT {_counts()} FROM scored)
    SELECT {r(ratio('fp', 'fp + tn'))} AS fpr, {r(ratio('fn', 'fn + tp'))} AS fnr FROM c""", ("scored",))
def fpr_fnr(spark, sf):
    return M.error_rates(V.scored(spark, sf), F.col("y"), X.predict(F.col("s")))


@query("predict_threshold", "SELECT event_id, s >= 0.35 AS flag, CASE WHEN s >= 0.35 THEN 1 ELSE 0 END AS pred FROM scored",
       ("scored",))
def predict_threshold(spark, sf):
    p = X.predict(F.col("s"), 0.35)
    return V.scored(spark, sf).select("event_id", (p == 1).alias("flag"), p.alias("pred"))


def auc_sql(source: str, s: str, keys: str = "", name: str = "auc") -> str:
    part, cols = (f"PARTITION BY {keys}", f"{keys},") if keys else ("", "")
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
    g AS (SELECT {cols} {s} AS sc, coalesce(sum(y), 0) AS p, count(y) - coalesce(sum(y), 0) AS q FROM {source} GROUP BY {cols} {s}),
    w AS (SELECT *, sum(p) OVER ({part} ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS cp FROM g),
    au AS (SELECT {cols} CASE WHEN sum(p) = 0 OR sum(q) = 0 THEN 0.5::DOUBLE ELSE sum(q * (2 * cp - p))::DOUBLE
           / (sum(p)::DOUBLE * sum(q)::DOUBLE * 2.0::DOUBLE) END AS {name} FROM w {group})"""


@query("roc_auc", f"{auc_sql('scored', 's')} SELECT {r('auc')} AS auc FROM au", ("scored",))
def roc_auc(spark, sf):
    return M.roc_auc(V.scored(spark, sf), F.col("y"), F.col("s"))


@query("roc_auc_tied", f"{auc_sql('scored', 's2')} SELECT {r('auc')} AS auc FROM au", ("scored",))
def roc_auc_tied(spark, sf):
    return M.roc_auc(V.scored(spark, sf), F.col("y"), F.col("s2"))


@query("roc_auc_ungrouped", f"""
    w AS (SELECT y, sum(y) OVER (ORDER BY s2 DESC, event_id ROWS UNBOUNDED PRECEDING) AS tp FROM scored)
    SELECT {r('sum(CASE WHEN y = 0 THEN tp ELSE 0 END)::DOUBLE / (sum(y)::DOUBLE * (count(*) - sum(y))::DOUBLE)')} AS auc FROM w""",
       ("scored",))
def roc_auc_ungrouped(spark, sf):
    return M.roc_auc_ungrouped(V.scored(spark, sf), F.col("y"), F.col("s2"), "event_id")


def _ll(eps: str, s: str = "s") -> str:
    p = f"greatest({eps}::DOUBLE, least(1.0::DOUBLE - {eps}::DOUBLE, {s}))"
    return f"(-(y * ln({p}) + (1.0::DOUBLE - y) * ln(1.0::DOUBLE - {p})))"


@query("logloss", f"SELECT {r('avg(' + _ll('1e-7') + ')')} AS logloss FROM scored", ("scored",))
def logloss(spark, sf):
    return M.logloss(V.scored(spark, sf), F.col("y"), F.col("s"))


@query("bce_loss", f"""
    SELECT {r('avg(' + _ll('1e-9') + ')')} AS from_probability,
    {r('avg(' + _ll('1e-9', '(1.0::DOUBLE / (1.0::DOUBLE + exp(-(4 * s - 2))))') + ')')} AS from_logit FROM scored""", ("scored",))
def bce_loss(spark, sf):
    return V.scored(spark, sf).agg(F.avg(X.bce(F.col("y"), F.col("s"))).alias("from_probability"),
                                   F.avg(X.bce(F.col("y"), 4 * F.col("s") - 2, from_logits=True)).alias("from_logit"))


@query("weighted_bce_loss", f"""
    SELECT {r('avg((CASE WHEN y = 1 THEN 3.0 ELSE 1.0 END)::DOUBLE * ' + _ll('1e-9') + ')')} AS loss FROM scored""", ("scored",))
def weighted_bce_loss(spark, sf):
    return V.scored(spark, sf).agg(F.avg(X.bce(F.col("y"), F.col("s"), pos_weight=3.0)).alias("loss"))


_P9 = "greatest(1e-9::DOUBLE, least(1.0::DOUBLE - 1e-9::DOUBLE, s))"
_PT = f"(CASE WHEN y = 1 THEN {_P9} ELSE 1.0::DOUBLE - {_P9} END)"
_AT = "(CASE WHEN y = 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END)"


@query("focal_loss", f"SELECT {r(f'avg(-{_AT} * pow(1.0::DOUBLE - {_PT}, 2) * ln({_PT}))')} AS loss FROM scored", ("scored",))
def focal_loss(spark, sf):
    return V.scored(spark, sf).agg(F.avg(X.focal(F.col("y"), F.col("s"))).alias("loss"))


_Z = "(1.0::DOUBLE / (1.0::DOUBLE + exp(-(4 * s - 2))))"
_W3 = "(CASE WHEN y = 1 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END)"
_MID = "greatest(0.01::DOUBLE, least(0.99::DOUBLE, s))"
_MT = f"(CASE WHEN y = 1 THEN {_MID} ELSE 1.0::DOUBLE - {_MID} END)"


@query("loss_gradients", f"""
    n AS (SELECT count(*) AS n FROM scored)
    SELECT event_id, {r(f'(-y / {_MID} + (1.0::DOUBLE - y) / (1.0::DOUBLE - {_MID})) / n', 9)} AS bce,
    {r(f'({_Z} - y) / n', 9)} AS bce_logit, {r(f'{_W3} * ({_Z} - y) / n', 9)} AS weighted_logit,
    {r(f'(CASE WHEN y = 1 THEN 1 ELSE -1 END) * {_AT} * (-2 * (1 - {_MT}) * ln({_MT}) - pow(1 - {_MT}, 2) / {_MT}) / n', 9)} AS focal
    FROM scored, n""", ("scored",), digits=9)
def loss_gradients(spark, sf):
    df = V.scored(spark, sf)
    n = F.lit(df.count())  # the batch size is a fitted number, not a window over all rows
    mid = X.clip(F.col("s"), 0.01, 0.99)
    return df.select(
        "event_id", X.bce_slope(F.col("y"), mid, n).alias("bce"), X.bce_slope(F.col("y"), 4 * F.col("s") - 2, n, from_logits=True).alias("bce_logit"),
        X.bce_slope(F.col("y"), 4 * F.col("s") - 2, n, from_logits=True, pos_weight=3.0).alias("weighted_logit"),
        X.focal_slope(F.col("y"), mid, n).alias("focal"))


def _sweep_sql(grid: str, source: str = "scored") -> str:
    return f"""
    t AS ({grid}),
    c AS (SELECT t.t, {_counts('t.t')} FROM t, {source} GROUP BY t.t), q AS (SELECT *, {_PR} FROM c),
    sw AS (SELECT t AS threshold, {_F1} AS f1, pr AS precision, rc AS recall, ac AS accuracy FROM q)"""


_FINE = "SELECT unnest(range(1, 100)) / 100.0::DOUBLE AS t"


@query("threshold_sweep", _sweep_sql("SELECT unnest(range(5, 96, 5)) / 100.0::DOUBLE AS t") + f"""
    SELECT threshold, {r('f1')} AS f1, {r('precision')} AS precision, {r('recall')} AS recall, {r('accuracy')} AS accuracy FROM sw""",
       ("scored",))
def threshold_sweep(spark, sf):
    return M.threshold_sweep(V.scored(spark, sf), F.col("y"), F.col("s"))


@query("threshold_sweep_fine", _sweep_sql(_FINE) + f"""
    SELECT threshold, {r('f1')} AS f1, {r('precision')} AS precision, {r('recall')} AS recall, {r('accuracy')} AS accuracy FROM sw""",
       ("scored",))
def threshold_sweep_fine(spark, sf):
    return M.threshold_sweep(V.scored(spark, sf), F.col("y"), F.col("s"), M.GRID_FINE)


@query("best_threshold_f1", _sweep_sql(_FINE) + f"""
    SELECT threshold, {r('f1')} AS f1 FROM sw WHERE true ORDER BY sw.f1 DESC, threshold LIMIT 1""", ("scored",))
def best_threshold_f1(spark, sf):
    return M.best_threshold(V.scored(spark, sf), F.col("y"), F.col("s"), "f1")


@query("best_threshold_accuracy", _sweep_sql("SELECT unnest(range(10, 91)) / 100.0::DOUBLE AS t") + f"""
    SELECT threshold, {r('accuracy')} AS accuracy FROM sw WHERE true ORDER BY sw.accuracy DESC, threshold LIMIT 1""", ("scored",))
def best_threshold_accuracy(spark, sf):
    return M.best_threshold(V.scored(spark, sf), F.col("y"), F.col("s"), "accuracy", M.GRID_MIDDLE)


@query("threshold_table", _sweep_sql(_FINE) + f""",
    b AS (SELECT threshold FROM sw ORDER BY f1 DESC, threshold LIMIT 1)
    SELECT threshold, {r('f1')} AS f1, {r('precision')} AS precision, {r('recall')} AS recall, {r('accuracy')} AS accuracy,
    CASE WHEN threshold IN (SELECT threshold FROM b) THEN 1 ELSE 0 END AS is_best FROM sw
    WHERE round(threshold * 100) IN (30, 40, 50, 60, 70) OR threshold IN (SELECT threshold FROM b)""", ("scored",))
def threshold_table(spark, sf):
    return M.threshold_table(V.scored(spark, sf), F.col("y"), F.col("s"))


def eval_sql(source: str, key: str, s: str, t: str = "0.5") -> str:
    return f"""
    {auc_sql(source, s, key)},
    c AS (SELECT {key}, {_counts(t, s)}, count(y) AS n, count(*) - count(y) AS n_unlabelled, avg({_ll('1e-7', s)}) AS logloss FROM {source} GROUP BY {key}),
    q AS (SELECT *, {_PR}, {ratio('fp', 'fp + tn')} AS fpr, {ratio('fn', 'fn + tp')} AS fnr FROM c),
    ev_raw AS (SELECT q.{key}, ac AS accuracy, pr AS precision, rc AS recall, {_F1} AS f1, auc FROM q JOIN au ON q.{key} IS NOT DISTINCT FROM au.{key}),
    ev_out AS (SELECT q.{key}, tp, fp, fn, tn, n, n_unlabelled, {r('logloss')} AS logloss, {r('pr')} AS precision, {r('rc')} AS recall,
      {r('ac')} AS accuracy, {r('fpr')} AS fpr, {r('fnr')} AS fnr, {r(_F1)} AS f1, {r('auc')} AS auc FROM q JOIN au ON q.{key} IS NOT DISTINCT FROM au.{key})"""


@query("evaluate_splits", eval_sql("scored", "split", "s") + " SELECT * FROM ev_out", ("scored",))
def evaluate_splits(spark, sf):
    return M.evaluate(V.scored(spark, sf), F.col("y"), F.col("s"), ["split"])


# Scores that are missing in two ways: such a row counts, and is negative at every threshold.
_GAPS = "CASE WHEN event_id % 11 = 3 OR event_id % 13 = 5 THEN '-inf'::DOUBLE ELSE s END"
_GAPPY = f"gappy AS (SELECT event_id, y, split, {_GAPS} AS s FROM scored)"


def _gappy(spark, sf):
    gap = F.when(F.col("event_id") % 11 == 3, F.lit(None).cast("double")).when(F.col("event_id") % 13 == 5, F.lit(float("nan")))
    return V.scored(spark, sf).withColumn("s", F.when((F.col("event_id") % 11 == 3) | (F.col("event_id") % 13 == 5), gap).otherwise(F.col("s")))


@query("sweep_missing_scores", _GAPPY + "," + _sweep_sql(_FINE, "gappy") + f"""
    SELECT threshold, {r('f1')} AS f1, {r('precision')} AS precision, {r('recall')} AS recall, {r('accuracy')} AS accuracy FROM sw""",
       ("scored",))
def sweep_missing_scores(spark, sf):
    return M.threshold_sweep(_gappy(spark, sf), F.col("y"), F.col("s"), M.GRID_FINE)


@query("evaluate_missing_scores", _GAPPY + "," + eval_sql("gappy", "split", "s") + " SELECT * FROM ev_out", ("scored",))
def evaluate_missing_scores(spark, sf):
    return M.evaluate(_gappy(spark, sf), F.col("y"), F.col("s"), ["split"])


_DOCS = ("dl AS (SELECT d.source AS grp, l.quality AS y, least(d.n_chars / 5000.0::DOUBLE, 1.0::DOUBLE) AS s "
         "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")


@query("evaluate_documents", _DOCS + "," + eval_sql("dl", "grp", "s") + " SELECT * FROM ev_out")
def evaluate_documents(spark, sf):
    docs, labels = V.table(spark, sf, "documents"), V.table(spark, sf, "labels")
    df = docs.join(labels, "doc_id").select(
        F.col("source").alias("grp"), F.col("quality").alias("y"), F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("s"))
    return M.evaluate(df, F.col("y"), F.col("s"), ["grp"])


@query("classification_report", eval_sql("scored", "split", "s") + " " + " UNION ALL ".join(
    f"SELECT split, '{m}' AS metric, {r(m, 4)} AS value FROM ev_raw" for m in ("accuracy", "precision", "recall", "f1", "auc")),
    ("scored",))
def classification_report(spark, sf):
    return M.report(evaluate_splits(spark, sf), keys=["split"])


_RUNS = "runs AS (SELECT *, event_id % 5 AS run FROM scored)"
_METRICS = ("accuracy", "precision", "recall", "f1", "auc", "fpr", "fnr")


def _runs(spark, sf):
    df = V.scored(spark, sf).withColumn("run", F.col("event_id") % 5)
    return M.report(M.evaluate(df, F.col("y"), F.col("s"), ["run"]), _METRICS, ["run"], digits=6)


@query("repeat_summary", _RUNS + "," + eval_sql("runs", "run", "s") + ", m AS (" + " UNION ALL ".join(
    f"SELECT run, '{m}' AS metric, {m} AS value FROM ev_out" for m in _METRICS) + f""")
    SELECT metric, {r('avg(value)')} AS mean, {r('coalesce(stddev_samp(value), 0)')} AS std, count(*) AS n_runs,
    min(value) FILTER (run = 0) AS first_run FROM m GROUP BY metric""", ("scored",))
def repeat_summary(spark, sf):
    return M.summarise_runs(_runs(spark, sf), ["metric"], "value", "run")


@query("importance_summary", f"""
    c AS (SELECT tree_id % 5 AS run, feature, count(*) AS k FROM grove WHERE feature >= 0 GROUP BY ALL),
    a AS (SELECT r.run, f.feature, coalesce(c.k, 0)::DOUBLE / (SELECT sum(k) FROM c c2 WHERE c2.run = r.run) AS v
          FROM (SELECT unnest(range(5)) AS run) r CROSS JOIN (SELECT unnest(range(4))::INT AS feature) f
          LEFT JOIN c ON c.run = r.run AND c.feature = f.feature)
    SELECT feature, {r('avg(v)')} AS mean, {r('coalesce(stddev_samp(v), 0)')} AS std, count(*) AS n_runs FROM a GROUP BY feature""",
       ("grove",))
def importance_summary(spark, sf):
    nodes = V.grove(spark, sf).withColumn("run", F.col("tree_id") % 5)
    per_run = T.importance_split_count(nodes, 4, ["run"])
    return M.summarise_runs(per_run, ["feature"], "importance", "run").drop("first_run").orderBy(F.desc("mean"), "feature")


@query("metric_delta", eval_sql("scored", "split", "s") + ", " + f"""
    c2 AS (SELECT split, avg(((s2 >= 0.5)::INT = y)::INT) AS ac2 FROM scored GROUP BY split)
    SELECT e.split, e.accuracy AS before, {r('ac2')} AS after, {r('ac2 - ac')} AS delta,
    CASE WHEN ac2 >= 0.8 THEN 'pass' ELSE 'warn' END AS verdict
    FROM ev_out e JOIN c2 ON e.split = c2.split JOIN q ON q.split = e.split""", ("scored",))
def metric_delta(spark, sf):
    df = V.scored(spark, sf)
    return M.metric_delta(M.evaluate(df, F.col("y"), F.col("s"), ["split"]), M.evaluate(df, F.col("y"), F.col("s2"), ["split"]), ["split"], "accuracy", 0.8)


@query("prediction_parity", f"""
    c AS (SELECT count(*) AS n, count(*) FILTER ((s >= 0.505) <> (s2 >= 0.505)) AS flips FROM scored)
    SELECT n, flips, {r(ratio('flips', 'n'))} AS flip_rate, CASE WHEN {ratio('flips', 'n')} <= 0.01 THEN 'pass' ELSE 'warn' END AS verdict
    FROM c""", ("scored",))
def prediction_parity(spark, sf):
    return M.prediction_parity(V.scored(spark, sf), X.predict(F.col("s"), 0.505), X.predict(F.col("s2"), 0.505))
