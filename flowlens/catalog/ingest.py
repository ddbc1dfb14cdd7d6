"""Source and sink queries: tables go through real files in the shared folder and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import metrics as M, scale as S
from ..plans.ranking import number_rows
from ..plans.small import scratch_path
from ..sources import delimited as D, records as B, results as R
from . import views as V
from .evaluation import _FINE, _sweep_sql
from .registry import query, r, ratio

# One text column holding a whole line; some lines are blank, short or long.
_LINE = ("case when event_id % 11 = 3 then '' when event_id % 11 = 5 then concat(' ', cast(event_id as string), ' ,', event_type) "
         "when event_id % 11 = 7 then concat(cast(event_id as string), ',', event_type, ',', cast(user_id as string), ',x,y') "
         "else concat(cast(event_id as string), ', ', event_type, ' ,\"', cast(user_id as string)) end")


@query("csv_ingest", """
    SELECT event_id::VARCHAR AS id, event_type AS kind, CASE event_id % 11 WHEN 5 THEN '' WHEN 7 THEN user_id::VARCHAR
    ELSE '"' || user_id::VARCHAR END AS kind_2 FROM ev WHERE event_id % 11 <> 3""", ("ev",))
def csv_ingest(spark, sf):
    lines = V.ev(spark, sf).select(F.expr(_LINE).alias(" id , kind,kind "))
    path = scratch_path(spark, "lines")
    # A separator that never occurs keeps the writer from quoting the line.
    (lines.write.options(header=True, sep="\u0001", emptyValue="", ignoreLeadingWhiteSpace=False,
                         ignoreTrailingWhiteSpace=False, quote="\u0002", escapeQuotes=False).csv(path))
    return D.read_delimited(spark, path)


@query("csv_rows_numbered", "SELECT count(*) AS n, 1::BIGINT AS first_no, count(*) AS last_no, count(*) AS n_distinct "
       "FROM ev WHERE event_id % 11 <> 3", ("ev",))
def csv_rows_numbered(spark, sf):
    numbered = number_rows(csv_ingest(spark, sf))
    return numbered.agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_no"),
                        F.max("row_no").alias("last_no"), F.countDistinct("row_no").alias("n_distinct"))


@query("rows_numbered_shuffled", "SELECT count(*) AS n, 1::BIGINT AS first_no, count(*) AS last_no, count(*) AS n_distinct, "
       "count(DISTINCT event_id) AS n_events FROM events", ())
def rows_numbered_shuffled(spark, sf):
    """Numbers stay dense when a shuffle, whose partitions are merged by size, stands before them."""
    numbered = number_rows(V.table(spark, sf, "events").repartition("event_id"))
    return numbered.agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_no"), F.max("row_no").alias("last_no"),
                        F.countDistinct("row_no").alias("n_distinct"), F.countDistinct("event_id").alias("n_events"))


_RECORD = ("case when l_linenumber = 3 then concat_ws(',', f0, f1, f2) "
           "else concat_ws(',', f0, f1, f2, f3, label) end")


def _strict_sql() -> str:
    nums = []
    for c in V.INPUTS:
        nums.append(f"CASE WHEN trim({c}) = '' THEN 0.0 WHEN regexp_matches(trim({c}), '{X.NUMBER}') OR "
                    f"regexp_matches(lower(trim({c})), '{X.SPECIAL}') THEN try_cast(trim({c}) AS DOUBLE) END AS v_{c}")
    return ("a AS (SELECT row_key, l_linenumber, label, " + ", ".join(nums) + " FROM dirty), "
            "b AS (SELECT *, CASE WHEN l_linenumber = 3 THEN 'short' WHEN v_f0 IS NULL OR v_f1 IS NULL OR v_f2 IS NULL OR v_f3 IS NULL "
            "THEN 'number' WHEN upper(trim(label)) NOT IN ('ATTACK', 'BENIGN') THEN 'label' END AS reject_reason FROM a)")


@query("strict_ingest", _strict_sql() + " SELECT row_key, " + ", ".join(
    f"CASE WHEN isfinite(v_{c}) THEN {r(f'v_{c}::FLOAT::DOUBLE', 3)} END AS f{i}" for i, c in enumerate(V.INPUTS))
    + ", CASE WHEN upper(trim(label)) = 'ATTACK' THEN 1 ELSE 0 END::TINYINT AS label FROM b WHERE reject_reason IS NULL",
       ("dirty",), digits=3)
def strict_ingest(spark, sf):
    lines = V.dirty(spark, sf).select("row_key", F.expr(_RECORD).alias("line"))
    good = D.accepted(D.strict_records(lines, "line", 4, ["row_key"]))
    return good.select("row_key", *[X.finite(F.col(f"f{i}").cast("double")).alias(f"f{i}") for i in range(4)], "label")


@query("reject_counts", _strict_sql() + """
    SELECT coalesce(reject_reason, 'written') AS outcome, count(*) AS n FROM b GROUP BY 1""", ("dirty",))
def reject_counts(spark, sf):
    lines = V.dirty(spark, sf).select(F.expr(_RECORD).alias("line"))
    return D.reject_counts(D.strict_records(lines, "line", 4))


@query("binary_records", "SELECT " + ", ".join(
    f"{r(f'(f{i % 5} + {i // 5})::FLOAT::DOUBLE', 3)} AS f{i}" for i in range(24)) + ", y::TINYINT AS label FROM flows",
       ("flows",), digits=3)
def binary_records(spark, sf):
    df = V.flows(spark, sf)
    wide = df.select(*[(F.col(f"f{i % 5}") + F.lit(float(i // 5))).cast("float").alias(f"f{i}") for i in range(24)],
                     F.col("y").cast("tinyint").alias("label"))
    path = scratch_path(spark, "records")
    B.write_records(wide, [f"f{i}" for i in range(24)], "label", path)
    return B.read_records(spark, path, 24)


@query("head_n", f"""
    SELECT row_key, {', '.join(f"CASE WHEN trim({c}) = '' THEN 0.0::DOUBLE WHEN regexp_matches(trim({c}), '{X.NUMBER}') THEN try_cast(trim({c}) AS DOUBLE) END AS {c}" for c in ('f2', 'f3'))},
    CASE WHEN upper(trim(label)) = 'BENIGN' THEN 0 ELSE 1 END AS label FROM dirty
    WHERE true ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, row_key LIMIT 1000""", ("dirty",))
def head_n(spark, sf):
    df = D.head_rows(V.dirty(spark, sf), 1000, V.ORDER, ["f2", "f3"], "label")
    return df.select("row_key", *[X.finite(F.col(c)).alias(c) for c in ("f2", "f3")], "label")


@query("metrics_json_roundtrip", f"""
    SELECT split, count(*) AS n, {r(ratio('count(*) FILTER (y = (s >= 0.5)::INT)', 'count(*)'))} AS accuracy
    FROM scored GROUP BY split""", ("scored",))
def metrics_json_roundtrip(spark, sf):
    df = V.scored(spark, sf)
    path = scratch_path(spark, "metrics")
    for part in ("train", "val", "test"):  # three appended runs
        one = (df.filter(F.col("split") == part).groupBy("split")
               .agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == X.predict(F.col("s"))).cast("double")).alias("accuracy")))
        R.write_metrics(one, path)
    return R.read_metrics(spark, path, "split string, n bigint, accuracy double")


@query("params_roundtrip", "p AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS m_{c}, greatest(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 1e-8) AS s_{c}"
    for c in V.INPUTS) + " FROM flows) SELECT row_key, " + ", ".join(
    f"{r(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in V.INPUTS) + " FROM flows, p", ("flows",))
def params_roundtrip(spark, sf):
    df = V.flows(spark, sf)
    path = scratch_path(spark, "params")
    R.save_table(S.params_table(spark, S.robust_fit(df, V.INPUTS)), path)
    return S.transform(df, S.params_from_table(R.load_table(spark, path))).select("row_key", *V.INPUTS)


@query("threshold_roundtrip", _sweep_sql(_FINE) + f""",
    b AS (SELECT threshold FROM sw ORDER BY f1 DESC, threshold LIMIT 1),
    z AS (SELECT quantile_cont(s, 0.5) AS m, greatest(quantile_cont(s, 0.75) - quantile_cont(s, 0.25), 1e-8) AS d FROM scored)
    SELECT event_id, {r('(s - m) / d')} AS s, CASE WHEN s >= threshold THEN 1 ELSE 0 END AS pred FROM scored, b, z""", ("scored",))
def threshold_roundtrip(spark, sf):
    """The scaler and its decision threshold, fitted, stored together, reloaded and applied."""
    df = V.scored(spark, sf)
    path = scratch_path(spark, "fitted")
    best = M.best_threshold(df, F.col("y"), F.col("s")).first()["threshold"]
    R.save_table(S.params_table(spark, S.robust_fit(df, ["s"]), best), path)
    stored = R.load_table(spark, path)
    called = df.select("event_id", "s", X.predict(F.col("s"), S.threshold_from_table(stored)).alias("pred"))
    return S.transform(called, S.params_from_table(stored))


@query("node_table_roundtrip", "SELECT tree_id, node_id, feature, " + r("threshold") + " AS threshold, left_id, right_id, value, "
       + r("prob") + " AS prob, " + r("leaf_value") + " AS leaf_value, gain, sum_h, n FROM grove", ("grove",))
def node_table_roundtrip(spark, sf):
    path = scratch_path(spark, "nodes")
    R.save_table(V.grove(spark, sf), path)
    return R.load_table(spark, path)


