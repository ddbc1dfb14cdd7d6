"""Stream queries over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import boosting as G, trees as T
from ..streaming import score as R
from . import views as V
from .registry import query, r, ratio
from .trees import ROUTE

# Events as inputs of the forest. Means the same in both engines.
_INPUT = ("{key} AS row_key, cast(user_id % 50 as double) AS f0, value * 1000 AS f1, cast(0 as double) AS f2, cast(0 as double) AS f3, "
          "cast(case when event_type = 'error' then 1 else 0 end as int) AS y")


def _stream(spark, sf):
    schema = V.table(spark, sf, "events").schema
    return R.open_stream(spark, f"{sf}/event*.parquet", schema)


def _prepare(df):
    return df.selectExpr(*[e.strip() for e in _INPUT.format(key="event_id").replace(", cast", "\n cast").replace(", value", "\n value").split("\n")])


@query("stream_source", "SELECT event_id, user_id, event_type, value FROM events")
def stream_source(spark, sf):
    return R.drain(_stream(spark, sf).select("event_id", "user_id", "event_type", "value"), "source")


@query("stream_limited", "SELECT least(count(*), 7000) AS n, least(count(*), 7000) AS n_events FROM events")
def stream_limited(spark, sf):
    """A stream that ends after a number of records."""
    taken = R.take(_stream(spark, sf).select("event_id", "value"), "taken", 7000)
    return taken.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_events"))


_SQL = f"inp AS (SELECT {_INPUT.format(key='event_id')} FROM events), {ROUTE.format(source='inp').strip()}"


@query("stream_score", _SQL + f""",
    bs AS (SELECT ln(avg(y) / (1.0::DOUBLE - avg(y))) AS b FROM flows),
    s AS (SELECT row_key, (SELECT b FROM bs) + 0.3::DOUBLE * sum(leaf_value) AS raw, sum(value) AS votes FROM lf GROUP BY row_key)
    SELECT row_key AS event_id, {r('1.0::DOUBLE / (1.0::DOUBLE + exp(-raw))')} AS score,
    CASE WHEN votes > (SELECT count(DISTINCT tree_id) FROM forest) // 2 THEN 1 ELSE 0 END AS vote FROM s""", ("flows", "forest"))
def stream_score(spark, sf):
    nodes = V.forest(spark, sf)
    base = G.base_score(V.flows(spark, sf), F.col("y")).first()["base_score"]

    def score(df):
        raw = T.boosted_score(_prepare(df), nodes, V.INPUTS, base, 0.3)
        voted = T.majority_vote(raw, nodes, V.INPUTS, name="vote")
        return voted.select(F.col("row_key").alias("event_id"), X.sigmoid(F.col("raw")).alias("score"), "vote")

    return R.drain(R.score_stream(_stream(spark, sf), score), "scores")


@query("stream_accuracy", _SQL + f""",
    v AS (SELECT row_key, min(y) AS y, CASE WHEN sum(value) > (SELECT count(DISTINCT tree_id) FROM forest) // 2 THEN 1 ELSE 0 END AS p FROM lf GROUP BY row_key),
    c AS (SELECT count(*) AS seen, count(*) FILTER (y = p) AS correct FROM v)
    SELECT seen, correct, {r(ratio('correct', 'seen'))} AS accuracy FROM c""", ("flows", "forest"))
def stream_accuracy(spark, sf):
    nodes = V.forest(spark, sf)
    voted = T.majority_vote(_prepare(_stream(spark, sf)), nodes, V.INPUTS)
    return R.running_accuracy(voted, F.col("y"), F.col("pred"), "accuracy")
