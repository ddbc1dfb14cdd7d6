"""Input views over the supplied tables, for Spark and as SQL for the check.

Texts shared by both engines are plain expressions that mean the same in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import expr as X

FEATURES = ["f0", "f1", "f2", "f3", "f4"]
INPUTS = ["f0", "f1", "f2", "f3"]
NUMBER_SQL = X.NUMBER


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- flows: numeric features and a value-derived label ---------------------------

_KEY = ("concat_ws('-', cast(l_orderkey as {s}), cast(l_linenumber as {s}), cast(l_partkey as {s}), "
        "cast(l_suppkey as {s}), cast(cast(l_quantity as bigint) as {s}), "
        "cast(cast(floor(l_extendedprice * 100 + 0.5) as bigint) as {s}))")
_Y = "cast(case when l_extendedprice * (1 - l_discount) > 70000 then 1 else 0 end as int)"
_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def flows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        *_IDS, _KEY.format(s="string") + " as row_key", "l_quantity as f0", "l_extendedprice as f1",
        "l_discount as f2", "l_tax as f3", "cast(0 as double) as f4", _Y + " as y")


# --- dirty: the same as text, with gaps, infinities and garbage ------------------

def _dirty_cell(source: str, s: str, marks: str) -> str:
    cases = ["when l_linenumber = 7 then ''"]
    if "i" in marks:
        cases.append("when l_linenumber = 6 and l_returnflag = 'A' then 'Infinity'")
    if "n" in marks:
        cases.append("when l_linenumber = 5 and l_returnflag = 'N' then 'NaN'")
    if "g" in marks:
        cases.append("when l_linenumber = 4 and l_returnflag = 'R' then 'abc'")
    return f"case {' '.join(cases)} else cast({source} as {s}) end"


_DIRTY = {"f0": ("l_quantity", "ig"), "f1": ("l_extendedprice", "in"), "f2": ("l_discount", "n"), "f3": ("l_tax", "g")}
_DIRTY_LABEL = (f"case when {_Y} = 1 then 'ATTACK' when l_linenumber = 2 and l_returnflag = 'N' then ' other ' "
                "else 'BENIGN' end")
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "row_key"]


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    cells = [f"{_dirty_cell(src, 'string', m)} as {c}" for c, (src, m) in _DIRTY.items()]
    return table(spark, sf, "lineitem").selectExpr(
        *_IDS, _KEY.format(s="string") + " as row_key", "l_returnflag", *cells, _DIRTY_LABEL + " as label", _Y + " as y")


def dnum(spark: SparkSession, sf: str) -> DataFrame:
    """``dirty`` after casting: one missing value, NULL."""
    return X.parse_columns(dirty(spark, sf), INPUTS)


# --- events -----------------------------------------------------------------------

def ev(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id", "user_id", "event_type", "value", "event_id + 1 as row_no",
        "cast(case when event_type = 'error' then 1 else 0 end as int) as y", "cast(user_id % 8 as int) as client")


_SPLIT = "substr(md5(cast(event_id as {s})), 1, 1)"
_SPLIT_CASE = "case when {h} < '9' then 'train' when {h} < 'c' then 'val' else 'test' end"
_SCORED_Y = "cast(case when (value > 50) <> (event_id % 7 = 0) then 1 else 0 end as int)"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id", _SCORED_Y + " as y", "least(value / 100, cast(1 as double)) as s",
        "floor(least(value, cast(100 as double))) / cast(100 as double) as s2",
        _SPLIT_CASE.format(h=_SPLIT.format(s="string")) + " as split")


# --- the same with gaps: NULL classes, labels and groups ------------------------------------

def evn(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the rows has no class."""
    return ev(spark, sf).selectExpr("event_id", "event_type", "value", _EVN)


def scoredn(spark: SparkSession, sf: str) -> DataFrame:
    """Some rows have no label, a quarter has no split."""
    return scored(spark, sf).selectExpr("event_id", "s", *_SCOREDN)


def vlongn(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of layer 3 belong to no layer."""
    return vlong(spark, sf).selectExpr("vec_id", "dim", "v", "nullif(label, 3) as label")


_EVN = "case when event_id % 3 = 0 then null else y end as y"
_SCOREDN = ["case when event_id % 10 = 7 then null else y end as y", "case when event_id % 4 = 1 then null else split end as split"]


# --- embeddings -------------------------------------------------------------------

def multi(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id", "label", "cast((label + vec_id % 3) % 10 as int) as predicted")


def vec(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def vlong(spark: SparkSession, sf: str) -> DataFrame:
    return vec(spark, sf).selectExpr("vec_id", "label", "posexplode(cast(embedding as array<double>)) as (dim, v)")


# --- node tables fitted from the rows ----------------------------------------------

# Attributes of the nodes 0..5 of one tree, from per-tree totals. Node 5 cannot be reached.
_NODE = {
    "feature": "case when node_id = 0 then 1 when node_id = 2 and tree_id % 3 <> 0 then 0 else -1 end",
    "threshold": "case when node_id = 0 then t1 when node_id = 2 and tree_id % 3 <> 0 then t0 + 0.5 else cast(0 as double) end",
    "left_id": "case when node_id = 0 then 1 when node_id = 2 and tree_id % 3 <> 0 then 3 else -1 end",
    "right_id": "case when node_id = 0 then 2 when node_id = 2 and tree_id % 3 <> 0 then 4 else -1 end",
    "value": "case when node_id = 4 then 1 when node_id = 2 and tree_id % 3 = 0 then 1 "
             "when node_id = 3 and pos * 2 >= n then 1 else 0 end",
    "prob": "case when node_id = 1 then p / 10 when node_id = 2 and tree_id % 3 = 0 then (1 + p) / 2 "
            "when node_id = 3 then p when node_id = 4 then (1 + p) / 2 else cast(0 as double) end",
    "leaf_value": "case when node_id = 1 then p / 10 - 0.5 when node_id = 2 and tree_id % 3 = 0 then p / 2 "
                  "when node_id = 3 then p - 0.5 when node_id = 4 then p / 2 else cast(0 as double) end",
    "gain": "case when node_id = 0 then cast(n as double) when node_id = 2 and tree_id % 3 <> 0 then cast(pos as double) "
            "else cast(0 as double) end",
    "sum_h": "cast(n as double) / 4",
}
_TREE_TOTALS = {
    "n": "count(*)", "pos": "cast(sum(y) as bigint)",
    "t1": "floor(cast(sum(cast(floor(f1 * 100 + 0.5) as bigint)) as double) / (count(*) * 100))",
    "t0": "floor(cast(sum(cast(f0 as bigint)) as double) / count(*))",
}


def _nodes(spark: SparkSession, sf: str, key: str) -> DataFrame:
    per = (flows(spark, sf).groupBy(F.col(key).cast("bigint").alias("tree_id"))
           .agg(*[F.expr(e).cast("double" if a.startswith("t") else "bigint").alias(a) for a, e in _TREE_TOTALS.items()])
           .withColumn("p", F.col("pos").cast("double") / F.col("n").cast("double")))
    fanned = per.withColumn("node_id", F.explode(F.sequence(F.lit(0), F.lit(5))))
    kept = fanned.filter("node_id NOT IN (3, 4) OR tree_id % 3 <> 0")
    kinds = {"feature": "int", "left_id": "int", "right_id": "int", "value": "int"}
    return kept.select("tree_id", "node_id", *[
        F.expr(e).cast(kinds.get(a, "double")).alias(a) for a, e in _NODE.items()], "n")


def forest(spark: SparkSession, sf: str) -> DataFrame:
    """A small forest: one tree per line number."""
    return _nodes(spark, sf, "l_linenumber")


def grove(spark: SparkSession, sf: str) -> DataFrame:
    """A large one: one tree per part."""
    return _nodes(spark, sf, "l_partkey")


def _nodes_sql(key: str) -> str:
    totals = ", ".join(f"cast({e} as {'double' if a.startswith('t') else 'bigint'}) AS {a}" for a, e in _TREE_TOTALS.items())
    kinds = {"feature": "int", "left_id": "int", "right_id": "int", "value": "int"}
    attrs = ", ".join(f"cast({e} as {kinds.get(a, 'double')}) AS {a}" for a, e in _NODE.items())
    return (f"SELECT tree_id, node_id, {attrs}, n FROM (SELECT *, pos::DOUBLE / n::DOUBLE AS p FROM "
            f"(SELECT {key}::BIGINT AS tree_id, {totals} FROM flows GROUP BY {key})), "
            "(SELECT unnest(range(6))::INT AS node_id) WHERE node_id NOT IN (3, 4) OR tree_id % 3 <> 0")


# --- loss logs ----------------------------------------------------------------------

ROUNDS = 40


def losses(spark: SparkSession, sf: str) -> DataFrame:
    """One run per user and 40 rounds each: a falling trend with a plateau and noise from the events."""
    return (table(spark, sf, "events")
            .groupBy(F.col("user_id").alias("run"), (F.col("event_id") % ROUNDS + 1).cast("int").alias("round"))
            .agg(F.expr(_LOSS).alias("val_loss")))


_LOSS = ("cast(1 as double) / (event_id_round + 1) + floor(cast(sum(cast(floor(value * 100 + 0.5) as bigint)) as double) / count(*) / 100) / 200"
         ).replace("event_id_round", "least(max(event_id % 40), 15)")


SQL_VIEWS = {
    "flows": f"SELECT {', '.join(_IDS)}, {_KEY.format(s='varchar')} AS row_key, l_quantity AS f0, l_extendedprice AS f1, "
             f"l_discount AS f2, l_tax AS f3, cast(0 as double) AS f4, {_Y} AS y FROM lineitem",
    "dirty": f"SELECT {', '.join(_IDS)}, {_KEY.format(s='varchar')} AS row_key, l_returnflag, "
             + ", ".join(f"{_dirty_cell(src, 'varchar', m)} AS {c}" for c, (src, m) in _DIRTY.items())
             + f", {_DIRTY_LABEL} AS label, {_Y} AS y FROM lineitem",
    "dnum": "SELECT " + ", ".join(_IDS) + ", row_key, label, y, "
            + ", ".join(f"CASE WHEN regexp_matches(trim({c}), '{NUMBER_SQL}') THEN try_cast(trim({c}) AS DOUBLE) END AS {c}"
                        for c in INPUTS) + " FROM dirty",
    "ev": "SELECT event_id, user_id, event_type, value, event_id + 1 AS row_no, "
          "cast(case when event_type = 'error' then 1 else 0 end as int) AS y, cast(user_id % 8 as int) AS client FROM events",
    "scored": f"SELECT event_id, {_SCORED_Y} AS y, least(value / 100, cast(1 as double)) AS s, "
              "floor(least(value, cast(100 as double))) / cast(100 as double) AS s2, "
              + _SPLIT_CASE.format(h=_SPLIT.format(s="varchar")) + " AS split FROM events",
    "evn": f"SELECT event_id, event_type, value, {_EVN} FROM ev",
    "scoredn": f"SELECT event_id, s, {', '.join(_SCOREDN)} FROM scored",
    "vlongn": "SELECT vec_id, dim, v, nullif(label, 3) AS label FROM vlong",
    "multi": "SELECT vec_id, label, cast((label + vec_id % 3) % 10 as int) AS predicted FROM embeddings",
    "vlong": "SELECT vec_id, label, (unnest(range(len(embedding))))::INT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings",
    "forest": _nodes_sql("l_linenumber"),
    "grove": _nodes_sql("l_partkey"),
    "losses": f"SELECT user_id AS run, cast(event_id % {ROUNDS} + 1 as int) AS round, {_LOSS} AS val_loss FROM events "
              f"GROUP BY user_id, event_id % {ROUNDS}",
}
VIEW_NEEDS = {"evn": ("ev",), "scoredn": ("scored",), "vlongn": ("vlong",), "dnum": ("dirty",), "forest": ("flows",), "grove": ("flows",)}
