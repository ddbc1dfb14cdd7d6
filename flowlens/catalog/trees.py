"""Split search, tree growth, node-table scoring and inspection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import boosting as G, histograms as H, models as Z, network as N, trees as T
from ..plans.small import ensure_checkpoint_dir, spread, written
from . import views as V
from .registry import query, r, ratio

FEATS = V.INPUTS
_UNPIVOT = " UNION ALL ".join(f"SELECT {{node}} AS node, {i} AS feature, {f} AS v, {{cols}} FROM {{source}}" for i, f in enumerate(FEATS))


@query("gini", f"""
    a AS (SELECT l_linenumber, count(*) AS n, sum(y)::BIGINT AS pos FROM flows GROUP BY l_linenumber)
    SELECT l_linenumber, n, pos, {r('1.0::DOUBLE - (pos::DOUBLE / n) * (pos::DOUBLE / n) - (1.0::DOUBLE - pos::DOUBLE / n) * (1.0::DOUBLE - pos::DOUBLE / n)')} AS gini FROM a""",
       ("flows",))
def gini(spark, sf):
    return T.gini(V.flows(spark, sf), ["l_linenumber"], F.col("y"))


def cart_sql(source: str, node: str, tag: str = "", min_leaf: int = 1) -> str:
    """CTEs up to ``gn{tag}``: every split of every node with its gain."""
    long = _UNPIVOT.format(node=node, cols="y", source=source)
    d = "::DOUBLE"
    left = f"(1.0{d} - (lp{d} / ln{d}) * (lp{d} / ln{d}) - ((ln - lp){d} / ln{d}) * ((ln - lp){d} / ln{d}))"
    right = (f"(1.0{d} - ((p - lp){d} / (n - ln){d}) * ((p - lp){d} / (n - ln){d}) "
             f"- ((n - ln - p + lp){d} / (n - ln){d}) * ((n - ln - p + lp){d} / (n - ln){d}))")
    parent = f"(1.0{d} - (p{d} / n{d}) * (p{d} / n{d}) - (1.0{d} - p{d} / n{d}) * (1.0{d} - p{d} / n{d}))"
    return f"""
    lg{tag} AS ({long}),
    vl{tag} AS (SELECT node, feature, v, count(*) AS c, sum(y)::BIGINT AS s FROM lg{tag} GROUP BY node, feature, v),
    cu{tag} AS (SELECT node, feature, v, sum(c) OVER w AS ln, sum(s) OVER w AS lp, lead(v) OVER (PARTITION BY node, feature ORDER BY v) AS nv,
      sum(c) OVER (PARTITION BY node, feature) AS n, sum(s) OVER (PARTITION BY node, feature) AS p FROM vl{tag}
      WINDOW w AS (PARTITION BY node, feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
    gn{tag} AS (SELECT node, feature, v, nv, (v + nv) / 2.0{d} AS threshold, ln, lp, n, p,
      {parent} - (ln{d} / n{d} * {left} + (n - ln){d} / n{d} * {right}) AS gain FROM cu{tag}
      WHERE nv IS NOT NULL AND ln >= {min_leaf} AND n - ln >= {min_leaf})"""


def _stats():
    return {"n": F.lit(1).cast("bigint"), "pos": F.col("y").cast("bigint")}


def _root(df):
    return df.withColumn("node", F.lit(0))


@query("cart_split_scan", cart_sql("flows", "0", min_leaf=20) + f"""
    SELECT feature, {r('v')} AS below, {r('nv')} AS above, ln::BIGINT AS left_n, lp::BIGINT AS left_pos, {r('gain', 9)} AS gain FROM gn""",
       ("flows",), digits=9)
def cart_split_scan(spark, sf):
    df = _root(V.flows(spark, sf))
    gains = T.gini_gain(T.running_splits(df, "node", FEATS, T.split_edges(df, FEATS), _stats()), 20)
    return gains.select("feature", F.round("lo", 6).alias("below"), F.round("next_value", 6).alias("above"), F.col("cum_n").alias("left_n"),
                        F.col("cum_pos").alias("left_pos"), "gain")


@query("cart_best_split", cart_sql("flows", "l_linenumber", min_leaf=5) + f""",
    b AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, v) AS k FROM gn)
    SELECT node, feature, {r('threshold')} AS threshold, {r('gain')} AS gain, ln::BIGINT AS cum_n, lp::BIGINT AS cum_pos FROM b WHERE k = 1""",
       ("flows",))
def cart_best_split(spark, sf):
    df = V.flows(spark, sf).withColumnRenamed("l_linenumber", "node")
    splits = T.running_splits(df, "node", FEATS, T.split_edges(df, FEATS), _stats())
    return T.best_split(T.gini_gain(splits, 5), "node", ["cum_n", "cum_pos"])


def _depth2(source: str) -> str:
    return cart_sql(source, "0", "0") + f""",
    b0 AS (SELECT * FROM gn0 ORDER BY gain DESC, feature, v LIMIT 1),
    f1v AS (SELECT {source}.*, CASE WHEN (CASE b0.feature WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END) <= b0.threshold
            THEN 1 ELSE 2 END AS side FROM {source}, b0),
    """ + cart_sql("f1v", "side", "1").strip() + f""",
    k1 AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, v) AS k FROM gn1),
    pure AS (SELECT side, count(*) AS n, sum(y) AS p FROM f1v GROUP BY side),
    b1 AS (SELECT k1.* FROM k1 JOIN pure ON pure.side = k1.node WHERE k = 1 AND pure.p > 0 AND pure.p < pure.n)
    SELECT 0 AS slot, feature, {r('threshold')} AS threshold, {r('gain')} AS gain, n::BIGINT AS n, p::BIGINT AS pos FROM b0
    UNION ALL SELECT node, feature, {r('threshold')}, {r('gain')}, n::BIGINT, p::BIGINT FROM b1"""


def _tree_sql(source: str, depth: int, gains, sums: str, may_split: str, accept: str, leaf: str) -> str:
    """A whole tree, level by level: ``gains(rows, tag)`` scores the cuts of the open nodes, nodes are numbered by levels."""
    parts, x = [f"r0 AS (SELECT *, 0 AS node FROM {source})", "c0 AS (SELECT 1 AS c)"], "CASE s.feature WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END"
    for k in range(depth):
        parts += [gains(f"r{k}", str(k)).strip(),
                  f"t{k} AS (SELECT node, count(*) AS n, {sums} FROM r{k} GROUP BY node)",
                  f"b{k} AS (SELECT * FROM (SELECT gn{k}.*, row_number() OVER (PARTITION BY gn{k}.node ORDER BY gain DESC, feature, v) AS k FROM gn{k} "
                  f"JOIN t{k} ON t{k}.node = gn{k}.node AND {may_split.format(t=f't{k}')}) WHERE k = 1 AND {accept})",
                  f"s{k} AS (SELECT *, (SELECT c FROM c{k}) + 2 * (row_number() OVER (ORDER BY node) - 1) AS left_id FROM b{k})",
                  f"c{k + 1} AS (SELECT c + 2 * (SELECT count(*) FROM s{k}) AS c FROM c{k})",
                  f"r{k + 1} AS (SELECT r.* EXCLUDE (node), CASE WHEN {x} <= s.threshold THEN s.left_id ELSE s.left_id + 1 END AS node "
                  f"FROM r{k} r JOIN s{k} s ON s.node = r.node)"]
    parts.append(f"t{depth} AS (SELECT node, count(*) AS n, {sums} FROM r{depth} GROUP BY node)")
    rows = [f"SELECT t.*, s.feature, s.threshold, s.left_id, s.gain FROM t{k} t LEFT JOIN s{k} s ON s.node = t.node" for k in range(depth)]
    rows.append(f"SELECT t.*, NULL, NULL, NULL, NULL FROM t{depth} t")
    return ", ".join(parts) + f""", al AS ({" UNION ALL ".join(rows)})
    SELECT 0::BIGINT AS tree_id, node::INT AS node_id, coalesce(feature, -1)::INT AS feature, {r('coalesce(threshold, 0.0::DOUBLE)')} AS threshold,
    coalesce(left_id, -1)::INT AS left_id, coalesce(left_id + 1, -1)::INT AS right_id, {leaf}, {r('coalesce(gain, 0.0::DOUBLE)', 4)} AS gain, n::BIGINT AS n"""


_CART_LEAF = f"CASE WHEN pos * 2 >= n THEN 1 ELSE 0 END AS value, {r('pos::DOUBLE / n')} AS prob, {r('pos::DOUBLE / n')} AS leaf_value, 0.0::DOUBLE AS sum_h"


def _cart_tree_sql() -> str:
    return _tree_sql("flows", 4, lambda rows, tag: cart_sql(rows, "node", tag, 10), "sum(y) AS pos", "{t}.n >= 20 AND {t}.pos > 0 AND {t}.pos < {t}.n",
                     "gain IS NOT NULL", _CART_LEAF) + " FROM al"


def _splits_of(spark, tree):
    rows = [(v.node_id, v.feature, float(v.threshold), float(v.gain), v.n, int(v.stats["pos"]))
            for v in tree.nodes.values() if v.feature >= 0]
    return spark.createDataFrame(rows, "slot int, feature int, threshold double, gain double, n bigint, pos bigint")


@query("cart_depth2", _depth2("flows"), ("flows",))
def cart_depth2(spark, sf):
    return _splits_of(spark, T.cart_tree(V.flows(spark, sf), FEATS, "y", max_depth=2))


# A missing feature goes right: its rows are in a node's totals and in the right child.
@query("cart_depth2_missing", _depth2("dnum"), ("dnum",))
def cart_depth2_missing(spark, sf):
    return _splits_of(spark, T.cart_tree(V.dnum(spark, sf), FEATS, "y", max_depth=2))


@query("cart_best_split_missing", cart_sql("dnum", "l_linenumber", min_leaf=5) + f""",
    b AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, v) AS k FROM gn)
    SELECT node, feature, {r('threshold')} AS threshold, {r('gain')} AS gain, ln::BIGINT AS cum_n, lp::BIGINT AS cum_pos, n::BIGINT AS tot_n,
    p::BIGINT AS tot_pos FROM b WHERE k = 1""", ("dnum",))
def cart_best_split_missing(spark, sf):
    df = V.dnum(spark, sf).withColumnRenamed("l_linenumber", "node")
    splits = T.running_splits(df, "node", FEATS, T.split_edges(df, FEATS), _stats())
    return T.best_split(T.gini_gain(splits, 5), "node", ["cum_n", "cum_pos", "tot_n", "tot_pos"])


@query("cart_tree", _cart_tree_sql(), ("flows",))
def cart_tree(spark, sf):
    tree = T.cart_tree(V.flows(spark, sf), FEATS, "y", max_depth=4, min_split=20, min_leaf=10)
    return T.node_table(spark, [tree]).withColumn("gain", F.round("gain", 4))


@query("cart_tree_binned")
def cart_tree_binned(spark, sf):
    """The same job on bucket sums, the form for very many distinct values."""
    tree = T.cart_tree(V.flows(spark, sf), FEATS, "y", max_depth=4, min_split=20, min_leaf=10, binned=True)
    return T.node_table(spark, [tree])


@query("cart_forest")
def cart_forest(spark, sf):
    """Ten trees of depth 10 on balanced bootstraps of all rows."""
    return T.node_table(spark, H.forest(V.flows(spark, sf), FEATS, "y", ["row_key"], trees=10, max_depth=10))


# --- scoring ------------------------------------------------------------------------

_X = "(CASE {f} WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END)"
ROUTE = f"""
    st AS (SELECT fl.row_key, fl.y, fl.f0, fl.f1, fl.f2, fl.f3, rt.tree_id, rt.node_id, rt.feature, rt.threshold, rt.left_id, rt.right_id,
             rt.value, rt.prob, rt.leaf_value FROM {{source}} fl, forest rt WHERE rt.node_id = 0
      UNION ALL
      SELECT st.row_key, st.y, st.f0, st.f1, st.f2, st.f3, nx.tree_id, nx.node_id, nx.feature, nx.threshold, nx.left_id, nx.right_id,
             nx.value, nx.prob, nx.leaf_value FROM st JOIN forest nx ON nx.tree_id = st.tree_id AND st.feature >= 0
             AND nx.node_id = CASE WHEN {_X.format(f='st.feature')} <= st.threshold THEN st.left_id ELSE st.right_id END),
    lf AS (SELECT * FROM st WHERE feature < 0)"""
_FLOWS_ROUTE = ROUTE.format(source="flows")


@query("tree_route", _FLOWS_ROUTE + " SELECT tree_id, node_id, y, count(*) AS n FROM lf GROUP BY ALL", ("forest",))
def tree_route(spark, sf):
    df, nodes = V.flows(spark, sf), V.forest(spark, sf)
    return T.route(df, nodes, FEATS, ["row_key", "y"]).groupBy("tree_id", "node_id", "y").agg(F.count(F.lit(1)).alias("n"))


@query("tree_route_joined", _FLOWS_ROUTE + f" SELECT row_key, sum(value)::BIGINT AS votes, {r('sum(prob)')} AS prob_sum FROM lf GROUP BY row_key",
       ("forest",))
def tree_route_joined(spark, sf):
    """The join plan used for models too large to compile."""
    df, nodes = V.flows(spark, sf), V.forest(spark, sf)
    return (T.route_join(df, nodes, FEATS, ["row_key"]).groupBy("row_key")
            .agg(F.sum("value").alias("votes"), F.sum("prob").alias("prob_sum")))


@query("forest_soft_vote", _FLOWS_ROUTE + f""",
    s AS (SELECT row_key, avg(prob) AS score FROM lf GROUP BY row_key)
    SELECT row_key, {r('score')} AS score, CASE WHEN score >= 0.3 THEN 1 ELSE 0 END AS pred FROM s""", ("forest",))
def forest_soft_vote(spark, sf):
    df = T.soft_vote(V.flows(spark, sf), V.forest(spark, sf), FEATS)
    return df.select("row_key", "score", X.predict(F.col("score"), 0.3).alias("pred"))


@query("forest_majority_vote", _FLOWS_ROUTE + """
    SELECT row_key, CASE WHEN sum(value) > (SELECT count(DISTINCT tree_id) FROM forest) // 2 THEN 1 ELSE 0 END AS pred
    FROM lf GROUP BY row_key""", ("forest",))
def forest_majority_vote(spark, sf):
    return T.majority_vote(V.flows(spark, sf), V.forest(spark, sf), FEATS).select("row_key", "pred")


# Suppliers as inputs of the large forest.
_SUPPLIED = ("s_suppkey AS row_key, 0 AS y, cast(s_suppkey % 50 as double) AS f0, s_acctbal * 5 AS f1, cast(0 as double) AS f2, cast(0 as double) AS f3")


@query("grove_scores", f"sp AS (SELECT {_SUPPLIED} FROM supplier)," + ROUTE.format(source="sp").replace("forest", "grove") + f"""
    SELECT row_key, {r('avg(prob)')} AS score, {r('0.5::DOUBLE + 0.01::DOUBLE * sum(leaf_value)')} AS raw,
    CASE WHEN sum(value) > (SELECT count(DISTINCT tree_id) FROM grove) // 2 THEN 1 ELSE 0 END AS pred FROM lf GROUP BY row_key""", ("grove",))
def grove_scores(spark, sf):
    """All three votes of a forest of thousands of trees."""
    nodes = _stored_grove(spark, sf)
    df = V.table(spark, sf, "supplier").selectExpr(*[e.strip() for e in (
        "s_suppkey AS row_key", "cast(s_suppkey % 50 as double) AS f0", "s_acctbal * 5 AS f1", "cast(0 as double) AS f2", "cast(0 as double) AS f3")])
    # A small file is one split, and its rows would meet the whole forest in one task.
    df = T.boosted_score(T.soft_vote(spread(df), nodes, FEATS), nodes, FEATS, 0.5, 0.01)
    return T.majority_vote(df, nodes, FEATS).select("row_key", "score", "raw", "pred")


_BASE = "bs AS (SELECT ln(avg(y) / (1.0::DOUBLE - avg(y))) AS f0b FROM flows)"


@query("base_score", f"{_BASE} SELECT {r('f0b')} AS base_score FROM bs", ("flows",))
def base_score(spark, sf):
    return G.base_score(V.flows(spark, sf), F.col("y"))


@query("gbt_score", f"""{_FLOWS_ROUTE}, {_BASE},
    s AS (SELECT row_key, (SELECT f0b FROM bs) + 0.3::DOUBLE * sum(leaf_value) AS raw FROM lf GROUP BY row_key)
    SELECT row_key, {r('raw')} AS raw, {r('1.0::DOUBLE / (1.0::DOUBLE + exp(-raw))')} AS score,
    CASE WHEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-raw)) >= 0.25 THEN 1 ELSE 0 END AS pred FROM s""", ("forest",))
def gbt_score(spark, sf):
    df = V.flows(spark, sf)
    base = G.base_score(df, F.col("y")).first()["base_score"]
    raw = T.boosted_score(df, V.forest(spark, sf), FEATS, base, 0.3)
    out = raw.select("row_key", "raw", X.sigmoid(F.col("raw")).alias("score"))
    return out.withColumn("pred", X.predict(F.col("score"), 0.25))


# --- inspection ---------------------------------------------------------------------

def _importance_sql(amount: str) -> str:
    return f"""
    t AS (SELECT sum({amount})::DOUBLE AS t FROM grove WHERE feature >= 0),
    im AS (SELECT f.feature, {ratio(f'coalesce((SELECT sum({amount}) FROM grove g WHERE g.feature = f.feature), 0)', '(SELECT t FROM t)')} AS importance
           FROM (SELECT unnest(range(4))::INT AS feature) f)"""


@query("importance_split_count", _importance_sql("1") + f" SELECT feature, {r('importance')} AS importance FROM im", ("grove",))
def importance_split_count(spark, sf):
    return T.importance_split_count(V.grove(spark, sf), 4)


@query("importance_gain", _importance_sql("gain") + f" SELECT feature, {r('importance')} AS importance FROM im", ("grove",))
def importance_gain(spark, sf):
    return T.importance_gain(V.grove(spark, sf), 4)


@query("top_features", _importance_sql("gain") + f"""
    SELECT (row_number() OVER (ORDER BY importance DESC, feature))::INT AS rank, 'feat_' || feature::VARCHAR AS name,
    {r('importance')} AS importance FROM im WHERE true ORDER BY im.importance DESC, feature LIMIT 3""", ("grove",))
def top_features(spark, sf):
    return T.top_features(T.importance_gain(V.grove(spark, sf), 4), 3)


@query("node_kinds", """
    SELECT CASE WHEN feature < 0 AND leaf_value = 0 THEN 'empty' WHEN feature < 0 THEN 'real_leaf' ELSE 'split' END AS kind,
    count(*) AS n FROM grove GROUP BY 1""", ("grove",))
def node_kinds(spark, sf):
    return T.node_kinds(V.grove(spark, sf))


@query("tree_stats", """
    wk AS (SELECT tree_id, node_id, feature, left_id, right_id, 0 AS depth FROM grove WHERE node_id = 0
      UNION ALL SELECT n.tree_id, n.node_id, n.feature, n.left_id, n.right_id, wk.depth + 1 FROM wk JOIN grove n
      ON n.tree_id = wk.tree_id AND wk.feature >= 0 AND n.node_id IN (wk.left_id, wk.right_id)),
    a AS (SELECT tree_id, max(depth) AS depth, count(*) AS n_reachable FROM wk GROUP BY tree_id),
    b AS (SELECT tree_id, count(*) AS n_nodes, count(*) FILTER (feature < 0) AS n_leaves FROM grove GROUP BY tree_id)
    SELECT b.tree_id, n_nodes, n_leaves, a.depth::INT AS depth, n_reachable FROM b JOIN a ON a.tree_id = b.tree_id""", ("grove",))
def tree_stats(spark, sf):
    return T.tree_stats(_stored_grove(spark, sf))


def _stored_grove(spark, sf):
    """The model as a stored table: a walk reads it once per level."""
    ensure_checkpoint_dir(spark)
    return V.grove(spark, sf).checkpoint()


@query("leaf_soft_threshold", f"""
    SELECT tree_id, node_id, {r("CASE WHEN abs(leaf_value) <= 0.1 THEN 0.0::DOUBLE ELSE sign(leaf_value) * (abs(leaf_value) - 0.1::DOUBLE) END")} AS leaf_value
    FROM grove WHERE feature < 0""", ("grove",))
def leaf_soft_threshold(spark, sf):
    df = V.grove(spark, sf).filter("feature < 0")
    return df.select("tree_id", "node_id", (T.soft_threshold(F.col("leaf_value"), 0.1) + 0.0).alias("leaf_value"))


@query("leaf_replace", f"""
    l AS (SELECT tree_id, node_id, row_number() OVER (PARTITION BY tree_id ORDER BY node_id) AS k FROM grove WHERE feature < 0)
    SELECT g.tree_id, g.node_id, {r('CASE WHEN l.k IS NULL THEN g.leaf_value ELSE l.k / 10.0::DOUBLE - 0.05::DOUBLE END')} AS leaf_value
    FROM grove g LEFT JOIN l ON l.tree_id = g.tree_id AND l.node_id = g.node_id""", ("grove",))
def leaf_replace(spark, sf):
    nodes = V.grove(spark, sf)
    values = T.leaf_positions(nodes).select("tree_id", "leaf_no", (F.col("leaf_no") / 10.0).alias("new_value"))
    return T.replace_leaves(nodes, values, alpha=0.05).select("tree_id", "node_id", "leaf_value")


# --- second-order boosting -------------------------------------------------------------

# The first round's gradients at a positive rate cut to 1/1024ths: their sums are exact in doubles, in any order.
_PRIOR = ("pr AS (SELECT floor(avg(y) * 1024) / 1024.0::DOUBLE AS p0 FROM flows), "
          "gh AS (SELECT flows.*, p0 - y AS g, p0 * (1.0::DOUBLE - p0) AS h FROM flows, pr)")


def _prior(spark, sf):
    df = V.flows(spark, sf)
    rate = df.agg(F.floor(F.avg("y") * 1024) / 1024.0).first()[0]
    return df.withColumns({"g": F.lit(rate) - F.col("y"), "h": F.lit(rate * (1.0 - rate))})


@query("grad_hess", f"""
    z AS (SELECT event_id, y, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(6 * s - 3))) AS p FROM scored)
    SELECT event_id, {r('p - y')} AS g, {r('greatest(p * (1.0::DOUBLE - p), 1e-7)')} AS h FROM z""", ("scored",))
def grad_hess(spark, sf):
    return G.with_gradients(V.scored(spark, sf), F.col("y"), 6 * F.col("s") - 3).select("event_id", "g", "h")


def newton_sql(source: str, node: str, min_child: float = 1.0, tag: str = "") -> str:
    long = _UNPIVOT.format(node=node, cols="g, h", source=source)
    return f"""
    lg{tag} AS ({long}),
    vl{tag} AS (SELECT node, feature, v, sum(g) AS g, sum(h) AS h, count(*) AS c FROM lg{tag} GROUP BY node, feature, v),
    cu{tag} AS (SELECT node, feature, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(c) OVER w AS cl,
      lead(v) OVER (PARTITION BY node, feature ORDER BY v) AS nv,
      sum(g) OVER (PARTITION BY node, feature) AS gt, sum(h) OVER (PARTITION BY node, feature) AS ht FROM vl{tag}
      WINDOW w AS (PARTITION BY node, feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
    gn{tag} AS (SELECT node, feature, v, nv, (v + nv) / 2.0::DOUBLE AS threshold, cl,
      0.5::DOUBLE * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM cu{tag}
      WHERE nv IS NOT NULL AND hl >= {min_child} AND ht - hl >= {min_child})"""


def _newton_stats():
    return {"n": F.lit(1).cast("bigint"), "g": F.col("g"), "h": F.col("h")}


# The hessian limit lies between two reachable sums, so rounding noise cannot move a split across it.
@query("newton_split_scan", f"{_PRIOR}, {newton_sql('gh', '0', 5.013)}" + f"""
    SELECT feature, {r('v')} AS below, {r('nv')} AS above, cl::BIGINT AS left_n, {r('gain', 4)} AS gain FROM gn""", ("flows",))
def newton_split_scan(spark, sf):
    df = _root(_prior(spark, sf))
    splits = T.running_splits(df, "node", FEATS, T.split_edges(df, FEATS), _newton_stats())
    return T.newton_gain(splits, min_child=5.013).select(
        "feature", F.col("lo").alias("below"), F.col("next_value").alias("above"), F.col("cum_n").alias("left_n"), F.round("gain", 4).alias("gain"))


@query("newton_best_split", f"{_PRIOR}, {newton_sql('gh', 'l_linenumber', 5.013)}" + f""",
    b AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, v) AS k FROM gn)
    SELECT node, feature, {r('threshold')} AS threshold, {r('gain', 4)} AS gain, cl::BIGINT AS cum_n FROM b WHERE k = 1 AND gain > 0""",
       ("flows",))
def newton_best_split(spark, sf):
    df = _prior(spark, sf).withColumnRenamed("l_linenumber", "node")
    splits = T.running_splits(df, "node", FEATS, T.split_edges(df, FEATS), _newton_stats())
    best = T.best_split(T.newton_gain(splits, min_child=5.013).filter("gain > 0"), "node", ["cum_n"])
    return best.withColumn("gain", F.round("gain", 4))


@query("newton_leaf_weight", f"""{_PRIOR}
    SELECT l_linenumber, count(*) AS n, {r('-sum(g) / (sum(h) + 1)')} AS leaf_weight FROM gh GROUP BY l_linenumber""", ("flows",))
def newton_leaf_weight(spark, sf):
    return G.leaf_weight(_prior(spark, sf), ["l_linenumber"])


_NEWTON_LEAF = f"0 AS value, 0.0::DOUBLE AS prob, {r('-g / (h + 1)')} AS leaf_value, {r('h')} AS sum_h"


@query("newton_tree", f"{_PRIOR}, " + _tree_sql("gh", 3, lambda rows, tag: newton_sql(rows, "node", 5.013, tag), "sum(g) AS g, sum(h) AS h", "{t}.n >= 2", "gain > 0",
                                                _NEWTON_LEAF) + " FROM al", ("flows",))
def newton_tree(spark, sf):
    tree = G.newton_tree(_prior(spark, sf), FEATS, max_depth=3, min_child=5.013)
    return T.node_table(spark, [tree], newton_lambda=1.0).withColumn("gain", F.round("gain", 4))


def _keyed(spark, sf):
    return V.flows(spark, sf)


@query("gbt_train")
def gbt_train(spark, sf):
    model = H.boost(_keyed(spark, sf), FEATS, "y", ["row_key"], rounds=20, rate=0.1, max_depth=6)
    return model.round_log(spark).select("round", "train_loss")


@query("gbt_early_stopping")
def gbt_early_stopping(spark, sf):
    df = _keyed(spark, sf)
    hold = F.pmod(F.xxhash64("row_key"), F.lit(5)) == 0
    model = H.boost(df.filter(~hold), FEATS, "y", ["row_key"], rounds=60, rate=0.5, max_depth=3, valid=df.filter(hold), patience=3)
    return model.round_log(spark)


@query("early_stop_round", f"""
    ls AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round) AS k FROM losses),
    fd AS (SELECT run, 0::BIGINT AS k, 1e308::DOUBLE AS best, 0 AS best_round, 0 AS waited, 0 AS stopped, 0 AS seen
           FROM (SELECT DISTINCT run FROM losses)
      UNION ALL
      SELECT l.run, l.k,
        CASE WHEN fd.stopped = 0 AND l.val_loss < fd.best - 1e-7 THEN l.val_loss ELSE fd.best END,
        CASE WHEN fd.stopped = 0 AND l.val_loss < fd.best - 1e-7 THEN l.round ELSE fd.best_round END,
        CASE WHEN fd.stopped <> 0 THEN fd.waited WHEN l.val_loss < fd.best - 1e-7 THEN 0 ELSE fd.waited + 1 END,
        CASE WHEN fd.stopped = 0 AND NOT l.val_loss < fd.best - 1e-7 AND fd.waited + 1 >= 5 THEN l.round ELSE fd.stopped END,
        CASE WHEN fd.stopped = 0 THEN l.round ELSE fd.seen END
      FROM fd JOIN ls l ON l.run = fd.run AND l.k = fd.k + 1),
    z AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k DESC) AS back FROM fd)
    SELECT run, {r('best')} AS best_loss, best_round::INT AS best_round, seen::INT AS last_round,
    CASE WHEN stopped > 0 THEN 1 ELSE 0 END AS stopped_early FROM z WHERE back = 1""", ("losses",))
def early_stop_round(spark, sf):
    return G.early_stop(V.losses(spark, sf), "run", "round", "val_loss", patience=5)


# --- trained classifiers ------------------------------------------------------------------

def _split_flows(spark, sf):
    """The split rows, narrow and written once: a trainer reads them many times."""
    from ..operators import sample as S

    return written(S.split_stratified(V.flows(spark, sf), "y", ["row_key"], 0.2).select("split", "y", *FEATS), "split")


def _evaluated(scored):
    """Metrics per split. Every row is scored once: the area reads the scores several times."""
    from ..operators import metrics as M

    return M.evaluate(written(scored.select("split", "y", "score"), "scored"), F.col("y"), F.col("score"), ["split"])


@query("random_forest_train")
def random_forest_train(spark, sf):
    df = _split_flows(spark, sf)
    model = Z.forest_train(df.filter("split = 'train'"), FEATS, "y", trees=10, max_depth=5, min_leaf=20)
    return _evaluated(Z.score(model, df, FEATS))


@query("random_forest_nodes")
def random_forest_nodes(spark, sf):
    model = Z.forest_train(V.flows(spark, sf), FEATS, "y", trees=5, max_depth=4, min_leaf=20)
    return T.importance_split_count(Z.forest_nodes(model, spark), len(FEATS))


@query("mlp_train")
def mlp_train(spark, sf):
    from ..operators import scale as K

    df = _split_flows(spark, sf)
    scaled = K.transform(df, K.robust_fit(df.filter("split = 'train'"), FEATS))
    model = Z.perceptron_train(scaled.filter("split = 'train'"), FEATS, "y", hidden=(8,), epochs=20)
    return _evaluated(Z.score(model, scaled.select("split", "y", *FEATS), FEATS))


@query("net_train_balanced")
def net_train_balanced(spark, sf):
    """A net trained with balanced classes and a focal loss on all training rows, by gradient sums."""
    from ..operators import scale as K

    df = _split_flows(spark, sf)
    scaled = K.transform(df, K.robust_fit(df.filter("split = 'train'"), FEATS))
    layers, _ = N.train(scaled.filter("split = 'train'"), FEATS, "y", hidden=(8,), steps=40, rate=0.1, loss=N.Loss(gamma=1.0), weights="balanced")
    return _evaluated(N.score(scaled.select("split", "y", *FEATS), layers, FEATS))
