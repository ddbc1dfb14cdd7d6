"""MLlib trainers behind the forest and perceptron jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..plans.small import scratch_path, spread
from .sample import class_weights, resolve_max_features


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features").transform(df)


def forest_train(df: DataFrame, features: Sequence[str], y: str, trees: int = 10, max_depth: int = 10,
                 min_leaf: int = 1, max_features="sqrt", weights="balanced", seed: int = 42):
    """Bagged Gini trees with a feature subset per node; class weights as row weights."""
    ready = class_weights(df, y, weights, "_w") if weights is not None else df.withColumn("_w", F.lit(1.0))
    k = resolve_max_features(max_features, len(features))
    stage = RandomForestClassifier(
        featuresCol="_features", labelCol=y, weightCol="_w", numTrees=trees, maxDepth=max_depth,
        minInstancesPerNode=min_leaf, featureSubsetStrategy=str(k), seed=seed, maxBins=64)
    model = stage.fit(assemble(spread(ready.select(*features, F.col(y).cast("double").alias(y), "_w")), features))
    # A fitted forest carries its training summary, and with it the session, into every scoring task; the session cannot be
    # sent once a query of it was observed. The saved form has no summary.
    path = scratch_path(df.sparkSession, "forest")
    model.write().save(path)
    return RandomForestClassificationModel.load(path)


def score(model, df: DataFrame, features: Sequence[str], name: str = "score") -> DataFrame:
    """Probability of class 1 as a plain column."""
    out = model.transform(assemble(df, features))
    return (out.withColumn(name, vector_to_array("probability")[1])
            .drop("_features", "rawPrediction", "probability", "prediction"))


def forest_nodes(model, spark) -> DataFrame:
    """The fitted forest as a node table, read from its own saved form."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    raw = spark.read.parquet(f"{path}/data")
    n = F.col("nodeData")
    stats = n["impurityStats"]
    prob = F.when(stats[0] + stats[1] > 0, stats[1] / (stats[0] + stats[1])).otherwise(0.0)
    leaf = n["leftChild"] < 0
    return raw.select(
        F.col("treeID").cast("bigint").alias("tree_id"), n["id"].cast("int").alias("node_id"),
        F.when(leaf, -1).otherwise(n["split"]["featureIndex"]).cast("int").alias("feature"),
        F.when(leaf, 0.0).otherwise(n["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"),
        n["leftChild"].cast("int").alias("left_id"), n["rightChild"].cast("int").alias("right_id"),
        (prob >= 0.5).cast("int").alias("value"), prob.alias("prob"), prob.alias("leaf_value"),
        n["gain"].alias("gain"), n["rawCount"].cast("bigint").alias("n"), F.lit(0.0).alias("sum_h"))


def perceptron_train(df: DataFrame, features: Sequence[str], y: str, hidden: Sequence[int] = (16, 8),
                     epochs: int = 30, seed: int = 42):
    """Feed-forward classifier on scaled features."""
    stage = MultilayerPerceptronClassifier(
        featuresCol="_features", labelCol=y, layers=[len(features), *hidden, 2], maxIter=epochs, seed=seed)
    return stage.fit(assemble(spread(df.select(*features, F.col(y).cast("double").alias(y))), features))
