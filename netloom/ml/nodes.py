"""A fitted forest as a table of nodes, and its predictions by descent over that table.

The table is what Spark's own model files hold: one row for each (tree, node). Scoring joins
rows with it level by level, so predictions can be followed, audited and repeated by any
engine that can join; they equal those of :meth:`FlowModel.predict` bit by bit, as votes are
added in the order of trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.ml.train import FlowModel
from netloom.session import fresh_path, materialize

#: Levels between two writes; a plan holds so many joins at most. A stage's joins become one method,
#: and the JVM never compiles one of more than 8,000 bytes of code (nine levels had 8,526).
LEVELS = 5


def forest_nodes(model: FlowModel, spark) -> DataFrame:
    """(tree, node, weight, feature, threshold, left, right, share) of a random forest.

    A node sends a row left if its scaled feature is at most ``threshold``; leaves point to
    themselves. ``share`` are the classes' shares of the training weight that met the node.
    """
    forest = model.pipeline.stages[-1]
    if not hasattr(forest, "treeWeights") or not hasattr(forest, "numClasses"):
        raise ValueError("only a forest of classification trees has a node table")
    path = fresh_path(spark, "forest")
    forest.write().save(path)
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(forest.treeWeights)], "tree int, weight double")
    n = F.col("nodeData")
    leaf, total = n["leftChild"] < 0, F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x)
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"),
        F.when(~leaf, F.element_at(F.array(*[F.lit(c) for c in model.features]), n["split"]["featureIndex"] + 1)).alias("feature"),
        F.when(~leaf, n["split"]["featureIndex"]).alias("place"),
        F.when(~leaf, n["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"),
        F.when(leaf, n["id"]).otherwise(n["leftChild"]).alias("left"),
        F.when(leaf, n["id"]).otherwise(n["rightChild"]).alias("right"),
        F.when(total == 0, n["impurityStats"]).otherwise(F.transform(n["impurityStats"], lambda x: x / total)).alias("share"),
    )
    return materialize(nodes.join(weights, "tree"), "forest-nodes")


def descend(rows: DataFrame, model: FlowModel, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tree, node): the leaf that each row reaches in each tree. ``keys`` name a row."""
    scaler = model.scaler
    scaled = [(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(scaler.columns, scaler.center, scaler.scale)]
    forest = model.pipeline.stages[-1]
    trees = F.sequence(F.lit(0), F.lit(len(forest.trees) - 1))
    state = rows.select(*keys, F.array(*scaled).alias("_z"), F.explode(trees).alias("tree"), F.lit(0).alias("node"))
    steps = nodes.select("tree", "node", "place", "threshold", "left", "right")
    for level in range(max(t.depth for t in forest.trees)):
        if level and level % LEVELS == 0:
            state = materialize(state, "descent")
        # A leaf has no place: the comparison is null and both children are itself.
        goes_left = F.element_at("_z", F.col("place") + 1) <= F.col("threshold")
        state = state.join(steps, ["tree", "node"]).select(
            *keys, "_z", "tree", F.when(goes_left, F.col("left")).otherwise(F.col("right")).alias("node")
        )
    return state.drop("_z")


def predict_by_nodes(rows: DataFrame, model: FlowModel, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``prediction`` and ``confidence`` of each row, from the node table alone."""
    votes = nodes.select("tree", "node", "weight", "share")
    found = descend(rows, model, nodes, keys).join(votes, ["tree", "node"])
    by_tree = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tree", "weight", "share"))).alias("votes"))
    classes = model.pipeline.stages[-1].numClasses

    def votes_for(k: int) -> Column:
        return F.aggregate("votes", F.lit(0.0), lambda acc, v: acc + v["share"][k] * v["weight"])

    out = by_tree.select(*keys, F.array(*[votes_for(k) for k in range(classes)]).alias("raw"))
    total = F.aggregate("raw", F.lit(0.0), lambda acc, x: acc + x)
    return out.select(
        *keys, (F.array_position("raw", F.array_max("raw")) - 1).cast("int").alias("prediction"),
        (F.array_max("raw") / total).alias("confidence"),
    )
