"""Fitted churn models taken apart: the logistic fit again by Newton's method, and trees as a table
of nodes that scores and importances can be derived from with joins and sums."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.churn import TARGET, Prepared
from tallyspark.plans.shared import new_path

INTERCEPT = "(intercept)"


# --- logistic regression ----------------------------------------------------------------------


def _scales(rows: DataFrame, names: list[str]) -> list[tuple[float, float]]:
    """Mean and sample deviation of each feature; one aggregate."""
    row = rows.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.avg, F.stddev_samp)]).first()
    return [(row[2 * i] or 0.0, row[2 * i + 1] or 0.0) for i in range(len(names))]


def _scaled(names: list[str], scales: list[tuple[float, float]]) -> list[Column]:
    """The inputs of the fit: 1, then each feature standardised (0 if it is constant)."""
    inputs = [(F.col(n) - mean) / spread if spread else F.lit(0.0) for n, (mean, spread) in zip(names, scales)]
    return [F.lit(1.0), *inputs]


def _dot(inputs: list[Column], weights) -> Column:
    total = F.lit(0.0)
    for x, b in zip(inputs, weights):
        total = total + x * F.lit(float(b))
    return total


def newton_logistic(prepared: Prepared, tolerance: float = 1e-11, most: int = 60) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """(intercept and coefficients, scales) of the weighted logistic regression that the churn models
    fit: standardised inputs, balanced weights, a penalty of strength 1 on the summed loss.

    Every step is one aggregate over the training rows: loss, gradient and the weighted Gram matrix
    of the inputs, (k + 1)(k + 2) / 2 sums that combine on the map side. What reaches the driver is
    one row, however many users there are. A step that does not lower the loss is halved."""
    names = prepared.names
    scales = _scales(prepared.train, names)
    size = len(names) + 1
    x = [f"x{i}" for i in range(size)]
    rows = prepared.train.select(
        *[c.alias(a) for a, c in zip(x, _scaled(names, scales))], F.col(TARGET).cast("double").alias("y"), F.col("balanced_weight").alias("w")
    )
    upper = [(i, j) for i in range(size) for j in range(i, size)]

    def state(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        # The weights come as a row and not as literals, so every step runs the same compiled plan.
        b = [f"b{i}" for i in range(size)]
        weights = rows.sparkSession.createDataFrame([tuple(map(float, beta))], ", ".join(f"{c} double" for c in b))
        z = sum((F.col(a) * F.col(c) for a, c in zip(x, b)), F.lit(0.0))
        at = rows.crossJoin(F.broadcast(weights)).withColumn("z", z).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
        at = at.withColumn("r", F.col("w") * (F.col("p") - F.col("y"))).withColumn("h", F.col("w") * F.col("p") * (1 - F.col("p")))
        loss = F.col("w") * (F.log1p(F.exp(-F.abs("z"))) + F.greatest(F.col("z"), F.lit(0.0)) - F.col("y") * F.col("z"))
        sums = at.agg(
            F.sum(loss), *[F.sum(F.col("r") * F.col(a)) for a in x], *[F.sum(F.col("h") * F.col(x[i]) * F.col(x[j])) for i, j in upper]
        ).first()
        penalised = np.array([0.0, *[1.0] * (size - 1)])
        gradient = np.array(sums[1 : 1 + size]) + penalised * beta
        gram = np.diag(penalised)
        for (i, j), value in zip(upper, sums[1 + size :]):
            gram[i, j] += value
            if i != j:
                gram[j, i] += value
        return sums[0] + (penalised * beta**2).sum() / 2, gradient, gram

    beta = np.zeros(size)
    loss, gradient, gram = state(beta)
    for _ in range(most):
        move = np.linalg.solve(gram, gradient)
        if np.abs(move).max() < tolerance:
            return beta - move, scales
        after = state(beta - move)
        while after[0] > loss + 1e-9 * abs(loss):
            move = move / 2
            after = state(beta - move)
        beta = beta - move
        loss, gradient, gram = after
    raise ValueError(f"the fit did not settle within {most} steps")


def fitted_coefficients(model: PipelineModel) -> np.ndarray:
    last = model.stages[-1]
    return np.array([last.intercept, *last.coefficients.toArray()])


def coefficient_table(spark: SparkSession, names: list[str], newton: np.ndarray, fitted: np.ndarray, tolerance: float = 1e-5) -> DataFrame:
    """One row per input: the coefficient by Newton's method, and whether the fitted model has the
    same within the tolerance (its own search stops on the loss, which is flat there)."""
    rows = [(n, float(a), bool(abs(a - b) <= tolerance)) for n, a, b in zip([INTERCEPT, *names], newton, fitted)]
    return spark.createDataFrame(rows, "feature string, coefficient double, agrees boolean")


def logistic_scores(rows: DataFrame, names: list[str], beta: np.ndarray, scales: list[tuple[float, float]]) -> DataFrame:
    """user_id, label, score by the given coefficients."""
    z = _dot(_scaled(names, scales), beta)
    return rows.select("user_id", F.col(TARGET).alias("label"), (1 / (1 + F.exp(-z))).alias("score"))


# --- trees ------------------------------------------------------------------------------------

NODES = (
    "tree int, node int, feature int, cut double, left_child int, right_child int, gain double, weight double, leaf_value double"
)


def tree_nodes(model: PipelineModel) -> DataFrame:
    """The nodes of a fitted ensemble, in a table (see `NODES`), read from where the model saves
    itself: bounded by trees and depth, whatever it was fitted on. `feature` is -1 in a leaf; `weight` is the training weight
    that reached a node; a leaf's value is its share of leavers (classification trees), or its
    prediction times the tree's weight (boosted trees)."""
    last = model.stages[-1]
    spark = SparkSession.getActiveSession()
    path = new_path(spark, "trees")
    last.write().save(path)
    node, stats = "nodeData", F.col("nodeData.impurityStats")
    boosted = _is_boosted(model)
    rate = F.element_at(F.array(*[F.lit(float(w)) for w in last.treeWeights]), F.col("treeID") + 1)
    shares = stats[1] / (stats[0] + stats[1])
    leaf = F.col(f"{node}.leftChild") < 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col(f"{node}.id").alias("node"),
        F.col(f"{node}.split.featureIndex").alias("feature"),
        F.when(~leaf, F.col(f"{node}.split.leftCategoriesOrThreshold")[0]).alias("cut"),
        F.col(f"{node}.leftChild").alias("left_child"),
        F.col(f"{node}.rightChild").alias("right_child"),
        F.col(f"{node}.gain").alias("gain"),
        (stats[0] if boosted else stats[0] + stats[1]).alias("weight"),
        F.when(leaf, F.col(f"{node}.prediction") * rate if boosted else shares).alias("leaf_value"),
    )


def _is_boosted(model: PipelineModel) -> bool:
    return type(model.stages[-1]).__name__.startswith("GBT")


def tree_scores(rows: DataFrame, names: list[str], nodes: DataFrame, boosted: bool) -> DataFrame:
    """user_id, score: every row walks down all trees at once, a level per join.

    The node table is broadcast (its size follows from trees and depth: some hundred trees of at most
    2 ** (depth + 1) nodes). A row's paths stay in its task, so the last sum is combined there and
    one row per user is shuffled."""
    split = nodes.filter("left_child >= 0").select("tree", "node", "feature", "cut", "left_child", "right_child")
    trees = nodes.select("tree").distinct()
    features = F.array(*[F.col(n) for n in names])
    paths = rows.select("user_id", features.alias("x")).crossJoin(F.broadcast(trees)).withColumn("node", F.lit(0))
    for _ in range(depth(nodes)):
        here = F.element_at("x", F.col("feature") + 1) <= F.col("cut")
        paths = paths.join(F.broadcast(split), ["tree", "node"], "left").select(
            "user_id", "x", "tree",
            F.when(F.col("feature").isNull(), F.col("node")).when(here, F.col("left_child")).otherwise(F.col("right_child")).alias("node"),
        )
    leaves = nodes.filter("left_child < 0").select("tree", "node", "leaf_value")
    summed = paths.join(F.broadcast(leaves), ["tree", "node"]).groupBy("user_id").agg(
        F.sum("leaf_value").alias("total"), F.count(F.lit(1)).alias("trees")
    )
    score = 1 / (1 + F.exp(-2 * F.col("total"))) if boosted else F.col("total") / F.col("trees")
    return summed.select("user_id", score.alias("score"))


def depth(nodes: DataFrame) -> int:
    """Levels below the roots. Children have larger numbers than their parents; a level a join."""
    here = nodes.filter("node = 0").select("tree", "left_child", "right_child")
    children = nodes.select("tree", F.col("node").alias("at"), F.col("left_child").alias("l"), F.col("right_child").alias("r"))
    levels = 0
    while True:
        here = here.filter("left_child >= 0").select("tree", F.explode(F.array("left_child", "right_child")).alias("at"))
        here = here.join(F.broadcast(children), ["tree", "at"]).select("tree", F.col("l").alias("left_child"), F.col("r").alias("right_child"))
        if not here.limit(1).count():
            return levels
        levels += 1


def tree_importance(nodes: DataFrame, names: list[str], boosted: bool) -> DataFrame:
    """feature, importance: gains times the weight they apply to, summed by feature; in a forest each
    tree counts the same. Shares of all."""
    per_tree = nodes.filter("left_child >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("gained"))
    totals = per_tree.groupBy("tree").agg(F.sum("gained").alias("total"))
    scaled = per_tree.join(F.broadcast(totals), "tree").select(
        "feature", (F.col("gained") if boosted else F.col("gained") / F.nullif("total", F.lit(0.0))).alias("gained")
    )
    found = scaled.groupBy("feature").agg(F.sum("gained").alias("gained"))
    everything = found.agg(F.sum("gained")).scalar()
    known = nodes.sparkSession.createDataFrame(list(enumerate(names)), "feature int, name string")
    return known.join(found, "feature", "left").select(
        F.col("name").alias("feature"), F.coalesce(F.col("gained") / everything, F.lit(0.0)).alias("importance")
    )


def score_agreement(scored: DataFrame, by_table: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """user_id, agrees: whether a model's score and the table's are the same, for every user of
    either."""
    other = by_table.select("user_id", F.col("score").alias("other"))
    return scored.select("user_id", "score").join(other, "user_id", "full").select(
        "user_id", F.coalesce(F.abs(F.col("score") - F.col("other")) <= tolerance, F.lit(False)).alias("agrees")
    )


def importance_agreement(fitted: DataFrame, by_table: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """feature, agrees: whether a model's importance equals the summed gains."""
    other = by_table.select("feature", F.col("importance").alias("other"))
    return fitted.select("feature", "importance").join(other, "feature", "full").select(
        "feature", F.coalesce(F.abs(F.col("importance") - F.col("other")) <= tolerance, F.lit(False)).alias("agrees")
    )
