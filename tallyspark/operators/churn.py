"""Churn: features, split, weights, models, and exact quality measures as DataFrames."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import exact_total, or_zero
from tallyspark.plans.ordered import running_totals, smallest_share
from tallyspark.plans.shared import allow_checkpoints, written

# Model inputs, label, split and model settings.
FEATURE_COLUMNS = [
    "total_events", "n_views", "n_cart", "n_purchase", "n_sessions",
    "n_products", "n_brands", "n_categories", "customer_lifetime_value",
    "average_order_value", "lifespan_days", "purchase_frequency",
    "view_to_cart_rate", "cart_to_purchase_rate", "avg_session_events",
]
TARGET = "is_churned"
TEST_SHARE = 0.25
SEED = 42
# Training rows per partition. Tree models draw their samples partition by partition, so the
# partitions must follow from the rows alone: never from cores, files or session settings. Boosting
# runs ten stages a round, so small partitions cost more in tasks and their results than in work.
ROWS_PER_PARTITION = 100_000
LOGISTIC, FOREST, BOOSTED = "Logistic Regression", "Random Forest", "Gradient Boosted Trees"
MODELS = (LOGISTIC, FOREST, BOOSTED)

# Recommended action per churn driver.
DEFAULT_ACTION = "Investigate this signal further and design targeted interventions."
DRIVER_ACTIONS = {
    "n_sessions": "Implement session-frequency nudges: push notifications, email cadence, and in-app prompts.",
    "n_purchase": "Drive repeat purchases with post-purchase lifecycle emails and loyalty incentives.",
    "purchase_frequency": "Create purchase-frequency triggers: replenishment reminders, subscription offers.",
    "n_views": "Increase engagement depth: personalised recommendations, curated content feeds.",
    "customer_lifetime_value": "Protect high-CLV users with concierge support and early churn intervention.",
    "lifespan_days": "Focus on early retention: improve Day-1 and Day-7 onboarding experiences.",
    "avg_session_events": "Deepen session engagement: guided workflows, progressive disclosure of features.",
    "view_to_cart_rate": "Improve product discovery: better search, recommendations, and social proof.",
    "cart_to_purchase_rate": "Reduce checkout friction: simplify forms, add payment options, cart recovery emails.",
    "n_cart": "Target cart abandoners with time-sensitive recovery campaigns.",
}


def feature_names(users: DataFrame) -> list[str]:
    return [c for c in FEATURE_COLUMNS if c in users.columns]


def _finite(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(or_zero(value))


def churn_feature_matrix(users: DataFrame) -> DataFrame:
    """User id, the model features present as finite doubles, and the label if present."""
    label = [F.col(TARGET).cast("int").alias(TARGET)] if TARGET in users.columns else []
    return users.select(
        "user_id", *[_finite(c).alias(c) for c in feature_names(users)], *label
    )


def stratified_split(
    labelled: DataFrame, share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add `is_test`: within each label, the ceil(share * n) users smallest by a seeded hash.
    Repeatable on any partitioning, unlike `randomSplit`."""
    hashed = labelled.withColumn("_digest", F.md5(F.concat_ws(":", F.lit(seed), "user_id")))
    return smallest_share(hashed, TARGET, "_digest", "user_id", share, "is_test").drop("_digest")


def class_weights(labelled: DataFrame) -> DataFrame:
    """Per label: rows, balanced weight n / (2 n_label), and the weight on positives that a
    boosted model takes instead (negatives per positive)."""
    counts = labelled.groupBy(F.col(TARGET).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    negatives = F.greatest(F.sum(F.when(F.col("label") == 0, F.col("n"))).over(everything), F.lit(1))
    positives = F.greatest(F.sum(F.when(F.col("label") == 1, F.col("n"))).over(everything), F.lit(1))
    return counts.select(
        "label",
        "n",
        (F.sum("n").over(everything) / (2 * F.col("n"))).alias("balanced_weight"),
        F.when(F.col("label") == 1, negatives / positives).otherwise(1.0).alias("boosted_weight"),
    )


# --- models ---------------------------------------------------------------------------------


def _assembler(names: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=names, outputCol=out)


def logistic_model(names: list[str], n_train: int) -> Pipeline:
    """Standardised inputs, L2 penalty of strength 1 on the summed loss, balanced weights."""
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    model = LogisticRegression(
        labelCol=TARGET, weightCol="balanced_weight", maxIter=1000, regParam=1.0 / n_train,
        elasticNetParam=0.0, standardization=False, tol=1e-12,
    )
    return Pipeline(stages=[_assembler(names, "raw"), scaler, model])


def forest_model(names: list[str], seed: int = SEED) -> Pipeline:
    model = RandomForestClassifier(
        labelCol=TARGET, weightCol="balanced_weight", numTrees=200, maxDepth=8,
        featureSubsetStrategy="sqrt", seed=seed,
    )
    return Pipeline(stages=[_assembler(names), model])


def boosted_model(names: list[str], seed: int = SEED, rounds: int = 300) -> Pipeline:
    """300 rounds of depth-5 trees, rate 0.05, nine tenths of the rows per tree and of the columns
    per node."""
    model = GBTClassifier(
        labelCol=TARGET, weightCol="boosted_weight", maxIter=rounds, maxDepth=5, stepSize=0.05,
        subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed,
    )
    return Pipeline(stages=[_assembler(names), model])


@dataclass
class Prepared:
    """Feature rows split into train (with weight columns) and test, read from written tables."""

    names: list[str]
    train: DataFrame
    test: DataFrame
    n_train: int


def train_partitions(n_train: int) -> int:
    return math.ceil(n_train / ROWS_PER_PARTITION)


def prepare(users: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> Prepared:
    """Split once and write it, so every model trains on the same rows without recomputing them.
    The training rows are dealt by user id into a number of partitions that depends on their count,
    and sorted there, so a seeded fit is the same on any cluster. A single class is an error."""
    rows = written(stratified_split(churn_feature_matrix(users), share, seed), "churn-rows")
    weights = class_weights(rows.filter("is_test = 0"))
    found = {r["label"]: r["n"] for r in weights.collect()}  # two rows at most
    if len(found) < 2:
        raise ValueError("churn label has a single class: both churned and active users are needed")
    n_train = sum(found.values())
    train = written(
        rows.filter("is_test = 0").join(
            F.broadcast(weights.withColumnRenamed("label", TARGET).drop("n")), TARGET
        ),
        "churn-train",
    )
    train = train.repartition(train_partitions(n_train), "user_id").sortWithinPartitions("user_id")
    return Prepared(feature_names(users), train, rows.filter("is_test = 1"), n_train)


def fit(prepared: Prepared, name: str, seed: int = SEED, rounds: int = 300) -> PipelineModel:
    builders = {
        LOGISTIC: lambda: logistic_model(prepared.names, prepared.n_train),
        FOREST: lambda: forest_model(prepared.names, seed),
        BOOSTED: lambda: boosted_model(prepared.names, seed, rounds),
    }
    # Hundreds of boosting rounds would otherwise grow one lineage.
    allow_checkpoints(prepared.train.sparkSession)
    return builders[name]().fit(prepared.train)


def with_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add `score`, the probability of churn."""
    scored = model.transform(rows)
    return scored.select(
        *rows.columns, vector_to_array("probability").getItem(1).alias("score")
    )


def feature_importance(spark: SparkSession, model: PipelineModel, names: list[str]) -> DataFrame:
    """Absolute coefficients of a linear model, or tree importances, largest first."""
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    rows = [(n, abs(float(v))) for n, v in zip(names, values.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def score_test(prepared: Prepared, model: PipelineModel) -> DataFrame:
    """(user_id, label, score) of the held-out users, written, since several measures read it."""
    scored = with_probability(model, prepared.test)
    return written(scored.select("user_id", F.col(TARGET).alias("label"), "score"), "churn-scored")


def compare(scored: dict[str, DataFrame]) -> DataFrame:
    """One row per model: its area under the curve, and whether it is the best (the first of equal
    ones). `scored` holds a handful of models."""
    parts = [
        auc(rows).select(F.lit(place).alias("place"), F.lit(name).alias("model"), "auc")
        for place, (name, rows) in enumerate(scored.items(), 1)
    ]
    best_first = Window.orderBy(F.col("auc").desc(), "place")
    ranked = reduce(DataFrame.unionByName, parts).withColumn(
        "is_best", (F.row_number().over(best_first) == 1).cast("int")
    )
    return ranked.select("model", "auc", "is_best")


@dataclass
class Evaluation:
    """What is reported of one model on the held-out users."""

    auc: DataFrame
    roc: DataFrame
    confusion: DataFrame
    report: DataFrame
    importance: DataFrame


def evaluate(scored: DataFrame, model: PipelineModel, names: list[str]) -> Evaluation:
    """All measures of a model from its scores; users from one half on count as predicted to leave."""
    confusion = confusion_matrix(scored)
    return Evaluation(
        auc(scored), roc_curve(scored), confusion, classification_report(confusion),
        feature_importance(scored.sparkSession, model, names),
    )


def best_model(results: DataFrame) -> str:
    return results.filter("is_best = 1").first()["model"]


@dataclass
class Training:
    """Fitted models, their scores on the held-out users, the comparison and each evaluation."""

    models: dict[str, PipelineModel]
    scored: dict[str, DataFrame]
    results: DataFrame
    names: list[str]
    evaluations: dict[str, Evaluation]

    @property
    def best(self) -> str:
        return best_model(self.results)


def train_compare(
    users: DataFrame,
    share: float = TEST_SHARE,
    seed: int = SEED,
    names: tuple[str, ...] = MODELS,
    rounds: int = 300,
) -> Training:
    """Fit every model on the same split and compare them on the held-out users."""
    prepared = prepare(users, share, seed)
    models = {name: fit(prepared, name, seed, rounds) for name in names}
    scored = {name: score_test(prepared, model) for name, model in models.items()}
    evaluations = {name: evaluate(scored[name], model, prepared.names) for name, model in models.items()}
    return Training(models, scored, compare(scored), prepared.names, evaluations)


def score_users(model: PipelineModel, users: DataFrame) -> DataFrame:
    """Every user's churn probability, highest first."""
    rows = churn_feature_matrix(users).drop(TARGET)
    return (
        with_probability(model, rows)
        .select("user_id", F.round("score", 4).alias("churn_probability"))
        .orderBy(F.col("churn_probability").desc(), "user_id")
    )


def top_risk_users(scores: DataFrame, users: DataFrame, n: int = 15) -> DataFrame:
    """The report of the n users most likely to leave, with their lifetime value. The n rows are
    broadcast, so the user table is scanned without a shuffle."""
    top = scores.orderBy(F.col("churn_probability").desc(), "user_id").limit(n)
    value = users.select("user_id", "customer_lifetime_value")
    return (
        value.join(F.broadcast(top), "user_id")
        .select("user_id", "churn_probability", "customer_lifetime_value")
        .orderBy(F.col("churn_probability").desc(), "user_id")
    )


# --- measures over (label, score) ------------------------------------------------------------


def _by_score(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score, with running totals from the top score."""
    counts = scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    return running_totals(counts, "score", ["pos", "neg"], descending=True)


def auc(scored: DataFrame) -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs ranked right, ties
    counting half. Works on distinct scores with range-sliced running totals, so no task sees all
    scores and no pairs are built."""
    higher_positives = F.col("pos_upto") - F.col("pos")
    won = (F.col("neg") * (2 * higher_positives + F.col("pos"))).cast("decimal(38,0)")
    pairs = F.max("pos_total").cast("double") * F.max("neg_total").cast("double")
    return _by_score(scored).agg(
        F.round(F.sum(won).cast("double") / 2 / F.nullif(pairs, F.lit(0.0)), 4).alias("auc")
    )


def roc_curve(scored: DataFrame) -> DataFrame:
    """One point per distinct score used as threshold, plus the origin."""
    points = _by_score(scored).select(
        F.col("score").alias("threshold"),
        (F.col("neg_upto") / F.nullif(F.col("neg_total"), F.lit(0))).alias("fpr"),
        (F.col("pos_upto") / F.nullif(F.col("pos_total"), F.lit(0))).alias("tpr"),
    )
    origin = scored.sparkSession.createDataFrame(
        [(None, 0.0, 0.0)], "threshold double, fpr double, tpr double"
    )
    return origin.unionByName(points)


def confusion_matrix(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Four (actual, predicted, n) rows."""
    predicted = (F.col("score") >= threshold).cast("int")
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    counted = scored.agg(
        *[
            F.count_if((F.col("label") == a) & (predicted == p)).alias(f"n{a}{p}")
            for a, p in cells
        ]
    )
    entries = [
        F.struct(
            F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"n{a}{p}").alias("n")
        )
        for a, p in cells
    ]
    return counted.select(F.inline(F.array(*entries)))


def classification_report(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class and as plain and weighted means, and the
    accuracy; 0 where a measure is undefined."""

    def n(actual: int, predicted: int) -> Column:
        hit = (F.col("actual") == actual) & (F.col("predicted") == predicted)
        return F.sum(F.when(hit, F.col("n")).otherwise(0)).cast("double")

    def ratio(a: Column, b: Column) -> Column:
        return or_zero(a / F.nullif(b, F.lit(0.0)))

    wide = confusion.agg(n(0, 0).alias("a"), n(0, 1).alias("b"), n(1, 0).alias("c"), n(1, 1).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    total = a + b + c + d
    sides = {"0": (a, c, b), "1": (d, b, c)}  # right, wrongly predicted, missed
    parts = {}
    for label, (right, extra, missed) in sides.items():
        precision, recall = ratio(right, right + extra), ratio(right, right + missed)
        parts[label] = (precision, recall, ratio(2 * precision * recall, precision + recall), right + missed)

    def row(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1_score"), support.cast("bigint").alias("support"),
        )

    accuracy = ratio(a + d, total)
    macro = [(x + y) / 2 for x, y in zip(parts["0"][:3], parts["1"][:3])]
    weighted = [
        ratio(x * parts["0"][3] + y * parts["1"][3], total)
        for x, y in zip(parts["0"][:3], parts["1"][:3])
    ]
    rows = [
        row("0", *parts["0"]),
        row("1", *parts["1"]),
        row("accuracy", accuracy, accuracy, accuracy, total),
        row("macro avg", *macro, total),
        row("weighted avg", *weighted, total),
    ]
    return wide.select(F.inline(F.array(*rows)))


# --- business reading ------------------------------------------------------------------------


def revenue_at_risk(users: DataFrame) -> DataFrame:
    """One row: churned users, the sum and the mean of their lifetime value."""
    gone = F.col("is_churned") == 1
    total = F.sum(F.when(gone, exact_total("customer_lifetime_value"))).cast("double")
    count = F.count_if(gone)
    return users.agg(
        count.alias("churned_users"),
        or_zero(total).alias("revenue_at_risk"),
        or_zero(total / F.nullif(count, F.lit(0))).alias("avg_churned_clv"),
    )


def churn_overview(users: DataFrame) -> DataFrame:
    """One row: churn rate, active users, their mean lifetime value, and the risk level."""
    active = F.col("is_churned") == 0
    value = F.sum(F.when(active, exact_total("customer_lifetime_value"))).cast("double")
    rate = 100 * F.avg("is_churned")
    level = F.when(rate >= 40, "High").when(rate >= 25, "Medium").otherwise("Low")
    return users.agg(
        rate.alias("churn_rate"),
        F.count_if(active).alias("active_users"),
        (value / F.nullif(F.count_if(active), F.lit(0))).alias("avg_active_clv"),
        level.alias("risk_level"),
    )


def driver_actions(drivers: DataFrame, risk: DataFrame, top: int = 3) -> DataFrame:
    """The strongest drivers with direction, revenue touched, and the action for each."""
    actions = F.create_map(
        *[x for k, v in DRIVER_ACTIONS.items() for x in (F.lit(k), F.lit(v))]
    )
    r = F.col("correlation")
    strongest = drivers.orderBy(F.abs("correlation").desc_nulls_last(), "feature").limit(top)
    return strongest.crossJoin(F.broadcast(risk.select("revenue_at_risk"))).select(
        "feature",
        "correlation",
        F.when(r > 0, "increases").otherwise("decreases").alias("direction"),
        (F.col("revenue_at_risk") * F.abs("correlation")).alias("revenue_impact"),
        F.coalesce(actions[F.col("feature")], F.lit(DEFAULT_ACTION)).alias("action"),
    )
