import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import churn, models, segments
from tallyspark.plans.mart import mart
from tallyspark.plans.ordered import exact_quantile, exact_quantiles, running_totals

from conftest import SMALL


@pytest.fixture(scope="module")
def users(spark):
    return mart(spark, SMALL).users


def scored_rows(spark, seed=5, n=300):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "label int, score double")


def test_auc_and_roc_against_brute_force(spark):
    rows, frame = scored_rows(spark)
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert churn.auc(frame).first()["auc"] == round(won / len(pos) / len(neg), 4)
    curve = {r["threshold"]: (r["fpr"], r["tpr"]) for r in churn.roc_curve(frame).collect()}
    assert curve.pop(None) == (0.0, 0.0)
    for t, (fpr, tpr) in curve.items():
        assert fpr == sum(s >= t for s in neg) / len(neg)
        assert tpr == sum(s >= t for s in pos) / len(pos)


def test_running_totals_over_many_slices(spark):
    frame = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 7 % 1000).alias("k"), F.lit(1).alias("n"))
    got = running_totals(frame, "k", ["n"], descending=True).collect()
    assert all(r["n_upto"] == 1000 - r["k"] and r["n_total"] == 1000 for r in got)


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 9.0, None], list(map(float, range(101)))])
def test_exact_quantile(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None)
    pos = 0.75 * (len(known) - 1)
    low, high = math.floor(pos), math.ceil(pos)
    want = known[low] + (known[high] - known[low]) * (pos - low)
    assert exact_quantile(frame, "v", 0.75, "q").first()["q"] == want


def test_split_takes_the_smallest_hashes_of_each_label(spark):
    frame = spark.range(1, 401).select(F.col("id").alias("user_id"), (F.col("id") % 10 == 0).cast("int").alias("is_churned"))
    got = {r["user_id"]: r["is_test"] for r in churn.stratified_split(frame).collect()}
    for label in (0, 1):
        members = [i for i in range(1, 401) if int(i % 10 == 0) == label]
        members.sort(key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        quota = math.ceil(0.25 * len(members))
        assert {i for i in members if got[i]} == set(members[:quota])
    again = churn.stratified_split(frame.repartition(5)).collect()
    assert {r["user_id"]: r["is_test"] for r in again} == got


def test_report_with_a_class_never_predicted(spark):
    frame = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.3)], "label int, score double")
    report = {r["class"]: r for r in churn.classification_report(churn.confusion_matrix(frame)).collect()}
    assert (report["1"]["precision"], report["1"]["recall"], report["1"]["f1_score"]) == (0.0, 0.0, 0.0)
    assert report["0"]["recall"] == 1.0 and report["0"]["precision"] == 2 / 3
    assert report["accuracy"]["f1_score"] == 2 / 3


def test_features_replace_missing_and_infinite_values(spark):
    frame = spark.createDataFrame(
        [(1, float("inf"), None, 1), (2, 2.0, 3.0, 0)],
        "user_id long, average_order_value double, lifespan_days double, is_churned int",
    )
    rows = {r["user_id"]: tuple(r) for r in churn.churn_feature_matrix(frame).collect()}
    assert rows == {1: (1, 0.0, 0.0, 1), 2: (2, 2.0, 3.0, 0)}


def test_one_class_cannot_be_trained(users):
    with pytest.raises(ValueError, match="single class"):
        churn.prepare(users.withColumn("is_churned", F.lit(1)))


def test_models_train_and_compare(users):
    out = churn.train_compare(users, names=(churn.LOGISTIC, churn.BOOSTED), rounds=5)
    results = {r["model"]: r for r in out.results.collect()}
    assert set(results) == {churn.LOGISTIC, churn.BOOSTED} and out.best in results
    assert all(0.0 <= r["auc"] <= 1.0 for r in results.values())
    assert sum(r["is_best"] for r in results.values()) == 1
    spark = users.sparkSession
    for model in out.models.values():
        importance = churn.feature_importance(spark, model, out.names).collect()
        assert len(importance) == 15 and importance[0]["importance"] >= importance[-1]["importance"] >= 0
    scores = churn.score_users(out.models[churn.LOGISTIC], users)
    assert scores.count() == users.count()
    top = churn.top_risk_users(scores, users).collect()
    assert len(top) == 15
    assert [r["churn_probability"] for r in top] == sorted((r["churn_probability"] for r in top), reverse=True)


def test_fits_do_not_depend_on_partitions(users):
    spark, results = users.sparkSession, []
    for parts in (1, 3, 8):
        prepared = churn.prepare(users.repartition(parts))
        assert prepared.train.rdd.getNumPartitions() == -(-prepared.n_train // churn.ROWS_PER_PARTITION)
        found = []
        for name in (churn.FOREST, churn.BOOSTED):
            model = churn.fit(prepared, name, rounds=3)
            scored = churn.score_test(prepared, model)
            found.append(churn.auc(scored).first()["auc"])
            found += [tuple(r) for r in churn.feature_importance(spark, model, prepared.names).collect()]
        results.append(found)
    assert results[0] == results[1] == results[2]


def test_every_model_is_evaluated(users):
    out = churn.train_compare(users, names=(churn.LOGISTIC,), rounds=2)
    got = out.evaluations[churn.LOGISTIC]
    n_test = churn.prepare(users).test.count()
    assert got.confusion.agg({"n": "sum"}).first()[0] == n_test
    assert got.report.count() == 5 and got.importance.count() == 15
    assert got.roc.agg({"tpr": "max"}).first()[0] == 1.0 and 0 <= got.auc.first()["auc"] <= 1


def test_highest_risk_is_a_broadcast(users):
    scores = users.select("user_id", F.lit(0.5).alias("churn_probability"))
    plan = churn.top_risk_users(scores, users)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_risk_without_churned_users(users):
    active = users.withColumn("is_churned", F.lit(0))
    assert tuple(churn.revenue_at_risk(active).first()) == (0, 0.0, 0.0)
    assert churn.churn_overview(active).first()["risk_level"] == "Low"


def test_weights_balance_the_classes(users):
    rows = {r["label"]: r for r in churn.class_weights(users).collect()}
    assert rows[0]["n"] * rows[0]["balanced_weight"] == pytest.approx(rows[1]["n"] * rows[1]["balanced_weight"])
    assert rows[1]["boosted_weight"] == rows[0]["n"] / rows[1]["n"]


@pytest.fixture(scope="module")
def prepared(users):
    return churn.prepare(users)


def test_newton_equals_the_fitted_model(spark, prepared):
    beta, scales = models.newton_logistic(prepared)
    model = churn.fit(prepared, churn.LOGISTIC)
    table = models.coefficient_table(spark, prepared.names, beta, models.fitted_coefficients(model)).collect()
    assert len(table) == 16 and table[0]["feature"] == models.INTERCEPT and all(r["agrees"] for r in table)
    own = models.logistic_scores(prepared.test, prepared.names, beta, scales)
    agree = models.score_agreement(churn.score_test(prepared, model), own, 1e-5)
    assert [r["agrees"] for r in agree.collect()] == [True] * prepared.test.count()


def test_newton_with_a_constant_feature_and_a_separable_one(spark):
    rows = [(i, 1.0, float(i), int(i >= 50)) for i in range(100)]
    frame = spark.createDataFrame(rows, "user_id long, n_views double, n_cart double, is_churned int")
    ready = churn.prepare(frame)
    beta, scales = models.newton_logistic(ready)
    assert beta[1] == 0.0 and beta[2] > 1 and scales[0] == (1.0, 0.0)
    fitted = models.fitted_coefficients(churn.fit(ready, churn.LOGISTIC))
    assert max(abs(beta - fitted)) < 1e-5


@pytest.mark.parametrize("name", [churn.FOREST, churn.BOOSTED])
def test_node_tables_equal_the_models(spark, prepared, name):
    model = churn.fit(prepared, name, rounds=7)
    nodes = models.tree_nodes(model)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) == models.NODES
    trees = model.stages[-1].trees
    assert nodes.count() == sum(t.numNodes for t in trees) and models.depth(nodes) == max(t.depth for t in trees)
    boosted = name == churn.BOOSTED
    by_table = models.tree_scores(prepared.test, prepared.names, nodes, boosted)
    agree = models.score_agreement(churn.score_test(prepared, model), by_table)
    assert [r["agrees"] for r in agree.collect()] == [True] * prepared.test.count()
    summed = models.tree_importance(nodes, prepared.names, boosted)
    agree = models.importance_agreement(churn.feature_importance(spark, model, prepared.names), summed)
    assert [r["agrees"] for r in agree.collect()] == [True] * 15


def test_agreement_sees_differences(spark):
    one = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5)], "user_id long, score double")
    two = spark.createDataFrame([(1, 0.5), (2, 0.6), (4, 0.5)], "user_id long, score double")
    assert {tuple(r) for r in models.score_agreement(one, two).collect()} == {(1, True), (2, False), (3, False), (4, False)}


@pytest.mark.parametrize("buckets", [2, 7, 1 << 16])
def test_exact_quantiles_of_several_columns(spark, buckets):
    rng = random.Random(buckets)
    rows = [(rng.choice([None, rng.gauss(0, 1e9), 5.0, -1e308, 1e308]), float(i % 3), rng.randint(-9, 9), float("nan"), float(i)) for i in range(400)]
    rows += [(0.1 + 1e-15 * i, 1.0, 3, None, float("inf")) for i in range(50)]
    frame = spark.createDataFrame(rows, "a double, b double, c int, d double, e double").repartition(5)
    shares = {"a": 0.75, "b": 0.5, "c": 0.01, "d": 0.5, "e": 0.999}
    got = exact_quantiles(frame, shares, buckets)
    for i, (column, share) in enumerate(shares.items()):
        known = sorted(r[i] for r in rows if r[i] is not None and r[i] == r[i])
        at = (len(known) - 1) * share if known else 0
        low, high = (known[math.floor(at)], known[math.ceil(at)]) if known else (None, None)
        assert got[column] == (low if low == high else low + (high - low) * (at - math.floor(at)))


def test_segments_need_no_written_rows(spark, users):
    cuts = segments.segment_cuts(users)
    assert cuts == {c: exact_quantile(users, c, 0.75, "q").first()["q"] for c in segments.CUT_COLUMNS}
    plan = segments.assign_segments(users, cuts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_a_fit_has_few_tasks():
    """Ten stages a boosting round: 34 partitions at 674,955 rows were 100,000 tasks."""
    assert [churn.train_partitions(n) for n in (1, 20_000, 67_500, 674_955)] == [1, 1, 1, 7]
