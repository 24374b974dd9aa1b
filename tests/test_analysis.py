import datetime as dt
import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.stats import normal_tail, pct_change, pearson, safe_corr
from tallyspark.operators import adoption, experiments, filters, funnel, rootcause, segments

FLAGS = "user_id long, reached_view int, reached_cart int, reached_purchase int, reached_repeat int"


def flag_users(spark, view, cart, purchase, repeat):
    n = max(view, cart, purchase, repeat, 1)
    return spark.createDataFrame(
        [(i, int(i < view), int(i < cart), int(i < purchase), int(i < repeat)) for i in range(n)], FLAGS
    )


def test_funnel_with_an_empty_stage(spark):
    stages = funnel.funnel_stages(flag_users(spark, 4, 0, 0, 0))
    got = [tuple(r)[2:] for r in stages.collect()]
    assert got == [(4, 100.0, 100.0, 0.0), (0, 0.0, 0.0, 100.0), (0, 0.0, 0.0, 100.0), (0, 0.0, 0.0, 100.0)]
    summary = funnel.funnel_summary(stages).first()
    assert summary["largest_dropoff_stage"] == "View Product → Add To Cart"  # the first of equals
    assert (summary["largest_dropoff_pct"], summary["overall_conversion"]) == (100.0, 0.0)


def test_funnel_growing_stage_has_negative_dropoff(spark):
    stages = funnel.funnel_stages(flag_users(spark, 2, 4, 1, 1))
    assert [r["dropoff_pct"] for r in stages.collect()] == [0.0, -100.0, 75.0, 0.0]


def test_funnel_impact_counts_viewers(spark):
    stages = funnel.funnel_stages(flag_users(spark, 100, 90, 30, 29))
    kpis = spark.createDataFrame([(12.5,)], "arpu double")
    row = funnel.funnel_impact(stages, funnel.funnel_summary(stages), kpis).first()
    assert (row["stage"], row["lost_users"], row["recoverable_users"]) == ("Add To Cart → Purchase", 66, 6)
    assert row["revenue_opportunity"] == 75.0
    steps = {r["stage"]: (r["lost_users"], r["recoverable_revenue"], r["severity"])
             for r in funnel.funnel_stage_impact(stages, kpis).collect()}
    assert steps == {"Add To Cart": (10, 12, "info"), "Purchase": (66, 82, "danger")}


SEG = ("user_id long, customer_lifetime_value double, purchase_frequency double, n_orders long, "
       "is_churned int, is_repeat_purchaser int, n_sessions long")


def test_segments_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        orders = rng.choice([0, 0, 1, 2, 5])
        rows.append((i, round(orders * rng.uniform(1, 90), 2), orders / rng.randint(1, 4), orders,
                     rng.randint(0, 1), int(orders >= 2), rng.randint(1, 9)))

    def q75(values):
        values = sorted(values)
        pos = 0.75 * (len(values) - 1)
        low = math.floor(pos)
        high = min(low + 1, len(values) - 1)
        return values[low] + (values[high] - values[low]) * (pos - low)

    clv, often = q75([r[1] for r in rows]), q75([r[2] for r in rows])

    def rule(r):
        if r[3] == 0:
            return "Window Shopper"
        if r[1] >= clv:
            return "At-Risk Customer" if r[4] else "High Value Customer"
        return "Power Buyer" if r[5] and r[2] >= often else "Casual Buyer"

    segmented = segments.assign_segments(spark.createDataFrame(rows, SEG))
    assert {r["user_id"]: r["segment"] for r in segmented.collect()} == {r[0]: rule(r) for r in rows}
    summary = segments.segment_summary(segmented).collect()
    assert sum(r["revenue_share_pct"] for r in summary) == pytest.approx(100, abs=1)
    assert [r["total_revenue"] for r in summary] == sorted((r["total_revenue"] for r in summary), reverse=True)


def test_segment_highlights_without_at_risk(spark):
    rows = [(1, 5.0, 1.0, 1, 0, 0, 1), (2, 0.0, 0.0, 0, 0, 0, 1)]
    summary = segments.segment_summary(segments.assign_segments(spark.createDataFrame(rows, SEG)))
    row = segments.segment_highlights(summary).first()
    assert (row["top_segment"], row["at_risk_users"], row["at_risk_revenue"]) == ("High Value Customer", 0, 0.0)


def test_constant_and_half_null_columns(spark):
    frame = spark.createDataFrame(
        [(1.0, 0.1, 1.0, 1), (2.0, 0.1, None, 2), (3.0, 0.1, 5.0, 4), (4.0, 0.1, None, 9)],
        "x double, c double, h double, y int",
    )
    row = frame.agg(
        safe_corr(F.col("c"), F.col("y")).alias("c"),
        pearson(F.col("c"), F.col("y")).alias("n"),
        pearson(F.col("h"), F.col("y")).alias("h"),
    ).first()
    assert row["c"] == 0.0 and row["n"] is None
    assert row["h"] == pytest.approx(1.0)  # rows 1 and 3 only
    drivers = rootcause.correlation_drivers(frame, "y").collect()
    assert [r["feature"] for r in drivers] == ["h", "x", "c"]  # undefined last
    assert rootcause.correlation_drivers(frame, "y", exclude=("h",)).count() == 2


def test_adoption_when_everyone_adopts(spark):
    frame = spark.createDataFrame(
        [(1, 1, 1, 0, 0, 3, 1, 0, 0, 0, 0.0), (2, 1, 0, 1, 1, 5, 0, 2, 2, 1, 40.0)],
        "user_id long, reached_view int, reached_cart int, reached_purchase int, reached_repeat int, "
        "n_views long, n_cart long, n_purchase long, n_orders long, is_churned int, "
        "customer_lifetime_value double",
    )
    table = {r["feature"]: r for r in adoption.adoption_table(frame).collect()}
    assert (table["View"]["adoption_rate_pct"], table["View"]["avg_usage_frequency"]) == (100.0, 4.0)
    assert (table["View"]["retention_correlation"], table["View"]["revenue_correlation"]) == (0.0, 0.0)
    assert (table["Purchase"]["retention_correlation"], table["Purchase"]["revenue_correlation"]) == (-1.0, 1.0)
    ranked = adoption.feature_value_ranking(adoption.adoption_table(frame)).collect()
    assert [r["standing"] for r in ranked] == ["most_valuable", "between", "between", "least_valuable"]
    assert ranked[0]["feature"] == "View"  # all score 0: the first one leads


def test_drops_skip_nulls_and_zero_previous(spark):
    series = spark.createDataFrame(
        [(1, 100.0), (2, None), (3, 75.0), (4, 72.0), (5, 0.0), (6, 10.0)], "p int, v double"
    )
    got = [(r["period"], r["change_pct"]) for r in rootcause.detect_drops(series, "p", "v", "m").collect()]
    assert got == [("3", -25.0), ("5", -100.0)]


def test_causes_are_ranked_with_stable_ties(spark):
    revenue = spark.createDataFrame(
        [(dt.date(2024, 1, 1), 100.0), (dt.date(2024, 1, 2), 50.0)], "date date, revenue double"
    )
    drivers = spark.createDataFrame([("a", -0.5), ("b", 0.25)], "feature string, correlation double")
    impact = spark.createDataFrame(
        [("toys", "2024-01", "2024-02", 10.0, 5.0, -50.0), ("new", "2024-01", "2024-02", 0.0, 5.0, None)],
        "segment string, prev_month string, last_month string, prev_revenue double, last_revenue double, change_pct double",
    )
    rows = rootcause.cause_severity(rootcause.rank_causes(revenue, drivers, impact)).collect()
    assert [r["cause"] for r in rows] == [
        "Revenue fell 50% on 2024-01-02",
        "'a' strongly correlates with churn (-0.50)",
        "Segment 'toys' revenue changed -50% MoM",
        "'b' strongly correlates with churn (+0.25)",
        "Segment 'new' revenue changed +nan% MoM",
    ]
    assert [r["severity"] for r in rows] == ["Medium", "Medium", "Medium", "Medium", "Low"]


def test_segment_impact_with_zero_previous(events_of, rows_of):
    events = events_of(
        [
            ("2024-01-01 00:00:00", "purchase", 1, 1, "a", 10.0, "x", "old.a"),
            ("2024-02-01 00:00:00", "purchase", 1, 1, "b", 10.0, "x", "both.a"),
            ("2024-04-01 00:00:00", "purchase", 1, 1, "c", 15.0, "x", "both.a"),
            ("2024-04-01 00:00:00", "purchase", 2, 1, "c", 5.0, "x", "new.a"),
            ("2024-05-01 00:00:00", "view", 2, 1, "d", 5.0, "x", "new.a"),
        ]
    )
    got = rows_of(rootcause.segment_impact(events), "segment")
    assert {k: v["change_pct"] for k, v in got.items()} == {"old": None, "both": 50.0, "new": None}
    assert {v["prev_month"] for v in got.values()} == {"2024-02"}
    wide = rootcause.segment_matrix(events)
    assert wide.columns == ["category", "2024-01", "2024-02", "2024-04"]


def arms(spark, control, treatment):
    rows = [("e", "control", int(i < control[1])) for i in range(control[0])]
    rows += [("e", "treatment", int(i < treatment[1])) for i in range(treatment[0])]
    return spark.createDataFrame(rows, "experiment string, variant string, converted int")


def test_normal_tail(spark):
    xs = [0.0, 0.5, 1.0, 1.96, 3.0, 5.0, 7.0]
    frame = spark.createDataFrame([(x,) for x in xs], "x double").select(normal_tail(F.col("x")))
    for x, (got,) in zip(xs, frame.collect()):
        assert got == pytest.approx(0.5 * math.erfc(x / math.sqrt(2)), abs=1e-15)


def test_large_lift_ships(spark):
    row = experiments.ab_analyze(arms(spark, (4000, 480), (4000, 640))).first()
    diff = 0.04
    pooled = 1120 / 8000
    z = diff / math.sqrt(pooled * (1 - pooled) * 2 / 4000)
    assert row["p_value"] == round(2 * (1 - NormalDist().cdf(z)), 5)
    assert row["recommendation"].startswith("Ship") and row["significant"] == 1
    assert (row["control_rate"], row["treatment_rate"], row["relative_lift_pct"]) == (0.12, 0.16, 33.33)
    spread = 1.959963984540054 * math.sqrt(0.12 * 0.88 / 4000 + 0.16 * 0.84 / 4000)
    assert (row["ci_low"], row["ci_high"]) == (round(diff - spread, 4), round(diff + spread, 4))


def test_degenerate_experiments(spark):
    none = experiments.ab_analyze(arms(spark, (50, 0), (50, 0))).first()
    assert none["p_value"] is None and none["significant"] == 0
    assert none["recommendation"].startswith("Need More Data")
    from_zero = experiments.ab_analyze(arms(spark, (500, 0), (500, 50))).first()
    assert from_zero["relative_lift_pct"] == 0.0 and from_zero["recommendation"].startswith("Ship")
    worse = experiments.ab_analyze(arms(spark, (2000, 400), (2000, 200))).first()
    assert worse["recommendation"].startswith("Do Not Ship")


def test_sample_size(spark):
    rows = [("a", i, int(i < 12)) for i in range(100)] + [("b", i, 1) for i in range(5)]
    users = spark.createDataFrame(rows, "seg string, user_id long, reached_purchase int")
    got = {r["segment"]: r for r in experiments.sample_size_plan(users, "seg").collect()}
    assert (got["a"]["baseline_rate"], got["a"]["n_per_arm"], got["a"]["enough_users"]) == (0.12, 17170, 0)
    assert got["b"]["n_per_arm"] is None


def test_filters(events_of):
    events = events_of(
        [
            ("2024-01-01 00:00:00", "view", 1, 1, "a", 1.0, "x", "toys.a"),
            ("2024-01-31 12:00:00", "view", 1, 2, "b", 1.0, "y", "toys.a"),
            ("2024-02-01 00:00:00", "view", 1, 3, "c", 1.0, "x", "food.a"),
        ]
    )

    def users(**kwargs):
        got = filters.filter_events(events, filters.Filters(**kwargs))
        return {r["user_id"] for r in got.collect()}

    assert users() == {1, 2, 3}
    assert users(start=dt.date(2024, 1, 31)) == {2, 3}
    assert users(end=dt.date(2024, 1, 31)) == {1, 2}
    assert users(categories=("toys",), brands=("x",)) == {1}
    options = [tuple(r) for r in filters.filter_options(events).collect()]
    assert options == [("brand", "x"), ("brand", "y"), ("category", "food"), ("category", "toys"),
                       ("max_date", "2024-02-01"), ("min_date", "2024-01-01")]


def test_pct_change(spark):
    frame = spark.createDataFrame([(5, 4), (5, 0), (5, None)], "a int, b int")
    assert [r[0] for r in frame.select(pct_change(F.col("a"), F.col("b"))).collect()] == [25.0, 0.0, 0.0]
