import pytest

from pyspark.sql import functions as F

from tallyspark.operators import churn, clean, metrics, segments, tables, warehouse
from tallyspark.plans import shared

A, B, C = ("2024-01-01 10:00:00", "2024-01-01 10:05:00", "2024-01-02 09:00:00")


def test_session_less_events_are_one_session(events_of):
    events = events_of(
        [(B, "view", 1, 7, None), (A, "cart", 2, 9, None), (C, "view", 2, 3, None)]
    )
    row = tables.session_metrics(events).first()
    assert row["user_session"] == "no_session"
    assert row["user_id"] == 9  # user of the earliest event
    assert (row["n_events"], row["n_products"]) == (3, 2)
    assert (row["cart_abandonment"], row["converted"], row["revenue"]) == (1, 0, 0.0)
    assert row["session_duration_proxy"] == 23 * 3600
    assert warehouse.sql_session_metrics(events).first()["user_id"] == 3  # the lowest id there


def test_users_without_purchases(events_of, rows_of):
    events = events_of(
        [
            (A, "view", 1, 1, "a"),
            (A, "cart", 1, 2, "b"),
            (A, "purchase", 1, 3, "c", 20.0),
            (B, "purchase", 1, 3, "c", 25.0),
        ]
    )
    users = rows_of(tables.user_metrics(events), "user_id")
    assert (users[1]["customer_lifetime_value"], users[1]["average_order_value"]) == (0.0, 0.0)
    assert users[1]["last_purchase_time"] is None
    assert users[1]["days_since_last_purchase"] is None
    assert (users[2]["view_to_cart_rate"], users[2]["reached_view"]) == (1.0, 0)
    assert (users[3]["reached_view"], users[3]["reached_cart"], users[3]["reached_repeat"]) == (0, 0, 1)
    assert users[3]["cart_to_purchase_rate"] == 2.0  # no carts count as one
    assert (users[3]["customer_lifetime_value"], users[3]["average_order_value"]) == (45.0, 22.5)
    assert (users[3]["purchase_frequency"], users[3]["avg_session_events"]) == (2.0, 2.0)

    value = rows_of(warehouse.sql_user_value(events), "user_id")
    assert value[1]["customer_lifetime_value"] is None and value[1]["n_orders"] == 0
    features = rows_of(warehouse.sql_churn_features(events), "user_id")
    assert features[1]["customer_lifetime_value"] == 0.0
    assert features[2]["view_to_cart_rate"] is None


def test_churn_starts_after_thirty_days(users_of, rows_of):
    users = rows_of(
        users_of(
            [
                ("2024-03-01 00:00:00", "view", 1, 1, "a"),
                ("2024-01-31 00:00:00", "view", 1, 2, "b"),
                ("2024-01-30 23:59:59", "view", 1, 3, "c"),
            ]
        ),
        "user_id",
    )
    assert users[2]["days_since_last_seen"] == 30.0
    assert [users[u]["is_churned"] for u in (1, 2, 3)] == [0, 0, 1]


def test_equally_frequent_preferences_take_the_lowest(users_of):
    rows = [(A, "view", p, 1, "s", 1.0, b, c) for p, b, c in
            ((1, "zeta", "x.y"), (2, "beta", "x.y"), (3, "zeta", "a.b"), (4, "beta", "a.b"))]
    row = users_of(rows).first()
    assert (row["preferred_brand"], row["preferred_category"]) == ("beta", "a")
    assert (row["n_brands"], row["n_categories"], row["n_products"]) == (2, 2, 4)


def test_product_labels_first_or_highest(events_of):
    events = events_of(
        [
            (B, "view", 1, 1, "s", 10.0, "zeta", "z.z"),
            (A, "purchase", 1, 2, "s", 30.0, "mid", "m.m"),
        ]
    )
    row = tables.product_metrics(events).first()
    assert (row["brand"], row["category"]) == ("mid", "m")
    assert (row["avg_price"], row["revenue"], row["view_to_purchase_rate"]) == (20.0, 30.0, 1.0)
    row = warehouse.sql_product_metrics(events).first()
    assert (row["brand"], row["category"]) == ("zeta", "z")


def test_daily_activity(events_of):
    events = events_of(
        [(A, "view", 1, 1, "s"), (A, "view", 1, 2, "s"), (B, "purchase", 1, 2, "t", 5.0), (C, "view", 1, 1, "u")]
    )
    rows = [tuple(r)[1:] for r in tables.daily_activity(events).collect()]
    assert rows == [(2, 2, 3, 1, 5.0), (1, 1, 1, 0, 0.0)]


@pytest.mark.parametrize("share_of_one", [0.0, 0.5])
def test_a_hot_user_does_not_change_results(spark, events_of, share_of_one, rows_of):
    """User 1 holds half of all events; counts are checked against plain Python."""
    rows, n = [], 400
    for i in range(n):
        user = 1 if i < n * share_of_one else i % 7 + 2
        kind = ("view", "cart", "purchase")[i % 3]
        rows.append((f"2024-01-{i % 28 + 1:02d} 00:{i % 60:02d}:00", kind, i, user, f"s{i % 50}", 1.0 + i, f"b{i % 5}"))
    got = rows_of(tables.user_metrics(events_of(rows)), "user_id")
    for user in {r[3] for r in rows}:
        mine = [r for r in rows if r[3] == user]
        assert got[user]["total_events"] == len(mine)
        assert got[user]["n_sessions"] == len({r[4] for r in mine})
        assert got[user]["n_products"] == len({r[2] for r in mine})
        assert got[user]["customer_lifetime_value"] == sum(r[5] for r in mine if r[1] == "purchase")


def test_large_money_fits_everywhere(raw_of):
    rows = [(f"2019-10-{d:02d} 10:00:00 UTC", "purchase", 1, 7, f"s{d}", 1.2e10 + d, "acme", "toys.cars") for d in (1, 2, 3)]
    rows += [("2019-10-04 10:00:00 UTC", "view", 2, 8, "t", float("inf"), "b", "x.y"), ("2019-10-05 09:00:00 UTC", "purchase", 2, 9, "u", float("inf"), "b", "x.y")]
    events = clean.clean_events(raw_of(rows))
    users = tables.user_metrics(events)
    spent = {r["user_id"]: r["customer_lifetime_value"] for r in users.collect()}
    assert spent == {7: 3.6e10 + 6, 8: 0.0, 9: 0.0}
    assert {r["product_id"]: r["revenue"] for r in tables.product_metrics(events).collect()} == {1: 3.6e10 + 6, 2: 0.0}
    assert tables.session_metrics(events).agg({"revenue": "sum"}).first()[0] == 3.6e10 + 6
    assert tables.daily_activity(events).agg({"revenue": "sum"}).first()[0] == 3.6e10 + 6
    days = tables.user_days(events)
    assert metrics.executive_kpis(days, users).first()["total_revenue"] == 3.6e10 + 6
    assert segments.preference_breakdown(users).first()["revenue"] == 3.6e10 + 6
    assert segments.segment_summary(segments.assign_segments(users)).agg({"total_revenue": "max"}).first()[0] == 3.6e10 + 6
    gone = users.withColumn("is_churned", F.lit(1))
    assert churn.revenue_at_risk(gone).first()["revenue_at_risk"] == 3.6e10 + 6
    assert churn.churn_overview(users.withColumn("is_churned", F.lit(0))).first()["avg_active_clv"] > 1e10


def test_sessions_are_hash_aggregated(spark, events_of):
    rows = [
        ("0001-01-01 00:00:00", "view", 1, -(2**63), "a"), ("9999-12-31 23:59:59", "view", 1, 2**63 - 1, "a"),
        ("2024-01-01 00:00:00", "view", 1, 9, "b"), ("2024-01-01 00:00:00", "cart", 2, 7, "b"), ("2023-01-01 00:00:00", "cart", 2, 2**63 - 1, "b"),
        ("2024-01-01 00:00:00.000002", "view", 1, 1, "c"), ("2024-01-01 00:00:00.000001", "view", 3, 5, "c"), ("1969-01-01 00:00:00", "view", 3, -4, "d"),
        ("1970-01-01 00:00:00", "view", 3, -5, "d"),
    ]
    sessions = tables.session_metrics(events_of(rows))
    assert {r["user_session"]: r["user_id"] for r in sessions.select("user_session", "user_id").collect()} == {"a": -(2**63), "b": 2**63 - 1, "c": 5, "d": -4}
    events = shared.written(events_of(rows), "events")
    plan = tables.session_metrics(events)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_removing_what_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_folder", lambda _: str(tmp_path))
    spark.range(3).write.parquet(shared.new_path(spark, "rows"))
    assert list(tmp_path.iterdir()) != []
    shared.remove_written(spark)
    assert list(tmp_path.iterdir()) == []


def _some_events(events_of):
    rows = [
        (f"2024-01-{i % 28 + 1:02d} 00:{i % 60:02d}:00", ("view", "cart", "purchase", "remove_from_cart")[i * i % 4], i % 37, i % i_users + 1,
         f"s{i % 23}", 1.0 + i % 13, f"b{i % 5}", f"c{i % 3}.x")
        for i_users in (3, 11) for i in range(300)
    ]
    # Raw events as well, for nulls that cleaning would have filled.
    events = events_of(rows)
    return events.withColumn("brand", F.when(F.col("product_id") % 4 > 0, F.col("brand"))).withColumn(
        "product_id", F.when(F.col("user_id") != 2, F.col("product_id"))
    )


@pytest.mark.parametrize("build", [tables.user_facets, tables.product_facets, tables.session_metrics])
def test_hot_keys_are_spread_and_equal_the_others(events_of, build):
    """The same rows whether all keys are taken at once, some are spread, or all are."""
    events = _some_events(events_of)
    found = [sorted(map(str, build(events, hot).collect())) for hot in (10**6, 30, 0)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 8


@pytest.mark.parametrize("build", [tables.user_facets, tables.product_facets, tables.session_metrics])
def test_events_of_usual_keys_are_moved_once(spark, events_of, build):
    """One shuffle of events: no rows are multiplied by the number of facets, and what is summed before
    a shuffle is at most a count by key."""
    events = shared.written(_some_events(events_of), "events")
    plan = build(events, 10**6)._jdf.queryExecution().optimizedPlan().toString()
    usual = plan[: plan.index("LeftSemi")]
    assert "Expand" not in usual.split("LeftAnti")[0] and "RepartitionByExpression" in usual


def test_events_are_laid_out_before_columns_are_derived(events_of, raw_of):
    raw = raw_of([(A, "view", 1, 1, "s"), (B, "cart", 2, 1, "t")])
    laid = clean.clean_events(raw, to_write=True)
    assert sorted(map(str, laid.collect())) == sorted(map(str, clean.clean_events(raw).collect()))
    below = laid._jdf.queryExecution().optimizedPlan().toString().split("RebalancePartitions")[1]
    assert "substring_index" not in below


def test_preferences_of_many_users_taken_at_once_equal_spread_ones(spark):
    """More users than an aggregation keeps objects for, with nulls, ties and empty labels."""
    n = F.xxhash64("id")
    events = spark.range(20_000).select(
        (n % 700).alias("user_id"), F.timestamp_seconds(F.col("id")).alias("event_time"), F.lit("view").alias("event_type"),
        (F.col("id") % 90).alias("product_id"), (n % 11).cast("string").alias("user_session"), F.lit(1.5).alias("price"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("b"), (F.col("id") % 7).cast("string"))).alias("brand"),
        F.when(F.col("id") % 3 > 0, F.repeat(F.lit("c"), (F.col("id") % 4).cast("int"))).alias("category"),
    )
    found = [sorted(map(str, tables.user_facets(events, hot).collect())) for hot in (10**6, 0)]
    assert found[0] == found[1] and len(found[0]) > 1000


def test_events_are_shuffled_once_for_a_layout_by_month(spark, raw_of):
    """Copies over slots, months and prices: the rows of the plain de-duplication, in one exchange."""
    rows = [
        (f"2024-{i % 3 + 1:02d}-01 00:{i % 60:02d}:00", ("view", "cart", "bounce")[i % 7 % 3], i % 5, i % 4, None if i % 11 == 0 else f"s{i % 2}", float(i % 9))
        for i in range(2000)
    ]
    raw = raw_of(rows)
    laid = clean.clean_events(raw, to_write=True)
    found = sorted(map(str, laid.collect()))
    assert found == sorted(map(str, clean.clean_events(raw).collect())) and 100 < len(found) < 2000
    plan = laid._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert len([line for line in plan.splitlines() if "Exchange" in line]) == 1


@pytest.mark.parametrize("groups", [1, 3, 1 << 16])
def test_hot_keys_are_found_by_groups(spark, monkeypatch, groups):
    """Exact however keys fall into groups, null being a key; keys of other groups are never counted."""
    monkeypatch.setattr(tables, "KEY_GROUPS", groups)
    events = spark.range(1000).select(F.when(F.col("id") >= 40, F.floor(F.sqrt("id"))).alias("user_id"))
    counts = events.groupBy("user_id").count().collect()
    for most in (0, 40, 45, 10**6):
        found = [r["_hot"] for r in tables._hot_keys(events, "user_id", most).collect()]
        assert sorted(map(str, found)) == sorted(str(r["user_id"]) for r in counts if r["count"] > most)
