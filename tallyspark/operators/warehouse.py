"""Warehouse variants. They answer the same questions as the other operators but keep SQL's
conventions: no purchases means NULL revenue, a zero denominator means NULL, a session's user is
the lowest id, a product's labels are the highest values, results are wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import (
    days_between,
    flag,
    is_type,
    money_sum,
    or_zero,
    per_or_null,
    seconds_between,
)
from tallyspark.operators.cohort import cohort_activity
from tallyspark.operators.tables import CHURN_DAYS, product_facets, user_facets

def _bought() -> Column:
    return is_type("purchase")


def _n(kind: str) -> Column:
    return F.count_if(is_type(kind))


def _mean_price(condition: Column) -> Column:
    return money_sum(condition) / F.nullif(F.count_if(condition), F.lit(0))


def sql_active_users(days: DataFrame) -> DataFrame:
    """Distinct users per date. The view's two window columns compare a row's date with itself, so
    they equal the daily count; `rolling_active_users` has the trailing windows."""
    daily = days.groupBy("event_date").agg(F.count("user_id").alias("dau"))
    return daily.select(
        "event_date", "dau", F.col("dau").alias("wau_window"), F.col("dau").alias("mau_window")
    ).orderBy("event_date")


def _trailing(days: DataFrame, length: int, name: str) -> DataFrame:
    last = days.agg(F.max("event_date")).scalar()
    recent = days.filter(F.col("event_date") > F.date_sub(last, length))
    return recent.agg(F.countDistinct("user_id").alias(name))


def sql_dau(days: DataFrame) -> DataFrame:
    return _trailing(days, 1, "dau")


def sql_wau(days: DataFrame) -> DataFrame:
    return _trailing(days, 7, "wau")


def sql_mau(days: DataFrame) -> DataFrame:
    return _trailing(days, 30, "mau")


def sql_revenue_summary(events: DataFrame) -> DataFrame:
    totals = events.agg(
        money_sum(_bought()).alias("total_revenue"),
        _n("purchase").alias("total_orders"),
        F.countDistinct("user_id").alias("total_users"),
    )
    return totals.withColumn(
        "arpu", F.col("total_revenue") / F.nullif(F.col("total_users"), F.lit(0))
    )


def sql_user_value(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
        _n("purchase").alias("n_orders"),
        money_sum(_bought()).alias("customer_lifetime_value"),
        _mean_price(_bought()).alias("average_order_value"),
        F.countDistinct("user_session").alias("n_sessions"),
        flag(_n("purchase") >= 2).alias("is_repeat_purchaser"),
    )


def sql_session_metrics(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("user_session")
        .agg(
            F.min("user_id").alias("user_id"),
            F.min("event_time").alias("session_start"),
            F.max("event_time").alias("session_end"),
            F.count(F.lit(1)).alias("n_events"),
            _n("view").alias("n_views"),
            _n("cart").alias("n_cart"),
            _n("purchase").alias("n_purchase"),
            money_sum(_bought()).alias("revenue"),
        )
        .withColumns(
            {
                "session_duration_proxy": seconds_between(
                    F.col("session_start"), F.col("session_end")
                ),
                "cart_abandonment": flag((F.col("n_cart") > 0) & (F.col("n_purchase") == 0)),
                "converted": flag(F.col("n_purchase") > 0),
            }
        )
    )


def sql_session_rates(sessions: DataFrame) -> DataFrame:
    def rate(column: str) -> Column:
        return F.avg(column).cast("decimal(6,4)").cast("double")

    seconds = F.sum(F.col("session_duration_proxy").cast("decimal(28,6)")).cast("double")
    return sessions.agg(
        rate("cart_abandonment").alias("cart_abandonment_rate"),
        rate("converted").alias("session_conversion_rate"),
        (seconds / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("avg_session_seconds"),
    )


def sql_product_metrics(events: DataFrame) -> DataFrame:
    return product_facets(events).select(
        "product_id",
        F.col("highest_category").alias("category"),
        F.col("highest_brand").alias("brand"),
        "avg_price",
        "n_views",
        "n_cart",
        "n_purchase",
        "n_unique_users",
        F.col("spent").alias("revenue"),
        per_or_null(F.col("n_purchase"), F.col("n_views")).alias("view_to_purchase_rate"),
    )


def sql_top_brands(events: DataFrame, top: int = 20) -> DataFrame:
    brands = events.groupBy("brand").agg(
        money_sum(_bought()).alias("revenue"), _n("purchase").alias("orders")
    )
    return brands.orderBy(F.col("revenue").desc_nulls_last(), "brand").limit(top)


def sql_category_revenue(events: DataFrame) -> DataFrame:
    """Revenue per category; `buyers` counts every user seen in it, buying or not."""
    return (
        events.groupBy("category")
        .agg(money_sum(_bought()).alias("revenue"), F.countDistinct("user_id").alias("buyers"))
        .orderBy(F.col("revenue").desc_nulls_last(), "category")
    )


def sql_funnel(events: DataFrame) -> DataFrame:
    """One wide row: users per stage and the conversions between stages."""
    per_user = events.groupBy("user_id").agg(
        _n("view").alias("v"), _n("cart").alias("c"), _n("purchase").alias("p")
    )
    stages = per_user.agg(
        F.count_if(F.col("v") > 0).alias("users_view"),
        F.count_if(F.col("c") > 0).alias("users_cart"),
        F.count_if(F.col("p") >= 1).alias("users_purchase"),
        F.count_if(F.col("p") >= 2).alias("users_repeat"),
    )

    def step(to: str, start: str) -> Column:
        return F.round(100 * per_or_null(F.col(f"users_{to}"), F.col(f"users_{start}")), 2)

    return stages.withColumns(
        {
            "view_to_cart_pct": step("cart", "view"),
            "cart_to_purchase_pct": step("purchase", "cart"),
            "purchase_to_repeat_pct": step("repeat", "purchase"),
            "overall_conversion_pct": step("purchase", "view"),
        }
    )


def sql_monthly_cohorts(days: DataFrame) -> DataFrame:
    return (
        cohort_activity(days)
        .select(F.col("cohort").cast("timestamp").alias("cohort_month"), "month_number", "active_users")
        .orderBy("cohort_month", "month_number")
    )


def sql_day_n_retention(days: DataFrame) -> DataFrame:
    """One wide row of D1, D7, D30 and D90 retention."""
    age = F.datediff("event_date", F.min("event_date").over(Window.partitionBy("user_id")))
    counts = days.select(age.alias("age")).agg(
        F.count_if(F.col("age") == 0).alias("cohort_size"),
        *[F.count_if(F.col("age") == n).alias(f"n{n}") for n in (1, 7, 30, 90)],
    )
    size = F.col("cohort_size")
    return counts.select(
        "cohort_size",
        *[
            F.round(100 * per_or_null(F.col(f"n{n}"), size), 2).alias(f"d{n}_retention")
            for n in (1, 7, 30, 90)
        ],
    )


def sql_churn_features(events: DataFrame) -> DataFrame:
    latest = events.agg(F.max("event_time")).scalar()
    idle = days_between(F.col("last_seen"), F.col("latest"))
    return (
        user_facets(events)
        .withColumn("latest", latest)
        .select(
            "user_id",
            "total_events",
            "n_views",
            "n_cart",
            "n_purchase",
            "n_sessions",
            "n_products",
            "n_brands",
            "n_categories",
            or_zero(F.col("spent")).alias("customer_lifetime_value"),
            or_zero(F.col("spent") / F.nullif(F.col("n_purchase"), F.lit(0))).alias(
                "average_order_value"
            ),
            idle.alias("days_since_last_seen"),
            days_between(F.col("first_seen"), F.col("last_seen")).alias("lifespan_days"),
            per_or_null(F.col("n_cart"), F.col("n_views")).alias("view_to_cart_rate"),
            per_or_null(F.col("n_purchase"), F.col("n_cart")).alias("cart_to_purchase_rate"),
            flag(idle > CHURN_DAYS).alias("is_churned"),
        )
    )


def sql_churn_by_cohort(users: DataFrame) -> DataFrame:
    """Users and mean churn per first-seen month. The user table already holds both the label and
    the first-seen time, so no join with the events is needed."""
    return (
        users.groupBy(F.date_trunc("month", "first_seen").alias("cohort_month"))
        .agg(
            F.count(F.lit(1)).alias("users"),
            F.avg("is_churned").cast("decimal(6,4)").cast("double").alias("churn_rate"),
        )
        .orderBy("cohort_month")
    )
