"""Value segmentation of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import exact_total, or_zero
from tallyspark.plans.ordered import exact_quantiles

TOP_QUARTILE = 0.75
TOP_PREFERENCES = 8
CUT_COLUMNS = ("customer_lifetime_value", "purchase_frequency")

# Segment names.
HIGH_VALUE = "High Value Customer"
POWER = "Power Buyer"
CASUAL = "Casual Buyer"
AT_RISK = "At-Risk Customer"
WINDOW_SHOPPER = "Window Shopper"


def segment_cuts(users: DataFrame) -> dict[str, float | None]:
    """The upper quartiles that segments are cut at, exact, over all given users; two counting passes
    over two columns."""
    return exact_quantiles(users, dict.fromkeys(CUT_COLUMNS, TOP_QUARTILE))


def assign_segments(users: DataFrame, cuts: dict[str, float | None] | None = None) -> DataFrame:
    """Add `segment`; the first matching rule wins. Without `cuts` those of the given users are
    taken. Users are neither shuffled nor written."""
    clv_cut, often_cut = (F.lit((cuts or segment_cuts(users))[c]).cast("double") for c in CUT_COLUMNS)
    valuable = F.col("customer_lifetime_value") >= clv_cut
    often = F.col("purchase_frequency") >= often_cut
    segment = (
        F.when(F.col("n_orders") < 1, WINDOW_SHOPPER)
        .when((F.col("is_churned") == 1) & valuable, AT_RISK)
        .when(valuable, HIGH_VALUE)
        .when((F.col("is_repeat_purchaser") == 1) & often, POWER)
        .otherwise(CASUAL)
    )
    return users.withColumn("segment", segment)


def segment_summary(segmented: DataFrame) -> DataFrame:
    """One row per segment, most revenue first."""
    clv = F.sum(exact_total("customer_lifetime_value")).cast("double")
    per_segment = segmented.groupBy("segment").agg(
        F.count("user_id").alias("users"),
        (clv / F.count("customer_lifetime_value")).alias("avg_clv"),
        clv.alias("total_revenue"),
        F.avg("n_orders").alias("avg_orders"),
        F.avg("n_sessions").alias("avg_sessions"),
        F.round(100 * F.avg("is_churned"), 2).alias("churn_rate"),
    )
    everyone = F.sum("total_revenue").over(Window.partitionBy())
    share = 100 * F.col("total_revenue") / F.when(everyone == 0, 1.0).otherwise(everyone)
    return per_segment.withColumn("revenue_share_pct", F.round(share, 2)).orderBy(
        F.col("total_revenue").desc(), "segment"
    )


def preference_breakdown(
    segmented: DataFrame, by: str = "preferred_category", top: int | None = None
) -> DataFrame:
    """Users and revenue per preferred category or brand, most revenue first."""
    out = (
        segmented.groupBy(by)
        .agg(
            F.count("user_id").alias("users"),
            F.sum(exact_total("customer_lifetime_value")).cast("double").alias("revenue"),
        )
        .orderBy(F.col("revenue").desc(), by)
    )
    return out.limit(top) if top else out


def segment_highlights(summary: DataFrame) -> DataFrame:
    """One row: the top segment and a tenth of its revenue as exposure, and the at-risk figures
    (0 without such a segment)."""

    def top(column: str):
        best = F.struct(F.col("total_revenue"), F.col("users"))
        return F.max_by(column, best).alias(f"top_{column}")

    def at_risk(column: str):
        return F.max(F.when(F.col("segment") == AT_RISK, F.col(column)))

    return summary.agg(
        top("segment"),
        top("users"),
        top("avg_clv"),
        top("total_revenue"),
        top("revenue_share_pct"),
        F.coalesce(at_risk("users"), F.lit(0)).alias("at_risk_users"),
        or_zero(at_risk("total_revenue")).alias("at_risk_revenue"),
        or_zero(at_risk("churn_rate")).alias("at_risk_churn"),
    ).withColumn("top_loss_exposure", F.col("top_total_revenue") * F.lit(0.1))
