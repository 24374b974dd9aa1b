"""Feature adoption: user actions as features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import or_zero
from tallyspark.functions.stats import safe_corr

# Feature name -> (adoption flag, usage count).
FEATURES = {
    "View": ("reached_view", "n_views"),
    "Cart": ("reached_cart", "n_cart"),
    "Purchase": ("reached_purchase", "n_purchase"),
    "Repeat Purchase": ("reached_repeat", "n_orders"),
}


def adoption_table(users: DataFrame) -> DataFrame:
    """Per feature: adoption share, mean use among adopters, and the correlation of adoption with
    being retained and with lifetime value. One aggregation over the users."""
    retained = (F.col("is_churned") == 0).cast("int")
    entries = []
    for position, (feature, (adopted, used)) in enumerate(FEATURES.items(), 1):
        share = 100.0 * F.sum(adopted) / F.greatest(F.count("user_id"), F.lit(1))
        usage = F.avg(F.when(F.col(adopted) == 1, F.col(used)))
        entries.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(feature).alias("feature"),
                or_zero(F.round(share, 2)).alias("adoption_rate_pct"),
                or_zero(F.round(usage, 2)).alias("avg_usage_frequency"),
                F.round(safe_corr(F.col(adopted), retained), 3).alias("retention_correlation"),
                F.round(safe_corr(F.col(adopted), F.col("customer_lifetime_value")), 3).alias(
                    "revenue_correlation"
                ),
            )
        )
    return users.agg(F.array(*entries).alias("rows")).select(F.inline("rows"))


def feature_value_ranking(table: DataFrame) -> DataFrame:
    """Features by the mean of their two correlations, best first."""
    score = (F.col("retention_correlation") + F.col("revenue_correlation")) / 2
    best_first = Window.orderBy(F.col("value_score").desc(), "position")
    place = F.row_number().over(best_first)
    last = F.count("feature").over(Window.partitionBy())
    return (
        table.withColumn("value_score", score)
        .withColumn("value_rank", place)
        .withColumn(
            "standing",
            F.when(F.col("value_rank") == 1, "most_valuable")
            .when(F.col("value_rank") == last, "least_valuable")
            .otherwise("between"),
        )
        .drop("position")
        .orderBy("value_rank")
    )
