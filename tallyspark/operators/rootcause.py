"""Root cause: drops in a series, drivers of churn, segments that lost revenue, and a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.money import is_type, money_sum, or_zero
from tallyspark.functions.stats import pearson

DROP_THRESHOLD = -10.0
PAGE_THRESHOLD = -15.0


def detect_drops(
    series: DataFrame, period: str, value: str, metric: str, threshold: float = DROP_THRESHOLD
) -> DataFrame:
    """Points that fell by at least the threshold (percent) against the previous known point. A
    previous value of 0 has no percent change and is never flagged."""
    previous = F.lag(value).over(Window.orderBy(period))
    change = 100.0 * (F.col(value) / F.nullif(F.col("_before"), F.lit(0.0)) - 1)
    return (
        series.filter(F.col(value).isNotNull())
        .withColumn("_before", previous)
        .withColumn("_change", change)
        .filter(F.col("_change") <= threshold)
        .select(
            F.lit(metric).alias("metric"),
            F.col(period).cast("string").alias("period"),
            F.round("_change", 2).alias("change_pct"),
            F.lit("drop").alias("direction"),
        )
    )


def worst_drop(revenue_drops: DataFrame, retention_drops: DataFrame) -> DataFrame:
    """One row: drops per metric and the deepest of both (revenue first, then the earlier one, on
    a tie)."""
    both = revenue_drops.withColumn("place", F.lit(1)).unionByName(
        retention_drops.withColumn("place", F.lit(2))
    )
    depth = F.struct("change_pct", "place", "period")
    return both.agg(
        F.count_if(F.col("place") == 1).alias("revenue_drops"),
        F.count_if(F.col("place") == 2).alias("retention_drops"),
        F.count(F.lit(1)).alias("total_drops"),
        F.min_by("metric", depth).alias("worst_metric"),
        F.min_by("period", depth).alias("worst_period"),
        or_zero(F.min("change_pct")).alias("worst_change_pct"),
    )


def correlation_drivers(
    users: DataFrame, target: str = "is_churned", exclude: tuple[str, ...] = ()
) -> DataFrame:
    """Correlation of every numeric column with the target, strongest first, undefined last.

    The user id and the recency column the label is made from are numeric too and are included;
    `exclude` leaves columns out. The columns are unpivoted and aggregated by name: the shuffle
    holds one row per column and task, and the generated code does not grow with the columns."""
    numeric = [
        f.name
        for f in users.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name != target and f.name not in exclude
    ]
    if target not in users.columns or not numeric:
        return users.sparkSession.createDataFrame([], "feature string, correlation double")
    values = [F.col(name).cast("double").alias(name) for name in numeric]
    tall = users.select(F.col(target).cast("double").alias("_target"), *values).unpivot(
        "_target", numeric, "feature", "_value"
    )
    return (
        tall.groupBy("feature")
        .agg(pearson(F.col("_value"), F.col("_target")).alias("correlation"))
        .orderBy(F.abs("correlation").desc_nulls_last(), "feature")
    )


def segment_revenue(events: DataFrame, dimension: str = "category") -> DataFrame:
    """Purchase revenue per segment and month."""
    return (
        events.filter(is_type("purchase"))
        .groupBy(dimension, "event_month")
        .agg(money_sum().alias("revenue"))
    )


def segment_impact(events: DataFrame, dimension: str = "category") -> DataFrame:
    """Per segment: revenue of the last two months with purchases and the change between them
    (null when the earlier one is 0, or when there is no earlier month)."""
    monthly = segment_revenue(events, dimension)
    # The months of the calendar, newest first; one short array.
    months = monthly.agg(
        F.sort_array(F.collect_set("event_month"), asc=False).alias("months")
    ).select(
        F.get("months", F.lit(0)).alias("last_month"), F.get("months", F.lit(1)).alias("prev_month")
    )

    def of(month: str):
        hit = F.when(F.col("event_month") == F.col(month), F.col("revenue"))
        return or_zero(F.sum(hit)).alias(month.replace("month", "revenue"))

    change = F.col("last_revenue") - F.col("prev_revenue")
    return (
        monthly.crossJoin(F.broadcast(months))
        .groupBy(F.col(dimension).alias("segment"), "prev_month", "last_month")
        .agg(of("prev_month"), of("last_month"))
        .withColumn("change_pct", 100 * change / F.nullif(F.col("prev_revenue"), F.lit(0.0)))
    )


def segment_matrix(
    events: DataFrame, dimension: str = "category", months: list[str] | None = None
) -> DataFrame:
    """Wide form for display: one column per month, 0-filled. Without `months` the columns are the
    months with purchases, fetched to name them."""
    monthly = segment_revenue(events, dimension)
    return monthly.groupBy(dimension).pivot("event_month", months).agg(F.first("revenue")).fillna(0.0)


def _signed(value: Column, digits: int) -> Column:
    """A number with its sign, `+nan` where it is undefined."""
    return F.when(value.isNull(), "+nan").otherwise(F.format_string(f"%+.{digits}f", value))


def rank_causes(
    revenue: DataFrame, drivers: DataFrame, impact: DataFrame, top_n: int = 5
) -> DataFrame:
    """Revenue drops, the three strongest churn drivers and the two worst segments in one list,
    ordered by impact; ties keep the order of the sources."""
    drops = detect_drops(revenue, "date", "revenue", "revenue")
    fell = F.abs("change_pct")
    from_drops = drops.select(
        F.lit(1).alias("source"),
        F.col("period").alias("place"),
        F.concat(
            F.lit("Revenue fell "), F.rint(fell).cast("bigint"), F.lit("% on "), F.col("period")
        ).alias("cause"),
        fell.alias("impact"),
        F.lit("Day-over-day revenue trend anomaly.").alias("evidence"),
    )
    strength = F.abs("correlation")
    top_drivers = drivers.orderBy(strength.desc_nulls_last(), "feature").limit(3)
    from_drivers = top_drivers.select(
        F.lit(2).alias("source"),
        F.col("feature").alias("place"),
        F.concat(
            F.lit("'"), F.col("feature"), F.lit("' strongly correlates with churn ("),
            _signed(F.col("correlation"), 2), F.lit(")"),
        ).alias("cause"),
        (strength * 100).alias("impact"),
        F.lit("Pearson correlation with churn label.").alias("evidence"),
    )
    worst = impact.orderBy(F.col("change_pct").asc_nulls_last(), "segment").limit(2)
    moved = _signed(F.rint("change_pct"), 0)
    from_segments = worst.filter(F.col("prev_month").isNotNull()).select(
        F.lit(3).alias("source"),
        F.col("segment").alias("place"),
        F.concat(
            F.lit("Segment '"), F.col("segment"), F.lit("' revenue changed "), moved, F.lit("% MoM")
        ).alias("cause"),
        or_zero(F.abs("change_pct")).alias("impact"),
        F.lit("Month-over-month revenue by segment.").alias("evidence"),
    )
    strongest = [F.col("impact").desc_nulls_last(), F.col("source"), F.col("place")]
    kept = (
        from_drops.unionByName(from_drivers)
        .unionByName(from_segments)
        .orderBy(*strongest)
        .limit(top_n)
    )
    return kept.select(
        F.row_number().over(Window.orderBy(*strongest)).alias("rank"), "cause", "impact", "evidence"
    )


def cause_severity(causes: DataFrame) -> DataFrame:
    level = F.when(F.col("impact") > 50, "High").when(F.col("impact") > 20, "Medium")
    return causes.withColumn("severity", level.otherwise("Low"))
