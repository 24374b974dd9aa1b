"""Purchase funnel: stages, the largest leak, and what closing it could bring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Stage names, in funnel order, and the user flag behind each.
STAGES = {
    "View Product": "reached_view",
    "Add To Cart": "reached_cart",
    "Purchase": "reached_purchase",
    "Repeat Purchase": "reached_repeat",
}
RECOVERY_SHARE = 0.10


def funnel_stages(users: DataFrame) -> DataFrame:
    """Four rows. Stage flags are independent, so a stage can exceed the one before it and the
    drop-off can be negative. An empty previous stage counts as a full drop-off."""
    sums = users.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STAGES.values()])
    entries = [
        F.struct(F.lit(i).alias("stage_no"), F.lit(stage).alias("stage"), F.col(c).alias("users"))
        for i, (stage, c) in enumerate(STAGES.items(), 1)
    ]
    in_order = Window.orderBy("stage_no")
    people = F.col("users").cast("double")
    is_first = F.col("stage_no") == 1
    previous = F.when(is_first, people).otherwise(F.lag(people).over(in_order))
    from_previous = F.coalesce(100 * people / F.nullif(previous, F.lit(0.0)), F.lit(0.0))
    top = F.first(people).over(in_order)
    return sums.select(F.inline(F.array(*entries))).select(
        "stage_no",
        "stage",
        "users",
        F.round(from_previous, 2).alias("conversion_from_prev_pct"),
        F.round(100 * people / F.when(top == 0, 1.0).otherwise(top), 2).alias(
            "conversion_from_top_pct"
        ),
        F.round(F.when(is_first, 0.0).otherwise(100 - from_previous), 2).alias("dropoff_pct"),
    )


def _with_previous(stages: DataFrame) -> DataFrame:
    return stages.withColumn("previous_stage", F.lag("stage").over(Window.orderBy("stage_no")))


def funnel_summary(stages: DataFrame) -> DataFrame:
    """One row: the transition with the largest drop-off (the earlier one on a tie) and the
    overall conversion to purchase."""
    step = F.when(F.col("stage_no") > 1, F.struct(F.col("dropoff_pct"), -F.col("stage_no")))
    name = F.concat_ws(" → ", "previous_stage", "stage")
    return _with_previous(stages).agg(
        F.max_by(name, step).alias("largest_dropoff_stage"),
        F.max(F.when(F.col("stage_no") > 1, F.col("dropoff_pct"))).alias("largest_dropoff_pct"),
        F.max(F.when(F.col("stage_no") == 3, F.col("conversion_from_top_pct"))).alias(
            "overall_conversion"
        ),
    )


def funnel_impact(stages: DataFrame, summary: DataFrame, kpis: DataFrame) -> DataFrame:
    """One row: users lost at the largest leak, a tenth of them recovered, times ARPU. The loss is
    taken from the viewers whichever transition leaks."""
    viewers = stages.filter("stage_no = 1").select(F.col("users").alias("viewers"))
    lost = (F.col("viewers") * F.col("largest_dropoff_pct") / 100).cast("bigint")
    recoverable = (F.col("lost_users") * F.lit(RECOVERY_SHARE)).cast("bigint")
    return (
        summary.crossJoin(F.broadcast(viewers))
        .crossJoin(F.broadcast(kpis.select("arpu")))
        .withColumn("lost_users", lost)
        .withColumn("recoverable_users", recoverable)
        .select(
            "lost_users",
            "recoverable_users",
            (F.col("recoverable_users") * F.col("arpu")).alias("revenue_opportunity"),
            F.col("largest_dropoff_stage").alias("stage"),
            F.col("largest_dropoff_pct").alias("dropoff_pct"),
        )
    )


def funnel_stage_impact(stages: DataFrame, kpis: DataFrame) -> DataFrame:
    """Per transition losing more than 5%: lost users, recoverable revenue and severity."""
    top = F.first("users").over(Window.orderBy("stage_no"))
    drop = F.col("dropoff_pct")
    return (
        _with_previous(stages)
        .withColumn("top_users", top)
        .filter((F.col("stage_no") > 1) & (drop > 5))
        .crossJoin(F.broadcast(kpis.select("arpu")))
        .withColumn("lost_users", (F.col("top_users") * drop / 100).cast("bigint"))
        .select(
            "previous_stage",
            "stage",
            "dropoff_pct",
            "lost_users",
            (F.col("lost_users") * F.lit(RECOVERY_SHARE) * F.col("arpu"))
            .cast("bigint")
            .alias("recoverable_revenue"),
            F.when(drop > 40, "danger").when(drop > 20, "warning").otherwise("info").alias(
                "severity"
            ),
        )
    )
