"""Experiments: arm assignment, evaluation, and how many users a test needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import flag, or_zero
from tallyspark.functions.stats import normal_tail, z_value

ALPHA = 0.05
POWER = 0.8
PAGE_ARPU = 50.0

# Verdict texts.
SHIP = "Ship 🚀 — statistically significant positive lift."
DO_NOT_SHIP = "Do Not Ship ⛔ — treatment significantly underperforms control."
MORE_DATA = "Need More Data ⏳ — result is not statistically significant."


def ab_assign(users: DataFrame, experiments: tuple[str, ...]) -> DataFrame:
    """Each user's arm per experiment from a salted hash, stable across runs, with conversion to
    purchase as the outcome."""
    named = users.select(
        F.explode(F.array(*[F.lit(e) for e in experiments])).alias("experiment"),
        "user_id",
        F.col("reached_purchase").alias("converted"),
    )
    digest = F.md5(F.concat_ws(":", "experiment", "user_id"))
    odd = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 2 == 1
    return named.select(
        "experiment",
        "user_id",
        F.when(odd, "treatment").otherwise("control").alias("variant"),
        "converted",
    )


def ab_analyze(assignments: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row per experiment: rates, lift, pooled two-sided z-test, unpooled interval, verdict.
    An undefined p-value is not significant."""

    def arm(variant: str, name: str):
        mine = F.col("variant") == variant
        return [
            F.count_if(mine).alias(f"{name}_n"),
            F.sum(F.when(mine, F.col("converted")).otherwise(0)).alias(f"{name}_conversions"),
        ]

    counted = assignments.groupBy("experiment").agg(
        *arm("control", "control"), *arm("treatment", "treatment")
    )
    c_n, t_n = F.nullif(F.col("control_n"), F.lit(0)), F.nullif(F.col("treatment_n"), F.lit(0))
    # Each step is a column of its own: inlined, the rate formulas would be repeated at every use.
    rates = counted.withColumns(
        {
            "c": F.col("control_conversions") / c_n,
            "t": F.col("treatment_conversions") / t_n,
            "pooled": (F.col("control_conversions") + F.col("treatment_conversions"))
            / F.nullif(F.col("control_n") + F.col("treatment_n"), F.lit(0)),
        }
    )
    c, t, pooled = F.col("c"), F.col("t"), F.col("pooled")
    pooled_error = F.sqrt(pooled * (1 - pooled) * (1 / c_n + 1 / t_n))
    errors = rates.withColumns(
        {
            "diff": t - c,
            "z": F.abs(t - c) / F.nullif(pooled_error, F.lit(0.0)),
            "spread": F.sqrt(c * (1 - c) / c_n + t * (1 - t) / t_n)
            * F.lit(z_value(1 - alpha / 2)),
        }
    )
    tested = errors.withColumn("p", 2 * normal_tail(F.col("z")))
    p, diff, spread = F.col("p"), F.col("diff"), F.col("spread")
    significant = F.coalesce(p < alpha, F.lit(False))
    return tested.select(
        "experiment",
        "control_n",
        "treatment_n",
        F.round(c, 4).alias("control_rate"),
        F.round(t, 4).alias("treatment_rate"),
        F.round(diff, 4).alias("absolute_lift"),
        F.round(F.coalesce(100 * diff / F.nullif(c, F.lit(0.0)), F.lit(0.0)), 2).alias(
            "relative_lift_pct"
        ),
        F.round(p, 5).alias("p_value"),
        F.round(diff - spread, 4).alias("ci_low"),
        F.round(diff + spread, 4).alias("ci_high"),
        flag(significant).alias("significant"),
        F.when(significant & (diff > 0), SHIP)
        .when(significant & (diff < 0), DO_NOT_SHIP)
        .otherwise(MORE_DATA)
        .alias("recommendation"),
    )


def ab_confidence(results: DataFrame) -> DataFrame:
    return results.select(
        "experiment", "p_value", ((1 - F.col("p_value")) * 100).alias("confidence_pct")
    )


def ab_annual_impact(results: DataFrame, arpu: float = PAGE_ARPU) -> DataFrame:
    """Yearly revenue of the lift, over the users of both arms at the control's rate."""
    people = F.col("control_n") + F.col("treatment_n")
    gained = people * F.abs(F.col("relative_lift_pct") / 100) * F.col("control_rate")
    return results.select("experiment", (gained * arpu * 12).alias("annual_impact"))


def sample_size_plan(
    users: DataFrame, by: str, mde: float = 0.01, alpha: float = ALPHA, power: float = POWER
) -> DataFrame:
    """Per group: its conversion rate and the users per arm needed to detect an absolute lift of
    `mde` on it, against the users it has. Null where the rate leaves no room for the lift."""
    z = z_value(1 - alpha / 2) + z_value(power)
    rate = F.col("baseline_rate")
    middle = (rate + (rate + mde)) / 2
    variance = middle * (1 - middle)
    effect = F.when(variance > 0, ((rate + mde) - rate) / F.sqrt(variance))
    per_arm = F.ceil(2 * F.pow(F.lit(z) / effect, F.lit(2.0)))
    return (
        users.groupBy(F.col(by).alias("segment"))
        .agg(
            F.count("user_id").alias("users"),
            or_zero(F.avg("reached_purchase")).alias("baseline_rate"),
        )
        .withColumn("n_per_arm", per_arm)
        .withColumn("enough_users", flag(F.col("users") >= 2 * F.col("n_per_arm")))
    )
