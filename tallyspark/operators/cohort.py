"""Acquisition cohorts and Day-N retention over the user-day rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_LIST = (1, 7, 30, 90)
# The retention benchmark of each Day-N card, in percent.
BENCHMARKS = {"D1": 40, "D7": 20, "D30": 10, "D90": 5}


def _per_user():
    return Window.partitionBy("user_id")


def cohort_activity(days: DataFrame) -> DataFrame:
    """Long form: active users per first month (a date) and months since. The first month comes
    from a per-user window over the user's distinct months, so users are not joined to events."""
    months = days.select("user_id", F.trunc("event_date", "month").alias("month")).distinct()
    since = (F.year("month") - F.year("cohort")) * 12 + F.month("month") - F.month("cohort")
    return (
        months.withColumn("cohort", F.min("month").over(_per_user()))
        .groupBy(F.col("cohort"), since.cast("bigint").alias("month_number"))
        .agg(F.count("user_id").alias("active_users"))
    )


def cohort_retention(days: DataFrame) -> DataFrame:
    """Long form of the cohort matrix: percent of the cohort active `month_number` months after
    its first month, one decimal. Months without activity have no row."""
    return retention_matrix(cohort_activity(days))


def retention_matrix(activity: DataFrame) -> DataFrame:
    """Percent of the cohort from the active users per cohort and month number."""
    size = F.max(F.when(F.col("month_number") == 0, F.col("active_users"))).over(
        Window.partitionBy("cohort")
    )
    return activity.select(
        F.date_format("cohort", "yyyy-MM").alias("cohort"),
        "month_number",
        F.round(100.0 * F.col("active_users") / size, 1).alias("retention_pct"),
    )


def cohort_matrix(days: DataFrame, months: list[int] | None = None) -> DataFrame:
    """Wide form for display: one column per month number. Without `months` the columns run to
    the largest month number, a single number fetched to name them."""
    return wide_matrix(cohort_retention(days), months)


def wide_matrix(long: DataFrame, months: list[int] | None = None) -> DataFrame:
    if months is None:
        last = long.agg(F.max("month_number")).first()[0]
        months = list(range((last or 0) + 1))
    return (
        long.groupBy("cohort").pivot("month_number", months).agg(F.first("retention_pct"))
    ).orderBy("cohort")


def cohort_sizes(days: DataFrame) -> DataFrame:
    first = days.groupBy("user_id").agg(F.min("event_date").alias("first_date"))
    return (
        first.groupBy(F.date_format("first_date", "yyyy-MM").alias("cohort"))
        .agg(F.count("user_id").alias("cohort_size"))
        .orderBy("cohort")
    )


def day_n_retention(days: DataFrame, day_list: tuple[int, ...] = DAY_LIST) -> DataFrame:
    """Users active exactly n days after their first day, as a share of all users."""
    age = F.datediff("event_date", F.min("event_date").over(_per_user()))
    counts = days.select(age.alias("age")).agg(
        F.count_if(F.col("age") == 0).alias("users"),
        *[F.count_if(F.col("age") == n).alias(f"d{n}") for n in day_list],
    )
    return retention_shares(counts, day_list)


def retention_shares(counts: DataFrame, day_list: tuple[int, ...]) -> DataFrame:
    """A row per day n from one row of `users` and counts `d<n>`."""

    def share(n: int):
        return 100.0 * F.col(f"d{n}") / F.nullif(F.col("users"), F.lit(0))

    entries = [
        F.struct(
            F.lit(f"D{n}").alias("day"),
            F.col(f"d{n}").alias("retained_users"),
            F.coalesce(F.round(share(n), 2), F.lit(0.0)).alias("retention_pct"),
        )
        for n in day_list
    ]
    return counts.select(F.inline(F.array(*entries)))


def cohort_summary(retention: DataFrame, day_n: DataFrame) -> DataFrame:
    """One row: D1 and D30 retention, its status, the mean of the matrix's second column (the
    smallest month number above 0 that any cohort has) and the cohort leading it (the earliest
    on a tie)."""
    later = retention.filter("month_number > 0")
    second = later.agg(F.min("month_number")).scalar()
    column = later.filter(F.col("month_number") == second)
    age_of_cohort = -F.unix_date(F.to_date(F.concat("cohort", F.lit("-01"))))
    leading = column.agg(
        (
            F.sum(F.col("retention_pct").cast("decimal(12,1)")).cast("double")
            / F.nullif(F.count("retention_pct"), F.lit(0))
        ).alias("avg_month1_retention"),
        F.max_by("cohort", F.struct(F.col("retention_pct"), age_of_cohort)).alias("best_cohort"),
        F.max("retention_pct").alias("best_cohort_retention"),
    )

    def on_day(day: str):
        return F.max(F.when(F.col("day") == day, F.col("retention_pct")))

    headline = day_n.agg(on_day("D1").alias("d1_retention"), on_day("D30").alias("d30_retention"))
    d30 = F.col("d30_retention")
    status = F.when(d30 >= 20, "Strong").when(d30 >= 10, "Stable").otherwise("Weak")
    return headline.withColumn("status", status).crossJoin(F.broadcast(leading))


def retention_benchmark(day_n: DataFrame) -> DataFrame:
    """Day-N retention against its benchmark."""
    known = F.create_map(*[x for k, v in BENCHMARKS.items() for x in (F.lit(k), F.lit(v))])
    bench = F.coalesce(known[F.col("day")], F.lit(10))
    return day_n.select(
        "day",
        "retained_users",
        "retention_pct",
        bench.alias("benchmark"),
        F.when(F.col("retention_pct") >= bench, "above").otherwise("below").alias("status"),
    )
