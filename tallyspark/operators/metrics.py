"""Executive metrics over the user-day rollup (`user_days`) and the user table.

Series windows (`lag` over days, weeks or months) run on rows already aggregated to the calendar.
"Previous" always means the previous period that has data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import exact_total, flag, is_type, money_sum, or_zero
from tallyspark.functions.stats import pct_change

SPARK_POINTS = 20


def daily_active_trend(days: DataFrame) -> DataFrame:
    return (
        days.groupBy(F.col("event_date").alias("date"))
        .agg(F.count("user_id").alias("dau"))
        .orderBy("date")
    )


def monthly_active(days: DataFrame) -> DataFrame:
    month = F.date_format("event_date", "yyyy-MM").alias("event_month")
    return (
        days.select("user_id", month)
        .distinct()
        .groupBy("event_month")
        .agg(F.count("user_id").alias("active_users"))
    )


def monthly_growth_trend(days: DataFrame) -> DataFrame:
    previous = F.lag("active_users").over(Window.orderBy("event_month"))
    growth = 100.0 * (F.col("active_users") - previous) / previous
    return monthly_active(days).withColumn("growth_pct", growth).orderBy("event_month")


def revenue_trend(events: DataFrame) -> DataFrame:
    """Purchase revenue per date; dates without purchases have no row."""
    return (
        events.filter(is_type("purchase"))
        .groupBy(F.col("event_date").alias("date"))
        .agg(money_sum().alias("revenue"))
        .orderBy("date")
    )


def retention_trend(days: DataFrame) -> DataFrame:
    """Per Monday-to-Sunday week: the share of the previous present week's users seen again.

    Each user's weeks are paired with the user's previous week in one per-user window. A user was
    retained when that previous week is the previous present week, which is the latest it can be.
    """
    weeks = days.select("user_id", F.trunc("event_date", "week").alias("monday")).distinct()
    last_week = F.lag("monday").over(Window.partitionBy("user_id").orderBy("monday"))
    pairs = (
        weeks.withColumn("came_from", last_week)
        .groupBy("monday", "came_from")
        .agg(F.count("user_id").alias("n"))
    )
    return retention_of_pairs(pairs)


def retention_of_pairs(pairs: DataFrame) -> DataFrame:
    """Weekly retention from users per week and the week they came from."""
    in_order = Window.orderBy("monday")
    per_week = pairs.groupBy("monday").agg(
        F.sum("n").alias("users"), F.max(F.struct("came_from", "n")).alias("latest")
    )
    before = F.lag("monday").over(in_order)
    users_before = F.lag("users").over(in_order)
    returned = F.when(F.col("latest.came_from") == before, F.col("latest.n")).otherwise(0)
    label = F.concat_ws("/", F.col("monday"), F.date_add("monday", 6))
    return per_week.select(
        label.alias("week"), (100.0 * returned / users_before).alias("retention_pct")
    ).orderBy("week")


def churn_trend(retention: DataFrame) -> DataFrame:
    return retention.select("week", (100 - F.col("retention_pct")).alias("churn_pct"))


def retention_churn_join(retention: DataFrame, churn: DataFrame) -> DataFrame:
    return retention.join(churn, "week")


def _latest_date(days: DataFrame) -> DataFrame:
    return days.agg(F.max("event_date"))


def window_active(days: DataFrame, length: int, end: dt.date | None = None) -> DataFrame:
    """Distinct users in the `length` days up to and including `end` (default: the latest date).
    The latest date is a scalar subquery, resolved before the scan and pushed into it."""
    last = F.lit(end) if end is not None else _latest_date(days).scalar()
    inside = F.col("event_date").between(F.date_sub(last, length - 1), last)
    return days.filter(inside).agg(F.countDistinct("user_id").alias("active_users"))


def _in_window(ends_back: int, length: int, last: Column) -> Column:
    """Whether a date lies in the `length` days that end `ends_back` days before `last`."""
    age = F.datediff(last, F.col("event_date"))
    return (age >= ends_back) & (age < ends_back + length)


def window_counts(days: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """One row of distinct users per (ends_back, length) window. One pass over the dates that any
    window covers, one shuffle by user, whatever the number of windows."""
    last = _latest_date(days).scalar()
    reach = max(back + length for back, length in windows.values())
    recent = days.filter(F.col("event_date") > F.date_sub(last, reach))
    flags = recent.groupBy("user_id").agg(
        *[F.max(flag(_in_window(*w, last))).alias(name) for name, w in windows.items()]
    )
    return flags.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in windows])


def executive_kpis(days: DataFrame, users: DataFrame) -> DataFrame:
    """One row: dau, wau, mau, growth between the last two present months, 30-day retention,
    churn, revenue, ARPU and users; zeros without events."""
    last = _latest_date(days).scalar()
    recent = days.filter(F.col("event_date") > F.date_sub(last, 60))
    per_user = recent.groupBy("user_id").agg(
        F.max(flag(_in_window(0, 1, last))).alias("d"),
        F.max(flag(_in_window(0, 7, last))).alias("w"),
        F.max(flag(_in_window(0, 30, last))).alias("m"),
        F.max(flag(_in_window(30, 30, last))).alias("p"),
    )
    active = per_user.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("d", "dau"), ("w", "wau"), ("m", "mau"))],
        F.sum("p").alias("prior"),
        F.sum(F.col("m") * F.col("p")).alias("kept"),
    )
    newest_first = Window.orderBy(F.col("event_month").desc())
    months = monthly_active(days).withColumn("age", F.row_number().over(newest_first))
    growth = months.agg(
        F.max(F.when(F.col("age") == 1, F.col("active_users"))).alias("cur"),
        F.max(F.when(F.col("age") == 2, F.col("active_users"))).alias("prev"),
    )
    value = users.agg(
        F.sum("is_churned").alias("churned"),
        F.sum(exact_total("customer_lifetime_value")).cast("double").alias("total"),
        F.count("user_id").alias("n_users"),
    )
    n = F.nullif(F.col("n_users"), F.lit(0))
    any_events = F.col("mau") > 0

    def shown(rate: Column) -> Column:
        return F.when(any_events, or_zero(F.round(rate, 2))).otherwise(0.0)

    return (
        active.crossJoin(F.broadcast(growth))
        .crossJoin(F.broadcast(value))
        .select(
            "dau",
            "wau",
            "mau",
            shown(100.0 * (F.col("cur") - F.col("prev")) / F.col("prev")).alias("growth_rate"),
            shown(100.0 * F.col("kept") / F.nullif(F.col("prior"), F.lit(0))).alias(
                "retention_rate"
            ),
            shown(100.0 * F.col("churned") / n).alias("churn_rate"),
            shown(F.col("total")).alias("total_revenue"),
            shown(F.col("total") / n).alias("arpu"),
            F.when(any_events, F.col("n_users")).otherwise(0).alias("n_users"),
        )
    )


def _last_steps(series: DataFrame, order: str, **values: str) -> DataFrame:
    """One row: difference between the last two points of each value, by result column; null with
    fewer than two. The values are null on the same rows, which do not count as points."""
    known = series.filter(F.col(next(iter(values.values()))).isNotNull())
    newest = Window.orderBy(F.col(order).desc())
    aged = known.withColumn("age", F.row_number().over(newest))

    def step(value: str) -> Column:
        at = lambda age: F.max(F.when(F.col("age") == age, F.col(value)))
        return F.round(at(1) - at(2), 2)

    return aged.agg(*[step(value).alias(name) for name, value in values.items()])


def kpi_deltas(days: DataFrame, revenue: DataFrame, retention: DataFrame) -> DataFrame:
    """One (kpi, delta) row per KPI card."""
    active = window_counts(
        days, {"w": (0, 7), "w_prev": (7, 7), "m": (0, 30), "m_prev": (30, 30)}
    )
    newest = Window.orderBy(F.col("date").desc())
    aged = daily_active_trend(days).withColumn("age", F.row_number().over(newest))
    daily = aged.agg(
        F.max(F.when(F.col("age") == 1, F.col("dau"))).alias("d"),
        F.max(F.when(F.col("age") == 2, F.col("dau"))).alias("d_prev"),
    )
    age = F.datediff(_latest_date(days).scalar(), F.col("date"))
    income = revenue.agg(
        F.sum(F.when(age < 7, F.col("revenue").cast("decimal(22,2)"))).cast("double").alias("r"),
        F.sum(F.when((age >= 7) & (age < 14), F.col("revenue").cast("decimal(22,2)")))
        .cast("double")
        .alias("r_prev"),
    )
    # Churn is the rest of retention, so both come from one pass over the weeks.
    both = retention.withColumn("churn_pct", 100 - F.col("retention_pct"))
    steps = _last_steps(both, "week", kept="retention_pct", lost="churn_pct")
    row = active
    for part in (daily, income, steps):
        row = row.crossJoin(F.broadcast(part))
    money = pct_change(or_zero(F.col("r")), F.col("r_prev"))
    deltas = {
        "dau": pct_change(F.col("d"), F.col("d_prev")),
        "wau": pct_change(F.col("w"), F.col("w_prev")),
        "mau": pct_change(F.col("m"), F.col("m_prev")),
        "growth_rate": F.lit(None).cast("double"),
        "retention_rate": F.col("kept"),
        "churn_rate": F.col("lost"),
        "revenue": money,
        "arpu": money,
    }
    entries = [F.struct(F.lit(k).alias("kpi"), v.alias("delta")) for k, v in deltas.items()]
    return row.select(F.inline(F.array(*entries)))


def kpi_sparks(days: DataFrame, revenue: DataFrame, retention: DataFrame) -> DataFrame:
    """Last points of the series behind each KPI card, as (kpi, point, value), oldest first."""

    def tail(series: DataFrame, order: str, value: str, *kpis: str) -> DataFrame:
        known = series.filter(F.col(value).isNotNull())
        newest = Window.orderBy(F.col(order).desc())
        last = known.withColumn("age", F.row_number().over(newest)).filter(
            F.col("age") <= SPARK_POINTS
        )
        point = F.row_number().over(Window.orderBy(order)).alias("point")
        numbered = last.select(point, F.col(value).cast("double").alias("value"))
        names = F.explode(F.array(*[F.lit(k) for k in kpis])).alias("kpi")
        return numbered.select(names, "point", "value")

    return (
        tail(daily_active_trend(days), "date", "dau", "dau", "wau", "mau")
        .unionByName(tail(monthly_active(days), "event_month", "active_users", "growth_rate"))
        .unionByName(tail(retention, "week", "retention_pct", "retention_rate"))
        .unionByName(tail(churn_trend(retention), "week", "churn_pct", "churn_rate"))
        .unionByName(tail(revenue, "date", "revenue", "revenue", "arpu"))
    )


def rolling_active_users(days: DataFrame, lengths: dict[str, int] | None = None) -> DataFrame:
    """Per date with activity: distinct users of the trailing 1, 7 and 30 days.

    A user active on day d counts on the dates d .. d+length-1, cut off at the user's next active
    day, which starts its own stretch. So every user-day adds one +1 and one -1, and a running sum
    over the calendar counts the users. Copying each user-day to every date it counts for would
    shuffle `length` times as many rows.
    """
    lengths = lengths or {"dau": 1, "wau": 7, "mau": 30}
    following = F.lead("event_date").over(Window.partitionBy("user_id").orderBy("event_date"))
    stretches = days.select("user_id", "event_date", following.alias("next_date"))
    marks = []
    for name, length in lengths.items():
        over = F.date_add("event_date", length)
        marks.append(F.struct(F.lit(name).alias("m"), F.col("event_date").alias("date"), F.lit(1).alias("step")))
        marks.append(
            F.struct(
                F.lit(name).alias("m"),
                F.least(over, F.coalesce("next_date", over)).alias("date"),
                F.lit(-1).alias("step"),
            )
        )
    steps = stretches.select(F.inline(F.array(*marks))).groupBy("date").agg(
        *[F.sum(F.when(F.col("m") == n, F.col("step")).otherwise(0)).alias(n) for n in lengths],
        F.max(F.col("step") > 0).alias("present"),
    )
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        steps.select("present", F.col("date").alias("event_date"), *[F.sum(n).over(upto).alias(n) for n in lengths])
        .filter("present")
        .drop("present")
        .orderBy("event_date")
    )
