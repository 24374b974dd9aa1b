"""One row per user with the days and weeks it was active in as bits: cohorts, Day-N retention and weekly
retention are then counted by shifts and ANDs over a scan, and only calendar-sized counts are shuffled.

A row is (user_id, first_date, months, weeks). `months` has a struct (no, bits) per month with activity, a
bit for each day; `weeks` one per 32 Monday-to-Sunday weeks, a bit for each week. Both ascend by
number, and neither grows with the events a user has. Rows of different days can be merged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.cohort import DAY_LIST, retention_shares
from tallyspark.operators.metrics import retention_of_pairs

WEEKS = 32


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def _month_no(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def _highest(bits: Column) -> Column:
    """Place of the highest bit that is set."""
    return F.length(F.bin(bits)) - 1


def _per_user(marks: DataFrame) -> DataFrame:
    """Rows per user from marks (user_id, first_date, weekly, no, bits). Bits are merged before each of the
    two shuffles, so the second one moves a user's distinct words."""
    words = marks.groupBy("user_id", "weekly", "no").agg(
        F.bit_or("bits").alias("bits"), F.min("first_date").alias("first_date")
    )
    word = F.struct("no", "bits")
    return words.groupBy("user_id").agg(
        F.min("first_date").alias("first_date"),
        F.sort_array(F.collect_list(F.when(~F.col("weekly"), word))).alias("months"),
        F.sort_array(F.collect_list(F.when(F.col("weekly"), word))).alias("weeks"),
    )


def user_activity(days: DataFrame) -> DataFrame:
    """Activity rows of a user-day rollup, or of events. Rows without a user or a date are left out."""
    date = F.col("event_date")
    week = F.floor((F.unix_date(date) + 3) / 7)
    monthly = F.struct(
        F.lit(False).alias("weekly"), _month_no(date).cast("bigint").alias("no"), _bit(F.day(date) - 1).alias("bits")
    )
    weekly = F.struct(
        F.lit(True).alias("weekly"), F.floor(week / WEEKS).alias("no"), _bit(F.pmod(week, F.lit(WEEKS))).alias("bits")
    )
    known = days.filter(F.col("user_id").isNotNull() & date.isNotNull())
    return _per_user(known.select("user_id", date.alias("first_date"), F.inline(F.array(monthly, weekly))))


def merged(*activities: DataFrame) -> DataFrame:
    """Activity of several spans of days, which may overlap: a new file's rows are added to the old ones
    without reading old user-days."""
    kinds = ((False, "months"), (True, "weeks"))
    marks = [
        a.select("user_id", "first_date", F.lit(weekly).alias("weekly"), F.inline(column))
        for a in activities
        for weekly, column in kinds
    ]
    return _per_user(reduce(DataFrame.unionByName, marks))


def cohort_activity(activity: DataFrame) -> DataFrame:
    """Active users per first month (a date) and months since, the long form of the cohort matrix."""
    first = F.col("first_date")
    months = activity.select(
        F.trunc(first, "month").alias("cohort"), _month_no(first).alias("started"), F.inline("months")
    )
    since = (F.col("no") - F.col("started")).cast("bigint")
    return months.groupBy("cohort", since.alias("month_number")).agg(F.count(F.lit(1)).alias("active_users"))


def cohort_sizes(activity: DataFrame) -> DataFrame:
    cohort = F.date_format("first_date", "yyyy-MM").alias("cohort")
    return activity.groupBy(cohort).agg(F.count(F.lit(1)).alias("cohort_size")).orderBy("cohort")


def day_n_retention(activity: DataFrame, day_list: tuple[int, ...] = DAY_LIST) -> DataFrame:
    """Users active exactly n days after their first day, as a share of all users: day n lies in one
    month of a user, where its bit is looked up."""

    def active(n: int) -> Column:
        date = F.date_add("first_date", n)
        marked = F.col("bits").bitwiseAND(_bit(F.day(date) - 1)) != 0
        return F.count_if((F.col("no") == _month_no(date)) & marked)

    counts = activity.select("first_date", F.inline("months")).agg(
        active(0).alias("users"), *[active(n).alias(f"d{n}") for n in day_list]
    )
    return retention_shares(counts, day_list)


def week_pairs(activity: DataFrame) -> DataFrame:
    """Users per week (its Monday) and the week they were active in before it, null for the first. The one
    before is the next lower bit, or the highest one of the words before."""
    words = activity.select("weeks", F.posexplode("weeks").alias("i", "word")).select(
        "word.no", "word.bits", F.get("weeks", F.col("i") - 1).alias("earlier")
    )
    place, bits, earlier = F.col("place"), F.col("bits"), F.col("earlier")
    marked = words.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(WEEKS - 1)))).filter(
        bits.bitwiseAND(_bit(place)) != 0
    )
    lower = bits.bitwiseAND(_bit(place) - 1)
    before = F.when(lower != 0, F.col("no") * WEEKS + _highest(lower)).otherwise(
        earlier["no"] * WEEKS + _highest(earlier["bits"])
    )

    def monday(week: Column) -> Column:
        return F.date_from_unix_date((week * 7 - 3).cast("int"))

    return marked.groupBy(
        monday(F.col("no") * WEEKS + place).alias("monday"), monday(before).alias("came_from")
    ).agg(F.count(F.lit(1)).alias("n"))


def retention_trend(activity: DataFrame) -> DataFrame:
    """Per Monday-to-Sunday week: the share of the previous present week's users seen again."""
    return retention_of_pairs(week_pairs(activity))
