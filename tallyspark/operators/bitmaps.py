"""Active users from one bitmap of users per day: exact distinct counts of any span of days by OR, and
new days added without reading the old ones.

A folder holds two growing tables. `users` is the dictionary, (user_id, load, bucket, position): the
place of a user's bit, given once by the load that first saw the user. `days` has (event_date, load, bucket,
bits): the users of a date, 32,768 to a bucket. Rows of one date and bucket from several loads are merged
when read, so late or repeated user-days do no harm. Loads of one folder run one after the other.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_USERS = "user_id bigint, bucket bigint, position bigint, load int"
_DAYS = "event_date date, load int, bucket bigint, bits binary, event_month string"
_PLACE = ["load", "bucket"]
SPANS = {"dau": 1, "wau": 7, "mau": 30}


def _users(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_USERS).parquet(f"{folder}/users")


def day_bits(spark: SparkSession, folder: str) -> DataFrame:
    """The bitmaps as written, a directory a month."""
    return spark.read.schema(_DAYS).parquet(f"{folder}/days")


def _grown(users: DataFrame, known: DataFrame, load: int, folder: str) -> None:
    """Places for users that have none. The numbers are dense within a task; what a task numbers is a hash
    slice of the users, so a task that runs again gives other numbers to its own users at most, and
    only one attempt is written."""
    new = users.distinct().join(known, "user_id", "left_anti")
    number = F.monotonically_increasing_id()
    new.select(
        "user_id",
        F.bitmap_bucket_number(number).alias("bucket"),
        F.bitmap_bit_position(number).alias("position"),
    ).withColumn("load", F.lit(load)).write.mode("append").partitionBy("load").parquet(f"{folder}/users")


def create_bitmaps(days: DataFrame, folder: str) -> None:
    """Bitmaps of a user-day rollup in a new folder."""
    spark = days.sparkSession
    for table, columns in (("users", _USERS), ("days", _DAYS)):
        spark.createDataFrame([], columns).write.parquet(f"{folder}/{table}")
    add_days(days, folder)


def add_days(days: DataFrame, folder: str) -> None:
    """Add user-days. Reads these and the dictionary, no old day."""
    spark = days.sparkSession
    known = _users(spark, folder)
    load = known.agg(F.coalesce(F.max("load") + 1, F.lit(0))).first()[0]
    _grown(days.select("user_id").filter("user_id IS NOT NULL"), known, load, folder)
    placed = days.select("user_id", "event_date").join(_users(spark, folder), "user_id")
    bits = placed.groupBy("event_date", *_PLACE).agg(F.bitmap_construct_agg("position").alias("bits"))
    stamped = bits.withColumn("event_month", F.date_format("event_date", "yyyy-MM"))
    stamped.hint("rebalance", "event_month").write.mode("append").partitionBy("event_month").parquet(f"{folder}/days")


def _between(bits: DataFrame, first: Column | None, last: Column | None) -> DataFrame:
    """Bitmaps of a span of days; months outside it are not listed."""
    date, month = F.col("event_date"), F.col("event_month")
    if first is not None:
        bits = bits.filter((date >= first) & (month >= F.date_format(first, "yyyy-MM")))
    if last is not None:
        bits = bits.filter((date <= last) & (month <= F.date_format(last, "yyyy-MM")))
    return bits


def active_users(spark: SparkSession, folder: str, length: int, end: dt.date | None = None) -> DataFrame:
    """Distinct users in the `length` days up to and including `end` (default: the latest date)."""
    bits = day_bits(spark, folder)
    last = F.lit(end) if end is not None else bits.agg(F.max("event_date")).scalar()
    merged = _between(bits, F.date_sub(last, length - 1), last).groupBy(*_PLACE).agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("active_users"))


def rolling_active_users(
    spark: SparkSession, folder: str, lengths: dict[str, int] | None = None, since: dt.date | None = None
) -> DataFrame:
    """Per date with activity, from `since` on: distinct users of the trailing 1, 7 and 30 days. Only
    the bitmaps that such a window covers are read.

    A bucket's counts can change only on dates it has a bitmap for and on those where one leaves a
    window. At these the window's bitmaps are merged, and the change since the bucket's previous such
    date is added up over the calendar, so no bucket needs a row for every date.
    """
    lengths = lengths or SPANS
    reach = max(lengths.values())
    first = None if since is None else F.date_sub(F.lit(since), reach - 1)
    bits = _between(day_bits(spark, folder), first, None)
    leaving = F.explode(F.array(*[F.lit(n) for n in {0, *lengths.values()}]))
    points = (
        bits.select("event_date", *_PLACE, "bits", leaving.alias("later"))
        .select(
            F.date_add("event_date", F.col("later")).alias("event_date"), *_PLACE,
            F.when(F.col("later") == 0, F.col("bits")).alias("bits"),
        )
        .groupBy("event_date", *_PLACE)
        .agg(F.bitmap_or_agg("bits").alias("bits"), F.max(F.col("bits").isNotNull()).alias("present"))
    )
    in_order = Window.partitionBy(*_PLACE).orderBy(F.unix_date("event_date"))
    counted = points.select(
        "event_date", *_PLACE, "present",
        *[
            F.bitmap_count(F.bitmap_or_agg("bits").over(in_order.rangeBetween(1 - n, 0))).alias(name)
            for name, n in lengths.items()
        ],
    )
    steps = counted.select(
        "event_date", "present",
        *[(F.col(n) - F.coalesce(F.lag(n).over(in_order), F.lit(0))).alias(n) for n in lengths],
    )
    # A row per date, so one task orders the calendar only.
    per_date = steps.groupBy("event_date").agg(
        F.max("present").alias("present"), *[F.sum(n).alias(n) for n in lengths]
    )
    upto = Window.orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    rolled = per_date.select("event_date", "present", *[F.sum(n).over(upto).alias(n) for n in lengths])
    wanted = F.col("present") if since is None else F.col("present") & (F.col("event_date") >= F.lit(since))
    return rolled.filter(wanted).drop("present").orderBy("event_date")
