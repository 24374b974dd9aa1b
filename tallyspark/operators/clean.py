"""Cleaning: raw events to canonical events, one small step per function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import PRICE_LIMIT
from tallyspark.sources.schema import EVENT_TYPES

# Columns an event needs, and those that tell events apart.
REQUIRED = ["event_time", "user_id", "product_id", "event_type"]
EVENT_KEY = ["event_time", "event_type", "product_id", "user_id", "user_session"]
BLANKS = " \t\n\r\x0b\x0c"


def normalize_timestamps(events: DataFrame) -> DataFrame:
    """Event times as UTC timestamps; a time that cannot be read becomes null."""
    return events.withColumn("event_time", F.col("event_time").try_cast("timestamp"))


def drop_incomplete(events: DataFrame) -> DataFrame:
    return events.dropna(subset=REQUIRED)


def fill_categoricals(events: DataFrame) -> DataFrame:
    """Sentinels for missing labels. All session-less events share one session."""
    return events.withColumns(
        {
            "brand": F.trim(F.lower(F.coalesce("brand", F.lit("unknown"))), F.lit(BLANKS)),
            "category_code": F.lower(F.coalesce("category_code", F.lit("unknown"))),
            "user_session": F.coalesce("user_session", F.lit("no_session")),
        }
    )


def coerce_price(events: DataFrame) -> DataFrame:
    """Prices as doubles: what is not a number, infinite or beyond the limit counts as 0, negative
    prices are raised to 0."""
    number = F.col("price").try_cast("double")
    readable = ~F.isnan(number) & (number < PRICE_LIMIT)
    return events.withColumn("price", F.when(readable & (number > 0), number).otherwise(0.0))


def split_category(events: DataFrame) -> DataFrame:
    """Category before the first dot, subcategory after it (`unknown` without a dot)."""
    code = F.col("category_code")
    dot = F.instr(code, ".")
    return events.withColumns(
        {
            "category": F.substring_index(code, ".", 1),
            "subcategory": F.when(dot > 0, F.substr(code, dot + 1)).otherwise("unknown"),
        }
    )


def calendar_columns(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {
            "event_date": F.to_date("event_time"),
            "event_month": F.date_format("event_time", "yyyy-MM"),
        }
    )


def dedup_events(events: DataFrame) -> DataFrame:
    """One row per (time, type, product, user, session).

    Rows have no file order in Spark, so the kept row is the smallest by (price, category_id,
    category_code, brand). An aggregate, so copies collapse on the map side before the shuffle:
    a key holding a large share of all rows sends one row per map task.
    """
    return _kept(events, EVENT_KEY)


def _kept(events: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in events.columns if c not in keys]
    leading = [c for c in ("price", "category_id", "category_code", "brand") if c in rest]
    order = leading + [c for c in rest if c not in leading]
    kept = events.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_kept"))
    return kept.select(
        *[F.col(c) if c in keys else F.col(f"_kept.{c}").alias(c) for c in events.columns]
    )


def filter_vocabulary(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin(*EVENT_TYPES))


def wanted_events(raw: DataFrame) -> DataFrame:
    """Rows of known type, complete and with clean values; copies are still there."""
    return (
        raw.transform(normalize_timestamps)
        .transform(drop_incomplete)
        .transform(fill_categoricals)
        .transform(coerce_price)
        .transform(filter_vocabulary)
    )


#: Tasks a month may be cut over, or a twelfth of the session's shuffle partitions if that is more.
MONTH_SLOTS = 8


def dedup_by_month(events: DataFrame) -> DataFrame:
    """`dedup_events` for a writer that partitions by month, in one shuffle: copies of an event are of the
    same month and, by a hash of hour and user, of the same slot of it. Small months share a task, a large one
    is cut over its slots, a user's day stays in few files, and a user with most events is spread by hours. All
    copies of one event meet in one task, which keeps one row of them. Before the derived columns are
    added, so that only month and slot travel with an event."""
    partitions = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed_by = F.xxhash64(F.date_trunc("hour", "event_time"), "user_id")
    slot = F.pmod(placed_by, F.lit(max(MONTH_SLOTS, partitions // 12))).cast("smallint")
    place = ["event_month", "_slot"]
    placed = calendar_columns(events).withColumn("_slot", slot).select(*events.columns, *place)
    return _kept(placed.hint("rebalance", *place), [*place, *EVENT_KEY]).select(*events.columns)


def derived_columns(events: DataFrame) -> DataFrame:
    return events.transform(split_category).transform(calendar_columns)


def clean_events(raw: DataFrame, to_write: bool = False) -> DataFrame:
    """All steps. The type filter and the derived columns commute with the de-duplication, so
    the shuffle carries only wanted rows and no derived column. `to_write` lays the rows out by month."""
    return derived_columns(raw.transform(wanted_events).transform(dedup_by_month if to_write else dedup_events))


def data_quality_report(raw: DataFrame, clean: DataFrame | None = None) -> DataFrame:
    """Six (metric, value) rows: volumes before and after cleaning, and nulls in the raw data.

    Without the cleaned events the raw ones are read once: a cleaned row is a key that is complete
    and of a known type, so rows and nulls are counted by key, and keys by themselves. Counted that
    way and not while cleaning writes, since observed metrics count a repeated task twice."""
    raw_counts = {
        "raw_rows": F.count(F.lit(1)),
        "null_brands": F.count_if(F.col("brand").isNull()),
        "null_categories": F.count_if(F.col("category_code").isNull()),
    }
    if clean is None:
        keyed = normalize_timestamps(raw).withColumn("user_session", F.coalesce("user_session", F.lit("no_session")))
        wanted = F.col("event_type").isin(*EVENT_TYPES)
        for c in REQUIRED:
            wanted = wanted & F.col(c).isNotNull()
        unkept = F.when(~F.coalesce(wanted, F.lit(False)), F.xxhash64(*EVENT_KEY) % 64)  # one of few groups, dealt evenly
        keys = [F.when(wanted, F.col(c)).alias(c) for c in EVENT_KEY]
        per_key = keyed.groupBy(*keys, unkept.alias("_unkept")).agg(*[c.alias(n) for n, c in raw_counts.items()])
        both = per_key.agg(
            *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in raw_counts], F.count_if(F.col("_unkept").isNull()).alias("clean_rows")
        )
    else:
        both = raw.agg(*[c.alias(n) for n, c in raw_counts.items()]).crossJoin(clean.agg(F.count(F.lit(1)).alias("clean_rows")))
    dropped = F.col("raw_rows") - F.col("clean_rows")
    share = F.round(100.0 * dropped / F.greatest(F.col("raw_rows"), F.lit(1)), 2)
    values = {
        "raw_rows": F.col("raw_rows"),
        "clean_rows": F.col("clean_rows"),
        "rows_dropped": dropped,
        "pct_dropped": share,
        "null_brand_filled": F.col("null_brands"),
        "null_category_filled": F.col("null_categories"),
    }
    entries = [
        F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
        for name, value in values.items()
    ]
    return both.select(F.inline(F.array(*entries)))
