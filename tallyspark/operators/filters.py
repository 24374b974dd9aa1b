"""Slicing: event filters, their options, and the user and session tables that go with them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Inclusive dates; an empty list or a missing value does not filter."""

    start: dt.date | None = None
    end: dt.date | None = None
    categories: tuple[str, ...] = ()
    brands: tuple[str, ...] = ()
    min_revenue: float = 0.0


def filter_events(events: DataFrame, f: Filters) -> DataFrame:
    """Literal predicates, so they reach the scan. Dates also bound the month, by which the
    written fact table is partitioned."""
    out = events
    by_month = "event_month" in events.columns
    if f.start is not None:
        out = out.filter(F.col("event_date") >= F.lit(f.start))
        if by_month:
            out = out.filter(F.col("event_month") >= f.start.strftime("%Y-%m"))
    if f.end is not None:
        out = out.filter(F.col("event_date") <= F.lit(f.end))
        if by_month:
            out = out.filter(F.col("event_month") <= f.end.strftime("%Y-%m"))
    if f.categories:
        out = out.filter(F.col("category").isin(*f.categories))
    if f.brands:
        out = out.filter(F.col("brand").isin(*f.brands))
    return out


def filter_options(events: DataFrame) -> DataFrame:
    """Sorted (option, value) rows: every category, every brand, first and last date. Rows, not
    arrays, so the number of brands is not limited by one task's memory."""

    def distinct(column: str) -> DataFrame:
        value = F.col(column).alias("value")
        return events.filter(F.col(column).isNotNull()).select(F.lit(column).alias("option"), value).distinct()

    bounds = events.agg(F.min("event_date").alias("lo"), F.max("event_date").alias("hi")).select(
        F.inline(
            F.array(
                F.struct(F.lit("min_date").alias("option"), F.col("lo").cast("string").alias("value")),
                F.struct(F.lit("max_date").alias("option"), F.col("hi").cast("string").alias("value")),
            )
        )
    )
    rows = distinct("category").unionByName(distinct("brand")).unionByName(bounds)
    return rows.orderBy("option", "value")


def filtered_users(users: DataFrame, filtered: DataFrame, f: Filters) -> DataFrame:
    """Users with at least one filtered event; their metrics stay whole-history ones."""
    seen = users.join(filtered.select("user_id").distinct(), "user_id", "left_semi")
    if f.min_revenue:
        seen = seen.filter(F.col("customer_lifetime_value") >= f.min_revenue)
    return seen


def filtered_sessions(sessions: DataFrame, filtered: DataFrame) -> DataFrame:
    """Sessions of users with at least one filtered event; the revenue limit does not apply."""
    return sessions.join(filtered.select("user_id").distinct(), "user_id", "left_semi")
