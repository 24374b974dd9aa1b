"""Money and rate expressions.

Sums of doubles depend on the order of addition, so prices are added as exact decimals and
handed out as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A price of this much or more, and an infinite one, counts as unreadable.
PRICE_LIMIT = 1e15


def exact(price: str | Column = "price") -> Column:
    """A cleaned price with two exact decimals; anything under the limit fits."""
    return (F.col(price) if isinstance(price, str) else price).cast("decimal(18,2)")


def exact_total(total: str | Column) -> Column:
    """A sum of prices with two exact decimals, with room for 10**11 prices at the limit."""
    return (F.col(total) if isinstance(total, str) else total).cast("decimal(28,2)")


def is_type(kind: str) -> Column:
    return F.col("event_type") == kind


def money_sum(condition: Column | None = None, price: str = "price") -> Column:
    """Sum of prices, optionally of the rows meeting a condition; null when there are none."""
    value = exact(price) if condition is None else F.when(condition, exact(price))
    return F.sum(value).cast("double")


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def per(numerator: str | Column, denominator: str | Column) -> Column:
    """Ratio in which an empty denominator counts as one."""
    num = F.col(numerator) if isinstance(numerator, str) else numerator
    den = F.col(denominator) if isinstance(denominator, str) else denominator
    return num.cast("double") / F.greatest(den, F.lit(1)).cast("double")


def per_or_null(numerator: Column, denominator: Column) -> Column:
    """Ratio that is null when the denominator is zero or null."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000.0)


def flag(condition: Column) -> Column:
    """0/1 integer; a null condition counts as 0."""
    return F.when(condition, 1).otherwise(0)
