"""Statistics as column expressions."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Hart's rational form of the normal upper tail, high power first.
TAIL_NUMERATOR = [
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
TAIL_DENOMINATOR = [
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
TAIL_LIMIT = 7.07


def z_value(probability: float) -> float:
    """Normal quantile of a parameter (a number, not a column)."""
    return NormalDist().inv_cdf(probability)


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_tail(x: Column) -> Column:
    """P(Z > x) for x >= 0; 0 beyond the range of the rational form."""
    ratio = _polynomial(x, TAIL_NUMERATOR) / _polynomial(x, TAIL_DENOMINATOR)
    return F.when(x <= TAIL_LIMIT, F.exp(-x * x / 2) * ratio).when(x > TAIL_LIMIT, 0.0)


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation over rows in which both sides are present; null when either side is
    constant. (`corr` divides by zero on a constant column under ANSI.)"""
    x = F.when(b.isNotNull(), a.cast("double"))
    y = F.when(a.isNotNull(), b.cast("double"))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    spread = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return F.when(varies, F.covar_pop(x, y) / spread)


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation, 0 when either side is constant."""
    return F.coalesce(pearson(a, b), F.lit(0.0))


def pct_change(current: Column, previous: Column) -> Column:
    """Percent change to two decimals, 0 without a previous value to compare with."""
    compared = F.round(100.0 * (current - previous) / F.nullif(previous.cast("double"), F.lit(0.0)), 2)
    return F.coalesce(compared, F.lit(0.0))
