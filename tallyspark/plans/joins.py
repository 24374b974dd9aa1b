"""Joins whose hot keys must not land in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_lookup(big: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Inner join to a lookup with one row per key.

    Whether the lookup is broadcast is left to the session's limit, checked on the estimated size
    when planning and on the measured one at run time. Beyond it both sides are shuffled, and
    adaptive execution splits the partitions of hot keys against a copy of the few lookup rows they
    meet; an inner join may be split on either side, so no key has to fit one task."""
    return big.join(lookup, key)
