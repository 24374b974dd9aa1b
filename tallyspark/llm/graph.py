"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m"))
    least = least.select("u", F.least("u", "_m").alias("_m"))
    return (
        both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        .filter("u != v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    # After a large star every edge already points from the larger to the smaller node.
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    moved = edges.join(least, "u").filter("v != _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return moved.union(least.select("u", F.col("_m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (u, v) with v the smallest node reachable from u, for every u that is not
    itself the smallest. Rounds grow with the logarithm of the longest path; each round is a
    written table, so a lost executor costs one round at most."""
    now = written(edges.select("u", "v").filter("u != v").distinct(), "links")
    before = _state(now)
    if not before[0]:
        return now
    while True:
        now = written(_small_star(written(_large_star(now), "large-star")), "small-star")
        after = _state(now)
        if after == before:
            return now
        before = after
