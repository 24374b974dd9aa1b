"""Running totals, exact quantiles and exact shares over data too large for one ordered task.

A window without partitions pulls everything into one task. Here rows are range-partitioned into
slices, each slice is summed, the slice sums (one row per partition) are accumulated, and the
final window runs inside each slice.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.plans.shared import checkpointed


def running_totals(
    rows: DataFrame, order: str, measures: list[str], descending: bool = False
) -> DataFrame:
    """Add `<m>_upto` (sum of m over rows up to and including this one) and `<m>_total`.

    `order` must be unique. The sliced rows are checkpointed: the range boundaries come from a
    sample, and both the slice sums and the rows must see the same slices.
    """
    by = F.col(order).desc() if descending else F.col(order).asc()
    sliced = checkpointed(
        rows.repartitionByRange(by).withColumn("_slice", F.spark_partition_id())
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        sliced.groupBy("_slice")
        .agg(*[F.sum(m).alias(f"_{m}") for m in measures])
        .select(
            "_slice",
            *[F.coalesce(F.sum(f"_{m}").over(before), F.lit(0)).alias(f"_{m}_before") for m in measures],
            *[F.sum(f"_{m}").over(Window.partitionBy()).alias(f"{m}_total") for m in measures],
        )
    )
    inside = Window.partitionBy("_slice").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    # One row per partition of `sliced`, so the broadcast is bounded by the partition count.
    joined = sliced.join(F.broadcast(slices), "_slice")
    return joined.select(
        *rows.columns,
        *[(F.col(f"_{m}_before") + F.sum(m).over(inside)).alias(f"{m}_upto") for m in measures],
        *[f"{m}_total" for m in measures],
    )


#: Buckets of a counting pass.
BUCKETS = 1 << 16


def exact_quantiles(df: DataFrame, shares: dict[str, float], buckets: int = BUCKETS) -> dict[str, float | None]:
    """The linearly interpolated quantile of each numeric column, all columns together; nulls and NaN
    are not counted, and a column without any other value gives None.

    Radix selection without a sort: a pass counts the values of every interval that still holds a
    wanted rank, in `buckets` equal parts, and the part with the rank is the next interval, narrowed
    to its least and greatest value. Parts follow the order of the values, so the result is exact.
    Nothing but counts is shuffled, a few hundred thousand at most, and one row per wanted rank
    reaches the driver: two per column, usually done after two passes."""
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in shares}
    frame = df.select(*[v.alias(f"v{i}") for i, v in enumerate(value.values())])
    first = frame.agg(*[f(f"v{i}") for i in range(len(shares)) for f in (F.count, F.min, F.max)]).first()
    # (column, rank): least and greatest value of the interval, and how many values lie below it
    open_, found = {}, {}
    for i, share in enumerate(shares.values()):
        n, low, high = first[3 * i : 3 * i + 3]
        if n:
            position = math.floor((n - 1) * share)
            for rank in {position, min(position + 1, n - 1)}:
                open_[i, rank] = (low, high, 0)
    while open_:
        for target in [t for t, (low, high, _) in open_.items() if low == high]:
            found[target] = open_.pop(target)[0]
        if not open_:
            break
        numbered = list(enumerate(open_.items()))
        hits = []
        for k, ((i, _), (low, high, _)) in numbered:
            v = F.col(f"v{i}")
            if math.isinf(low) or math.isinf(high):  # infinite values are parts of their own
                part = F.when(v == float("-inf"), 0).when(v == float("inf"), 2).otherwise(1)
            else:  # halves, so that the span cannot overflow
                part = F.least(F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * buckets), F.lit(buckets - 1))
            hits.append(F.when(v.between(low, high), F.struct(F.lit(k).alias("k"), part.cast("long").alias("part"), v.alias("v"))))
        tall = frame.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.*")
        counts = tall.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        ranks = F.create_map(*[F.lit(x) for k, ((_, rank), (_, _, below)) in numbered for x in (k, rank - below)])
        upto = F.sum("n").over(Window.partitionBy("k").orderBy("part"))
        picked = counts.withColumn("upto", upto).withColumn("rank", ranks[F.col("k")])
        picked = picked.filter((F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
        for row in picked.collect():
            target, (_, _, below) = numbered[row["k"]][1]
            open_[target] = (row["low"], row["high"], below + row["upto"] - row["n"])
    out = {}
    for i, (column, share) in enumerate(shares.items()):
        if not first[3 * i]:
            out[column] = None
            continue
        position = (first[3 * i] - 1) * share
        low = math.floor(position)
        below, above = found[i, low], found[i, min(low + 1, first[3 * i] - 1)]
        out[column] = below if below == above else below + (above - below) * (position - low)
    return out


def exact_quantile(df: DataFrame, column: str, share: float, name: str) -> DataFrame:
    """One row with the linearly interpolated quantile of a column, nulls ignored."""
    return df.sparkSession.createDataFrame([(exact_quantiles(df, {column: share})[column],)], f"{name} double")


def smallest_share(
    rows: DataFrame, group: str, hash_column: str, tie: str, share: float, name: str
) -> DataFrame:
    """Mark, within each group, the ceil(share * n) rows smallest by (hash, tie) with 1.

    The hash is a hex digest, so its first four digits cut every group, hot or not, into 65,536
    even buckets. Bucket counts give each bucket's first rank; ranks are then counted inside a
    bucket only.
    """
    cut = rows.withColumn("_bucket", F.substring(hash_column, 1, 4))
    before = (
        Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    buckets = (
        cut.groupBy(group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            group,
            "_bucket",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.ceil(F.sum("_n").over(Window.partitionBy(group)) * F.lit(share)).alias("_quota"),
        )
    )
    place = Window.partitionBy(group, "_bucket").orderBy(hash_column, tie)
    rank = F.col("_before") + F.row_number().over(place)
    return (
        cut.join(buckets, [group, "_bucket"])
        .withColumn(name, F.when(rank <= F.col("_quota"), 1).otherwise(0))
        .drop("_bucket", "_before", "_quota")
    )
