"""Layouts for slicing: events whose files can be skipped by category and brand, and tables that
already lie where a join by user needs them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.shared import new_path

SLICED_BY = ("category", "brand")
BUCKET_ROWS = 2_000_000


def _bloom(writer, columns: tuple[str, ...], values: int):
    """Bloom filters for the columns, sized for the stated number of different values. Parquet writes one
    only for row groups whose values do not all fit a dictionary; the others are ruled out by that."""
    for column in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(values))
    return writer


def write_clustered(events: DataFrame, path: str, values: int = 10_000, row_group: int | None = None) -> None:
    """Write events by month, and within a month ordered by category and brand over the files: their
    row groups hold few values, so smallest and largest value, dictionary or Bloom filter rule most out.

    The ranges go on through time and user, so a (category, brand) with a third of all events is cut over
    many tasks. The bounds come from Spark's sample of the rows, which reads the key columns once more.
    """
    order = ["event_month", *SLICED_BY, "event_time", "user_id"]
    ordered = events.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = _bloom(ordered.write.mode("overwrite").partitionBy("event_month"), SLICED_BY, values)
    if row_group is not None:
        writer = writer.option("parquet.block.size", str(row_group))
    writer.parquet(path)


def clustered(events: DataFrame, name: str) -> DataFrame:
    """Write events clustered in the shared folder and read them back."""
    path = new_path(events.sparkSession, name)
    write_clustered(events, path)
    return events.sparkSession.read.schema(events.schema).parquet(path)


def user_slices(events: DataFrame) -> DataFrame:
    """One row per user, date, category and brand: what a slice needs to know of a user's events. A user
    with a third of all events has as many rows as such combinations, and they are made by a map-side sum."""
    return events.groupBy("user_id", "event_date", *SLICED_BY).agg(F.count(F.lit(1)).alias("n_events"))


def bucket_count(rows: int) -> int:
    """Buckets for tables joined by user, a power of two: 2 million slice rows each at most, on average."""
    count = 8
    while count * BUCKET_ROWS < rows:
        count *= 2
    return count


def bucketed(frame: DataFrame, name: str, buckets: int, order: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Write a table bucketed by user, one file a bucket, and read it back. Tables with the same number of
    buckets are joined by user without a shuffle. The files lie in the shared folder, the table is known
    to this session's catalog."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    sliced = tuple(c for c in SLICED_BY if c in frame.columns)
    writer = _bloom(frame.repartition(buckets, "user_id").write, sliced, 10_000)
    writer.bucketBy(buckets, "user_id").sortBy(*order).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)
