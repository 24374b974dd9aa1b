"""Readers and writers: event CSV, Parquet tables, catalog tables, JDBC tables, SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import clean, tables
from tallyspark.plans.shared import CODEC, write_by
from tallyspark.sources.schema import DECLARED, RAW_EVENTS, TABLES, declared_columns


def _csv_header(spark: SparkSession, path: str) -> list[str]:
    header = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(RAW_EVENTS.names) - set(header))
    if missing:
        raise ValueError(f"event file lacks the columns {missing}")
    return header


def _csv_reader(spark: SparkSession, header: list[str], mode: str, *more: str) -> DataFrameReader:
    kinds = {f.name: f.dataType.simpleString() for f in RAW_EVENTS.fields}
    schema = ", ".join([*[f"`{name}` {kinds.get(name, 'string')}" for name in header], *more])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    # With column pruning the parser looks only at wanted fields and takes any number of them.
    return reader.option("mode", mode).option("columnPruning", mode == "PERMISSIVE" and not more)


_NUMBERS = [f.name for f in RAW_EVENTS.fields if f.dataType.simpleString() != "string"]


def _numbers_read() -> Column:
    """True for every row. It refers to every number: Spark converts only the fields that a query refers
    to, and whether a line is malformed must not depend on the columns somebody selects later."""
    return F.xxhash64(*_NUMBERS) >= F.lit(-(1 << 63))


#: What becomes of a malformed line, and the reader's mode for it.
ON_MALFORMED = {"null": "PERMISSIVE", "drop": "DROPMALFORMED", "fail": "FAILFAST"}


def read_events_csv(
    spark: SparkSession, path: str, nrows: int | None = None, on_malformed: str = "null"
) -> DataFrame:
    """Raw events from CSV files with a header, in the contract's column order.

    The header line is read first: a missing column is an error, extra columns and any column
    order are accepted. All files must have the same header: one with other columns or another
    order is an error, never read by position. Times such as `2019-10-01 00:00:00 UTC` become timestamps, times that
    cannot be read become null. `nrows` is the reader's optional row limit.

    A line is malformed if it has too few or too many fields, or a number that cannot be read.
    `on_malformed`: "null" keeps it, with null for what is missing or unreadable and without spare fields;
    "drop" leaves it out; "fail" is strict, the read ends with an error. `malformed_lines` shows them.
    """
    reader = _csv_reader(spark, _csv_header(spark, path), ON_MALFORMED[on_malformed])
    lines = reader.csv(path)
    if on_malformed != "null":
        lines = lines.filter(_numbers_read())
    events = lines.select(
        F.col("event_time").try_cast("timestamp").alias("event_time"),
        *[name for name in RAW_EVENTS.names if name != "event_time"],
    )
    # A limit leaves one partition; what follows should not run in one task.
    return events.limit(nrows).hint("rebalance") if nrows is not None else events


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The malformed lines of CSV files: (file, problem, line), the problem one of `too few fields`,
    `too many fields` and `unreadable number`. A field in quotes may hold commas."""
    header = _csv_header(spark, path)
    line = "_line"
    while line in header:
        line += "_"
    reader = _csv_reader(spark, header, "PERMISSIVE", f"`{line}` string")
    lines = reader.option("columnNameOfCorruptRecord", line).csv(path)
    outside_quotes = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    fields = F.size(F.split(line, outside_quotes))
    problem = (
        F.when(fields < len(header), "too few fields")
        .when(fields > len(header), "too many fields")
        .otherwise("unreadable number")
    )
    return lines.filter(_numbers_read() & F.col(line).isNotNull()).select(
        F.col("_metadata.file_path").alias("file"), problem.alias("problem"), F.col(line).alias("line")
    )


def write_events_csv(events: DataFrame, path: str) -> None:
    """Raw events as CSV files with a header, nulls as empty fields."""
    stamped = events.withColumn(
        "event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS 'UTC'")
    )
    stamped.write.mode("overwrite").option("header", True).csv(path)


def write_tables_parquet(frames: dict[str, DataFrame], folder: str) -> None:
    """One Parquet dataset per table, replaced if present; the events are laid out by month."""
    for name, frame in frames.items():
        path = f"{folder}/{name}.parquet"
        if name == "fact_events":
            write_by(frame, "event_month", path)
        else:
            frame.write.mode("overwrite").option("compression", CODEC).parquet(path)


def read_events_parquet(spark: SparkSession, folder: str) -> DataFrame:
    """The written events. Their columns are stated, since a table without rows has no month and
    so no file to take them from."""
    columns = clean.clean_events(spark.createDataFrame([], RAW_EVENTS)).schema
    return spark.read.schema(columns).parquet(f"{folder}/fact_events.parquet")


def read_tables_parquet(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    derived = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in TABLES[1:]}
    return {"fact_events": read_events_parquet(spark, folder), **derived}


def load_tables(
    spark: SparkSession, folder: str, database: str | None = None
) -> dict[str, DataFrame]:
    """The five tables by name: from the catalog database where it has them, else from Parquet."""
    fallback: dict[str, DataFrame] = {}
    out = {}
    for name in TABLES:
        if database and spark.catalog.tableExists(f"{database}.{name}"):
            out[name] = spark.table(f"{database}.{name}")
            continue
        if not fallback:
            fallback = read_tables_parquet(spark, folder)
        out[name] = fallback[name]
    return out


def create_star_schema(
    spark: SparkSession, frames: dict[str, DataFrame], database: str, location: str
) -> None:
    """Drop and create the five catalog tables with their declared types, and fill them; the events
    are partitioned by month. Values are rounded to the declared scale on the way in."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    for name in TABLES:
        columns = declared_columns(name)
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(
            f"CREATE TABLE {database}.{name} ({DECLARED[name]}) USING parquet "
            + ("PARTITIONED BY (event_month) " if name == "fact_events" else "")
            + f"LOCATION '{location}/{name}'"
        )
        typed = frames[name].select(*[F.col(c).cast(kind).alias(c) for c, kind in columns])
        if name == "fact_events":
            typed = typed.hint("rebalance", "event_month")
        typed.write.insertInto(f"{database}.{name}", overwrite=True)


def read_sql(spark: SparkSession, query: str, params: dict | None = None) -> DataFrame:
    """SQL with named parameters (`:name`) over the session's views and tables."""
    return spark.sql(query, args=params or {})


def register_views(frames: dict[str, DataFrame]) -> None:
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def write_table_jdbc(
    frame: DataFrame, name: str, url: str, properties: dict[str, str] | None = None,
    mode: str = "overwrite",
) -> None:
    """Replace (or append to) a database table, 10,000 rows per statement."""
    options = {"batchsize": "10000", "truncate": "true", **(properties or {})}
    frame.write.jdbc(url, name, mode=mode, properties=options)


def read_table_jdbc(
    spark: SparkSession, name: str, url: str, properties: dict[str, str] | None = None,
    split_on: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1,
) -> DataFrame:
    """A database table; with `split_on` it is read in `parts` ranges of that column at once."""
    if split_on is None:
        return spark.read.jdbc(url, name, properties=properties or {})
    return spark.read.jdbc(
        url, name, column=split_on, lowerBound=lower, upperBound=upper, numPartitions=parts,
        properties=properties or {},
    )


DERIVED = {
    "user_metrics": tables.user_metrics,
    "session_metrics": tables.session_metrics,
    "product_metrics": tables.product_metrics,
    "daily_activity": tables.daily_activity,
}


def star_schema(events: DataFrame) -> dict[str, DataFrame]:
    """The five tables over cleaned events."""
    return {"fact_events": events, **{name: build(events) for name, build in DERIVED.items()}}


def etl_run(raw: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Clean and write the events, then derive and write the other tables from the written events,
    so the cleaning runs once. Returns the tables as read back."""
    events = clean.clean_events(raw, to_write=True)
    write_by(events, "event_month", f"{folder}/fact_events.parquet", laid_out=True)
    return derive_tables(raw.sparkSession, folder)


def derive_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Write the four derived tables anew from the written events."""
    events = read_events_parquet(spark, folder)
    write_tables_parquet({name: build(events) for name, build in DERIVED.items()}, folder)
    return read_tables_parquet(spark, folder)
