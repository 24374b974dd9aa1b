"""Adapters from the given tables to the raw event contract.

`order_raw` reads a shop history out of the order tables (years of months, so growth,
cohorts and churn are populated); `click_raw` reads a dense month of sessions out of the
event stream (so daily and weekly activity is populated). Both leave dirt in (null brands,
null sessions, an unknown event type) for the cleaning operators to deal with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.plans.joins import join_lookup
from tallyspark.sources.schema import RAW_EVENTS

RAW_COLUMNS = RAW_EVENTS.names


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product attributes in the event contract's terms, one row per part."""
    part = _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_size").cast("bigint").alias("category_id"),
        F.concat_ws(
            ".", F.lower("p_type"), F.substring_index("p_name", " ", 1)
        ).alias("category_code"),
        F.when(F.col("p_brand") != "Brand#13", F.col("p_brand")).alias("brand"),
    )


def _order_type() -> Column:
    """Event type by shopper archetype; the first match wins."""
    shopper = F.col("o_custkey") % 10
    buys = (shopper >= 6) | (shopper.isin(4, 5) & (F.col("l_quantity") <= 4))
    return (
        F.when((F.col("l_returnflag") == "R") & buys, "purchase")
        .when((F.col("l_returnflag") == "A") & (shopper >= 2), "cart")
        .when((F.col("l_returnflag") == "N") | (F.col("l_linenumber") > 3), "view")
        .otherwise("remove_from_cart")
    )


def order_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events out of lineitem, orders and part: one event per order line."""
    lines = _read(
        spark, sf_dir, "lineitem",
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag",
    )
    orders = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn(
        "product_id", F.col("l_partkey")
    )
    return join_lookup(joined, _products(spark, sf_dir), "product_id").select(
        (
            F.col("o_orderdate").cast("timestamp")
            + F.make_dt_interval(mins=F.col("l_linenumber"))
        ).alias("event_time"),
        _order_type().alias("event_type"),
        "product_id",
        "category_id",
        "category_code",
        "brand",
        F.col("l_extendedprice").alias("price"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderkey").cast("string")).alias(
            "user_session"
        ),
    )


def click_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events out of the event stream and part; the product is the key inside `props`."""
    events = _read(
        spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props"
    )
    kind = F.col("event_type")
    clicks = events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        F.when(kind == "click", "cart")
        .when(kind == "signup", "remove_from_cart")
        .otherwise(kind)
        .alias("event_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
        F.col("value").alias("price"),
        "user_id",
        F.when(
            F.col("event_id") % 97 != 0,
            F.concat_ws("-", F.col("user_id"), F.to_date(F.col("ts"))),
        ).alias("user_session"),
    )
    return join_lookup(clicks, _products(spark, sf_dir), "product_id").select(
        *RAW_COLUMNS
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`order_raw` as lines of a CSV file, some with two fields missing, a spare one, or a price that is
    no number. The only column has the file's header for a name."""
    product, user = F.col("product_id"), F.col("user_id")
    price = F.when(user % 31 == 0, "n/a").otherwise(F.col("price").cast("string"))
    fields = [
        F.coalesce((price if c == "price" else F.col(c)).cast("string"), F.lit("")) for c in RAW_COLUMNS
    ]
    line = (
        F.when(product % 23 == 0, F.concat_ws(",", *fields[:-2]))
        .when(product % 29 == 0, F.concat_ws(",", *fields, F.lit("spare")))
        .otherwise(F.concat_ws(",", *fields))
    )
    return order_raw(spark, sf_dir).select(line.alias(",".join(RAW_COLUMNS)))


def dirty_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`order_raw` as an untyped feed would bring it: times and prices as text, some unreadable,
    missing ids, unknown types, untidy labels, and repeated events with a second price."""
    product, user = F.col("product_id"), F.col("user_id")
    code = F.col("category_code")
    text_time = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss 'UTC'")
    copies = F.when(product % 19 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    price = F.col("price") + F.col("copy")
    return (
        order_raw(spark, sf_dir)
        .withColumn("copy", F.explode(copies))
        .select(
            F.when(product % 211 != 0, text_time).otherwise("not a time").alias("event_time"),
            F.when(product % 17 == 0, "bounce").otherwise(F.col("event_type")).alias("event_type"),
            "product_id",
            "category_id",
            F.when(product % 97 == 0, None)
            .when(user % 7 == 0, F.substring_index(code, ".", 1))
            .when(user % 11 == 0, F.concat(code, F.lit(".x")))
            .otherwise(code)
            .alias("category_code"),
            F.when(user % 5 == 0, F.concat(F.lit("  "), F.upper("brand"), F.lit(" ")))
            .otherwise(F.col("brand"))
            .alias("brand"),
            F.when(product % 53 == 0, "n/a")
            .when(product % 59 == 0, (-price).cast("string"))
            .otherwise(price.cast("string"))
            .alias("price"),
            F.when(product % 101 != 0, user).alias("user_id"),
            "user_session",
        )
    )
