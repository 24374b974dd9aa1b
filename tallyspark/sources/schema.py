"""The event contract and the declared types of the star schema."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, order and types of the raw event file.
RAW_EVENTS = T.StructType(
    [
        T.StructField("event_time", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("category_code", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_session", T.StringType()),
    ]
)

# The funnel vocabulary.
EVENT_TYPES = ("view", "cart", "remove_from_cart", "purchase")

# Names of the star schema tables.
TABLES = (
    "fact_events",
    "user_metrics",
    "session_metrics",
    "product_metrics",
    "daily_activity",
)

# Declared column types, in declared order.
DECLARED = {
    "fact_events": """
        event_time timestamp, event_type string, product_id bigint, category_id bigint,
        category_code string, category string, subcategory string, brand string,
        price decimal(12,2), user_id bigint, user_session string, event_date date,
        event_month string
    """,
    "user_metrics": """
        user_id bigint, first_seen timestamp, last_seen timestamp, total_events int,
        n_views int, n_cart int, n_purchase int, n_sessions int, n_products int,
        n_brands int, n_categories int, customer_lifetime_value decimal(14,2),
        average_order_value decimal(12,2), n_orders int, cohort_month string,
        signup_date date, lifespan_days decimal(10,2), days_since_last_purchase decimal(10,2),
        days_since_last_seen decimal(10,2), purchase_frequency decimal(10,4),
        is_repeat_purchaser int, reached_view int, reached_cart int, reached_purchase int,
        reached_repeat int, is_churned int, view_to_cart_rate decimal(10,4),
        cart_to_purchase_rate decimal(10,4), avg_session_events decimal(10,4),
        preferred_brand string, preferred_category string
    """,
    "session_metrics": """
        user_session string, user_id bigint, session_start timestamp, session_end timestamp,
        n_events int, n_views int, n_cart int, n_purchase int, n_products int,
        revenue decimal(12,2), session_duration_proxy decimal(12,2), cart_abandonment int,
        converted int, session_date date
    """,
    "product_metrics": """
        product_id bigint, category string, brand string, avg_price decimal(12,2), n_views int,
        n_cart int, n_purchase int, n_unique_users int, revenue decimal(14,2),
        view_to_purchase_rate decimal(10,4)
    """,
    "daily_activity": """
        activity_date date, active_users int, sessions int, events int, purchases int,
        revenue decimal(14,2)
    """,
}


def declared_columns(table: str) -> list[tuple[str, str]]:
    """(column, type) pairs of a star schema table; commas inside `decimal(p,s)` are kept."""
    flat = " ".join(DECLARED[table].split())
    pairs = [part.strip().split(" ", 1) for part in flat.split(", ")]
    return [(name, kind) for name, kind in pairs]
