"""Derived tables: sessions, users, products, days, and the user-day rollup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import (
    days_between,
    exact,
    flag,
    is_type,
    money_sum,
    or_zero,
    per,
    seconds_between,
)

CHURN_DAYS = 30
REPEAT_ORDERS = 2

def _bought() -> Column:
    return is_type("purchase")


def _type_counts() -> dict[str, Column]:
    kinds = {"n_views": "view", "n_cart": "cart", "n_purchase": "purchase"}
    return {name: F.count_if(is_type(kind)) for name, kind in kinds.items()}


#: Microseconds from the year 1 to 1970, and what a user id is raised by: both make a key positive.
_YEAR_ONE, _ID_SHIFT = 62_135_596_800_000_000, 1 << 63


def _first_user() -> tuple[Column, Callable[[Column], Column]]:
    """A number that orders events by (time, user), and the user in it. Its least value is found by
    hash aggregation; `min_by` over a struct has no fixed-width buffer and sorts all events."""
    at = (F.unix_micros("event_time").cast("decimal(18,0)") + F.lit(_YEAR_ONE).cast("decimal(17,0)")).cast("decimal(18,0)")
    span = F.lit(str(1 << 64)).cast("decimal(20,0)")
    shifted = (F.col("user_id").cast("decimal(19,0)") + F.lit(str(_ID_SHIFT)).cast("decimal(19,0)")).cast("decimal(20,0)")
    key = (at * span).cast("decimal(38,0)") + shifted
    return key.cast("decimal(38,0)"), lambda least: (least % span - F.lit(str(_ID_SHIFT)).cast("decimal(19,0)")).cast("bigint")


#: Events of one key that a single task still takes whole.
HOT_EVENTS = 100_000


#: Groups of keys, by hash, that are counted before any key is: few enough to be summed up in each task.
KEY_GROUPS = 1 << 16


def _hot_keys(events: DataFrame, key: str, most: int) -> DataFrame:
    """The keys with more than so many events, as `_hot`. Keys are counted in groups first, by hash, and one
    by one only in groups that hold more than the limit together: a count of all keys would shuffle
    nearly a row an event where few events of a key lie in one task."""
    slim = events.select(F.col(key).alias("_hot"), F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS)).cast("int").alias("_group"))
    in_group = slim.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    full = F.broadcast(in_group.filter(F.col("_n") > most).select("_group"))
    counts = slim.join(full, "_group", "left_semi").groupBy("_hot").agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > most).select("_hot")


def _apart(events: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Events of the keys that have at most so many, and those of the hot keys. There are fewer of these
    than events divided by the limit, so they are broadcast."""
    hot = F.broadcast(_hot_keys(events, key, most))
    same = F.col(key).eqNullSafe(F.col("_hot"))
    return events.join(hot, same, "left_anti"), events.join(hot, same, "left_semi")


def _kind() -> Column:
    """The event type as the number of its count."""
    return F.when(is_type("view"), 1).when(is_type("cart"), 2).when(is_type("purchase"), 3).cast("tinyint")


def _kind_counts() -> list[Column]:
    return [F.count_if(F.col("kind") == i).alias(name) for i, name in enumerate(_type_counts(), 1)]


def _n_distinct(column: str) -> Column:
    """Different values, null being one, of a group that is bounded in size."""
    return F.size(F.collect_set(column)).cast("bigint") + F.max(F.col(column).isNull().cast("bigint"))


def session_metrics(events: DataFrame, hot: int = HOT_EVENTS) -> DataFrame:
    """One row per session. The session's user is that of its earliest event (lowest id on a
    tie; for times from the year 1 on). Events are shuffled once, by session, but for a session with more
    than `hot` events, as that of all session-less events may be: its products are counted in two
    phases, so it is combined before and after its shuffle."""
    few, many = _apart(events, "user_session", hot)
    sessions = _sessions_at_once(few).unionByName(_sessions_spread(many))
    return sessions.withColumns(
        {
            "session_duration_proxy": seconds_between(
                F.col("session_start"), F.col("session_end")
            ),
            "cart_abandonment": flag((F.col("n_cart") > 0) & (F.col("n_purchase") == 0)),
            "converted": flag(F.col("n_purchase") > 0),
            "session_date": F.to_date("session_start"),
        }
    )


def _sessions_at_once(events: DataFrame) -> DataFrame:
    order, user_in = _first_user()
    slim = events.select(
        "user_session", "event_time", "user_id", "product_id", _kind().alias("kind"), F.when(_bought(), exact()).alias("paid")
    ).repartition("user_session")
    return slim.groupBy("user_session").agg(
        user_in(F.min(order)).alias("user_id"),
        F.min("event_time").alias("session_start"),
        F.max("event_time").alias("session_end"),
        F.count(F.lit(1)).alias("n_events"),
        *_kind_counts(),
        F.size(F.collect_set("product_id")).cast("bigint").alias("n_products"),
        or_zero(F.sum("paid").cast("double")).alias("revenue"),
    )


def _sessions_spread(events: DataFrame) -> DataFrame:
    order, user_in = _first_user()
    return events.groupBy("user_session").agg(
        user_in(F.min(order)).alias("user_id"),
        F.min("event_time").alias("session_start"),
        F.max("event_time").alias("session_end"),
        F.count(F.lit(1)).alias("n_events"),
        *[count.alias(name) for name, count in _type_counts().items()],
        F.countDistinct("product_id").alias("n_products"),
        or_zero(money_sum(_bought())).alias("revenue"),
    )


def _per_facet(
    events: DataFrame, key: str, facets: list[str | tuple[str, ...]], measures: dict[str, Column]
) -> tuple[DataFrame, Callable[[str | tuple[str, ...]], Column]]:
    """Measures per (key, facet value), one grouping set per facet (a column, or columns taken
    together), and the test whether a row is of a facet's set.

    This is how distinct values per key are counted here. One scan; the shuffle is keyed by (key,
    value) and combined on the map side, so a key holding a large share of all events is spread
    over many tasks, and only one row per value reaches the step that groups by the key alone.
    """

    def members(facet: str | tuple[str, ...]) -> tuple[str, ...]:
        return (facet,) if isinstance(facet, str) else facet

    columns = [column for facet in facets for column in members(facet)]
    rows = events.groupingSets([[key, *members(f)] for f in facets], key, *columns).agg(
        F.grouping_id().alias("_set"), *[m.alias(name) for name, m in measures.items()]
    )

    def in_set(facet: str | tuple[str, ...]) -> Column:
        # grouping_id has a 1 bit for every column left out of the set; the key never is.
        left_out = ["0" if column in members(facet) else "1" for column in columns]
        return F.col("_set") == int("".join(left_out), 2)

    return rows, in_set


def user_facets(events: DataFrame, hot: int = HOT_EVENTS) -> DataFrame:
    """Per user: totals, distinct sessions / products / brands / categories, and the most
    frequent brand and category (lowest value on a tie).

    Events are shuffled once, by user, and a user is summed up where its events lie. A user with more than
    `hot` events is spread by (user, value) instead. That way for all users moved every event four
    times, with sums that spilled on the map side."""
    few, many = _apart(events, "user_id", hot)
    return _users_at_once(few).unionByName(_users_spread(many))


def _users_at_once(events: DataFrame) -> DataFrame:
    slim = events.select(
        "user_id", "event_time", _kind().alias("kind"), F.when(_bought(), exact()).alias("paid"),
        "user_session", "product_id", "brand", "category",
    ).repartition("user_id")

    def most_frequent(facet: str) -> Column:
        # Null is a value like others, the lowest one. A mode over structs takes copies of one for different.
        value = F.mode(F.coalesce(F.concat(F.lit("1"), facet), F.lit("0")), True)
        return F.when(value != "0", F.substr(value, F.lit(2)))

    return slim.groupBy("user_id").agg(
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
        F.count(F.lit(1)).alias("total_events"),
        *_kind_counts(),
        _n_distinct("user_session").alias("n_sessions"),
        _n_distinct("product_id").alias("n_products"),
        _n_distinct("brand").alias("n_brands"),
        _n_distinct("category").alias("n_categories"),
        F.sum("paid").cast("double").alias("spent"),
        F.max(F.when(F.col("kind") == 3, F.col("event_time"))).alias("last_purchase_time"),
        most_frequent("brand").alias("preferred_brand"),
        most_frequent("category").alias("preferred_category"),
    )


def _users_spread(events: DataFrame) -> DataFrame:
    per_value, in_set = _per_facet(
        events,
        "user_id",
        ["user_session", "product_id", "brand", "category"],
        {
            "first_seen": F.min("event_time"),
            "last_seen": F.max("event_time"),
            "total_events": F.count(F.lit(1)),
            **_type_counts(),
            "spent": F.sum(F.when(_bought(), exact())),
            "last_purchase_time": F.max(F.when(_bought(), F.col("event_time"))),
        },
    )

    def once(column: str) -> Column:
        return F.when(in_set("user_session"), F.col(column))

    def most_frequent(facet: str) -> Column:
        return F.min(F.when(in_set(facet), F.struct(-F.col("total_events"), F.col(facet))))[facet]

    return per_value.groupBy("user_id").agg(
        F.min(once("first_seen")).alias("first_seen"),
        F.max(once("last_seen")).alias("last_seen"),
        *[
            F.sum(once(c)).alias(c)
            for c in ("total_events", "n_views", "n_cart", "n_purchase")
        ],
        F.count_if(in_set("user_session")).alias("n_sessions"),
        F.count_if(in_set("product_id")).alias("n_products"),
        F.count_if(in_set("brand")).alias("n_brands"),
        F.count_if(in_set("category")).alias("n_categories"),
        F.sum(once("spent")).cast("double").alias("spent"),
        F.max(once("last_purchase_time")).alias("last_purchase_time"),
        most_frequent("brand").alias("preferred_brand"),
        most_frequent("category").alias("preferred_category"),
    )


def _recency(latest: Column) -> dict[str, Column]:
    """What depends on the latest event of all: days since a user's last purchase and last event,
    and the churn label."""
    since_seen = days_between(F.col("last_seen"), latest)
    return {
        "days_since_last_purchase": days_between(F.col("last_purchase_time"), latest),
        "days_since_last_seen": since_seen,
        "is_churned": flag(since_seen > CHURN_DAYS),
    }


def with_recency(users: DataFrame, latest: Column) -> DataFrame:
    """The user table as of another latest event."""
    return users.withColumn("_latest", latest).withColumns(_recency(F.col("_latest"))).drop("_latest")


def user_metrics(events: DataFrame, latest: Column | None = None) -> DataFrame:
    """One row per user: counts, revenue, recency against the latest event of all (of `events` unless
    given), funnel flags, churn label, engagement ratios and preferences."""
    latest = events.agg(F.max("event_time")).scalar() if latest is None else latest
    orders = F.col("n_purchase")
    sessions = F.greatest("n_sessions", F.lit(1))
    recency = _recency(F.col("_latest"))
    return (
        user_facets(events)
        .withColumn("_latest", latest)
        .select(
            "user_id",
            "first_seen",
            "last_seen",
            "total_events",
            "n_views",
            "n_cart",
            "n_purchase",
            "n_sessions",
            "n_products",
            "n_brands",
            "n_categories",
            or_zero(F.col("spent")).alias("customer_lifetime_value"),
            or_zero(F.col("spent") / F.nullif(orders, F.lit(0))).alias("average_order_value"),
            orders.alias("n_orders"),
            F.date_format("first_seen", "yyyy-MM").alias("cohort_month"),
            F.to_date("first_seen").alias("signup_date"),
            F.round(days_between(F.col("first_seen"), F.col("last_seen")), 2).alias(
                "lifespan_days"
            ),
            "last_purchase_time",
            recency["days_since_last_purchase"].alias("days_since_last_purchase"),
            recency["days_since_last_seen"].alias("days_since_last_seen"),
            (orders / sessions).alias("purchase_frequency"),
            flag(orders >= REPEAT_ORDERS).alias("is_repeat_purchaser"),
            flag(F.col("n_views") > 0).alias("reached_view"),
            flag(F.col("n_cart") > 0).alias("reached_cart"),
            flag(orders >= 1).alias("reached_purchase"),
            flag(orders >= REPEAT_ORDERS).alias("reached_repeat"),
            recency["is_churned"].alias("is_churned"),
            per("n_cart", F.col("n_views")).alias("view_to_cart_rate"),
            per("n_purchase", F.col("n_cart")).alias("cart_to_purchase_rate"),
            per("total_events", F.col("n_sessions")).alias("avg_session_events"),
            "preferred_brand",
            "preferred_category",
        )
    )


def product_facets(events: DataFrame, hot: int = HOT_EVENTS) -> DataFrame:
    """Per product: totals, distinct users, and its category and brand in two readings: those of
    the earliest event (lowest value on a tie) and the highest ones.

    Like users: events are shuffled once, by product, and only a product with more than `hot` events is
    spread by (product, value)."""
    few, many = _apart(events, "product_id", hot)
    return _products_at_once(few).unionByName(_products_spread(many))


def _products_at_once(events: DataFrame) -> DataFrame:
    labels = ("category", "brand")
    slim = events.select(
        "product_id", "user_id", "event_time", _kind().alias("kind"), exact().alias("asked"), F.col("price").isNotNull().alias("priced"), *labels
    ).repartition("product_id")
    return slim.groupBy("product_id").agg(
        *[F.min(F.struct("event_time", label))[label].alias(f"first_{label}") for label in labels],
        *[F.max(label).alias(f"highest_{label}") for label in labels],
        (F.sum("asked").cast("double") / F.nullif(F.count_if("priced"), F.lit(0))).alias("avg_price"),
        *_kind_counts(),
        _n_distinct("user_id").alias("n_unique_users"),
        F.sum(F.when(F.col("kind") == 3, F.col("asked"))).cast("double").alias("spent"),
    )


def _products_spread(events: DataFrame) -> DataFrame:
    """The labels come from a grouping set of their own, a row or two per product: as an aggregate
    over the events their text would turn the whole aggregation into a sorting one."""
    labels = ("category", "brand")
    per_value, in_set = _per_facet(
        events,
        "product_id",
        ["user_id", labels],
        {
            "first_seen": F.min("event_time"),
            "priced": F.count("price"),
            "asked": F.sum(exact()),
            **_type_counts(),
            "spent": F.sum(F.when(_bought(), exact())),
        },
    )

    def first(label: str) -> Column:
        return F.min(F.when(in_set(labels), F.struct("first_seen", label)))[label]

    def once(column: str) -> Column:
        return F.sum(F.when(in_set("user_id"), F.col(column)))

    return per_value.groupBy("product_id").agg(
        *[first(label).alias(f"first_{label}") for label in labels],
        *[F.max(F.when(in_set(labels), F.col(c))).alias(f"highest_{c}") for c in labels],
        (once("asked").cast("double") / F.nullif(once("priced"), F.lit(0))).alias("avg_price"),
        *[once(name).alias(name) for name in _type_counts()],
        F.count_if(in_set("user_id")).alias("n_unique_users"),
        once("spent").cast("double").alias("spent"),
    )


def product_metrics(events: DataFrame) -> DataFrame:
    """One row per product, labelled by its earliest event; the mean price is over all events, not
    only purchases."""
    return product_facets(events).select(
        "product_id",
        F.col("first_category").alias("category"),
        F.col("first_brand").alias("brand"),
        "avg_price",
        *_type_counts(),
        "n_unique_users",
        or_zero(F.col("spent")).alias("revenue"),
        per("n_purchase", F.col("n_views")).alias("view_to_purchase_rate"),
    )


def daily_activity(events: DataFrame) -> DataFrame:
    """One row per date with activity, in date order."""
    per_value, in_set = _per_facet(
        events,
        "event_date",
        ["user_id", "user_session"],
        {
            "n": F.count(F.lit(1)),
            "bought": F.count_if(_bought()),
            "spent": F.sum(F.when(_bought(), exact())),
        },
    )

    def total(column: str) -> Column:
        return F.sum(F.when(in_set("user_id"), F.col(column)))

    return (
        per_value.groupBy(F.col("event_date").alias("activity_date"))
        .agg(
            F.count_if(in_set("user_id")).alias("active_users"),
            F.count_if(in_set("user_session")).alias("sessions"),
            total("n").alias("events"),
            total("bought").alias("purchases"),
            or_zero(total("spent").cast("double")).alias("revenue"),
        )
        .orderBy("activity_date")
    )


def user_days(events: DataFrame) -> DataFrame:
    """One row per user and active date: the rollup that the activity, retention and cohort
    operators read instead of the events. A user has at most one row per calendar day, so
    windows per user stay small however many events the user has."""
    return events.groupBy("user_id", "event_date").agg(F.count(F.lit(1)).alias("n_events"))
