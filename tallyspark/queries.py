"""Registered queries: name -> callable (spark, sf_dir) -> DataFrame.

`orders` is the shop history, `clicks` the dense month; see `sources.adapters`. Queries over the
derived tables read the written ones of `plans.mart`, the cleaning steps read the raw adapters.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.stats import pct_change, safe_corr
from tallyspark.operators import (
    activity,
    adoption,
    bitmaps,
    churn,
    clean,
    cohort,
    experiments,
    filters,
    funnel,
    metrics,
    models,
    rootcause,
    segments,
    snapshot,
    tables,
    warehouse,
)
from tallyspark.plans.mart import Mart, mart
from tallyspark.plans.shared import new_path
from tallyspark.sources import store
from tallyspark.sources.adapters import RAW_COLUMNS, dirty_raw, order_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EXPERIMENTS = ("checkout", "search", "pricing")
FILTER = filters.Filters(
    start=dt.date(1996, 3, 1), end=dt.date(1999, 8, 31),
    categories=("economy", "promo", "small"),
    brands=("brand#1", "brand#2", "brand#3", "brand#4", "brand#5", "unknown"),
    min_revenue=100000.0,
)


def query(name: str, source: str = "orders"):
    """Register a function of a mart."""

    def register(build: Callable[[Mart], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(mart(spark, sf_dir, source))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        return build

    return register


# --- cleaning --------------------------------------------------------------------------------

KEYS = ["event_time", "event_type", "product_id", "user_id", "user_session"]


def _dirty(m: Mart) -> DataFrame:
    return dirty_raw(m.spark, m.sf_dir)


def _timed(m: Mart) -> DataFrame:
    return _dirty(m).transform(clean.normalize_timestamps)


def _filled(m: Mart) -> DataFrame:
    return (
        _timed(m)
        .transform(clean.drop_incomplete)
        .transform(clean.fill_categoricals)
        .transform(clean.coerce_price)
    )


@query("read_events_csv")
def _(m):
    path = new_path(m.spark, "events-csv")
    store.write_events_csv(m.raw, path)
    return store.read_events_csv(m.spark, path)


def _lines_csv(m: Mart) -> str:
    """A CSV file with malformed lines; written with another separator, so that lines stay unquoted."""
    path = new_path(m.spark, "lines-csv")
    order_lines(m.spark, m.sf_dir).write.option("header", True).option("sep", "\x01").csv(path)
    return path


@query("read_events_csv_intact")
def _(m):
    return store.read_events_csv(m.spark, _lines_csv(m), on_malformed="drop")


@query("malformed_lines")
def _(m):
    return store.malformed_lines(m.spark, _lines_csv(m)).groupBy("problem").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars")
    )


@query("normalize_timestamps")
def _(m):
    return _timed(m).select(*KEYS)


@query("drop_incomplete")
def _(m):
    return _timed(m).transform(clean.drop_incomplete).select(*KEYS)


@query("fill_categoricals")
def _(m):
    return _dirty(m).transform(clean.fill_categoricals).select(
        "product_id", "user_id", "brand", "category_code", "user_session"
    )


@query("coerce_price")
def _(m):
    return _dirty(m).transform(clean.coerce_price).select("product_id", "user_id", "price")


@query("split_category")
def _(m):
    filled = _dirty(m).transform(clean.fill_categoricals)
    return filled.transform(clean.split_category).select(
        "product_id", "user_id", "category_code", "category", "subcategory"
    )


@query("calendar_columns")
def _(m):
    return _timed(m).transform(clean.calendar_columns).select(
        "product_id", "user_id", "event_time", "event_date", "event_month"
    )


@query("dedup_events")
def _(m):
    return _filled(m).transform(clean.dedup_events).select(*RAW_COLUMNS)


@query("filter_vocabulary")
def _(m):
    return _filled(m).transform(clean.filter_vocabulary).select(*RAW_COLUMNS)


@query("clean_events")
def _(m):
    return clean.clean_events(_dirty(m))


@query("clean_events_clicks", "clicks")
def _(m):
    return m.events


@query("data_quality_report")
def _(m):
    return clean.data_quality_report(_dirty(m))


# --- tables ----------------------------------------------------------------------------------


def _sizes(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counts = [
        frame.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, frame in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query("session_metrics")
def _(m):
    return tables.session_metrics(m.events)


@query("session_metrics_clicks", "clicks")
def _(m):
    return tables.session_metrics(m.events)


@query("user_metrics")
def _(m):
    return tables.user_metrics(m.events)


@query("user_metrics_clicks", "clicks")
def _(m):
    return tables.user_metrics(m.events)


@query("user_counts")
def _(m):
    return m.users.select(
        "user_id", "first_seen", "last_seen", "total_events", "n_views", "n_cart", "n_purchase",
        "n_sessions", "n_products", "n_brands", "n_categories",
    )


@query("user_revenue")
def _(m):
    return m.users.select("user_id", "customer_lifetime_value", "average_order_value", "n_orders")


@query("user_recency")
def _(m):
    return m.users.select(
        "user_id", "cohort_month", "signup_date", "lifespan_days", "last_purchase_time",
        "days_since_last_purchase", "days_since_last_seen",
    )


@query("user_funnel_flags")
def _(m):
    return m.users.select(
        "user_id", "purchase_frequency", "is_repeat_purchaser", "reached_view", "reached_cart",
        "reached_purchase", "reached_repeat",
    )


@query("churn_label")
def _(m):
    return m.users.select("user_id", "days_since_last_seen", "is_churned")


@query("engagement_ratios")
def _(m):
    return m.users.select(
        "user_id", "view_to_cart_rate", "cart_to_purchase_rate", "avg_session_events"
    )


@query("preferred_value")
def _(m):
    return m.users.select("user_id", "preferred_brand", "preferred_category")


@query("product_metrics")
def _(m):
    return tables.product_metrics(m.events)


@query("daily_activity")
def _(m):
    return tables.daily_activity(m.events)


@query("daily_activity_clicks", "clicks")
def _(m):
    return tables.daily_activity(m.events)


@query("write_tables_parquet")
def _(m):
    folder = new_path(m.spark, "tables")
    store.write_tables_parquet(store.star_schema(m.events), folder)
    return _sizes(store.read_tables_parquet(m.spark, folder))


@query("load_tables")
def _(m):
    folder = new_path(m.spark, "tables")
    store.write_tables_parquet(store.star_schema(m.events), folder)
    frames = store.load_tables(m.spark, folder)
    return frames["user_metrics"].join(
        frames["fact_events"].groupBy("user_id").agg(F.max("event_month").alias("last_month")),
        "user_id",
    ).select("user_id", "total_events", "customer_lifetime_value", "last_month")


@query("load_tables_all")
def _(m):
    """What each of the five loaded tables says about events and money in total."""
    folder = new_path(m.spark, "tables")
    store.write_tables_parquet(store.star_schema(m.events), folder)
    frames = store.load_tables(m.spark, folder)
    paid = F.when(F.col("event_type") == "purchase", F.col("price"))
    said = {
        "fact_events": (F.lit(1), paid),
        "user_metrics": (F.col("total_events"), F.col("customer_lifetime_value")),
        "session_metrics": (F.col("n_events"), F.col("revenue")),
        "product_metrics": (F.col("n_views") + F.col("n_cart") + F.col("n_purchase"), F.col("revenue")),
        "daily_activity": (F.col("events"), F.col("revenue")),
    }
    rows = [
        frames[name].agg(
            F.sum(events).alias("n_events"), F.sum(money.cast("decimal(18,2)")).cast("double").alias("revenue")
        ).select(F.lit(name).alias("table_name"), "n_events", "revenue")
        for name, (events, money) in said.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@query("star_schema_tables")
def _(m):
    location = new_path(m.spark, "star")
    database = "tally_" + location.rsplit("-", 1)[-1]
    store.create_star_schema(m.spark, store.star_schema(m.events), database, location)
    frames = {name: m.spark.table(f"{database}.{name}") for name in store.TABLES}
    money = {
        "fact_events": "price", "user_metrics": "customer_lifetime_value",
        "session_metrics": "revenue", "product_metrics": "revenue", "daily_activity": "revenue",
    }
    rows = [
        frame.agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(money[name]).cast("double").alias("money")
        ).select(F.lit(name).alias("table_name"), "n_rows", "money")
        for name, frame in frames.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@query("etl_run")
def _(m):
    return _sizes(store.etl_run(m.raw, new_path(m.spark, "etl")))


@query("etl_append")
def _(m):
    return _sizes(m.appended)


def _register_appended(name: str, table: str) -> None:
    @query(name)
    def _(m):
        return m.appended[table]


for _part, _table in zip(("events", "users", "sessions", "products", "days"), store.TABLES):
    _register_appended(f"etl_append_{_part}", _table)


@query("read_sql_params")
def _(m):
    m.events.createOrReplaceTempView("tally_events")
    return store.read_sql(
        m.spark,
        """
        SELECT category, count(*) AS n_events, count(DISTINCT user_id) AS n_users
        FROM tally_events
        WHERE event_type = :kind AND event_date >= :since AND price >= :floor
        GROUP BY category
        """,
        {"kind": "purchase", "since": dt.date(1998, 1, 1), "floor": 20000.0},
    )


# --- warehouse variants ----------------------------------------------------------------------


@query("sql_active_users", "clicks")
def _(m):
    return warehouse.sql_active_users(m.days)


@query("sql_dau")
def _(m):
    return warehouse.sql_dau(m.days)


@query("sql_wau")
def _(m):
    return warehouse.sql_wau(m.days)


@query("sql_mau")
def _(m):
    return warehouse.sql_mau(m.days)


@query("sql_revenue_summary")
def _(m):
    return warehouse.sql_revenue_summary(m.events)


@query("sql_user_value")
def _(m):
    return warehouse.sql_user_value(m.events)


@query("sql_session_metrics")
def _(m):
    return warehouse.sql_session_metrics(m.events)


@query("sql_session_rates", "clicks")
def _(m):
    return warehouse.sql_session_rates(warehouse.sql_session_metrics(m.events))


@query("sql_product_metrics")
def _(m):
    return warehouse.sql_product_metrics(m.events)


@query("sql_top_brands")
def _(m):
    return warehouse.sql_top_brands(m.events)


@query("sql_category_revenue")
def _(m):
    return warehouse.sql_category_revenue(m.events)


@query("sql_funnel")
def _(m):
    return warehouse.sql_funnel(m.events)


@query("sql_monthly_cohorts")
def _(m):
    return warehouse.sql_monthly_cohorts(m.days)


@query("sql_day_n_retention", "clicks")
def _(m):
    return warehouse.sql_day_n_retention(m.days)


@query("sql_churn_features")
def _(m):
    return warehouse.sql_churn_features(m.events)


@query("sql_churn_by_cohort")
def _(m):
    return warehouse.sql_churn_by_cohort(m.users)


# --- slicing ---------------------------------------------------------------------------------


def _filtered(m: Mart) -> DataFrame:
    return filters.filter_events(m.clustered, FILTER)


def _seen(m: Mart) -> DataFrame:
    """What the filters leave of the users' slices: enough for who has such events."""
    return filters.filter_events(m.slices, FILTER)


@query("filter_events")
def _(m):
    return _filtered(m)


@query("filter_options")
def _(m):
    return filters.filter_options(m.events)


@query("filtered_users")
def _(m):
    return filters.filtered_users(m.users, _seen(m), FILTER)


@query("filtered_sessions")
def _(m):
    return filters.filtered_sessions(m.sessions, _seen(m))


# --- executive metrics -----------------------------------------------------------------------


def _kpis(m: Mart) -> DataFrame:
    return metrics.executive_kpis(m.days, m.users)


@query("executive_kpis")
def _(m):
    return _kpis(m)


@query("executive_kpis_clicks", "clicks")
def _(m):
    return _kpis(m)


@query("executive_kpis_filtered")
def _(m):
    users = filters.filtered_users(m.users, _seen(m), FILTER)
    return metrics.executive_kpis(_seen(m).select("user_id", "event_date").distinct(), users)


@query("daily_active_trend", "clicks")
def _(m):
    return metrics.daily_active_trend(m.days)


@query("monthly_growth_trend")
def _(m):
    return metrics.monthly_growth_trend(m.days)


@query("revenue_trend")
def _(m):
    return metrics.revenue_trend(m.events)


@query("retention_trend")
def _(m):
    return activity.retention_trend(m.activity)


@query("retention_trend_clicks", "clicks")
def _(m):
    return activity.retention_trend(m.activity)


@query("churn_trend")
def _(m):
    return metrics.churn_trend(activity.retention_trend(m.activity))


@query("window_active", "clicks")
def _(m):
    windows = {
        "latest_7": metrics.window_active(m.days, 7),
        "latest_30": metrics.window_active(m.days, 30),
        "to_jan_20": metrics.window_active(m.days, 14, dt.date(2024, 1, 20)),
    }
    rows = [w.select(F.lit(n).alias("window_name"), "active_users") for n, w in windows.items()]
    return reduce(DataFrame.unionByName, rows)


@query("pct_change", "clicks")
def _(m):
    from pyspark.sql import Window

    daily = metrics.daily_active_trend(m.days)
    before = F.lag("dau").over(Window.orderBy("date"))
    return daily.select("date", "dau", pct_change(F.col("dau"), before).alias("change_pct"))


@query("kpi_deltas", "clicks")
def _(m):
    return metrics.kpi_deltas(
        m.days, metrics.revenue_trend(m.events), activity.retention_trend(m.activity)
    )


@query("kpi_deltas_orders")
def _(m):
    return metrics.kpi_deltas(
        m.days, metrics.revenue_trend(m.events), activity.retention_trend(m.activity)
    )


@query("kpi_sparks")
def _(m):
    return metrics.kpi_sparks(
        m.days, metrics.revenue_trend(m.events), activity.retention_trend(m.activity)
    )


@query("retention_churn_join")
def _(m):
    kept = activity.retention_trend(m.activity)
    return metrics.retention_churn_join(kept, metrics.churn_trend(kept))


@query("rolling_active_users", "clicks")
def _(m):
    return metrics.rolling_active_users(m.days)


@query("rolling_active_users_orders")
def _(m):
    return metrics.rolling_active_users(m.days)


@query("rolling_active_bitmaps", "clicks")
def _(m):
    return bitmaps.rolling_active_users(m.spark, m.bitmaps)


@query("rolling_active_bitmaps_orders")
def _(m):
    return bitmaps.rolling_active_users(m.spark, m.bitmaps)


@query("window_active_bitmaps", "clicks")
def _(m):
    windows = {
        "latest_7": bitmaps.active_users(m.spark, m.bitmaps, 7),
        "latest_30": bitmaps.active_users(m.spark, m.bitmaps, 30),
        "to_jan_20": bitmaps.active_users(m.spark, m.bitmaps, 14, dt.date(2024, 1, 20)),
    }
    rows = [w.select(F.lit(n).alias("window_name"), "active_users") for n, w in windows.items()]
    return reduce(DataFrame.unionByName, rows)


# --- funnel ----------------------------------------------------------------------------------


@query("funnel_stages")
def _(m):
    return funnel.funnel_stages(m.users)


@query("funnel_summary")
def _(m):
    return funnel.funnel_summary(funnel.funnel_stages(m.users))


@query("funnel_impact")
def _(m):
    stages = funnel.funnel_stages(m.users)
    return funnel.funnel_impact(stages, funnel.funnel_summary(stages), _kpis(m))


@query("funnel_stage_impact")
def _(m):
    return funnel.funnel_stage_impact(funnel.funnel_stages(m.users), _kpis(m))


# --- cohorts ---------------------------------------------------------------------------------


def _retention(m: Mart) -> DataFrame:
    return cohort.retention_matrix(activity.cohort_activity(m.activity))


@query("cohort_matrix")
def _(m):
    return _retention(m)


def _cells(wide: DataFrame, key: str, of: Callable[[str], Column]) -> DataFrame:
    """A wide matrix whose columns follow from the data, as one text per row."""
    return wide.select(key, F.concat_ws(",", *[F.coalesce(of(f"`{c}`"), F.lit("")) for c in wide.columns[1:]]).alias("cells"))


def _long(wide: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """Every cell of a wide matrix as a row, empty ones included."""
    return wide.unpivot([key], wide.columns[1:], column, value)


@query("cohort_matrix_wide")
def _(m):
    """Every month number from 0 on, one row per cohort."""
    return _cells(cohort.wide_matrix(_retention(m)), "cohort", lambda c: F.col(c).cast("string"))


@query("cohort_matrix_all")
def _(m):
    """Every cell of the wide matrix, null without activity."""
    long = _long(cohort.wide_matrix(_retention(m)), "cohort", "month_number", "retention_pct")
    return long.withColumn("month_number", F.col("month_number").cast("bigint"))


@query("cohort_sizes")
def _(m):
    return activity.cohort_sizes(m.activity)


@query("day_n_retention", "clicks")
def _(m):
    return activity.day_n_retention(m.activity)


@query("day_n_retention_orders")
def _(m):
    return activity.day_n_retention(m.activity)


@query("cohort_summary")
def _(m):
    return cohort.cohort_summary(_retention(m), activity.day_n_retention(m.activity))


@query("retention_benchmark", "clicks")
def _(m):
    return cohort.retention_benchmark(activity.day_n_retention(m.activity))


# --- segments --------------------------------------------------------------------------------


def _segmented(m: Mart) -> DataFrame:
    return segments.assign_segments(m.users, m.cuts)


@query("assign_segments")
def _(m):
    return _segmented(m).select(
        "user_id", "customer_lifetime_value", "purchase_frequency", "is_churned", "segment"
    )


@query("segment_summary")
def _(m):
    return segments.segment_summary(_segmented(m))


@query("preference_breakdown")
def _(m):
    both = []
    for by in ("preferred_category", "preferred_brand"):
        top = segments.preference_breakdown(m.users, by, segments.TOP_PREFERENCES)
        both.append(
            top.select(F.lit(by).alias("preference"), F.col(by).alias("choice"), "users", "revenue")
        )
    return both[0].unionByName(both[1])


@query("segment_highlights")
def _(m):
    return segments.segment_highlights(segments.segment_summary(_segmented(m)))


# --- adoption --------------------------------------------------------------------------------


@query("adoption_table")
def _(m):
    return adoption.adoption_table(m.users).drop("position")


@query("safe_corr")
def _(m):
    always = F.lit(1)
    return m.users.agg(
        F.round(safe_corr(F.col("n_views"), F.col("n_purchase")), 6).alias("views_purchases"),
        F.round(safe_corr(F.col("n_orders"), F.col("days_since_last_purchase")), 6).alias(
            "orders_recency"
        ),
        safe_corr(always, F.col("n_purchase")).alias("constant"),
    )


@query("feature_value_ranking")
def _(m):
    return adoption.feature_value_ranking(adoption.adoption_table(m.users))


# --- root cause ------------------------------------------------------------------------------


def _revenue_drops(m: Mart, threshold: float) -> DataFrame:
    return rootcause.detect_drops(
        metrics.revenue_trend(m.events), "date", "revenue", "revenue", threshold
    )


def _retention_drops(m: Mart, threshold: float) -> DataFrame:
    return rootcause.detect_drops(
        activity.retention_trend(m.activity), "week", "retention_pct", "retention", threshold
    )


@query("detect_drops")
def _(m):
    return _revenue_drops(m, rootcause.DROP_THRESHOLD).unionByName(
        _retention_drops(m, rootcause.DROP_THRESHOLD)
    )


@query("worst_drop")
def _(m):
    limit = rootcause.PAGE_THRESHOLD
    return rootcause.worst_drop(_revenue_drops(m, limit), _retention_drops(m, limit))


def _drivers(m: Mart) -> DataFrame:
    return rootcause.correlation_drivers(m.users)


@query("correlation_drivers")
def _(m):
    return _drivers(m).select("feature", F.round("correlation", 6).alias("correlation"))


@query("segment_impact")
def _(m):
    return rootcause.segment_impact(m.events)


@query("segment_matrix")
def _(m):
    """Every month with purchases, one row per category."""
    return _cells(rootcause.segment_matrix(m.events), "category", lambda c: F.col(c).cast("decimal(28,2)").cast("string"))


@query("segment_matrix_all")
def _(m):
    """Every cell of the wide matrix, 0 without revenue."""
    return _long(rootcause.segment_matrix(m.events), "category", "event_month", "revenue")


@query("segment_impact_brand")
def _(m):
    return rootcause.segment_impact(m.events, "brand")


def _causes(m: Mart) -> DataFrame:
    return rootcause.rank_causes(
        metrics.revenue_trend(m.events), _drivers(m), rootcause.segment_impact(m.events)
    )


@query("rank_causes")
def _(m):
    return _causes(m).withColumn("impact", F.round("impact", 4))


@query("rank_causes_clicks", "clicks")
def _(m):
    return _causes(m).withColumn("impact", F.round("impact", 4))


@query("cause_severity")
def _(m):
    return rootcause.cause_severity(_causes(m)).withColumn("impact", F.round("impact", 4))


# --- experiments -----------------------------------------------------------------------------


def _assigned(m: Mart) -> DataFrame:
    return experiments.ab_assign(m.users, EXPERIMENTS)


@query("ab_assign")
def _(m):
    return _assigned(m)


@query("ab_analyze")
def _(m):
    return experiments.ab_analyze(_assigned(m))


@query("ab_confidence")
def _(m):
    return experiments.ab_confidence(experiments.ab_analyze(_assigned(m)))


@query("ab_annual_impact")
def _(m):
    return experiments.ab_annual_impact(experiments.ab_analyze(_assigned(m)))


@query("sample_size_plan")
def _(m):
    return experiments.sample_size_plan(m.users, "preferred_category")


# --- churn -----------------------------------------------------------------------------------


def _fixed_scores(m: Mart) -> DataFrame:
    """A score by formula, so the measures can be checked exactly."""
    score = F.round((1 + F.col("n_cart")) / (1.0 + F.col("total_events")), 4)
    return m.users.select("user_id", F.col("is_churned").alias("label"), score.alias("score"))


@query("churn_feature_matrix")
def _(m):
    return churn.churn_feature_matrix(m.users)


@query("stratified_split")
def _(m):
    split = churn.stratified_split(m.users.select("user_id", churn.TARGET))
    return split.select("user_id", churn.TARGET, "is_test")


@query("class_weights")
def _(m):
    return churn.class_weights(m.users)


@query("auc")
def _(m):
    return churn.auc(_fixed_scores(m))


@query("roc_curve")
def _(m):
    return churn.roc_curve(_fixed_scores(m))


@query("confusion_matrix")
def _(m):
    return churn.confusion_matrix(_fixed_scores(m), 0.25)


@query("classification_report")
def _(m):
    return churn.classification_report(churn.confusion_matrix(_fixed_scores(m), 0.25))


def _quality(m: Mart, *names: str) -> DataFrame:
    """Quality of models on the held-out users."""
    return churn.compare({name: m.scored(name) for name in names})


@query("churn_logreg")
def _(m):
    return _quality(m, churn.LOGISTIC)


@query("logreg_coefficients")
def _(m):
    """By Newton's method, next to the fitted model's."""
    fitted = models.fitted_coefficients(m.model(churn.LOGISTIC))
    table = models.coefficient_table(m.spark, m.prepared.names, m.newton[0], fitted)
    return table.withColumn("coefficient", F.round("coefficient", 6))


@query("logreg_scores")
def _(m):
    """Held-out users by the coefficients of Newton's method."""
    scores = models.logistic_scores(m.prepared.test, m.prepared.names, *m.newton)
    return scores.withColumn("score", F.round("score", 6))


def _table_scores(m: Mart, name: str) -> DataFrame:
    return models.tree_scores(m.prepared.test, m.prepared.names, m.nodes(name), name == churn.BOOSTED)


@query("forest_table_scores")
def _(m):
    """Whether the forest's node table gives every held-out user the model's score."""
    return models.score_agreement(m.scored(churn.FOREST), _table_scores(m, churn.FOREST))


@query("boosted_table_scores")
def _(m):
    """Whether the boosted trees' node table gives every held-out user the model's score."""
    return models.score_agreement(m.scored(churn.BOOSTED), _table_scores(m, churn.BOOSTED))


@query("tree_importances")
def _(m):
    """Whether each tree model's importances equal the gains summed over its node table."""

    def of(name: str) -> DataFrame:
        fitted = churn.feature_importance(m.spark, m.model(name), m.prepared.names)
        summed = models.tree_importance(m.nodes(name), m.prepared.names, name == churn.BOOSTED)
        return models.importance_agreement(fitted, summed).select(F.lit(name).alias("model"), "*")

    return of(churn.FOREST).unionByName(of(churn.BOOSTED))


@query("churn_random_forest")
def _(m):
    return _quality(m, churn.FOREST)


@query("churn_gbt")
def _(m):
    return _quality(m, churn.BOOSTED)


@query("train_compare")
def _(m):
    return m.compared


def _of_each(m: Mart, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A measure of every model on the held-out users, with the model's name."""
    parts = [measure(m.scored(name)).select(F.lit(name).alias("model"), "*") for name in churn.MODELS]
    return reduce(DataFrame.unionByName, parts)


@query("model_roc")
def _(m):
    return _of_each(m, churn.roc_curve)


@query("model_confusion")
def _(m):
    return _of_each(m, churn.confusion_matrix)


@query("model_report")
def _(m):
    return _of_each(m, lambda scored: churn.classification_report(churn.confusion_matrix(scored)))


@query("model_test_users")
def _(m):
    """Held-out users of each model and class, from its confusion matrix."""
    cells = _of_each(m, churn.confusion_matrix)
    return cells.groupBy("model", "actual").agg(F.sum("n").alias("n_users"))


@query("feature_importance")
def _(m):
    """Of the best model."""
    return churn.feature_importance(m.spark, m.model(m.best), m.prepared.names)


@query("score_users")
def _(m):
    """By the best model."""
    return churn.score_users(m.model(m.best), m.users)


@query("score_coverage")
def _(m):
    """Users, and how many of them have one score between 0 and 1."""
    scores = churn.score_users(m.model(m.best), m.users)
    valid = scores.filter(F.col("churn_probability").between(0, 1)).select("user_id").distinct()
    return m.users.join(valid.withColumn("scored", F.lit(True)), "user_id", "left").agg(
        F.count(F.lit(1)).alias("n_users"), F.count("scored").alias("n_scored")
    )


@query("top_risk_users")
def _(m):
    """By the best model."""
    return churn.top_risk_users(churn.score_users(m.model(m.best), m.users), m.users)


@query("revenue_at_risk")
def _(m):
    return churn.revenue_at_risk(m.users)


@query("churn_overview")
def _(m):
    return churn.churn_overview(m.users)


@query("driver_actions")
def _(m):
    actions = churn.driver_actions(_drivers(m), churn.revenue_at_risk(m.users))
    return actions.withColumns(
        {
            "correlation": F.round("correlation", 6),
            "revenue_impact": F.round("revenue_impact", 2),
        }
    )


# --- health and snapshot ---------------------------------------------------------------------


@query("business_health")
def _(m):
    return snapshot.business_health(_kpis(m))


def _snapshot_parts(m: Mart) -> tuple[DataFrame, ...]:
    stages = funnel.funnel_stages(m.users)
    summary = segments.segment_summary(_segmented(m))
    return _kpis(m), stages, funnel.funnel_summary(stages), summary, _drivers(m)


@query("metrics_snapshot")
def _(m):
    return snapshot.metrics_snapshot(*_snapshot_parts(m))


@query("snapshot_json")
def _(m):
    return snapshot.snapshot_json(*_snapshot_parts(m))


@query("snapshot_json_values")
def _(m):
    """The document read back into the long form."""
    return snapshot.snapshot_values(snapshot.snapshot_json(*_snapshot_parts(m)))


@query("confusion_matrix_half")
def _(m):
    return churn.confusion_matrix(_fixed_scores(m))


@query("classification_report_half")
def _(m):
    return churn.classification_report(churn.confusion_matrix(_fixed_scores(m)))


@query("preference_breakdown_all")
def _(m):
    return segments.preference_breakdown(m.users, "preferred_category")
