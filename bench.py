"""Wall time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`etl_run` covers cleaning and all derived tables from the given tables. The other queries run over
the written tables of the mart, whose one-time build is reported as `build_mart`.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyspark import build_session  # noqa: E402
from tallyspark.plans.mart import mart  # noqa: E402
from tallyspark.queries import QUERIES  # noqa: E402

HEADLINE = [
    "etl_run", "etl_append", "clean_events", "data_quality_report", "user_metrics", "session_metrics",
    "product_metrics", "daily_activity", "sql_user_value", "sql_product_metrics", "sql_funnel",
    "sql_monthly_cohorts", "sql_churn_features", "filter_events", "filtered_users",
    "executive_kpis", "kpi_deltas_orders", "kpi_sparks", "retention_trend",
    "rolling_active_users_orders", "rolling_active_bitmaps_orders", "funnel_stages", "funnel_impact", "cohort_matrix",
    "day_n_retention_orders", "assign_segments", "segment_summary", "adoption_table",
    "correlation_drivers", "segment_impact", "rank_causes", "ab_analyze", "stratified_split",
    "auc", "roc_curve", "churn_logreg", "churn_random_forest", "churn_gbt", "train_compare",
    "feature_importance", "score_users", "top_risk_users", "metrics_snapshot",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executors
    seconds = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    def build():
        tables = mart(spark, sf_dir)
        return tables.events, tables.days, tables.activity, tables.users, tables.sessions

    timed("build_mart", build)
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
