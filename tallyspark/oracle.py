"""SQL counterparts of the registered queries, for DuckDB over the given tables.

Written from the meaning of each query and not from its Spark plan: plain joins, window functions
and correlated counts, so agreement says something about both.
"""

from __future__ import annotations

from statistics import NormalDist

from tallyspark.operators.churn import DEFAULT_ACTION, DRIVER_ACTIONS, FEATURE_COLUMNS, MODELS
from tallyspark.operators.experiments import DO_NOT_SHIP, MORE_DATA, SHIP
from tallyspark.functions.stats import TAIL_DENOMINATOR, TAIL_NUMERATOR

ORACLES: dict[str, str] = {}

# --- raw events ------------------------------------------------------------------------------

PRODUCTS = """products AS (
  SELECT p_partkey AS product_id, CAST(p_size AS BIGINT) AS category_id,
         lower(p_type) || '.' || split_part(p_name, ' ', 1) AS category_code,
         nullif(p_brand, 'Brand#13') AS brand
  FROM part)"""

ORDER_RAW = PRODUCTS + """,
order_raw AS (
  SELECT o_orderdate + to_minutes(CAST(l_linenumber AS BIGINT)) AS event_time,
         CASE WHEN l_returnflag = 'R' AND (o_custkey % 10 >= 6
                   OR (o_custkey % 10 IN (4, 5) AND l_quantity <= 4)) THEN 'purchase'
              WHEN l_returnflag = 'A' AND o_custkey % 10 >= 2 THEN 'cart'
              WHEN l_returnflag = 'N' OR l_linenumber > 3 THEN 'view'
              ELSE 'remove_from_cart' END AS event_type,
         product_id, category_id, category_code, brand, l_extendedprice AS price,
         o_custkey AS user_id,
         CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS user_session
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN products ON l_partkey = product_id)"""

CLICK_RAW = PRODUCTS + """,
click_raw AS (
  SELECT ts AS event_time,
         CASE event_type WHEN 'click' THEN 'cart' WHEN 'signup' THEN 'remove_from_cart'
              ELSE event_type END AS event_type,
         product_id, category_id, category_code, brand, value AS price, user_id,
         CASE WHEN event_id % 97 <> 0
              THEN CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) END
           AS user_session
  FROM events JOIN products
    ON product_id = CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT))"""

DIRTY_RAW = ORDER_RAW + """,
dirty_raw AS (
  SELECT CASE WHEN product_id % 211 <> 0
              THEN strftime(event_time, '%Y-%m-%d %H:%M:%S') ELSE 'not a time' END AS event_time,
         CASE WHEN product_id % 17 = 0 THEN 'bounce' ELSE event_type END AS event_type,
         product_id, category_id,
         CASE WHEN product_id % 97 = 0 THEN NULL
              WHEN user_id % 7 = 0 THEN split_part(category_code, '.', 1)
              WHEN user_id % 11 = 0 THEN category_code || '.x' ELSE category_code END AS category_code,
         CASE WHEN user_id % 5 = 0 THEN '  ' || upper(brand) || ' ' ELSE brand END AS brand,
         CASE WHEN product_id % 53 = 0 THEN 'n/a'
              WHEN product_id % 59 = 0 THEN CAST(-(price + copy) AS VARCHAR)
              ELSE CAST(price + copy AS VARCHAR) END AS price,
         CASE WHEN product_id % 101 <> 0 THEN user_id END AS user_id, user_session
  FROM order_raw, (VALUES (0), (1)) AS c(copy)
  WHERE copy = 0 OR product_id % 19 = 0)"""


def cleaned(raw: str, name: str = "ev") -> str:
    """CTEs from a raw relation to cleaned events."""
    return f""",
filled AS (
  SELECT TRY_CAST(event_time AS TIMESTAMP) AS event_time, event_type, product_id, category_id,
         lower(coalesce(category_code, 'unknown')) AS category_code,
         trim(lower(coalesce(brand, 'unknown'))) AS brand,
         greatest(coalesce(TRY_CAST(price AS DOUBLE), 0), 0) AS price, user_id,
         coalesce(user_session, 'no_session') AS user_session
  FROM {raw}),
complete AS (
  SELECT * FROM filled WHERE event_time IS NOT NULL AND user_id IS NOT NULL
    AND product_id IS NOT NULL AND event_type IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER (
      PARTITION BY event_time, event_type, product_id, user_id, user_session
      ORDER BY price, category_id, category_code, brand) AS copy_no
  FROM complete),
{name} AS MATERIALIZED (
  SELECT event_time, event_type, product_id, category_id, category_code, brand, price, user_id,
         user_session, split_part(category_code, '.', 1) AS category,
         CASE WHEN contains(category_code, '.')
              THEN substr(category_code, strpos(category_code, '.') + 1) ELSE 'unknown' END
           AS subcategory,
         CAST(event_time AS DATE) AS event_date, strftime(event_time, '%Y-%m') AS event_month,
         CAST(price AS DECIMAL(18,2)) AS money
  FROM numbered
  WHERE copy_no = 1 AND event_type IN ('view', 'cart', 'remove_from_cart', 'purchase'))"""


ORDERS = ORDER_RAW + cleaned("order_raw")
CLICKS = CLICK_RAW + cleaned("click_raw")
DIRTY = DIRTY_RAW + cleaned("dirty_raw")

EVENT_COLUMNS = (
    "event_time, event_type, product_id, category_id, category_code, brand, price, user_id, "
    "user_session, category, subcategory, event_date, event_month"
)

TYPE_COUNTS = """CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS n_views,
         CAST(sum(CASE WHEN event_type = 'cart' THEN 1 ELSE 0 END) AS BIGINT) AS n_cart,
         CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS n_purchase"""

SPENT = "CAST(sum(CASE WHEN event_type = 'purchase' THEN money END) AS DOUBLE)"

SECONDS = "epoch_us({b}) - epoch_us({a})"


def days(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 86400000000.0::DOUBLE)"


USERS = f""",
per_user AS (
  SELECT user_id, min(event_time) AS first_seen, max(event_time) AS last_seen,
         count(*) AS total_events, {TYPE_COUNTS},
         count(DISTINCT user_session) AS n_sessions, count(DISTINCT product_id) AS n_products,
         count(DISTINCT brand) AS n_brands, count(DISTINCT category) AS n_categories,
         {SPENT} AS spent,
         max(CASE WHEN event_type = 'purchase' THEN event_time END) AS last_purchase_time
  FROM ev GROUP BY user_id),
brand_rank AS (
  SELECT user_id, brand, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, brand) AS r
  FROM ev GROUP BY user_id, brand),
category_rank AS (
  SELECT user_id, category,
         row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category) AS r
  FROM ev GROUP BY user_id, category),
latest AS (SELECT max(event_time) AS last_at FROM ev),
us AS MATERIALIZED (
  SELECT u.user_id, first_seen, last_seen, total_events, n_views, n_cart, n_purchase, n_sessions,
         n_products, n_brands, n_categories,
         coalesce(spent, 0.0) AS customer_lifetime_value,
         coalesce(spent / nullif(n_purchase, 0), 0.0) AS average_order_value,
         n_purchase AS n_orders, strftime(first_seen, '%Y-%m') AS cohort_month,
         CAST(first_seen AS DATE) AS signup_date,
         round({days('first_seen', 'last_seen')}, 2) AS lifespan_days, last_purchase_time,
         {days('last_purchase_time', 'last_at')} AS days_since_last_purchase,
         {days('last_seen', 'last_at')} AS days_since_last_seen,
         CAST(n_purchase AS DOUBLE) / greatest(n_sessions, 1) AS purchase_frequency,
         CASE WHEN n_purchase >= 2 THEN 1 ELSE 0 END AS is_repeat_purchaser,
         CASE WHEN n_views > 0 THEN 1 ELSE 0 END AS reached_view,
         CASE WHEN n_cart > 0 THEN 1 ELSE 0 END AS reached_cart,
         CASE WHEN n_purchase >= 1 THEN 1 ELSE 0 END AS reached_purchase,
         CASE WHEN n_purchase >= 2 THEN 1 ELSE 0 END AS reached_repeat,
         CASE WHEN {days('last_seen', 'last_at')} > 30 THEN 1 ELSE 0 END AS is_churned,
         CAST(n_cart AS DOUBLE) / greatest(n_views, 1) AS view_to_cart_rate,
         CAST(n_purchase AS DOUBLE) / greatest(n_cart, 1) AS cart_to_purchase_rate,
         CAST(total_events AS DOUBLE) / greatest(n_sessions, 1) AS avg_session_events,
         b.brand AS preferred_brand, c.category AS preferred_category
  FROM per_user u JOIN brand_rank b ON b.user_id = u.user_id AND b.r = 1
       JOIN category_rank c ON c.user_id = u.user_id AND c.r = 1 CROSS JOIN latest)"""

OU = ORDERS + USERS
CU = CLICKS + USERS


def put(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH {ctes}\n{select}"


KEYS = "event_time, event_type, product_id, user_id, user_session"
RAW = "event_time, event_type, product_id, category_id, category_code, brand, price, user_id, user_session"

put("read_events_csv", ORDER_RAW, f"SELECT {RAW} FROM order_raw")
put(
    "read_events_csv_intact", ORDER_RAW,
    f"""SELECT {RAW} FROM order_raw
    WHERE product_id % 23 <> 0 AND product_id % 29 <> 0 AND user_id % 31 <> 0""",
)
put(
    "malformed_lines", ORDER_RAW,
    """, fields AS (
      SELECT product_id, user_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') || ',' || event_type || ','
             || product_id || ',' || coalesce(CAST(category_id AS VARCHAR), '') || ','
             || coalesce(category_code, '') || ',' || coalesce(brand, '') || ','
             || CASE WHEN user_id % 31 = 0 THEN 'n/a' ELSE CAST(price AS VARCHAR) END AS front,
             ',' || user_id || ',' || coalesce(user_session, '') AS back
      FROM order_raw),
    lines AS (
      SELECT CASE WHEN product_id % 23 = 0 THEN 'too few fields' WHEN product_id % 29 = 0 THEN 'too many fields'
                  WHEN user_id % 31 = 0 THEN 'unreadable number' END AS problem,
             CASE WHEN product_id % 23 = 0 THEN front WHEN product_id % 29 = 0 THEN front || back || ',spare'
                  ELSE front || back END AS line
      FROM fields)
    SELECT problem, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM lines
    WHERE problem IS NOT NULL GROUP BY problem""",
)
TIMED = "TRY_CAST(event_time AS TIMESTAMP) AS event_time, event_type, product_id, user_id, user_session"
put("normalize_timestamps", DIRTY_RAW, f"SELECT {TIMED} FROM dirty_raw")
put(
    "drop_incomplete", DIRTY_RAW,
    f"""SELECT * FROM (SELECT {TIMED} FROM dirty_raw)
    WHERE event_time IS NOT NULL AND event_type IS NOT NULL AND product_id IS NOT NULL
      AND user_id IS NOT NULL""",
)
put("fill_categoricals", DIRTY, "SELECT product_id, user_id, brand, category_code, user_session FROM filled")
put("coerce_price", DIRTY, "SELECT product_id, user_id, price FROM filled")
put(
    "split_category", DIRTY,
    """SELECT product_id, user_id, category_code, split_part(category_code, '.', 1) AS category,
    CASE WHEN contains(category_code, '.')
         THEN substr(category_code, strpos(category_code, '.') + 1) ELSE 'unknown' END AS subcategory
    FROM filled""",
)
put(
    "calendar_columns", DIRTY_RAW,
    """SELECT product_id, user_id, t AS event_time, CAST(t AS DATE) AS event_date,
    strftime(t, '%Y-%m') AS event_month
    FROM (SELECT product_id, user_id, TRY_CAST(event_time AS TIMESTAMP) AS t FROM dirty_raw)""",
)
put("dedup_events", DIRTY, f"SELECT {RAW} FROM numbered WHERE copy_no = 1")
put(
    "filter_vocabulary", DIRTY,
    f"SELECT {RAW} FROM complete WHERE event_type IN ('view', 'cart', 'remove_from_cart', 'purchase')",
)
put("clean_events", DIRTY, f"SELECT {EVENT_COLUMNS} FROM ev")
put("clean_events_clicks", CLICKS, f"SELECT {EVENT_COLUMNS} FROM ev")
put(
    "data_quality_report", DIRTY,
    """, r AS (SELECT count(*) AS n, count(*) - count(brand) AS nb, count(*) - count(category_code) AS nc
            FROM dirty_raw), c AS (SELECT count(*) AS k FROM ev)
    SELECT 'raw_rows' AS metric, CAST(n AS DOUBLE) AS value FROM r
    UNION ALL SELECT 'clean_rows', k FROM c
    UNION ALL SELECT 'rows_dropped', n - k FROM r, c
    UNION ALL SELECT 'pct_dropped', round(100.0 * (n - k) / greatest(n, 1)::DOUBLE, 2) FROM r, c
    UNION ALL SELECT 'null_brand_filled', nb FROM r
    UNION ALL SELECT 'null_category_filled', nc FROM r""",
)

# --- tables ----------------------------------------------------------------------------------

SESSIONS = f"""SELECT user_session, arg_min(user_id, (event_time, user_id)) AS user_id,
       min(event_time) AS session_start, max(event_time) AS session_end, count(*) AS n_events,
       {TYPE_COUNTS}, count(DISTINCT product_id) AS n_products,
       coalesce({SPENT}, 0.0) AS revenue,
       (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 1000000.0::DOUBLE AS session_duration_proxy,
       CASE WHEN bool_or(event_type = 'cart') AND NOT bool_or(event_type = 'purchase') THEN 1 ELSE 0 END
         AS cart_abandonment,
       CASE WHEN bool_or(event_type = 'purchase') THEN 1 ELSE 0 END AS converted,
       CAST(min(event_time) AS DATE) AS session_date
  FROM ev GROUP BY user_session"""
PRODUCT_TABLE = f"""SELECT product_id, arg_min(category, (event_time, category)) AS category,
       arg_min(brand, (event_time, brand)) AS brand,
       CAST(sum(money) AS DOUBLE) / count(*) AS avg_price, {TYPE_COUNTS},
       count(DISTINCT user_id) AS n_unique_users, coalesce({SPENT}, 0.0) AS revenue,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS DOUBLE)
         / greatest(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END), 1)::DOUBLE AS view_to_purchase_rate
  FROM ev GROUP BY product_id"""
DAILY = f"""SELECT event_date AS activity_date, count(DISTINCT user_id) AS active_users,
       count(DISTINCT user_session) AS sessions, count(*) AS events,
       CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchases,
       coalesce({SPENT}, 0.0) AS revenue
  FROM ev GROUP BY event_date"""

for suffix, base in (("", OU), ("_clicks", CU)):
    put("session_metrics" + suffix, base, SESSIONS)
    put("user_metrics" + suffix, base, "SELECT * FROM us")
    put("daily_activity" + suffix, base, DAILY)
put("product_metrics", ORDERS, PRODUCT_TABLE)
for name, columns in {
    "user_counts": "user_id, first_seen, last_seen, total_events, n_views, n_cart, n_purchase, "
    "n_sessions, n_products, n_brands, n_categories",
    "user_revenue": "user_id, customer_lifetime_value, average_order_value, n_orders",
    "user_recency": "user_id, cohort_month, signup_date, lifespan_days, last_purchase_time, "
    "days_since_last_purchase, days_since_last_seen",
    "user_funnel_flags": "user_id, purchase_frequency, is_repeat_purchaser, reached_view, "
    "reached_cart, reached_purchase, reached_repeat",
    "churn_label": "user_id, days_since_last_seen, is_churned",
    "engagement_ratios": "user_id, view_to_cart_rate, cart_to_purchase_rate, avg_session_events",
    "preferred_value": "user_id, preferred_brand, preferred_category",
}.items():
    put(name, OU, f"SELECT {columns} FROM us")

SIZES = """SELECT 'fact_events' AS table_name, count(*) AS n_rows{fact} FROM ev
UNION ALL SELECT 'user_metrics', count(DISTINCT user_id){paid} FROM ev
UNION ALL SELECT 'session_metrics', count(DISTINCT user_session){paid} FROM ev
UNION ALL SELECT 'product_metrics', count(DISTINCT product_id){paid} FROM ev
UNION ALL SELECT 'daily_activity', count(DISTINCT event_date){paid} FROM ev"""
for name in ("write_tables_parquet", "etl_run", "etl_append"):
    put(name, ORDERS, SIZES.format(fact="", paid=""))
put(
    "star_schema_tables", ORDERS,
    SIZES.format(fact=", CAST(sum(money) AS DOUBLE) AS money", paid=f", {SPENT}"),
)
put("etl_append_events", ORDERS, f"SELECT {EVENT_COLUMNS} FROM ev")
put("etl_append_users", OU, "SELECT * FROM us")
put("etl_append_sessions", ORDERS, SESSIONS)
put("etl_append_products", ORDERS, PRODUCT_TABLE)
put("etl_append_days", ORDERS, DAILY)
put(
    "load_tables_all", ORDERS,
    f""", said AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_type <> 'remove_from_cart') AS k,
                {SPENT} AS revenue FROM ev)
    SELECT 'fact_events' AS table_name, n AS n_events, revenue FROM said
    UNION ALL SELECT 'user_metrics', n, revenue FROM said UNION ALL SELECT 'session_metrics', n, revenue FROM said
    UNION ALL SELECT 'product_metrics', k, revenue FROM said UNION ALL SELECT 'daily_activity', n, revenue FROM said""",
)
put(
    "load_tables", ORDERS,
    f"""SELECT user_id, count(*) AS total_events, coalesce({SPENT}, 0.0) AS customer_lifetime_value,
    max(event_month) AS last_month FROM ev GROUP BY user_id""",
)
put(
    "read_sql_params", ORDERS,
    """SELECT category, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM ev
    WHERE event_type = 'purchase' AND event_date >= DATE '1998-01-01' AND price >= 20000
    GROUP BY category""",
)

# --- warehouse variants ----------------------------------------------------------------------

put(
    "sql_active_users", CLICKS,
    """SELECT event_date, count(DISTINCT user_id) AS dau, count(DISTINCT user_id) AS wau_window,
    count(DISTINCT user_id) AS mau_window FROM ev GROUP BY event_date""",
)
for name, length in (("dau", 1), ("wau", 7), ("mau", 30)):
    put(
        f"sql_{name}", ORDERS,
        f"""SELECT count(DISTINCT user_id) AS {name} FROM ev
        WHERE event_date > (SELECT max(event_date) FROM ev) - {length}""",
    )
put(
    "sql_revenue_summary", ORDERS,
    f"""SELECT {SPENT} AS total_revenue,
    CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS total_orders,
    count(DISTINCT user_id) AS total_users,
    {SPENT} / nullif(count(DISTINCT user_id), 0) AS arpu FROM ev""",
)
put(
    "sql_user_value", OU,
    """SELECT user_id, first_seen, last_seen, n_purchase AS n_orders, spent AS customer_lifetime_value,
    spent / nullif(n_purchase, 0) AS average_order_value, n_sessions,
    CASE WHEN n_purchase >= 2 THEN 1 ELSE 0 END AS is_repeat_purchaser FROM per_user""",
)
WH_SESSIONS = f"""SELECT user_session, min(user_id) AS user_id, min(event_time) AS session_start,
    max(event_time) AS session_end, count(*) AS n_events, {TYPE_COUNTS}, {SPENT} AS revenue,
    (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 1000000.0::DOUBLE AS session_duration_proxy,
    CASE WHEN bool_or(event_type = 'cart') AND NOT bool_or(event_type = 'purchase') THEN 1 ELSE 0 END
      AS cart_abandonment,
    CASE WHEN bool_or(event_type = 'purchase') THEN 1 ELSE 0 END AS converted
    FROM ev GROUP BY user_session"""
put("sql_session_metrics", ORDERS, WH_SESSIONS)
put(
    "sql_session_rates", CLICKS,
    f"""SELECT CAST(CAST(avg(cart_abandonment) AS DECIMAL(6,4)) AS DOUBLE) AS cart_abandonment_rate,
    CAST(CAST(avg(converted) AS DECIMAL(6,4)) AS DOUBLE) AS session_conversion_rate,
    CAST(sum(CAST(session_duration_proxy AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS avg_session_seconds
    FROM ({WH_SESSIONS})""",
)
put(
    "sql_product_metrics", ORDERS,
    f"""SELECT *, CAST(n_purchase AS DOUBLE) / nullif(n_views, 0) AS view_to_purchase_rate FROM (
    SELECT product_id, max(category) AS category, max(brand) AS brand,
    CAST(sum(money) AS DOUBLE) / count(*) AS avg_price, {TYPE_COUNTS},
    count(DISTINCT user_id) AS n_unique_users, {SPENT} AS revenue FROM ev GROUP BY product_id)""",
)
put(
    "sql_top_brands", ORDERS,
    f"""SELECT brand, {SPENT} AS revenue,
    CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS orders
    FROM ev GROUP BY brand ORDER BY revenue DESC NULLS LAST, brand LIMIT 20""",
)
put(
    "sql_category_revenue", ORDERS,
    f"SELECT category, {SPENT} AS revenue, count(DISTINCT user_id) AS buyers FROM ev GROUP BY category",
)
put(
    "sql_funnel", OU,
    """, f AS (SELECT count(*) FILTER (WHERE n_views > 0) AS v, count(*) FILTER (WHERE n_cart > 0) AS c,
    count(*) FILTER (WHERE n_purchase >= 1) AS p, count(*) FILTER (WHERE n_purchase >= 2) AS r FROM per_user)
    SELECT v AS users_view, c AS users_cart, p AS users_purchase, r AS users_repeat,
    round(100 * (c / nullif(v, 0)::DOUBLE), 2) AS view_to_cart_pct,
    round(100 * (p / nullif(c, 0)::DOUBLE), 2) AS cart_to_purchase_pct,
    round(100 * (r / nullif(p, 0)::DOUBLE), 2) AS purchase_to_repeat_pct,
    round(100 * (p / nullif(v, 0)::DOUBLE), 2) AS overall_conversion_pct FROM f""",
)
FIRSTS = """,
firsts AS (SELECT user_id, min(event_date) AS d0, date_trunc('month', min(event_time)) AS m0
           FROM ev GROUP BY user_id),
cohorts AS (
  SELECT m0, datediff('month', m0, date_trunc('month', event_time)) AS k,
         count(DISTINCT user_id) AS n
  FROM ev JOIN firsts USING (user_id) GROUP BY 1, 2),
cohort_long AS (
  SELECT strftime(c.m0, '%Y-%m') AS cohort, c.k AS month_number,
         round(100.0::DOUBLE * c.n / s.n, 1) AS retention_pct
  FROM cohorts c JOIN (SELECT m0, count(*) AS n FROM firsts GROUP BY m0) s ON s.m0 = c.m0),
day_n AS (
  SELECT 'D' || n AS day,
         (SELECT count(DISTINCT e.user_id) FROM ev e JOIN firsts f USING (user_id)
          WHERE e.event_date = f.d0 + n) AS retained_users,
         (SELECT count(*) FROM firsts) AS everyone
  FROM (VALUES (1), (7), (30), (90)) AS t(n)),
day_pct AS (
  SELECT day, retained_users,
         coalesce(round(100.0::DOUBLE * retained_users / nullif(everyone, 0), 2), 0.0) AS retention_pct
  FROM day_n)"""
put(
    "sql_monthly_cohorts", ORDERS + FIRSTS,
    "SELECT CAST(m0 AS TIMESTAMP) AS cohort_month, k AS month_number, n AS active_users FROM cohorts",
)
put(
    "sql_day_n_retention", CLICKS + FIRSTS,
    """SELECT max(everyone) AS cohort_size,
    """ + ",\n    ".join(
        f"max(CASE WHEN day = 'D{n}' THEN round(100 * (retained_users / everyone::DOUBLE), 2) END) "
        f"AS d{n}_retention" for n in (1, 7, 30, 90)
    ) + " FROM day_n",
)
put(
    "sql_churn_features", OU,
    f"""SELECT user_id, total_events, n_views, n_cart, n_purchase, n_sessions, n_products, n_brands,
    n_categories, coalesce(spent, 0.0) AS customer_lifetime_value,
    coalesce(spent / nullif(n_purchase, 0), 0.0) AS average_order_value,
    {days('last_seen', 'last_at')} AS days_since_last_seen, {days('first_seen', 'last_seen')} AS lifespan_days,
    n_cart / nullif(n_views, 0)::DOUBLE AS view_to_cart_rate,
    n_purchase / nullif(n_cart, 0)::DOUBLE AS cart_to_purchase_rate,
    CASE WHEN {days('last_seen', 'last_at')} > 30 THEN 1 ELSE 0 END AS is_churned
    FROM per_user CROSS JOIN latest""",
)
put(
    "sql_churn_by_cohort", OU,
    """SELECT CAST(date_trunc('month', first_seen) AS TIMESTAMP) AS cohort_month, count(*) AS users,
    CAST(CAST(avg(is_churned) AS DECIMAL(6,4)) AS DOUBLE) AS churn_rate FROM us GROUP BY 1""",
)

# --- slicing ---------------------------------------------------------------------------------

PICKED = """,
picked AS (
  SELECT * FROM ev WHERE event_date BETWEEN DATE '1996-03-01' AND DATE '1999-08-31'
    AND category IN ('economy', 'promo', 'small')
    AND brand IN ('brand#1', 'brand#2', 'brand#3', 'brand#4', 'brand#5', 'unknown'))"""
put("filter_events", ORDERS + PICKED, f"SELECT {EVENT_COLUMNS} FROM picked")
put(
    "filter_options", ORDERS,
    """SELECT DISTINCT 'category' AS option, category AS value FROM ev
    UNION ALL SELECT DISTINCT 'brand', brand FROM ev
    UNION ALL SELECT 'min_date', CAST(min(event_date) AS VARCHAR) FROM ev
    UNION ALL SELECT 'max_date', CAST(max(event_date) AS VARCHAR) FROM ev""",
)
PICKED_USERS = """,
picked_users AS (
  SELECT * FROM us WHERE user_id IN (SELECT user_id FROM picked) AND customer_lifetime_value >= 100000)"""
put("filtered_users", OU + PICKED + PICKED_USERS, "SELECT * FROM picked_users")
put(
    "filtered_sessions", ORDERS + PICKED,
    f"SELECT * FROM ({SESSIONS}) WHERE user_id IN (SELECT user_id FROM picked)",
)

# --- executive metrics -----------------------------------------------------------------------


def kpis(events: str = "ev", users: str = "us") -> str:
    """CTEs up to `kpi`, one row."""

    def active(after: int, until: int = 0) -> str:
        return (
            f"(SELECT count(DISTINCT user_id) FROM {events}, top_day WHERE event_date > d - {after} "
            f"AND event_date <= d - {until})"
        )

    return f""",
top_day AS (SELECT max(event_date) AS d FROM {events}),
month_users AS (
  SELECT event_month, count(DISTINCT user_id) AS n,
         row_number() OVER (ORDER BY event_month DESC) AS age
  FROM {events} GROUP BY event_month),
kpi AS (
  SELECT {active(1)} AS dau, {active(7)} AS wau, {active(30)} AS mau,
    coalesce((SELECT round(100.0::DOUBLE * (a.n - b.n) / b.n, 2)
              FROM month_users a, month_users b WHERE a.age = 1 AND b.age = 2), 0.0) AS growth_rate,
    coalesce(round(100.0::DOUBLE * (
        SELECT count(*) FROM (
          SELECT user_id FROM {events}, top_day WHERE event_date > d - 30
          INTERSECT
          SELECT user_id FROM {events}, top_day WHERE event_date > d - 60 AND event_date <= d - 30))
      / nullif({active(60, 30)}, 0), 2), 0.0) AS retention_rate,
    (SELECT coalesce(round(100.0::DOUBLE * sum(is_churned) / count(*), 2), 0.0) FROM {users}) AS churn_rate,
    (SELECT coalesce(round(CAST(sum(CAST(customer_lifetime_value AS DECIMAL(28,2))) AS DOUBLE), 2), 0.0)
     FROM {users}) AS total_revenue,
    (SELECT coalesce(round(CAST(sum(CAST(customer_lifetime_value AS DECIMAL(28,2))) AS DOUBLE)
       / nullif(count(*), 0), 2), 0.0) FROM {users}) AS arpu,
    (SELECT count(*) FROM {users}) AS n_users)"""


put("executive_kpis", OU + kpis(), "SELECT * FROM kpi")
put("executive_kpis_clicks", CU + kpis(), "SELECT * FROM kpi")
put(
    "executive_kpis_filtered", OU + PICKED + PICKED_USERS + kpis("picked", "picked_users"),
    "SELECT * FROM kpi",
)
TRENDS = f""",
dau AS (SELECT event_date AS date, count(DISTINCT user_id) AS dau FROM ev GROUP BY event_date),
rev AS (
  SELECT event_date AS date, {SPENT} AS revenue FROM ev WHERE event_type = 'purchase'
  GROUP BY event_date),
monthly AS (SELECT event_month, count(DISTINCT user_id) AS active_users FROM ev GROUP BY event_month),
user_weeks AS (SELECT DISTINCT user_id, CAST(date_trunc('week', event_time) AS DATE) AS w FROM ev),
weeks AS (SELECT w, lag(w) OVER (ORDER BY w) AS before FROM (SELECT DISTINCT w FROM user_weeks)),
ret AS (
  SELECT CAST(w AS VARCHAR) || '/' || CAST(CAST(w + 6 AS DATE) AS VARCHAR) AS week,
         100.0::DOUBLE * (SELECT count(*) FROM user_weeks a JOIN user_weeks b USING (user_id)
                  WHERE a.w = weeks.w AND b.w = weeks.before)
         / nullif((SELECT count(*) FROM user_weeks b WHERE b.w = weeks.before), 0) AS retention_pct
  FROM weeks),
churned AS (SELECT week, 100 - retention_pct AS churn_pct FROM ret)"""
OT, CT = ORDERS + TRENDS, CLICKS + TRENDS
put("daily_active_trend", CT, "SELECT * FROM dau")
put(
    "monthly_growth_trend", OT,
    """SELECT *, 100.0::DOUBLE * (active_users - lag(active_users) OVER (ORDER BY event_month))
    / lag(active_users) OVER (ORDER BY event_month) AS growth_pct FROM monthly""",
)
put("revenue_trend", OT, "SELECT * FROM rev")
put("retention_trend", OT, "SELECT * FROM ret")
put("retention_trend_clicks", CT, "SELECT * FROM ret")
put("churn_trend", OT, "SELECT * FROM churned")
put("retention_churn_join", OT, "SELECT week, retention_pct, churn_pct FROM ret JOIN churned USING (week)")
put(
    "window_active", CLICKS,
    """, t AS (SELECT max(event_date) AS d FROM ev)
    SELECT 'latest_7' AS window_name, count(DISTINCT user_id) AS active_users FROM ev, t
      WHERE event_date BETWEEN d - 6 AND d
    UNION ALL SELECT 'latest_30', count(DISTINCT user_id) FROM ev, t WHERE event_date BETWEEN d - 29 AND d
    UNION ALL SELECT 'to_jan_20', count(DISTINCT user_id) FROM ev
      WHERE event_date BETWEEN DATE '2024-01-07' AND DATE '2024-01-20'""",
)
put(
    "pct_change", CT,
    """SELECT date, dau, coalesce(round(100.0::DOUBLE * (dau - lag(dau) OVER (ORDER BY date))
    / nullif(lag(dau) OVER (ORDER BY date), 0), 2), 0.0) AS change_pct FROM dau""",
)


def change(cur: str, prev: str) -> str:
    return f"coalesce(round(100.0::DOUBLE * ({cur} - {prev}) / nullif(CAST({prev} AS DOUBLE), 0), 2), 0.0)"


DELTAS = f""",
t AS (SELECT max(event_date) AS d FROM ev),
a AS (SELECT
  (SELECT count(DISTINCT user_id) FROM ev, t WHERE event_date > d - 7) AS w,
  (SELECT count(DISTINCT user_id) FROM ev, t WHERE event_date BETWEEN d - 13 AND d - 7) AS w0,
  (SELECT count(DISTINCT user_id) FROM ev, t WHERE event_date > d - 30) AS m,
  (SELECT count(DISTINCT user_id) FROM ev, t WHERE event_date BETWEEN d - 59 AND d - 30) AS m0,
  (SELECT dau FROM dau ORDER BY date DESC LIMIT 1) AS x,
  (SELECT dau FROM dau ORDER BY date DESC LIMIT 1 OFFSET 1) AS x0,
  coalesce((SELECT CAST(sum(money) AS DOUBLE) FROM ev, t WHERE event_type = 'purchase'
            AND event_date > d - 7), 0) AS r,
  (SELECT CAST(sum(money) AS DOUBLE) FROM ev, t WHERE event_type = 'purchase'
            AND event_date > d - 14 AND event_date <= d - 7) AS r0,
  (SELECT retention_pct FROM ret WHERE retention_pct IS NOT NULL ORDER BY week DESC LIMIT 1) AS k,
  (SELECT retention_pct FROM ret WHERE retention_pct IS NOT NULL ORDER BY week DESC LIMIT 1 OFFSET 1) AS k0)
SELECT 'dau' AS kpi, {change('x', 'x0')} AS delta FROM a
UNION ALL SELECT 'wau', {change('w', 'w0')} FROM a
UNION ALL SELECT 'mau', {change('m', 'm0')} FROM a
UNION ALL SELECT 'growth_rate', NULL
UNION ALL SELECT 'retention_rate', round(k - k0, 2) FROM a
UNION ALL SELECT 'churn_rate', round((100 - k) - (100 - k0), 2) FROM a
UNION ALL SELECT 'revenue', {change('r', 'r0')} FROM a
UNION ALL SELECT 'arpu', {change('r', 'r0')} FROM a"""
put("kpi_deltas", CT, DELTAS)
put("kpi_deltas_orders", OT, DELTAS)


def spark(names: tuple[str, ...], table: str, order: str, value: str) -> str:
    values = ", ".join(f"('{n}')" for n in names)
    return f"""SELECT kpi, CAST(row_number() OVER (PARTITION BY kpi ORDER BY o) AS INTEGER) AS point, value FROM (
      SELECT kpi, {order} AS o, CAST({value} AS DOUBLE) AS value,
             row_number() OVER (PARTITION BY kpi ORDER BY {order} DESC) AS age
      FROM {table}, (VALUES {values}) AS k(kpi) WHERE {value} IS NOT NULL) WHERE age <= 20"""


put(
    "kpi_sparks", OT,
    "\nUNION ALL ".join(
        [
            spark(("dau", "wau", "mau"), "dau", "date", "dau"),
            spark(("growth_rate",), "monthly", "event_month", "active_users"),
            spark(("retention_rate",), "ret", "week", "retention_pct"),
            spark(("churn_rate",), "churned", "week", "churn_pct"),
            spark(("revenue", "arpu"), "rev", "date", "revenue"),
        ]
    ),
)
ROLLING = """, d AS (SELECT DISTINCT event_date FROM ev),
    ud AS (SELECT DISTINCT user_id, event_date AS on_date FROM ev)
    SELECT d.event_date, count(DISTINCT CASE WHEN on_date = d.event_date THEN user_id END) AS dau,
    count(DISTINCT CASE WHEN on_date > d.event_date - 7 THEN user_id END) AS wau,
    count(DISTINCT user_id) AS mau
    FROM d JOIN ud ON on_date <= d.event_date AND on_date > d.event_date - 30 GROUP BY d.event_date"""
put("rolling_active_users", CLICKS, ROLLING)
put("rolling_active_users_orders", ORDERS, ROLLING)
put("rolling_active_bitmaps", CLICKS, ROLLING)
put("rolling_active_bitmaps_orders", ORDERS, ROLLING)
ORACLES["window_active_bitmaps"] = ORACLES["window_active"]

# --- funnel ----------------------------------------------------------------------------------

FUNNEL = """,
counts AS (
  SELECT 1 AS stage_no, 'View Product' AS stage, CAST(sum(reached_view) AS BIGINT) AS users FROM us
  UNION ALL SELECT 2, 'Add To Cart', CAST(sum(reached_cart) AS BIGINT) FROM us
  UNION ALL SELECT 3, 'Purchase', CAST(sum(reached_purchase) AS BIGINT) FROM us
  UNION ALL SELECT 4, 'Repeat Purchase', CAST(sum(reached_repeat) AS BIGINT) FROM us),
steps AS (
  SELECT c.stage_no, c.stage, c.users, p.stage AS previous_stage, t.users AS top_users,
         CASE WHEN c.stage_no = 1 THEN CASE WHEN c.users > 0 THEN 100.0::DOUBLE ELSE 0.0 END
              ELSE coalesce(100 * c.users::DOUBLE / nullif(p.users, 0), 0.0) END AS conv
  FROM counts c LEFT JOIN counts p ON p.stage_no = c.stage_no - 1
       JOIN counts t ON t.stage_no = 1),
stages AS (
  SELECT stage_no, stage, users, previous_stage, top_users, round(conv, 2) AS conversion_from_prev_pct,
         round(100 * users::DOUBLE / greatest(top_users, 1), 2) AS conversion_from_top_pct,
         CASE WHEN stage_no = 1 THEN 0.0::DOUBLE ELSE round(100 - conv, 2) END AS dropoff_pct
  FROM steps),
leak AS (
  SELECT previous_stage || ' → ' || stage AS largest_dropoff_stage, dropoff_pct AS largest_dropoff_pct,
         (SELECT conversion_from_top_pct FROM stages WHERE stage_no = 3) AS overall_conversion
  FROM stages WHERE stage_no > 1 ORDER BY dropoff_pct DESC, stage_no LIMIT 1)"""
OF = OU + FUNNEL
put(
    "funnel_stages", OF,
    """SELECT stage_no, stage, users, conversion_from_prev_pct, conversion_from_top_pct, dropoff_pct
    FROM stages""",
)
put("funnel_summary", OF, "SELECT * FROM leak")
put(
    "funnel_impact", OF + kpis(),
    """, l AS (SELECT CAST(trunc(top_users * largest_dropoff_pct / 100) AS BIGINT) AS lost, leak.*
            FROM leak, stages WHERE stage_no = 1),
    r AS (SELECT *, CAST(trunc(lost * 0.1::DOUBLE) AS BIGINT) AS rec FROM l)
    SELECT lost AS lost_users, rec AS recoverable_users, rec * arpu AS revenue_opportunity,
    largest_dropoff_stage AS stage, largest_dropoff_pct AS dropoff_pct FROM r, kpi""",
)
put(
    "funnel_stage_impact", OF + kpis(),
    """, l AS (SELECT *, CAST(trunc(top_users * dropoff_pct / 100) AS BIGINT) AS lost
            FROM stages WHERE stage_no > 1 AND dropoff_pct > 5)
    SELECT previous_stage, stage, dropoff_pct, lost AS lost_users,
    CAST(trunc(lost * 0.1::DOUBLE * arpu) AS BIGINT) AS recoverable_revenue,
    CASE WHEN dropoff_pct > 40 THEN 'danger' WHEN dropoff_pct > 20 THEN 'warning' ELSE 'info' END AS severity
    FROM l, kpi""",
)

# --- cohorts ---------------------------------------------------------------------------------

put("cohort_matrix", ORDERS + FIRSTS, "SELECT * FROM cohort_long")
COHORT_CELLS = FIRSTS + """,
cohort_cells AS (
  SELECT cohort, CAST(number AS BIGINT) AS month_number, retention_pct
  FROM (SELECT DISTINCT cohort FROM cohort_long)
  CROSS JOIN (SELECT unnest(range(max(month_number) + 1)) AS number FROM cohort_long)
  LEFT JOIN (SELECT cohort, month_number AS number, retention_pct FROM cohort_long) USING (cohort, number))"""
put(
    "cohort_matrix_wide", ORDERS + COHORT_CELLS,
    """SELECT cohort, string_agg(coalesce(CAST(retention_pct AS VARCHAR), ''), ',' ORDER BY month_number) AS cells
    FROM cohort_cells GROUP BY cohort""",
)
put("cohort_matrix_all", ORDERS + COHORT_CELLS, "SELECT * FROM cohort_cells")
put(
    "cohort_sizes", ORDERS + FIRSTS,
    "SELECT strftime(m0, '%Y-%m') AS cohort, count(*) AS cohort_size FROM firsts GROUP BY 1",
)
put("day_n_retention", CLICKS + FIRSTS, "SELECT * FROM day_pct")
put("day_n_retention_orders", ORDERS + FIRSTS, "SELECT * FROM day_pct")
put(
    "cohort_summary", ORDERS + FIRSTS,
    """, second AS (SELECT * FROM cohort_long WHERE month_number =
        (SELECT min(month_number) FROM cohort_long WHERE month_number > 0)),
    best AS (SELECT cohort, retention_pct FROM second ORDER BY retention_pct DESC, cohort LIMIT 1)
    SELECT a.retention_pct AS d1_retention, b.retention_pct AS d30_retention,
    CASE WHEN b.retention_pct >= 20 THEN 'Strong' WHEN b.retention_pct >= 10 THEN 'Stable' ELSE 'Weak' END
      AS status,
    (SELECT CAST(sum(CAST(retention_pct AS DECIMAL(12,1))) AS DOUBLE) / count(*) FROM second)
      AS avg_month1_retention, best.cohort AS best_cohort,
    best.retention_pct AS best_cohort_retention
    FROM day_pct a, day_pct b, best WHERE a.day = 'D1' AND b.day = 'D30'""",
)
put(
    "retention_benchmark", CLICKS + FIRSTS,
    """SELECT day, retained_users, retention_pct, CAST(goal AS INTEGER) AS benchmark,
    CASE WHEN retention_pct >= goal THEN 'above' ELSE 'below' END AS status
    FROM day_pct JOIN (VALUES ('D1', 40), ('D7', 20), ('D30', 10), ('D90', 5)) AS g(day, goal) USING (day)""",
)

# --- segments --------------------------------------------------------------------------------

SEGMENTS = """,
cuts AS (SELECT quantile_cont(customer_lifetime_value, 0.75) AS clv,
                quantile_cont(purchase_frequency, 0.75) AS often FROM us),
seg AS MATERIALIZED (
  SELECT us.*, CASE WHEN n_orders = 0 THEN 'Window Shopper'
         WHEN customer_lifetime_value >= clv THEN
           CASE WHEN is_churned = 1 THEN 'At-Risk Customer' ELSE 'High Value Customer' END
         WHEN is_repeat_purchaser = 1 AND purchase_frequency >= often THEN 'Power Buyer'
         ELSE 'Casual Buyer' END AS segment
  FROM us, cuts),
seg_sum AS (
  SELECT segment, count(*) AS users,
         CAST(sum(CAST(customer_lifetime_value AS DECIMAL(28,2))) AS DOUBLE) AS total_revenue,
         avg(n_orders) AS avg_orders, avg(n_sessions) AS avg_sessions,
         round(100 * avg(is_churned), 2) AS churn_rate FROM seg GROUP BY segment),
seg_all AS (
  SELECT segment, users, total_revenue / users AS avg_clv, total_revenue, avg_orders, avg_sessions,
         churn_rate,
         round(100 * total_revenue / coalesce(nullif((SELECT sum(total_revenue) FROM seg_sum), 0), 1), 2)
           AS revenue_share_pct
  FROM seg_sum)"""
OS = OU + SEGMENTS
put(
    "assign_segments", OS,
    "SELECT user_id, customer_lifetime_value, purchase_frequency, is_churned, segment FROM seg",
)
put("segment_summary", OS, "SELECT * FROM seg_all")


def favourite(by: str) -> str:
    return f"""SELECT * FROM (SELECT '{by}' AS preference, {by} AS choice, count(*) AS users,
      CAST(sum(CAST(customer_lifetime_value AS DECIMAL(28,2))) AS DOUBLE) AS revenue
      FROM us GROUP BY {by} ORDER BY revenue DESC, choice LIMIT 8)"""


put(
    "preference_breakdown", OU,
    favourite("preferred_category") + " UNION ALL " + favourite("preferred_brand"),
)
put(
    "preference_breakdown_all", OU,
    """SELECT preferred_category, count(*) AS users,
      CAST(sum(CAST(customer_lifetime_value AS DECIMAL(28,2))) AS DOUBLE) AS revenue
      FROM us GROUP BY preferred_category""",
)
put(
    "segment_highlights", OS,
    """SELECT t.segment AS top_segment, t.users AS top_users, t.avg_clv AS top_avg_clv,
    t.total_revenue AS top_total_revenue, t.revenue_share_pct AS top_revenue_share_pct,
    coalesce(r.users, 0) AS at_risk_users, coalesce(r.total_revenue, 0) AS at_risk_revenue,
    coalesce(r.churn_rate, 0) AS at_risk_churn, t.total_revenue * 0.1::DOUBLE AS top_loss_exposure
    FROM (SELECT * FROM seg_all ORDER BY total_revenue DESC, users DESC LIMIT 1) t
    LEFT JOIN (SELECT * FROM seg_all WHERE segment = 'At-Risk Customer') r ON true""",
)

# --- adoption --------------------------------------------------------------------------------


def corr0(a: str, b: str) -> str:
    return (
        f"CASE WHEN min({a}) = max({a}) OR min({b}) = max({b}) THEN 0.0::DOUBLE "
        f"ELSE corr({a}, {b}) END"
    )


def adopted(position: int, name: str, flag: str, used: str) -> str:
    return f"""SELECT {position} AS position, '{name}' AS feature,
      round(100.0::DOUBLE * sum({flag}) / count(*), 2) AS adoption_rate_pct,
      coalesce(round(avg({used}) FILTER (WHERE {flag} = 1), 2), 0.0) AS avg_usage_frequency,
      round({corr0(flag, '(1 - is_churned)')}, 3) AS retention_correlation,
      round({corr0(flag, 'customer_lifetime_value')}, 3) AS revenue_correlation FROM us"""


ADOPTION = ",\nadopt AS (" + "\nUNION ALL ".join(
    [
        adopted(1, "View", "reached_view", "n_views"),
        adopted(2, "Cart", "reached_cart", "n_cart"),
        adopted(3, "Purchase", "reached_purchase", "n_purchase"),
        adopted(4, "Repeat Purchase", "reached_repeat", "n_orders"),
    ]
) + ")"
put("adoption_table", OU + ADOPTION, "SELECT * EXCLUDE (position) FROM adopt")
put(
    "feature_value_ranking", OU + ADOPTION,
    """, scored AS (SELECT *, (retention_correlation + revenue_correlation) / 2 AS value_score FROM adopt),
    placed AS (SELECT *, CAST(row_number() OVER (ORDER BY value_score DESC, position) AS INTEGER) AS value_rank
               FROM scored)
    SELECT * EXCLUDE (position), CASE value_rank WHEN 1 THEN 'most_valuable' WHEN 4 THEN 'least_valuable'
    ELSE 'between' END AS standing FROM placed""",
)
put(
    "safe_corr", OU,
    """SELECT round(corr(n_views, n_purchase), 6) AS views_purchases,
    round(corr(n_orders, days_since_last_purchase), 6) AS orders_recency, 0.0::DOUBLE AS constant FROM us""",
)

# --- root cause ------------------------------------------------------------------------------


def drops(table: str, period: str, value: str, metric: str, limit: float) -> str:
    return f"""SELECT '{metric}' AS metric, CAST({period} AS VARCHAR) AS period,
      round(c, 2) AS change_pct, 'drop' AS direction FROM (
      SELECT {period}, 100.0::DOUBLE * ({value} / nullif(lag({value}) OVER (ORDER BY {period}), 0) - 1) AS c
      FROM {table} WHERE {value} IS NOT NULL) WHERE c <= {limit}"""


def both_drops(limit: float) -> str:
    return (
        drops("rev", "date", "revenue", "revenue", limit)
        + "\nUNION ALL "
        + drops("ret", "week", "retention_pct", "retention", limit)
    )


put("detect_drops", OT, both_drops(-10))
put(
    "worst_drop", OT,
    f""", b AS ({both_drops(-15)}),
    w AS (SELECT * FROM b ORDER BY change_pct, metric DESC, period LIMIT 1)
    SELECT count(*) FILTER (WHERE b.metric = 'revenue') AS revenue_drops,
    count(*) FILTER (WHERE b.metric = 'retention') AS retention_drops, count(*) AS total_drops,
    (SELECT metric FROM w) AS worst_metric, (SELECT period FROM w) AS worst_period,
    coalesce((SELECT change_pct FROM w), 0.0) AS worst_change_pct FROM b""",
)
NUMERIC = [
    "user_id", "total_events", "n_views", "n_cart", "n_purchase", "n_sessions", "n_products",
    "n_brands", "n_categories", "customer_lifetime_value", "average_order_value", "n_orders",
    "lifespan_days", "days_since_last_purchase", "days_since_last_seen", "purchase_frequency",
    "is_repeat_purchaser", "reached_view", "reached_cart", "reached_purchase", "reached_repeat",
    "view_to_cart_rate", "cart_to_purchase_rate", "avg_session_events",
]
DRIVERS = ",\ndrv AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, CASE WHEN min({c}) < max({c}) "
    f"AND min(is_churned) FILTER (WHERE {c} IS NOT NULL) < max(is_churned) FILTER (WHERE {c} IS NOT NULL) "
    f"THEN corr({c}, is_churned) END AS correlation FROM us"
    for c in NUMERIC
) + """),
top3 AS (SELECT * FROM drv ORDER BY abs(correlation) DESC NULLS LAST, feature LIMIT 3)"""
put("correlation_drivers", OU + DRIVERS, "SELECT feature, round(correlation, 6) AS correlation FROM drv")


def impact(dimension: str) -> str:
    return f""",
seg_months AS (
  SELECT event_month, row_number() OVER (ORDER BY event_month DESC) AS age
  FROM (SELECT DISTINCT event_month FROM ev WHERE event_type = 'purchase')),
seg_imp AS (
  SELECT {dimension} AS segment, (SELECT event_month FROM seg_months WHERE age = 2) AS prev_month,
         (SELECT event_month FROM seg_months WHERE age = 1) AS last_month,
         coalesce(CAST(sum(CASE WHEN age = 2 THEN money END) AS DOUBLE), 0.0) AS prev_revenue,
         coalesce(CAST(sum(CASE WHEN age = 1 THEN money END) AS DOUBLE), 0.0) AS last_revenue
  FROM ev JOIN seg_months USING (event_month) WHERE event_type = 'purchase' GROUP BY {dimension}),
seg_change AS (
  SELECT *, 100 * (last_revenue - prev_revenue) / nullif(prev_revenue, 0) AS change_pct FROM seg_imp)"""


put("segment_impact", ORDERS + impact("category"), "SELECT * FROM seg_change")
SEGMENT_CELLS = """,
bought AS (SELECT category, event_month, sum(money) AS revenue FROM ev WHERE event_type = 'purchase' GROUP BY ALL),
segment_cells AS (
  SELECT category, event_month, coalesce(revenue, 0) AS revenue
  FROM (SELECT DISTINCT category FROM bought) CROSS JOIN (SELECT DISTINCT event_month FROM bought)
  LEFT JOIN bought USING (category, event_month))"""
put(
    "segment_matrix", ORDERS + SEGMENT_CELLS,
    """SELECT category, string_agg(CAST(CAST(revenue AS DECIMAL(28,2)) AS VARCHAR), ',' ORDER BY event_month) AS cells
    FROM segment_cells GROUP BY category""",
)
put(
    "segment_matrix_all", ORDERS + SEGMENT_CELLS,
    "SELECT category, event_month, CAST(revenue AS DOUBLE) AS revenue FROM segment_cells",
)
put("segment_impact_brand", ORDERS + impact("brand"), "SELECT * FROM seg_change")
CAUSES = DRIVERS + impact("category") + f""",
drop_rows AS ({drops('rev', 'date', 'revenue', 'revenue', -10)}),
worst2 AS (SELECT * FROM seg_change WHERE prev_month IS NOT NULL
           ORDER BY change_pct ASC NULLS LAST, segment LIMIT 2),
cause_rows AS (
  SELECT 1 AS src, period AS place,
         'Revenue fell ' || CAST(CAST(round_even(abs(change_pct), 0) AS BIGINT) AS VARCHAR) || '% on ' || period
           AS cause, abs(change_pct) AS impact, 'Day-over-day revenue trend anomaly.' AS evidence
  FROM drop_rows
  UNION ALL
  SELECT 2, feature, '''' || feature || ''' strongly correlates with churn ('
         || coalesce(printf('%+.2f', correlation), '+nan') || ')', abs(correlation) * 100,
         'Pearson correlation with churn label.' FROM top3
  UNION ALL
  SELECT 3, segment, 'Segment ''' || segment || ''' revenue changed '
         || coalesce(printf('%+.0f', change_pct), '+nan') || '% MoM', coalesce(abs(change_pct), 0),
         'Month-over-month revenue by segment.' FROM worst2),
causes AS (
  SELECT CAST(row_number() OVER (ORDER BY impact DESC NULLS LAST, src, place) AS INTEGER) AS rank,
         cause, round(impact, 4) AS impact, evidence
  FROM cause_rows ORDER BY rank LIMIT 5)"""
put("rank_causes", OU + TRENDS + CAUSES, "SELECT * FROM causes")
put("rank_causes_clicks", CU + TRENDS + CAUSES, "SELECT * FROM causes")
put(
    "cause_severity", OU + TRENDS + CAUSES,
    """SELECT *, CASE WHEN impact > 50 THEN 'High' WHEN impact > 20 THEN 'Medium' ELSE 'Low' END AS severity
    FROM causes""",
)

# --- experiments -----------------------------------------------------------------------------

ASSIGNED = """,
assigned AS (
  SELECT experiment, user_id,
         CASE WHEN contains('13579bdf', substr(md5(experiment || ':' || CAST(user_id AS VARCHAR)), 8, 1))
              THEN 'treatment' ELSE 'control' END AS variant, reached_purchase AS converted
  FROM us, (VALUES ('checkout'), ('search'), ('pricing')) AS e(experiment))"""


def polynomial(x: str, coefficients: list[float]) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


Z975 = NormalDist().inv_cdf(0.975)
AB = ASSIGNED + f""",
arms AS (
  SELECT experiment, count(*) FILTER (WHERE variant = 'control') AS nc,
         count(*) FILTER (WHERE variant = 'treatment') AS nt,
         coalesce(sum(converted) FILTER (WHERE variant = 'control'), 0)::DOUBLE AS xc,
         coalesce(sum(converted) FILTER (WHERE variant = 'treatment'), 0)::DOUBLE AS xt
  FROM assigned GROUP BY experiment),
rates AS (
  SELECT *, xc / nc AS c, xt / nt AS t, (xc + xt) / (nc + nt) AS q FROM arms),
tested AS (
  SELECT *, t - c AS diff,
         abs(t - c) / nullif(sqrt(q * (1 - q) * (1.0::DOUBLE / nc + 1.0::DOUBLE / nt)), 0) AS z,
         sqrt(c * (1 - c) / nc + t * (1 - t) / nt) * {Z975!r}::DOUBLE AS spread
  FROM rates),
valued AS (
  SELECT *, 2 * CASE WHEN z <= 7.07 THEN exp(-z * z / 2) * ({polynomial('z', TAIL_NUMERATOR)}
         / {polynomial('z', TAIL_DENOMINATOR)}) WHEN z > 7.07 THEN 0.0 END AS p FROM tested),
ab AS (
  SELECT experiment, nc AS control_n, nt AS treatment_n, round(c, 4) AS control_rate,
         round(t, 4) AS treatment_rate, round(diff, 4) AS absolute_lift,
         round(coalesce(100 * diff / nullif(c, 0), 0), 2) AS relative_lift_pct, round(p, 5) AS p_value,
         round(diff - spread, 4) AS ci_low, round(diff + spread, 4) AS ci_high,
         CASE WHEN p < 0.05 THEN 1 ELSE 0 END AS significant,
         CASE WHEN p < 0.05 AND diff > 0 THEN '{SHIP}' WHEN p < 0.05 AND diff < 0 THEN '{DO_NOT_SHIP}'
              ELSE '{MORE_DATA}' END AS recommendation
  FROM valued)"""
put("ab_assign", OU + ASSIGNED, "SELECT * FROM assigned")
put("ab_analyze", OU + AB, "SELECT * FROM ab")
put(
    "ab_confidence", OU + AB,
    "SELECT experiment, p_value, (1 - p_value) * 100 AS confidence_pct FROM ab",
)
put(
    "ab_annual_impact", OU + AB,
    """SELECT experiment, (control_n + treatment_n) * abs(relative_lift_pct / 100) * control_rate
    * 50.0::DOUBLE * 12 AS annual_impact FROM ab""",
)
Z_SUM = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)
put(
    "sample_size_plan", OU,
    f""", b AS (SELECT preferred_category AS segment, count(*) AS users, avg(reached_purchase) AS p
             FROM us GROUP BY 1),
    v AS (SELECT *, (p + (p + 0.01::DOUBLE)) / 2 AS mid FROM b),
    s AS (SELECT *, CASE WHEN mid * (1 - mid) > 0 THEN CAST(ceil(2 * pow({Z_SUM!r}::DOUBLE
              / (((p + 0.01::DOUBLE) - p) / sqrt(mid * (1 - mid))), 2)) AS BIGINT) END AS n FROM v)
    SELECT segment, users, p AS baseline_rate, n AS n_per_arm,
    CASE WHEN users >= 2 * n THEN 1 ELSE 0 END AS enough_users FROM s""",
)

# --- churn -----------------------------------------------------------------------------------

put(
    "churn_feature_matrix", OU,
    "SELECT user_id, "
    + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in FEATURE_COLUMNS)
    + ", is_churned FROM us",
)
put(
    "stratified_split", OU,
    """, h AS (SELECT user_id, is_churned,
      row_number() OVER (PARTITION BY is_churned ORDER BY md5('42:' || CAST(user_id AS VARCHAR)), user_id) AS r,
      count(*) OVER (PARTITION BY is_churned) AS n FROM us)
    SELECT user_id, is_churned, CASE WHEN r <= ceil(0.25 * n) THEN 1 ELSE 0 END AS is_test FROM h""",
)
put(
    "class_weights", OU,
    """, c AS (SELECT is_churned AS label, count(*) AS n FROM us GROUP BY 1)
    SELECT label, n, (SELECT sum(n) FROM c) / (2 * n)::DOUBLE AS balanced_weight,
    CASE WHEN label = 1 THEN (SELECT n FROM c WHERE label = 0) / n::DOUBLE ELSE 1.0::DOUBLE END AS boosted_weight
    FROM c""",
)
#: Newton steps written out below; more than the fit needs, the last ones change nothing.
NEWTON_STEPS = 12
INPUTS = [f"CAST(coalesce({c}, 0) AS DOUBLE)" for c in FEATURE_COLUMNS]
LOGISTIC = """,
split_users AS (
  SELECT *, row_number() OVER (PARTITION BY is_churned ORDER BY md5('42:' || CAST(user_id AS VARCHAR)), user_id)
      <= ceil(0.25 * count(*) OVER (PARTITION BY is_churned)) AS is_test
  FROM us),
class_size AS (SELECT is_churned, count(*) AS n, sum(count(*)) OVER () AS everyone
               FROM split_users WHERE NOT is_test GROUP BY 1),
tall AS (
""" + "\nUNION ALL ".join(
    f"  SELECT user_id, is_churned, is_test, {i} AS i, {x} AS raw FROM split_users" for i, x in enumerate(INPUTS, 1)
) + """),
scale AS (SELECT i, avg(raw) AS mean, stddev_samp(raw) AS spread FROM tall WHERE NOT is_test GROUP BY i),
x AS MATERIALIZED (
  SELECT user_id, is_churned, is_test, i, CASE WHEN spread > 0 THEN (raw - mean) / spread ELSE 0.0::DOUBLE END AS v
  FROM tall JOIN scale USING (i)
  UNION ALL SELECT user_id, is_churned, is_test, 0, 1.0::DOUBLE FROM split_users),
w AS (SELECT user_id, is_churned AS y, everyone / (2 * n)::DOUBLE AS w
      FROM split_users JOIN class_size USING (is_churned) WHERE NOT is_test),
beta0 AS (SELECT i, 0.0::DOUBLE AS b FROM (SELECT unnest(range(""" + str(len(FEATURE_COLUMNS) + 1) + """)) AS i))"""
for _step in range(1, NEWTON_STEPS + 1):
    # The weighted Gram matrix with the gradient as its last column, reduced to the unit matrix.
    LOGISTIC += f""",
p{_step} AS MATERIALIZED (
  SELECT user_id, w, y, 1 / (1 + exp(-z)) AS p
  FROM (SELECT user_id, sum(v * b) AS z FROM x JOIN beta{_step - 1} USING (i) WHERE NOT is_test GROUP BY user_id)
  JOIN w USING (user_id)),
gram{_step} AS MATERIALIZED (
  SELECT a.i AS r, c.i AS c, sum(w * p * (1 - p) * a.v * c.v) + CASE WHEN a.i = c.i AND a.i > 0 THEN 1 ELSE 0 END AS m
  FROM p{_step} JOIN x AS a USING (user_id) JOIN x AS c USING (user_id) GROUP BY 1, 2
  UNION ALL
  SELECT i, {len(FEATURE_COLUMNS) + 1}, sum(w * (p - y) * v) + max(CASE WHEN i > 0 THEN b ELSE 0 END)
  FROM p{_step} JOIN x USING (user_id) JOIN beta{_step - 1} USING (i) GROUP BY i),
solve{_step} AS (
  SELECT 0 AS k, r, c, m FROM gram{_step}
  UNION ALL
  SELECT k + 1, r, c, CASE WHEN r = k THEN m / head ELSE m - in_row * in_column / head END
  FROM (SELECT k, r, c, m, max(CASE WHEN r = k AND c = k THEN m END) OVER () AS head,
               max(CASE WHEN c = k THEN m END) OVER (PARTITION BY r) AS in_row,
               max(CASE WHEN r = k THEN m END) OVER (PARTITION BY c) AS in_column
        FROM solve{_step} WHERE k <= {len(FEATURE_COLUMNS)})),
beta{_step} AS MATERIALIZED (
  SELECT i, b - m AS b FROM beta{_step - 1} JOIN solve{_step} ON r = i
  WHERE k = {len(FEATURE_COLUMNS) + 1} AND c = {len(FEATURE_COLUMNS) + 1})"""
LOGISTIC += f""",
lr_scored AS (
  SELECT user_id, is_churned AS label, 1 / (1 + exp(-sum(v * b))) AS score
  FROM x JOIN beta{NEWTON_STEPS} USING (i) WHERE is_test GROUP BY ALL)"""
AS_RECURSIVE = "RECURSIVE "
put(
    "logreg_coefficients", AS_RECURSIVE + OU + LOGISTIC,
    f"SELECT [{', '.join(repr(c) for c in ('(intercept)', *FEATURE_COLUMNS))}][i + 1] AS feature, "
    f"round(b, 6) AS coefficient, true AS agrees FROM beta{NEWTON_STEPS}",
)
put("logreg_scores", AS_RECURSIVE + OU + LOGISTIC, "SELECT user_id, label, round(score, 6) AS score FROM lr_scored")
put(
    "churn_logreg", AS_RECURSIVE + OU + LOGISTIC,
    f"""SELECT '{MODELS[0]}' AS model, round(sum(CASE WHEN p.score > n.score THEN 2 WHEN p.score = n.score THEN 1 ELSE 0 END)
      / (2 * count(*))::DOUBLE, 4) AS auc, 1 AS is_best
    FROM lr_scored AS p, lr_scored AS n WHERE p.label = 1 AND n.label = 0""",
)
HELD_OUT = """, h AS (SELECT user_id, row_number() OVER (
      PARTITION BY is_churned ORDER BY md5('42:' || CAST(user_id AS VARCHAR)), user_id) AS r,
      count(*) OVER (PARTITION BY is_churned) AS n FROM us)
    SELECT user_id, true AS agrees FROM h WHERE r <= ceil(0.25 * n)"""
put("forest_table_scores", OU, HELD_OUT)
put("boosted_table_scores", OU, HELD_OUT)
put(
    "tree_importances", OU,
    f"SELECT m AS model, f AS feature, true AS agrees FROM (SELECT unnest({list(MODELS[1:])}) AS m), "
    f"(SELECT unnest({FEATURE_COLUMNS}) AS f)",
)
SCORED = """,
scored AS (SELECT user_id, is_churned AS label,
           round((1 + n_cart) / (1.0::DOUBLE + total_events), 4) AS score FROM us)"""
put(
    "auc", OU + SCORED,
    """, p AS (SELECT score, count(*) AS k FROM scored WHERE label = 1 GROUP BY score),
    n AS (SELECT score, count(*) AS k FROM scored WHERE label = 0 GROUP BY score)
    SELECT round(CAST(sum(p.k * n.k * CASE WHEN p.score > n.score THEN 2 WHEN p.score = n.score THEN 1
      ELSE 0 END) AS DOUBLE) / 2 / CAST(sum(p.k * n.k) AS DOUBLE), 4) AS auc FROM p, n""",
)
put(
    "roc_curve", OU + SCORED,
    """, g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score)
    SELECT NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
    UNION ALL SELECT score, CAST(sum(neg) OVER w AS DOUBLE) / CAST((SELECT sum(neg) FROM g) AS DOUBLE),
    CAST(sum(pos) OVER w AS DOUBLE) / CAST((SELECT sum(pos) FROM g) AS DOUBLE) FROM g
    WINDOW w AS (ORDER BY score DESC)""",
)
CONFUSION = SCORED + """,
conf AS (
  SELECT a AS actual, p AS predicted, (SELECT count(*) FROM scored
         WHERE label = a AND CASE WHEN score >= 0.25 THEN 1 ELSE 0 END = p) AS n
  FROM (VALUES (0), (1)) AS x(a), (VALUES (0), (1)) AS y(p))"""
put("confusion_matrix", OU + CONFUSION, "SELECT * FROM conf")
put("confusion_matrix_half", OU + CONFUSION.replace("0.25", "0.5"), "SELECT * FROM conf")
REPORT = """, side AS (
      SELECT l, (SELECT n FROM conf WHERE actual = l AND predicted = l)::DOUBLE AS hit,
             (SELECT sum(n) FROM conf WHERE predicted = l)::DOUBLE AS said,
             (SELECT sum(n) FROM conf WHERE actual = l)::DOUBLE AS support
      FROM (VALUES (0), (1)) AS x(l)),
    pr AS (SELECT l, support, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r
           FROM side),
    f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM pr),
    tot AS (SELECT sum(n)::DOUBLE AS n, sum(n) FILTER (WHERE actual = predicted)::DOUBLE AS ok FROM conf)
    SELECT CAST(l AS VARCHAR) AS class, p AS precision, r AS recall, f1 AS f1_score,
           CAST(support AS BIGINT) AS support FROM f
    UNION ALL SELECT 'accuracy', ok / n, ok / n, ok / n, CAST(n AS BIGINT) FROM tot
    UNION ALL SELECT 'macro avg', (a.p + b.p) / 2, (a.r + b.r) / 2, (a.f1 + b.f1) / 2, CAST(n AS BIGINT)
      FROM f a, f b, tot WHERE a.l = 0 AND b.l = 1
    UNION ALL SELECT 'weighted avg', (a.p * a.support + b.p * b.support) / n,
      (a.r * a.support + b.r * b.support) / n, (a.f1 * a.support + b.f1 * b.support) / n, CAST(n AS BIGINT)
      FROM f a, f b, tot WHERE a.l = 0 AND b.l = 1"""
put("classification_report", OU + CONFUSION, REPORT)
put("classification_report_half", OU + CONFUSION.replace("0.25", "0.5"), REPORT)
put(
    "model_test_users", OU,
    """, h AS (SELECT is_churned, count(*) AS n FROM us GROUP BY is_churned)
    SELECT model, CAST(is_churned AS INTEGER) AS actual, CAST(ceil(0.25 * n) AS BIGINT) AS n_users FROM h,
    (VALUES ('Logistic Regression'), ('Random Forest'), ('Gradient Boosted Trees')) AS x(model)""",
)
put("score_coverage", OU, "SELECT count(*) AS n_users, count(user_id) AS n_scored FROM us")
RISK = """,
risk AS (
  SELECT count(*) FILTER (WHERE is_churned = 1) AS churned_users,
         coalesce(CAST(sum(CAST(customer_lifetime_value AS DECIMAL(28,2)))
           FILTER (WHERE is_churned = 1) AS DOUBLE), 0.0) AS revenue_at_risk
  FROM us)"""
put(
    "revenue_at_risk", OU + RISK,
    """SELECT *, coalesce(revenue_at_risk / nullif(churned_users, 0), 0.0) AS avg_churned_clv FROM risk""",
)
put(
    "churn_overview", OU,
    """SELECT 100 * avg(is_churned) AS churn_rate, count(*) FILTER (WHERE is_churned = 0) AS active_users,
    CAST(sum(CAST(customer_lifetime_value AS DECIMAL(28,2))) FILTER (WHERE is_churned = 0) AS DOUBLE)
      / nullif(count(*) FILTER (WHERE is_churned = 0), 0) AS avg_active_clv,
    CASE WHEN 100 * avg(is_churned) >= 40 THEN 'High' WHEN 100 * avg(is_churned) >= 25 THEN 'Medium'
      ELSE 'Low' END AS risk_level FROM us""",
)
ACTION_CASE = "CASE feature " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in DRIVER_ACTIONS.items()
) + f" ELSE '{DEFAULT_ACTION}' END"
put(
    "driver_actions", OU + RISK + DRIVERS,
    f"""SELECT feature, round(correlation, 6) AS correlation,
    CASE WHEN correlation > 0 THEN 'increases' ELSE 'decreases' END AS direction,
    round(revenue_at_risk * abs(correlation), 2) AS revenue_impact, {ACTION_CASE} AS action
    FROM top3, risk""",
)

# --- health and snapshot ---------------------------------------------------------------------

put(
    "business_health", OU + kpis(),
    """SELECT CASE WHEN growth_rate >= 5 THEN 'Strong' WHEN growth_rate >= -5 THEN 'Stable' ELSE 'Weak' END
      AS growth,
    CASE WHEN retention_rate >= 50 THEN 'Strong' WHEN retention_rate >= 30 THEN 'Stable' ELSE 'Weak' END
      AS retention,
    CASE WHEN growth_rate >= 3 THEN 'Strong' WHEN growth_rate >= -3 THEN 'Stable' ELSE 'Weak' END AS revenue,
    CASE WHEN churn_rate >= 40 THEN 'High' WHEN churn_rate >= 25 THEN 'Medium' ELSE 'Low' END AS risk,
    CASE WHEN churn_rate >= 40 THEN 'danger' WHEN churn_rate >= 25 THEN 'warning' ELSE 'info' END AS alert
    FROM kpi""",
)


def tall(section: str, columns: list[str], table: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {section} AS section, '{c}' AS name, CAST({c} AS DOUBLE) AS value, "
        f"NULL::VARCHAR AS label FROM {table}"
        for c in columns
    )


SNAPSHOT = "\nUNION ALL ".join(
        [
            tall(
                "'kpis'",
                ["dau", "wau", "mau", "growth_rate", "retention_rate", "churn_rate", "total_revenue",
                 "arpu", "n_users"],
                "kpi",
            ),
            "SELECT 'funnel', 'largest_dropoff_stage', NULL, largest_dropoff_stage FROM leak",
            tall("'funnel'", ["largest_dropoff_pct", "overall_conversion"], "leak"),
            tall(
                "'stage:' || stage",
                ["users", "conversion_from_prev_pct", "conversion_from_top_pct", "dropoff_pct"],
                "stages",
            ),
            tall(
                "'segment:' || segment",
                ["users", "avg_clv", "total_revenue", "avg_orders", "avg_sessions", "churn_rate",
                 "revenue_share_pct"],
                "seg_all",
            ),
            "SELECT 'churn', 'rate', churn_rate, NULL FROM kpi",
            "SELECT 'churn', 'top_driver', NULL, feature FROM top3",
        ]
    )
for _name in ("metrics_snapshot", "snapshot_json_values"):
    put(_name, OU + SEGMENTS + FUNNEL + kpis() + DRIVERS, SNAPSHOT)
