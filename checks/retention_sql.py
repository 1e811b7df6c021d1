"""DuckDB statements for the catalogue entries of ``tallyback.catalog_retention``."""

from checks.views import day, dbl, num, stamp, with_views

CALENDAR = """
cal AS (
  SELECT date_trunc('day', min(order_date)) + INTERVAL 90 DAY AS a, date_trunc('day', max(order_date)) - INTERVAL 90 DAY AS f,
         date_trunc('day', max(order_date)) AS last_day
  FROM r_orders),
snaps AS (
  SELECT DISTINCT CAST(d AS TIMESTAMP) AS d
  FROM (SELECT unnest(generate_series(a, f, INTERVAL 30 DAY)) AS d FROM cal UNION SELECT f FROM cal))
"""

ITEM_DIMS = """
idim AS (
  SELECT i.*, p.category, p.brand, p.price AS catalogue_price, o.order_date
  FROM r_items i LEFT JOIN r_products p USING (product_id) LEFT JOIN r_orders o ON i.order_id = o.order_id),
eng AS (
  SELECT *, lower(trim(event_type)) AS kind FROM r_events WHERE lower(trim(event_type)) IN ('view', 'cart', 'wishlist'))
"""

PANEL = (
    CALENDAR
    + ","
    + ITEM_DIMS
    + """,
ho AS (
  SELECT user_id, d, max(order_date) AS last_order_date, count(DISTINCT order_id) AS order_count, sum(total_amount) AS total_spend,
         avg(total_amount) AS avg_order_value
  FROM r_orders JOIN snaps ON order_date < d GROUP BY user_id, d),
hi AS (
  SELECT user_id, d, sum(quantity) AS total_quantity, count(DISTINCT product_id) AS unique_products,
         count(DISTINCT category) AS category_breadth, count(DISTINCT brand) AS brand_breadth
  FROM idim JOIN snaps ON order_date < d GROUP BY user_id, d),
he AS (
  SELECT user_id, d, count(*) FILTER (WHERE kind = 'view') AS view_count, count(*) FILTER (WHERE kind = 'cart') AS cart_count,
         count(*) FILTER (WHERE kind = 'wishlist') AS wishlist_count
  FROM eng JOIN snaps ON event_timestamp < d GROUP BY user_id, d),
hr AS (
  SELECT user_id, d, count(DISTINCT review_id) AS review_count, avg(rating) AS avg_review_rating,
         avg(CASE WHEN rating <= 2 THEN 1.0 ELSE 0 END) AS negative_review_share
  FROM r_reviews JOIN snaps ON review_date < d GROUP BY user_id, d),
fo AS (
  SELECT user_id, d, count(DISTINCT order_id) AS future_order_count, sum(total_amount) AS future_spend
  FROM r_orders JOIN snaps ON order_date >= d AND order_date < d + INTERVAL 90 DAY GROUP BY user_id, d),
panel AS (
  SELECT ho.user_id, ho.d AS snapshot_date, u.gender, ho.last_order_date,
         greatest(0, floor(epoch_us(ho.d - ho.last_order_date) / 86400000000.0)) AS recency_days, ho.total_spend, ho.avg_order_value,
         ln(1 + greatest(ho.total_spend, 0)) AS total_spend_log1p, ln(1 + greatest(ho.avg_order_value, 0)) AS avg_order_value_log1p,
         coalesce(total_quantity, 0) AS total_quantity, order_count, coalesce(unique_products, 0) AS unique_products,
         coalesce(category_breadth, 0) AS category_breadth, coalesce(brand_breadth, 0) AS brand_breadth,
         coalesce(view_count, 0) AS view_count, coalesce(cart_count, 0) AS cart_count, coalesce(wishlist_count, 0) AS wishlist_count,
         coalesce(review_count, 0) AS review_count, coalesce(avg_review_rating, 0) AS avg_review_rating,
         coalesce(negative_review_share, 0) AS negative_review_share,
         greatest(0, floor(epoch_us(ho.d - u.signup_date) / 86400000000.0)) AS tenure_days,
         coalesce(future_order_count, 0) AS future_order_count, coalesce(future_spend, 0) AS future_spend,
         CASE WHEN coalesce(future_order_count, 0) = 0 THEN 1 ELSE 0 END AS churn
  FROM ho JOIN r_users u ON u.user_id = ho.user_id AND u.signup_date <= ho.d
  LEFT JOIN hi ON hi.user_id = ho.user_id AND hi.d = ho.d LEFT JOIN he ON he.user_id = ho.user_id AND he.d = ho.d
  LEFT JOIN hr ON hr.user_id = ho.user_id AND hr.d = ho.d LEFT JOIN fo ON fo.user_id = ho.user_id AND fo.d = ho.d),
current_c AS (
  SELECT *, CASE WHEN recency_days <= 30 AND order_count >= 3 THEN 'Champions' WHEN recency_days > 90 AND order_count >= 2 THEN 'At-risk'
                 WHEN recency_days > 180 THEN 'Lost' WHEN order_count = 1 THEN 'One-time' ELSE 'Core' END AS segment
  FROM panel WHERE snapshot_date = (SELECT f FROM cal))
"""
)
# The final snapshot alone: the same blocks over one date.
CURRENT = PANEL.replace(
    "FROM (SELECT unnest(generate_series(a, f, INTERVAL 30 DAY)) AS d FROM cal UNION SELECT f FROM cal))",
    "FROM (SELECT f AS d FROM cal))",
)

PANEL_COLUMNS = f"""user_id, {stamp('snapshot_date', 'snapshot_date')}, {stamp('last_order_date', 'last_order_date')},
  {num('recency_days')}, {dbl('total_spend', 'total_spend', 2)}, {dbl('avg_order_value', 'avg_order_value', 8)},
  {dbl('total_spend_log1p', 'total_spend_log1p', 8)}, {dbl('avg_order_value_log1p', 'avg_order_value_log1p', 8)},
  {dbl('total_quantity', 'total_quantity', 8)}, {num('order_count')}, {num('unique_products')}, {num('category_breadth')},
  {num('brand_breadth')}, {num('view_count')}, {num('cart_count')}, {num('wishlist_count')}, {num('review_count')},
  {dbl('avg_review_rating', 'avg_review_rating', 8)}, {dbl('negative_review_share', 'negative_review_share', 8)}, {num('tenure_days')},
  {num('future_order_count')}, {dbl('future_spend', 'future_spend', 2)}, {num('churn')}"""

COHORTS = (
    CALENDAR
    + """,
uc AS (
  SELECT user_id, signup_date, strftime(signup_date, '%Y-%m') AS cohort_month FROM r_users, cal WHERE signup_date <= last_day),
sizes AS (SELECT cohort_month, count(DISTINCT user_id) AS cohort_size FROM uc GROUP BY 1),
co AS (
  SELECT user_id, cohort_month, CAST(greatest(0, floor(floor(epoch_us(order_date - signup_date) / 86400000000.0) / 30)) AS BIGINT) AS m,
         CAST(order_date < signup_date AS INT) AS early
  FROM r_orders JOIN uc USING (user_id)),
ret AS (
  SELECT cohort_month, m AS months_since_signup, count(DISTINCT user_id) AS active_users, sum(early) AS orders_before_signup,
         any_value(cohort_size) AS cohort_size
  FROM co JOIN sizes USING (cohort_month) WHERE m BETWEEN 0 AND 12 GROUP BY 1, 2)
"""
)

SERIES = """
daily0 AS (
  SELECT 'total' AS series, CAST(order_date AS DATE) AS day, sum(total_amount) AS revenue FROM r_orders GROUP BY 2
  UNION ALL
  SELECT p.category, CAST(o.order_date AS DATE), sum(i.item_total) FROM r_items i JOIN r_orders o ON i.order_id = o.order_id
  JOIN r_products p ON p.product_id = i.product_id GROUP BY 1, 2),
daily AS (
  SELECT s.series, s.day, coalesce(d.revenue, 0) AS revenue, row_number() OVER (PARTITION BY s.series ORDER BY s.day DESC) AS back
  FROM (SELECT series, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
        FROM daily0 GROUP BY series) s
  LEFT JOIN daily0 d ON d.series = s.series AND d.day = s.day),
train AS (SELECT series, day, revenue, back - 30 AS back FROM daily WHERE back > 30),
test AS (SELECT series, day, revenue FROM daily WHERE back <= 30)
"""


def naive(history: str, horizon: int) -> str:
    return f"""SELECT h.series, h.last_day + CAST(step AS INT) AS day, step, '7-day seasonal naive' AS model, t.revenue AS forecast
  FROM (SELECT series, max(day) AS last_day, unnest(range(1, {horizon + 1})) AS step FROM {history} GROUP BY series) h
  JOIN {history} t ON t.series = h.series AND t.back = 7 - (step - 1) % 7"""


def errors(forecast: str) -> str:
    return f"""SELECT series, model, {dbl('avg(abs(forecast - revenue))', 'mae', 2)},
  {dbl('sqrt(avg((forecast - revenue) ** 2))', 'rmse', 2)}
  FROM ({forecast}) f JOIN test USING (series, day) GROUP BY series, model"""


FORECAST_COLUMNS = f"series, {day('day', 'day')}, {num('step')}, model, {dbl('forecast', 'forecast', 2)}"


def rules(level: str, column: str) -> str:
    labels = f"SELECT DISTINCT i.order_id, {column} AS label FROM idim i JOIN r_orders o ON i.order_id = o.order_id WHERE {column} IS NOT NULL"
    return f"""
{level}_l AS (SELECT * FROM ({labels}) QUALIFY count(*) OVER (PARTITION BY order_id) >= 2),
{level}_n AS (SELECT count(DISTINCT order_id) AS n, greatest(20, ceil(count(DISTINCT order_id) * 0.005)) AS least FROM {level}_l),
{level}_f AS (SELECT label, count(*) AS c FROM {level}_l GROUP BY label),
{level}_p AS (
  SELECT x.label AS a, y.label AS b, count(*) AS pair_n FROM {level}_l x JOIN {level}_l y ON x.order_id = y.order_id AND x.label <> y.label
  GROUP BY 1, 2 HAVING count(*) >= (SELECT least FROM {level}_n)),
{level}_r AS (
  SELECT '{level}' AS rule_level, a AS antecedent, b AS consequent, pair_n * 1.0 / n AS support, pair_n * 1.0 / fa.c AS confidence,
         (pair_n * 1.0 / fa.c) / (fb.c * 1.0 / n) AS lift, pair_n AS co_orders, least AS min_co_orders
  FROM {level}_p JOIN {level}_f fa ON fa.label = a JOIN {level}_f fb ON fb.label = b, {level}_n)"""


RULE_COLUMNS = f"""rule_level, antecedent, consequent, {dbl('support', 'support')}, {dbl('confidence', 'confidence')},
  {dbl('lift', 'lift')}, {num('co_orders')}, {num('min_co_orders')}"""

TFIDF = r"""
words AS (
  SELECT product_id, regexp_extract_all(lower(concat_ws(' ', category, brand, product_name)), '\b\w\w+\b') AS w FROM r_products),
tf AS (
  SELECT product_id, term, count(*) AS tf FROM (
    SELECT product_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words)
  GROUP BY 1, 2),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM r_products)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY term),
vec AS (
  SELECT product_id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY product_id)) AS w FROM tf JOIN idf USING (term))
"""
SIMILAR = (
    TFIDF
    + """,
sim AS (
  SELECT a.product_id AS s, b.product_id AS c, round(sum(a.w * b.w), 9) AS similarity
  FROM vec a JOIN vec b ON a.term = b.term AND a.product_id <> b.product_id GROUP BY 1, 2)
"""
)
RECOMMEND = (
    CURRENT
    + ","
    + SIMILAR
    + """,
hist AS (SELECT * FROM idim WHERE order_date < (SELECT f FROM cal)),
seed AS (
  SELECT user_id, product_id AS s FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY order_date DESC, order_item_id DESC, product_id DESC) AS rn FROM hist)
  WHERE rn = 1),
recs AS (
  SELECT c.user_id, c.segment, s.s, sim.c, similarity,
         row_number() OVER (PARTITION BY c.user_id ORDER BY similarity DESC, sim.c) AS r
  FROM current_c c JOIN seed s USING (user_id) JOIN sim ON sim.s = s.s
  WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = c.user_id AND h.product_id = sim.c))
"""
)

ROBUST = (
    ITEM_DIMS
    + """,
cm AS (SELECT category, median(item_price) AS med FROM idim WHERE category IS NOT NULL GROUP BY 1),
cs AS (SELECT category, any_value(med) AS med, median(abs(item_price - med)) AS mad FROM idim JOIN cm USING (category) GROUP BY 1),
iz AS (
  SELECT idim.*, med, mad, coalesce(0.6745 * (item_price - med) / nullif(mad, 0), 0) AS z FROM idim LEFT JOIN cs USING (category)),
oz AS (
  SELECT order_id, sum(item_total) AS item_total_sum, sum(quantity) AS total_quantity,
         CAST(count(DISTINCT order_item_id) AS DOUBLE) AS item_line_count, max(item_price) AS max_item_price,
         max(abs(z)) AS max_price_robust_z, avg(abs(z)) AS mean_price_robust_z
  FROM iz GROUP BY 1),
feat AS (SELECT o.order_id, oz.* EXCLUDE (order_id) FROM r_orders o LEFT JOIN oz ON o.order_id = oz.order_id)
"""
)
SCORED = ["total_quantity", "item_line_count", "max_item_price", "max_price_robust_z", "item_total_sum", "mean_price_robust_z"]


def _robust_columns() -> str:
    meds = ", ".join(f"median({c}) AS {c}_m" for c in SCORED)
    mads = ", ".join(f"median(abs({c} - {c}_m)) AS {c}_d, any_value({c}_m) AS {c}_m" for c in SCORED)
    zs = ", ".join(f"0.6745 * ({c} - {c}_m) / CASE WHEN {c}_d > 0 THEN {c}_d ELSE 1 END AS {c}_z" for c in SCORED)
    flag = "greatest(" + ", ".join(f"abs({c}_z)" for c in SCORED[:5]) + ")"
    out = ", ".join(dbl(f"{c}_z", f"{c}_z", 5) for c in SCORED)
    return f""",
meds AS (SELECT {meds} FROM feat),
mads AS (SELECT {mads} FROM feat, meds),
zs AS (SELECT order_id, {zs} FROM feat, mads)
SELECT order_id, {out}, {num(f'CASE WHEN {flag} > 3.5 THEN 1 ELSE 0 END', 'robust_z_flag')} FROM zs"""


PCT = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0) / count(*) OVER ()"
SHARE = """SELECT '{0}' AS level_kind, p.{0} AS level, sum(item_total) AS revenue, sum(item_total) / sum(sum(item_total)) OVER () AS share
  FROM r_items i LEFT JOIN r_products p USING (product_id) WHERE order_id IN (SELECT order_id FROM r_orders) GROUP BY p.{0}"""


def _kpis() -> str:
    rows = {
        "valid_order_count": "SELECT count(*) FROM r_orders",
        "valid_order_value": "SELECT sum(total_amount) FROM r_orders",
        "historical_buyers": "SELECT count(DISTINCT user_id) FROM current_c",
        "churn_count": "SELECT sum(churn) FROM current_c",
        "churn_rate": "SELECT avg(churn) FROM current_c",
        "active_next_90_days": "SELECT count(*) FROM current_c WHERE churn = 0",
        "at_risk_customers": "SELECT count(*) FROM current_c WHERE segment = 'At-risk'",
        "top_two_category_share": f"SELECT sum(share) FROM (SELECT share FROM ({SHARE.format('category')}) ORDER BY revenue DESC, level LIMIT 2)",
        "orders_with_items": "SELECT count(*) FROM r_orders WHERE order_id IN (SELECT order_id FROM r_items)",
        "item_total_gap_rate": """SELECT avg(CASE WHEN abs(total_amount - s) > 0.01 THEN 1.0 ELSE 0 END) FROM r_orders
            LEFT JOIN (SELECT order_id, sum(item_total) AS s FROM r_items GROUP BY 1) USING (order_id)""",
    }
    return "\nUNION ALL\n".join(f"SELECT '{k}' AS metric, {dbl(f'({v})', 'value', 4)}" for k, v in rows.items())


SQL: dict[str, str] = {
    "event_filter": with_views(ITEM_DIMS, "SELECT event_id, kind AS event_type FROM eng"),
    "date_range_filter": with_views(
        CALENDAR,
        """SELECT order_id, CASE WHEN order_date < f THEN 'history' WHEN order_date < f + INTERVAL 90 DAY THEN 'outcome' ELSE 'after' END AS period
    FROM r_orders, cal""",
    ),
    "order_reconcile": with_views(
        f"""SELECT order_id, {dbl('total_amount', 'total_amount', 2)}, {num('c', 'item_line_count')}, {dbl('s', 'item_total_sum', 2)},
      {dbl('total_amount - s', 'item_total_gap', 2)}, {dbl('abs(total_amount - s)', 'item_total_gap_abs', 2)}
    FROM r_orders LEFT JOIN (SELECT order_id, count(*) AS c, sum(item_total) AS s FROM r_items GROUP BY 1) USING (order_id)"""
    ),
    "reconciliation_summary": with_views(
        f"""SELECT count(c) AS orders_with_items, count(*) FILTER (WHERE abs(total_amount - s) > 0.01) AS orders_with_gap_over_one_cent,
      {dbl('avg(CASE WHEN abs(total_amount - s) > 0.01 THEN 1.0 ELSE 0 END)', 'gap_rate')}
    FROM r_orders LEFT JOIN (SELECT order_id, count(*) AS c, sum(item_total) AS s FROM r_items GROUP BY 1) USING (order_id)"""
    ),
    "enriched_items": with_views(
        f"""SELECT order_item_id, i.order_id, product_id, i.user_id, {dbl('quantity', 'quantity', 8)}, {dbl('item_price', 'item_price', 8)},
      {dbl('item_total', 'item_total', 8)}, category, brand, {dbl('price', 'catalogue_price', 8)}, {stamp('order_date', 'order_date')},
      {dbl('item_price / nullif(price, 0)', 'price_ratio', 8)}, {dbl('quantity * item_price', 'line_total', 8)},
      {dbl('item_total - quantity * item_price', 'line_gap', 8)}
    FROM r_items i LEFT JOIN r_products USING (product_id) LEFT JOIN r_orders o ON i.order_id = o.order_id"""
    ),
    "order_breadth_rollup": with_views(
        ITEM_DIMS,
        f"""SELECT order_id, {num('count(DISTINCT order_item_id)', 'item_line_count')}, {dbl('sum(quantity)', 'total_quantity', 8)},
      {dbl('sum(item_total)', 'item_total_sum', 2)}, count(DISTINCT product_id) AS unique_products,
      count(DISTINCT category) AS category_breadth, count(DISTINCT brand) AS brand_breadth, {dbl('max(item_price)', 'max_item_price', 8)},
      {dbl('avg(item_price / nullif(catalogue_price, 0))', 'mean_price_ratio', 8)},
      {dbl('max(item_price / nullif(catalogue_price, 0))', 'max_price_ratio', 8)} FROM idim GROUP BY 1""",
    ),
    "nonfinite_repair": with_views(
        "q AS (SELECT order_id, CASE WHEN total_amount > 100000 THEN ln(total_amount - 100000) END AS x FROM r_orders)",
        f"SELECT order_id, {dbl('coalesce(x, (SELECT median(x) FROM q))', 'x')} FROM q",
    ),
    "snapshot_range_join": with_views(
        CALENDAR,
        f"""SELECT user_id, {stamp('d', 'snapshot_date')}, count(*) AS order_count, {dbl('sum(total_amount)', 'total_spend', 2)}
    FROM r_orders JOIN snaps ON order_date < d GROUP BY user_id, d""",
    ),
    "one_to_one_chain": with_views(
        ITEM_DIMS,
        f"""SELECT u.user_id, o.n AS order_count, {dbl('coalesce(q, 0)', 'total_quantity')}, {num('coalesce(v, 0)', 'view_count')},
      {num('coalesce(c, 0)', 'cart_count')}, {num('coalesce(w, 0)', 'wishlist_count')}, {num('coalesce(rn, 0)', 'review_count')}
    FROM r_users u JOIN (SELECT user_id, count(*) AS n FROM r_orders GROUP BY 1) o USING (user_id)
    LEFT JOIN (SELECT user_id, sum(quantity) AS q FROM r_items GROUP BY 1) USING (user_id)
    LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE kind = 'view') AS v, count(*) FILTER (WHERE kind = 'cart') AS c,
                      count(*) FILTER (WHERE kind = 'wishlist') AS w FROM eng GROUP BY 1) USING (user_id)
    LEFT JOIN (SELECT user_id, count(*) AS rn FROM r_reviews GROUP BY 1) USING (user_id)""",
    ),
    "group_stats_join": with_views(
        ROBUST,
        f"SELECT order_item_id, category, {dbl('med', 'price_median', 5)}, {dbl('mad', 'price_mad', 5)}, {dbl('z', 'price_robust_z', 5)} FROM iz",
    ),
    "exclude_purchased": with_views(
        """pop AS (SELECT product_id, row_number() OVER (ORDER BY count(DISTINCT user_id) DESC, product_id) AS popularity_rank
      FROM r_items WHERE user_id IS NOT NULL GROUP BY product_id),
    dep AS (SELECT user_id, count(DISTINCT product_id) + 3 AS reach FROM r_items GROUP BY 1)""",
        """SELECT user_id, product_id, popularity_rank FROM dep JOIN pop ON popularity_rank <= reach
    WHERE NOT EXISTS (SELECT 1 FROM r_items i WHERE i.user_id = dep.user_id AND i.product_id = pop.product_id)""",
    ),
    "cohort_join": with_views(
        COHORTS,
        f"""SELECT cohort_month, m AS months_since_signup, count(*) AS orders, {num('sum(early)', 'orders_before_signup')}
    FROM co WHERE m BETWEEN 0 AND 12 GROUP BY 1, 2""",
    ),
    "daily_revenue": with_views(SERIES, f"SELECT series, {day('day', 'day')}, {dbl('revenue', 'revenue', 2)} FROM daily WHERE series = 'total'"),
    "revenue_share": with_views(
        f"""SELECT level_kind, level, {dbl('revenue', 'revenue', 2)}, {dbl('share', 'share')}
    FROM ({SHARE.format('category')} UNION ALL {SHARE.format('brand')})"""
    ),
    "engagement_reach": with_views(
        ITEM_DIMS,
        """SELECT kind AS event_type, count(DISTINCT user_id) AS unique_users FROM eng GROUP BY 1
    UNION ALL SELECT 'ordered_user', count(DISTINCT user_id) FROM r_orders""",
    ),
    "cohort_sizes": with_views(COHORTS, "SELECT cohort_month, cohort_size FROM sizes"),
    "cohort_retention": with_views(
        COHORTS,
        f"""SELECT cohort_month, months_since_signup, active_users, {num('orders_before_signup')}, cohort_size,
      {dbl('active_users * 1.0 / cohort_size', 'retention')} FROM ret""",
    ),
    "cohort_matrix": with_views(
        COHORTS,
        "SELECT cohort_month, "
        + ", ".join(dbl(f"max(active_users * 1.0 / cohort_size) FILTER (WHERE months_since_signup = {m})", f"month_{m}") for m in range(13))
        + " FROM ret GROUP BY 1",
    ),
    "event_pivot": with_views(
        ITEM_DIMS,
        """SELECT user_id, count(*) FILTER (WHERE kind = 'view') AS view_count, count(*) FILTER (WHERE kind = 'cart') AS cart_count,
      count(*) FILTER (WHERE kind = 'wishlist') AS wishlist_count FROM eng GROUP BY 1""",
    ),
    "customer_history_features": with_views(
        CURRENT,
        f"""SELECT user_id, {stamp('last_order_date', 'last_order_date')}, {num('order_count')}, {dbl('total_spend', 'total_spend', 2)},
      {dbl('avg_order_value', 'avg_order_value', 8)}, {dbl('total_quantity', 'total_quantity', 8)}, {num('unique_products')},
      {num('category_breadth')}, {num('brand_breadth')}, {num('review_count')}, {dbl('avg_review_rating', 'avg_review_rating', 8)},
      {dbl('negative_review_share', 'negative_review_share', 8)} FROM current_c""",
    ),
    "customer_outcome": with_views(
        CURRENT, f"SELECT user_id, {num('future_order_count')}, {dbl('future_spend', 'future_spend', 2)}, {num('churn')} FROM current_c"
    ),
    "segment_summary": with_views(
        CURRENT,
        f"""SELECT segment, count(DISTINCT user_id) AS customers, {dbl('sum(total_spend)', 'historical_spend', 2)},
      {dbl('avg(total_spend)', 'avg_historical_spend', 2)}, {dbl('avg(churn)', 'observed_churn_rate')},
      {dbl('avg(recency_days)', 'avg_recency_days')}, {dbl('avg(order_count)', 'avg_order_count')} FROM current_c GROUP BY 1""",
    ),
    "user_status_rates": with_views(
        f"""SELECT user_id, {dbl("avg(CASE WHEN lower(order_status) = 'cancelled' THEN 1.0 ELSE 0 END)", 'cancelled_rate')},
      {dbl("avg(CASE WHEN lower(order_status) = 'returned' THEN 1.0 ELSE 0 END)", 'returned_rate')} FROM r_orders GROUP BY 1"""
    ),
    "anomaly_rollup": with_views(
        ROBUST,
        f"""SELECT order_id, {dbl('item_total_sum', 'item_total_sum', 2)}, {dbl('total_quantity', 'total_quantity', 8)},
      {dbl('item_line_count', 'item_line_count', 8)}, {dbl('max_item_price', 'max_item_price', 8)},
      {dbl('max_price_robust_z', 'max_price_robust_z', 8)}, {dbl('mean_price_robust_z', 'mean_price_robust_z', 8)} FROM oz""",
    ),
    "robust_z": with_views(ROBUST, "").rstrip().rstrip(",") + _robust_columns(),
    "percent_rank_avg": with_views(f"SELECT review_id, {dbl(PCT.format('rating'), 'rating_rank', 8)} FROM r_reviews WHERE rating IS NOT NULL"),
    "quantile_gate": with_views(
        "SELECT order_id, total_amount >= (SELECT quantile_cont(total_amount, 0.75) FROM r_orders) AS top_quartile FROM r_orders"
    ),
    "last_purchase": with_views(
        CALENDAR,
        ITEM_DIMS,
        """SELECT user_id, product_id AS seed_product_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY order_date DESC, order_item_id DESC, product_id DESC) AS rn FROM idim WHERE order_date < (SELECT f FROM cal)) WHERE rn = 1""",
    ),
    "top_categories": with_views(
        f"""SELECT level AS category, {dbl('revenue', 'revenue', 2)}, {dbl('share', 'share')} FROM (
      SELECT * FROM ({SHARE.format('category')}) ORDER BY revenue DESC, level LIMIT 2)"""
    ),
    "stack_results": with_views(
        SERIES,
        f"""SELECT {day('day', 'day')}, 'Actual' AS row_type, {dbl('revenue', 'value', 2)} FROM daily WHERE series = 'total'
    UNION ALL SELECT {day('day', 'day')}, 'Forecast', {dbl('forecast', 'value', 2)} FROM ({naive('daily', 90)}) WHERE series = 'total'""",
    ),
    "snapshot_dates": with_views(CALENDAR, f"SELECT {stamp('d', 'snapshot_date')} FROM snaps"),
    "customer_snapshot_panel": with_views(PANEL, f"SELECT {PANEL_COLUMNS} FROM panel"),
    "risk_score": with_views(
        CURRENT,
        f"""SELECT user_id, {dbl('r', 'recency_rank', 8)}, {dbl('o', 'order_rank', 8)}, {dbl('e', 'engagement_rank', 8)},
      {dbl('0.5 * r + 0.25 * (1 - o) + 0.25 * (1 - e)', 'risk_score', 8)} FROM (
      SELECT user_id, {PCT.format('recency_days')} AS r, {PCT.format('order_count')} AS o,
             {PCT.format('(view_count + cart_count + wishlist_count)')} AS e FROM current_c)""",
    ),
    "rfm_segments": with_views(CURRENT, f"SELECT user_id, {num('recency_days')}, {num('order_count')}, segment FROM current_c"),
    "risk_band": with_views(
        CURRENT,
        """SELECT user_id, segment, CASE WHEN segment IN ('At-risk', 'Lost') THEN 'High' WHEN segment IN ('One-time', 'Core') THEN 'Medium'
      ELSE 'Low' END AS risk_band FROM current_c""",
    ),
    "temporal_split": with_views(
        PANEL,
        f"""SELECT part, {stamp('snapshot_date', 'snapshot_date')}, count(*) AS customers, {num('sum(churn)', 'churned')}
    FROM panel JOIN (SELECT d, CASE WHEN row_number() OVER (ORDER BY d) <= greatest(1, floor(0.8 * count(*) OVER ())) THEN 'train' ELSE 'test' END AS part
      FROM snaps) ON d = snapshot_date GROUP BY 1, snapshot_date""",
    ),
    "class_weights": with_views(
        f"""SELECT {num("CASE WHEN order_status = 'returned' THEN 1 ELSE 0 END", 'label')}, count(*) AS class_rows,
      {dbl('sum(count(*)) OVER () / (2.0 * count(*))', 'weight')} FROM r_orders GROUP BY CASE WHEN order_status = 'returned' THEN 1 ELSE 0 END"""
    ),
    "classifier_metrics": with_views(
        """sc AS (SELECT CASE WHEN order_status = 'returned' THEN 1 ELSE 0 END AS y, round(total_amount / 1000) / 500 AS s FROM r_orders),
    rk AS (SELECT y, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM sc)""",
        f"""SELECT {dbl('(sum(r) FILTER (WHERE y = 1) - p * (p + 1) / 2.0) / (p * q)', 'roc_auc')},
      {dbl('tp * 1.0 / (tp + fp)', 'precision')}, {dbl('tp * 1.0 / p', 'recall')}, {dbl('2.0 * tp / (2 * tp + fp + p - tp)', 'f1')},
      {num('p + q', 'test_rows')} FROM rk, (SELECT count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q,
        count(*) FILTER (WHERE y = 1 AND s >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND s >= 0.5) AS fp FROM sc) GROUP BY p, q, tp, fp""",
    ),
    "regression_metrics": with_views(
        f"""SELECT {dbl('avg(abs(price - item_price))', 'mae', 3)}, {dbl('sqrt(avg((price - item_price) ** 2))', 'rmse', 3)},
      {dbl('1 - sum((price - item_price) ** 2) / (var_pop(item_price) * count(*))', 'r2', 3)}, count(*) AS test_rows
    FROM r_items JOIN r_products USING (product_id)"""
    ),
    "kpi_summary": with_views(CURRENT, _kpis()),
    "basket_rules": with_views(
        ITEM_DIMS, rules("category", "category"), rules("brand", "brand"),
        f"SELECT {RULE_COLUMNS} FROM category_r UNION ALL SELECT {RULE_COLUMNS} FROM brand_r",
    ),
    "product_rule_diagnostic": with_views(
        ITEM_DIMS, rules("product", "product_id"),
        """SELECT (SELECT count(DISTINCT order_id) FROM idim WHERE order_id IN (SELECT order_id FROM r_orders)) AS product_baskets,
      (SELECT count(DISTINCT product_id) FROM idim WHERE order_id IN (SELECT order_id FROM r_orders)) AS distinct_products,
      (SELECT count(*) FROM product_r) AS product_rules""",
    ),
    "product_tfidf": with_views(TFIDF, f"SELECT product_id, term, {dbl('w', 'weight')} FROM vec"),
    "content_similarity": with_views(
        SIMILAR,
        f"""SELECT s AS seed_product_id, c AS similar_product_id, {dbl('similarity', 'similarity')}, {num('r', 'similarity_rank')} FROM (
      SELECT *, row_number() OVER (PARTITION BY s ORDER BY similarity DESC, c) AS r FROM sim) WHERE r <= 3""",
    ),
    "content_recommendations": with_views(
        RECOMMEND,
        f"""SELECT user_id, segment, s AS seed_product_id, c AS recommended_product_id, {dbl('similarity', 'similarity')},
      {num('r', 'recommendation_rank')}, 'similar text' AS source FROM recs WHERE r <= 3""",
    ),
    "top_k_recommendations": with_views(
        RECOMMEND,
        f"""SELECT segment, {num('r', 'recommendation_rank')}, count(*) AS recommendations, {dbl('avg(similarity)', 'avg_similarity')}
    FROM recs WHERE r <= 3 GROUP BY segment, r""",
    ),
    "seasonal_naive": with_views(SERIES, f"SELECT {FORECAST_COLUMNS} FROM ({naive('train', 30)})"),
    "seasonal_naive_backtest": with_views(SERIES, errors(naive("train", 30))),
    "seasonal_naive_outlook": with_views(SERIES, f"SELECT {FORECAST_COLUMNS} FROM ({naive('daily', 90)})"),
    "naive_and_average_backtest": with_views(
        SERIES,
        errors(
            """SELECT test.series, test.day, 'Naive' AS model, t.revenue AS forecast FROM test JOIN train t ON t.series = test.series AND t.back = 1
      UNION ALL SELECT test.series, test.day, 'Moving average', m FROM test JOIN (SELECT series, avg(revenue) AS m FROM train WHERE back <= 7 GROUP BY 1) t
        ON t.series = test.series"""
        ),
    ),
}
SQL["distinct_dates"] = with_views(PANEL, f"SELECT DISTINCT {stamp('snapshot_date', 'snapshot_date')} FROM panel")
