"""DuckDB text of the six retail tables and of the frames many checks start from."""

VIEWS = """
r_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS user_id, o_orderdate AS order_date,
         CASE o_orderstatus WHEN 'F' THEN 'returned' WHEN 'P' THEN 'cancelled' ELSE 'completed' END AS order_status,
         o_totalprice AS total_amount
  FROM orders),
r_lines AS (
  SELECT l.*, CAST(o.o_custkey AS VARCHAR) AS user_id,
         concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS line_id
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey),
r_items AS (
  SELECT line_id AS order_item_id, CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_id,
         user_id, l_quantity AS quantity, l_extendedprice / l_quantity AS item_price, l_extendedprice AS item_total
  FROM r_lines),
r_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_type AS category, p_brand AS brand,
         p_retailprice AS price, CAST(1 + p_size % 5 AS DOUBLE) AS rating
  FROM part),
r_users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name, lower(c_name) || '@example.com' AS email,
         c_mktsegment AS gender, CAST(c_nationkey AS VARCHAR) AS city,
         TIMESTAMP '1995-01-01' + to_days(CAST((c_custkey * 37) % 2400 AS INT)) AS signup_date
  FROM customer),
r_reviews AS (
  SELECT line_id AS review_id, CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_id,
         user_id, CAST(1 + CAST(round(l_tax * 100) AS INT) % 5 AS DOUBLE) AS rating,
         concat(l_returnflag, l_linestatus) AS review_text, l_shipdate AS review_date
  FROM r_lines),
r_events AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS product_id,
         CASE event_type WHEN 'click' THEN 'cart' WHEN 'signup' THEN 'wishlist' ELSE event_type END AS event_type,
         ts - to_days(8400) AS event_timestamp
  FROM events)
"""

ITEM_PRODUCT = """
ip AS (
  SELECT i.*, coalesce(nullif(trim(p.category), ''), 'Missing') AS category,
         coalesce(nullif(trim(p.brand), ''), 'Missing') AS brand,
         p.rating AS product_rating, p.product_id IS NOT NULL AS product_matched, p.price AS catalogue_price
  FROM r_items i LEFT JOIN r_products p USING (product_id)),
dom_cat AS (
  SELECT order_id, category AS dominant_category, n FROM (
    SELECT order_id, category, count(*) AS n,
           row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, category) AS rn
    FROM ip GROUP BY order_id, category) WHERE rn = 1),
dom_brand AS (
  SELECT order_id, brand AS dominant_brand FROM (
    SELECT order_id, brand, row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, brand) AS rn
    FROM ip GROUP BY order_id, brand) WHERE rn = 1),
rollup_v AS (
  SELECT order_id, count(*) AS item_count, sum(quantity) AS units, max(item_price) AS max_price,
         avg(product_rating) AS avg_product_rating, any_value(dominant_category) AS dominant_category,
         any_value(dominant_brand) AS dominant_brand, count(*) FILTER (WHERE NOT product_matched) AS unmatched_product_lines
  FROM ip JOIN dom_cat USING (order_id) JOIN dom_brand USING (order_id)
  GROUP BY order_id)
"""

MART = (
    ITEM_PRODUCT
    + """,
ranked AS (
  SELECT *, row_number() OVER (ORDER BY total_amount, user_id NULLS LAST, order_date NULLS LAST, order_id) AS rn,
         count(*) OVER () AS n
  FROM r_orders WHERE total_amount IS NOT NULL),
quint AS (
  SELECT order_id, ['Q1 lowest', 'Q2', 'Q3', 'Q4', 'Q5 highest'][
           CAST(greatest(1, ceil(5.0 * (rn - 1) / (n - 1))) AS INT)] AS value_quintile
  FROM ranked),
mart AS (
  SELECT o.order_id, o.user_id, o.order_status, o.order_date, o.total_amount,
         CASE WHEN o.order_status = 'returned' THEN 1 ELSE 0 END AS returned,
         CASE WHEN o.order_status = 'returned' THEN 'Returned' ELSE 'Not returned' END AS return_status,
         r.item_count, r.units, r.max_price, r.avg_product_rating,
         coalesce(r.dominant_category, 'Missing') AS dominant_category,
         coalesce(r.dominant_brand, 'Missing') AS dominant_brand,
         coalesce(nullif(trim(u.gender), ''), 'Missing') AS gender, u.signup_date,
         epoch_us(o.order_date - u.signup_date) / 86400000000.0 AS tenure_days,
         seq AS order_sequence,
         CASE WHEN seq IS NULL THEN 'Missing' WHEN seq = 1 THEN '1st' WHEN seq = 2 THEN '2nd' WHEN seq = 3 THEN '3rd'
              ELSE '4+' END AS sequence_group,
         coalesce(q.value_quintile, 'Missing') AS value_quintile,
         coalesce(monthname(o.order_date), 'Missing') AS month_name,
         coalesce(dayname(o.order_date), 'Missing') AS day_name,
         date_trunc('month', o.order_date) AS order_month
  FROM (SELECT *, CASE WHEN user_id IS NULL THEN NULL ELSE row_number() OVER (
          PARTITION BY user_id ORDER BY order_date NULLS LAST, order_id) END AS seq FROM r_orders) o
  LEFT JOIN rollup_v r USING (order_id) LEFT JOIN r_users u ON o.user_id = u.user_id LEFT JOIN quint q USING (order_id))
"""
)

SEGMENTS = (
    MART
    + """,
seg AS (
  SELECT dimension, level, count(*) AS orders, sum(returned) AS returned_orders FROM (
    SELECT returned, unnest([
      {'dimension': 'Dominant product category', 'level': dominant_category},
      {'dimension': 'Dominant brand', 'level': dominant_brand},
      {'dimension': 'Order-value quintile', 'level': value_quintile},
      {'dimension': 'Items per order', 'level': coalesce(CAST(item_count AS VARCHAR), 'Missing')},
      {'dimension': 'Gender', 'level': gender},
      {'dimension': 'Month of year', 'level': month_name},
      {'dimension': 'Day of week', 'level': day_name},
      {'dimension': 'Customer order sequence', 'level': sequence_group}], recursive := true)
    FROM mart) GROUP BY dimension, level),
reviewed AS (
  SELECT r.*, CASE WHEN o.order_status = 'returned' THEN 1 ELSE 0 END AS returned,
         CASE WHEN o.order_status = 'returned' THEN 'Returned' ELSE 'Not returned' END AS return_status,
         coalesce(nullif(trim(r.review_text), ''), 'Missing') AS text_label
  FROM r_reviews r JOIN r_orders o USING (order_id)),
assoc AS (
  SELECT * FROM seg
  UNION ALL SELECT 'Review text (exact normalized labels)', text_label, count(*), sum(returned) FROM reviewed GROUP BY text_label
  UNION ALL SELECT 'Review rating', printf('%.1f', rating), count(*), sum(returned) FROM reviewed
            WHERE rating IS NOT NULL GROUP BY rating),
tot AS (
  SELECT dimension, sum(orders) AS n, sum(returned_orders) AS n1, count(*) AS levels FROM assoc GROUP BY dimension),
cells AS (
  SELECT a.dimension, a.orders * t.n1 / t.n AS e1, a.orders * (t.n - t.n1) / t.n AS e0, a.returned_orders AS o1,
         a.orders - a.returned_orders AS o0, t.n, t.levels
  FROM assoc a JOIN tot t USING (dimension)),
tests AS (
  SELECT dimension, CASE WHEN any_value(levels) >= 2 THEN sum((o0 - e0) ** 2 / e0 + (o1 - e1) ** 2 / e1) END AS chi2,
         CASE WHEN any_value(levels) >= 2 THEN any_value(levels) - 1 ELSE 0 END AS degrees_freedom, any_value(n) AS n,
         CASE WHEN any_value(levels) >= 2 THEN sum(CAST(e0 < 5 AS INT) + CAST(e1 < 5 AS INT)) ELSE 0 END AS low,
         CASE WHEN any_value(levels) >= 2 THEN any_value(levels) * 2 ELSE 0 END AS cells
  FROM cells GROUP BY dimension)
"""
)

POOLED = """
pooled AS (SELECT avg(CASE WHEN order_status = 'returned' THEN 1.0 ELSE 0 END) AS p FROM r_orders)
"""

# From counts n, k per row of cust to p-values.
BINOMIAL = """
pairs AS (SELECT DISTINCT n, k, p FROM cust),
pmf AS (
  SELECT n, i, exp(CASE WHEN n = 0 THEN 0 ELSE lgamma(n + 1) - lgamma_safe_i - lgamma_safe_r + i * ln(p) + (n - i) * ln(1 - p) END) AS f
  FROM (SELECT n, p, i, CASE WHEN i < 2 THEN 0 ELSE lgamma(i + 1) END AS lgamma_safe_i,
               CASE WHEN n - i < 2 THEN 0 ELSE lgamma(n - i + 1) END AS lgamma_safe_r
        FROM (SELECT n, p, unnest(range(0, n + 1)) AS i FROM (SELECT DISTINCT n, p FROM pairs)))),
pv AS (
  SELECT a.n, a.k, least(1.0, sum(b.f) FILTER (WHERE b.f <= c.f * (1 + 1e-7))) AS pval
  FROM pairs a JOIN pmf b ON a.n = b.n JOIN pmf c ON c.n = a.n AND c.i = a.k GROUP BY a.n, a.k),
tested AS (
  SELECT cust.*, pval, pval < 0.01 AS unusual,
         CASE WHEN k > expected THEN 'Above expectation' WHEN k < expected THEN 'Below expectation'
              ELSE 'At expectation' END AS direction
  FROM cust JOIN pv USING (n, k))
"""

CUSTOMERS = (
    POOLED.rstrip()
    + """,
cust AS (
  SELECT u.user_id, coalesce(n, 0) AS n, coalesce(k, 0) AS k, p, coalesce(n, 0) * p AS expected,
         CASE WHEN coalesce(k, 0) = 0 THEN 0.0 ELSE v END AS v, coalesce(c, 0) AS c
  FROM (SELECT DISTINCT user_id FROM r_users) u
  LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE order_status = 'returned') AS k,
                    sum(total_amount) FILTER (WHERE order_status = 'returned') AS v,
                    count(total_amount) FILTER (WHERE order_status = 'returned') AS c
             FROM r_orders WHERE user_id IS NOT NULL GROUP BY user_id) USING (user_id), pooled)
"""
    + ",\n"
    + BINOMIAL.strip()
)

# Orders and returned orders per product bought; an order counts once however many of its lines hold the product.
PRODUCTS = (
    POOLED.rstrip()
    + """,
cust AS (
  SELECT product_id, count(*) AS n, count(*) FILTER (WHERE order_status = 'returned') AS k, any_value(p) AS p, count(*) * any_value(p) AS expected
  FROM (SELECT DISTINCT order_id, product_id FROM r_items WHERE product_id IS NOT NULL) JOIN r_orders USING (order_id), pooled
  GROUP BY product_id),
"""
    + BINOMIAL.strip()
)

MONTHS = """
mon AS (
  SELECT date_trunc('month', order_date) AS month, count(*) FILTER (WHERE order_status = 'returned') AS c,
         sum(total_amount) FILTER (WHERE order_status = 'returned') AS v
  FROM r_orders WHERE order_date IS NOT NULL GROUP BY 1),
ends AS (SELECT min(month) AS a, max(month) AS b, (SELECT max(order_date) FROM r_orders) AS last_order FROM mon),
spine AS (
  SELECT m.month, row_number() OVER (ORDER BY m.month) - 1 AS x,
         CASE WHEN mon.month IS NULL THEN 0 ELSE c END AS c, CASE WHEN mon.month IS NULL THEN 0 ELSE v END AS v,
         m.month = b AND day(last_order) < day(last_day(last_order)) AS partial, b, (SELECT count(*) FROM mon) AS k
  FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS month, b, last_order FROM ends) m
  LEFT JOIN mon ON mon.month = m.month)
"""


def with_views(*blocks_and_select: str) -> str:
    """A full statement: the six tables, further CTE blocks, and the closing SELECT."""
    *blocks, select = blocks_and_select
    return "WITH " + ",\n".join([VIEWS.strip(), *[b.strip() for b in blocks]]) + "\n" + select


def dbl(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) AS {name}"


def num(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"


def day(expr: str, name: str, fmt: str = "%Y-%m-%d") -> str:
    return f"strftime({expr}, '{fmt}') AS {name}"


def stamp(expr: str, name: str) -> str:
    return day(expr, name, "%Y-%m-%d %H:%M:%S")
