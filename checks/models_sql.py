"""DuckDB statements for the decision entries of ``tallyback.catalog_models`` that have one right answer."""

from checks.retention_sql import CURRENT, PCT, ROBUST, SCORED
from checks.views import dbl, num, with_views

_meds = ", ".join(f"median({c}) AS {c}_m" for c in SCORED)
_mads = ", ".join(f"median(abs({c} - {c}_m)) AS {c}_d, any_value({c}_m) AS {c}_m" for c in SCORED)
_flag = "greatest(" + ", ".join(
    f"abs(0.6745 * ({c} - {c}_m) / CASE WHEN {c}_d > 0 THEN {c}_d ELSE 1 END)" for c in SCORED[:5]
) + ")"

FLAGS = f"""
meds AS (SELECT {_meds} FROM feat),
mads AS (SELECT {_mads} FROM feat, meds),
flags AS (SELECT order_id, item_total_sum, CASE WHEN {_flag} > 3.5 THEN 1 ELSE 0 END AS review_flag FROM feat, mads),
uf AS (
  SELECT o.user_id, sum(review_flag) AS flagged_orders, count(*) AS orders_reviewed,
         coalesce(sum(item_total_sum) FILTER (review_flag = 1), 0) AS flagged_order_value, sum(review_flag) * 1.0 / count(*) AS flagged_order_rate
  FROM flags JOIN r_orders o USING (order_id) GROUP BY o.user_id)
"""

PLAN = f"""
pred AS (SELECT *, total_spend * 0.1234567 AS predicted_spend FROM current_c),
plan AS (
  SELECT pred.*, coalesce(uf.flagged_orders, 0) AS flagged_orders, coalesce(uf.flagged_order_value, 0) AS flagged_order_value,
         100 * (0.55 * {PCT.format('predicted_spend')} + 0.45 * (0.5 * {PCT.format('recency_days')}
           + 0.25 * (1 - {PCT.format('order_count')}) + 0.25 * (1 - {PCT.format('(view_count + cart_count + wishlist_count)')})))
           AS priority_score,
         CASE WHEN segment IN ('At-risk', 'Lost') THEN 'High' WHEN segment IN ('One-time', 'Core') THEN 'Medium' ELSE 'Low' END AS risk_band,
         (SELECT quantile_cont(predicted_spend, 0.75) FROM pred) AS gate
  FROM pred LEFT JOIN uf USING (user_id))
"""
# CURRENT already defines the item blocks that ROBUST starts with.
ROBUST_TAIL = "cm AS (" + ROBUST.split("cm AS (", 1)[1]


def plan(select: str) -> str:
    return with_views(CURRENT, ROBUST_TAIL, FLAGS, PLAN, select)


# kNN vote over whole numbers: distances are roots of whole numbers, ties go to the smaller key as text.
VOTE = """
marked AS (
  SELECT o.order_id, CASE WHEN order_status = 'returned' THEN 1 ELSE 0 END AS label, lines, units, floor(total_amount / 10000) AS bucket
  FROM r_orders o JOIN (SELECT order_id, count(*) AS lines, sum(quantity) AS units FROM r_items GROUP BY order_id) i USING (order_id)),
met AS (
  SELECT q.order_id, q.label, p.label AS vote, sqrt((p.lines - q.lines) ** 2 + (p.units - q.units) ** 2 + (p.bucket - q.bucket) ** 2) AS d
  FROM marked q JOIN marked p ON q.order_id::BIGINT % 5 = 0 AND p.order_id::BIGINT % 5 <> 0
  QUALIFY row_number() OVER (PARTITION BY q.order_id ORDER BY d, p.order_id) <= 15)
"""

# Ridge on two centred features by Cramer's rule.
RIDGE = """
xy AS (
  SELECT i.lines AS x, i.units AS z, total_amount / 1000 AS y
  FROM r_orders o JOIN (SELECT order_id, count(*) AS lines, sum(quantity) AS units FROM r_items GROUP BY order_id) i USING (order_id)),
m AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM xy),
s AS (
  SELECT sum((x - mx) ** 2) + 10 AS xx, sum((z - mz) ** 2) + 10 AS zz, sum((x - mx) * (z - mz)) AS xz,
         sum((x - mx) * (y - my)) AS xy, sum((z - mz) * (y - my)) AS zy FROM xy, m),
w AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM s),
terms AS (
  SELECT unnest([{'term': 'intercept', 'coefficient': my - a * mx - b * mz}, {'term': 'lines', 'coefficient': a}, {'term': 'units', 'coefficient': b}]) AS t
  FROM w, m)
"""

SQL: dict[str, str] = {
    "ridge_fixed": with_views(RIDGE, f"SELECT t.term AS term, {dbl('t.coefficient', 'coefficient')} FROM terms"),
    "knn_vote_fixed": with_views(
        VOTE,
        f"""SELECT order_id, {num('label')}, {dbl("""CASE WHEN min(d) = 0 THEN avg(vote) FILTER (d = 0)
      ELSE sum(vote / d) / sum(1 / d) END""", 'score')} FROM met GROUP BY order_id, label""",
    ),
    "user_flag_rates": with_views(
        ROBUST,
        FLAGS,
        f"""SELECT user_id, {num('flagged_orders')}, orders_reviewed, {dbl('flagged_order_value', 'flagged_order_value', 2)},
      {dbl('flagged_order_rate', 'flagged_order_rate')} FROM uf""",
    ),
    "priority_score": plan(f"SELECT user_id, {dbl('priority_score', 'priority_score')} FROM plan"),
    "recommended_action": plan(
        """SELECT user_id, segment, CASE
      WHEN segment = 'At-risk' AND predicted_spend >= gate THEN 'Personalized category/brand bundle plus time-limited incentive'
      WHEN segment = 'At-risk' THEN 'Personalized reminder and low-cost incentive'
      WHEN segment = 'Lost' THEN 'Win-back test with strict spend cap'
      WHEN segment = 'One-time' THEN 'Second-purchase journey using content recommendations'
      WHEN segment = 'Champions' THEN 'VIP protection and cross-sell; avoid blanket discounting'
      ELSE 'Cross-sell and category-expansion test' END AS recommended_action FROM plan"""
    ),
    "budget_cap": plan(f"SELECT user_id, {dbl('predicted_spend', 'predicted_spend', 2)}, {dbl('0.1 * predicted_spend', 'budget_cap', 2)} FROM plan"),
    "fraud_hold_status": plan(
        f"""SELECT user_id, {num('flagged_orders')}, CASE WHEN flagged_orders > 0 THEN 'Review flagged orders before crediting recovered revenue'
      ELSE 'No anomaly flag in order history' END AS fraud_review_status FROM plan"""
    ),
    "rank_plan": plan(
        f"""SELECT {num("CASE risk_band WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END", 'severity')}, risk_band, user_id,
      {dbl('priority_score', 'priority_score')} FROM plan ORDER BY severity, priority_score DESC, user_id"""
    ),
    "segment_action_summary": plan(
        f"""SELECT segment, count(*) AS customers, {dbl('sum(total_spend)', 'historical_spend', 2)},
      {dbl('sum(predicted_spend)', 'predicted_spend', 2)}, {dbl('0.1 * sum(predicted_spend)', 'budget_cap', 2)},
      {dbl('avg(churn)', 'observed_churn_rate', 2)}, count(*) FILTER (WHERE flagged_orders > 0) AS flagged_customers FROM plan GROUP BY 1"""
    ),
}
