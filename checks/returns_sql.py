"""DuckDB statements for the catalogue entries of ``tallyback.catalog_returns``."""

from checks.views import CUSTOMERS, ITEM_PRODUCT, MART, MONTHS, PRODUCTS, SEGMENTS, day, dbl, num, stamp, with_views

LOW, HIGH = "100000.0", "400000.0"
TABLES = ["events", "order_items", "orders", "products", "reviews", "users"]
VIEW_OF = {"events": "r_events", "order_items": "r_items", "orders": "r_orders", "products": "r_products",
           "reviews": "r_reviews", "users": "r_users"}
KEYS = {"events": "event_id", "order_items": "order_item_id", "orders": "order_id", "products": "product_id",
        "reviews": "review_id", "users": "user_id"}
COLUMNS = {
    "orders": ["order_id", "user_id", "order_date", "order_status", "total_amount"],
    "order_items": ["order_item_id", "order_id", "product_id", "user_id", "quantity", "item_price", "item_total"],
    "products": ["product_id", "product_name", "category", "brand", "price", "rating"],
    "users": ["user_id", "name", "email", "gender", "city", "signup_date"],
    "reviews": ["review_id", "order_id", "product_id", "user_id", "rating", "review_text", "review_date"],
    "events": ["event_id", "user_id", "product_id", "event_type", "event_timestamp"],
}
TEXT = {
    "orders": ["order_id", "user_id", "order_status"],
    "order_items": ["order_item_id", "order_id", "product_id", "user_id"],
    "products": ["product_id", "product_name", "category", "brand"],
    "users": ["user_id", "name", "email", "gender", "city"],
    "reviews": ["review_id", "order_id", "product_id", "user_id", "review_text"],
    "events": ["event_id", "user_id", "product_id", "event_type"],
}
PARSED = {
    "orders": ["total_amount", "order_date"],
    "order_items": ["quantity", "item_price", "item_total"],
    "products": ["price", "rating"],
    "users": ["signup_date"],
    "reviews": ["rating", "review_date"],
    "events": ["event_timestamp"],
}

DIRTY = """
d_orders AS (
  SELECT order_id, user_id, order_status,
         CASE WHEN order_status <> 'cancelled' THEN total_amount END AS total_amount,
         CASE WHEN order_status <> 'cancelled' THEN order_date END AS order_date
  FROM r_orders)
"""


def each(template: str) -> str:
    """One SELECT per table, stacked; {t} is its name, {v} its view, {k} its key."""
    return "\nUNION ALL\n".join(template.format(t=n, v=VIEW_OF[n], k=KEYS[n]) for n in TABLES)


def _file_quality(name: str) -> str:
    view, key, cols = VIEW_OF[name], KEYS[name], COLUMNS[name]
    nulls = " + ".join(f"CAST({c} IS NULL AS INT)" for c in cols)
    return f"""SELECT '{name}' AS table_name, CAST({len(cols)} AS BIGINT) AS table_columns, '{key}' AS key_column,
      {num('count(*)', 'table_rows')}, {num(f'sum({nulls})', 'null_cells')},
      {num(f'count(*) FILTER (WHERE {nulls} > 0)', 'rows_with_any_null')},
      {num(f'count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {view}))', 'exact_duplicate_extra_rows')},
      {num(f'count(*) FILTER (WHERE {key} IS NULL)', 'key_null_rows')},
      {num(f'count(*) - (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {view}))', 'repeated_key_extra_rows')},
      {num(f'(SELECT count(*) FROM (SELECT {key} FROM {view} WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*) > 1))',
           'repeated_key_values')}
    FROM {view}"""


def _column_nulls() -> str:
    parts = []
    for n in TABLES:
        for c in COLUMNS[n]:
            blank = f"count(*) FILTER (WHERE trim({c}) = '')" if c in TEXT[n] else "0"
            parts.append(
                f"SELECT '{n}' AS table_name, '{c}' AS column_name, {num(f'count(*) - count({c})', 'null_count')}, "
                f"{dbl(f'(count(*) - count({c})) * 100.0 / count(*)', 'null_pct')}, {num(blank, 'blank_count')} FROM {VIEW_OF[n]}"
            )
    return "\nUNION ALL\n".join(parts)


def _coercion() -> str:
    parts = []
    for n in TABLES:
        for c in PARSED[n]:
            if n == "orders":
                bad = "count(*) FILTER (WHERE order_status = 'cancelled')"
            elif (n, c) == ("products", "price"):
                bad = "count(*) FILTER (WHERE category = 'LARGE')"
            elif n == "events":
                # the text keeps fractions of a second, so it never has the plain date-time format
                bad = "count(*) FILTER (WHERE epoch_us(event_timestamp) % 1000000 <> 0)"
            else:
                bad = f"count(*) - count({c})"
            parts.append(f"SELECT '{n}' AS table_name, '{c}' AS column_name, {num(bad, 'unusable_cells')} FROM {VIEW_OF[n]}")
    return "\nUNION ALL\n".join(parts)


def _orphan(link: str, child: str, parent: str, key: str) -> str:
    return (
        f"SELECT '{link}' AS link, {num(f'count(*) FILTER (WHERE {key} IS NULL OR {key} NOT IN (SELECT {key} FROM {parent}))', 'orphan_rows')}, "
        f"{num('count(*)', 'child_rows')} FROM {child}"
    )


ORPHANS = "\nUNION ALL\n".join(
    [
        _orphan("orders_without_user", "r_orders", "r_users", "user_id"),
        _orphan("orders_without_items", "r_orders", "r_items", "order_id"),
        _orphan("items_without_order", "r_items", "r_orders", "order_id"),
        _orphan("items_without_product", "r_items", "r_products", "product_id"),
        _orphan("reviews_without_order", "r_reviews", "r_orders", "order_id"),
    ]
)


def _mismatch(link: str, child: str) -> str:
    return (
        f"SELECT '{link}' AS link, {num('count(*) FILTER (WHERE c.user_id <> o.user_id)', 'mismatched_rows')}, "
        f"{num('count(*)', 'linked_rows')} FROM {child} c JOIN r_orders o USING (order_id)"
    )


MISMATCHES = _mismatch("item_user_differs", "r_items") + "\nUNION ALL\n" + _mismatch("review_user_differs", "r_reviews")
EARLY = f"""SELECT {num('count(*) FILTER (WHERE order_date < signup_date)', 'orders_before_signup')},
  {num('count(*) FILTER (WHERE order_date IS NOT NULL AND signup_date IS NOT NULL)', 'comparable_orders')}
  FROM r_orders LEFT JOIN r_users USING (user_id)"""


def _metrics(source: str, metrics: dict[str, str], digits: int = 6) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS metric, {dbl(expr, 'value', digits)} FROM {source}" for name, expr in metrics.items()
    )


KPI = {
    "Orders": "count(*)",
    "Returned orders": "count(*) FILTER (WHERE order_status = 'returned')",
    "Overall return rate": "avg(CASE WHEN order_status = 'returned' THEN 1.0 ELSE 0 END)",
    "Total order value": "sum(total_amount)",
    "Returned order value": "sum(total_amount) FILTER (WHERE order_status = 'returned')",
    "Returned value share": "sum(total_amount) FILTER (WHERE order_status = 'returned') / sum(total_amount)",
    "Non-returned order value": "sum(total_amount) FILTER (WHERE order_status <> 'returned')",
    "Orders with usable total_amount": "count(total_amount)",
}
TWO_BASES = {
    "Return rate, all orders": KPI["Overall return rate"],
    "Return rate, orders not cancelled": "avg(CASE WHEN order_status = 'returned' THEN 1.0 ELSE 0 END) FILTER (WHERE order_status <> 'cancelled')",
}
LOST = {
    "Gross order value": "sum(total_amount)",
    "Lost value": "sum(total_amount) FILTER (WHERE order_status IN ('returned', 'cancelled'))",
    "Lost value share": "sum(total_amount) FILTER (WHERE order_status IN ('returned', 'cancelled')) / sum(total_amount)",
}
RATE = dbl("returned_orders * 1.0 / orders", "return_rate")


def _concentration() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT CAST({x} AS DOUBLE) AS amount_above, {num(f'count(*) FILTER (WHERE total_amount > {x})', 'returned_orders')}, "
        f"{dbl(f'count(*) FILTER (WHERE total_amount > {x}) * 1.0 / count(*)', 'order_share')}, "
        f"{dbl(f'sum(total_amount) FILTER (WHERE total_amount > {x}) / sum(total_amount)', 'value_share')} "
        f"FROM r_orders WHERE order_status = 'returned'"
        for x in (LOW, HIGH)
    )


LINKAGE = f"""SELECT link AS check_name, orphan_rows AS failing_rows, child_rows AS denominator FROM ({ORPHANS})
UNION ALL SELECT link, mismatched_rows, linked_rows FROM ({MISMATCHES})
UNION ALL SELECT 'orders_before_signup', orders_before_signup, comparable_orders FROM ({EARLY})
UNION ALL SELECT 'order_amount_unusable', count(*) - count(total_amount), count(*) FROM r_orders
UNION ALL SELECT 'order_date_unusable', count(*) - count(order_date), count(*) FROM r_orders"""

CUSTOMER_COLUMNS = f"""user_id, {num('n', 'customer_orders')}, {num('k', 'customer_returns')},
  {dbl('expected', 'expected_returns')}, {dbl('v', 'returned_order_value', 2)}, {num('c', 'returned_value_order_count')}"""


def _forecast(full_only: bool) -> str:
    fit = "NOT partial" if full_only else "true"
    status = "CASE WHEN partial THEN 'Actual (partial month)' ELSE 'Actual (full month)' END"
    extra = f"{status} AS period_status, {fit} AS included_in_trend_fit," if full_only else ""
    extra_future = "'Forecast' AS period_status, false AS included_in_trend_fit," if full_only else ""
    return f""",
fit AS (SELECT max(x) AS lastx, max(month) AS lastm, regr_slope(c, x) FILTER (WHERE {fit}) AS cs,
  regr_intercept(c, x) FILTER (WHERE {fit}) AS ci, regr_slope(v, x) FILTER (WHERE {fit}) AS vs,
  regr_intercept(v, x) FILTER (WHERE {fit}) AS vi FROM spine)
SELECT {extra} {day('month', 'month')}, {dbl('c', 'returned_order_count', 2)}, {dbl('v', 'returned_order_value', 2)},
  CAST(NULL AS DOUBLE) AS forecast_order_count, CAST(NULL AS DOUBLE) AS forecast_order_value FROM spine
UNION ALL
SELECT {extra_future} strftime(lastm + to_months(CAST(h AS INT)), '%Y-%m-%d'), NULL, NULL,
  round(greatest(0, ci + cs * (lastx + h)), 2), round(greatest(0, vi + vs * (lastx + h)), 2)
FROM fit, (SELECT unnest([1, 2, 3]) AS h)"""


MONTH_BASE = with_views(MONTHS, "").rstrip().rstrip(",")

ORDER_COLUMNS = f"order_id, user_id, {stamp('order_date', 'order_date')}, order_status, {dbl('total_amount', 'total_amount', 2)}"
ROLLUP_COLUMNS = f"""{num('item_count')}, {dbl('units', 'units', 2)}, {dbl('max_price', 'max_price', 8)},
  {dbl('avg_product_rating', 'avg_product_rating', 8)}, dominant_category, dominant_brand, {num('unmatched_product_lines')}"""
LEVEL_POSITION = """CASE dimension
  WHEN 'Order-value quintile' THEN nullif(list_position(['Q1 lowest','Q2','Q3','Q4','Q5 highest','Missing'], level), 0)
  WHEN 'Month of year' THEN nullif(list_position(['January','February','March','April','May','June','July','August','September','October','November','December','Missing'], level), 0)
  WHEN 'Day of week' THEN nullif(list_position(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday','Missing'], level), 0)
  WHEN 'Customer order sequence' THEN nullif(list_position(['1st','2nd','3rd','4+','Missing'], level), 0)
  ELSE try_cast(level AS DOUBLE) END"""
SUMMARY = {
    "Listed customers": "count(*)",
    "Customers with linked orders": "count(*) FILTER (WHERE n > 0)",
    "Orders linked to listed users": "sum(n)",
    "Pooled return probability": "max(p)",
    "Expected returns among linked customers": "sum(expected)",
    "Observed returns among linked customers": "sum(k)",
    "Unusual customers": "count(*) FILTER (WHERE unusual)",
    "Unusual customers above expectation": "count(*) FILTER (WHERE unusual AND direction = 'Above expectation')",
    "Returned value for unusual customers": "coalesce(sum(v) FILTER (WHERE unusual), 0)",
    "Returned value for unusual customers above expectation": "coalesce(sum(v) FILTER (WHERE unusual AND direction = 'Above expectation'), 0)",
    "Unusual customers below expectation": "count(*) FILTER (WHERE unusual AND direction = 'Below expectation')",
}
PRODUCT_SUMMARY = {
    "Products tested": "count(*)",
    "Unusual products": "count(*) FILTER (WHERE unusual)",
    "Unusual products above expectation": "count(*) FILTER (WHERE unusual AND direction = 'Above expectation')",
    "Unusual products below expectation": "count(*) FILTER (WHERE unusual AND direction = 'Below expectation')",
    "Unusual products by chance, at most": "count(*) * 0.01",
    "Smallest p-value": "min(pval)",
    "Bonferroni p-value of the smallest": "least(1.0, min(pval) * count(*))",
}

# Upper tail of chi-square: one minus the series of the regularised incomplete gamma function.
TAILS = """
tails AS (
  SELECT *, CASE WHEN chi2 = 0 THEN 1.0 WHEN chi2 IS NOT NULL THEN greatest(0.0, 1 - list_sum(list_transform(range(20000),
           lambda k: exp((degrees_freedom / 2.0 + k) * ln(chi2 / 2) - chi2 / 2 - lgamma(degrees_freedom / 2.0 + k + 1))))) END AS p
  FROM tests)
"""
TEST_COLUMNS = f"""dimension, {dbl('chi2', 'chi2')}, {num('degrees_freedom')}, {dbl('sqrt(chi2 / n)', 'cramers_v')}, {num('n', 'orders_tested')},
      {num('low', 'expected_cells_below_5')}, {num('cells', 'expected_cell_count')},
      {dbl('low * 1.0 / nullif(cells, 0)', 'pct_expected_cells_below_5')}, {dbl('p', 'p_value')}"""

SQL: dict[str, str] = {
    "chi_square_p_values": with_views(SEGMENTS, TAILS, f"SELECT {TEST_COLUMNS} FROM tails"),
    "bonferroni": with_views(SEGMENTS, TAILS, f"SELECT {TEST_COLUMNS}, {dbl('least(1.0, p * count(p) OVER ())', 'bonferroni_p')} FROM tails"),
    "csv_scan": with_views(
        "\nUNION ALL\n".join(
            f"""SELECT '{n}' AS table_name, {f"count(*) FILTER (order_status <> 'cancelled')" if n == 'orders' else 'count(*)'} AS table_rows,
      {f"count(*) FILTER (order_status = 'cancelled')" if n == 'orders' else '0::BIGINT'} AS bad_rows, 0::BIGINT AS unlike_rows FROM {VIEW_OF[n]}"""
            for n in TABLES
        )
    ),
    "scan_tables": with_views(each("SELECT '{t}' AS table_name, count(*) AS table_rows FROM {v}")),
    "schema_contract": with_views(
        "\nUNION ALL\n".join(
            f"SELECT '{n}' AS table_name, count(*) AS table_rows, '{c}' AS column_name, true AS present FROM {VIEW_OF[n]}"
            for n in TABLES for c in COLUMNS[n]
        )
    ),
    "unique_key_guard": with_views(
        each(
            "SELECT '{t}' AS table_name, '{k}' AS key_column, count(*) AS repeated_keys FROM "
            "(SELECT {k} FROM {v} GROUP BY 1 HAVING count(*) > 1)"
        )
    ),
    "join_cardinality_guard": with_views(
        "\nUNION ALL\n".join(
            f"SELECT '{link}' AS link, '{k}' AS key_column, count(*) AS repeated_keys FROM (SELECT {k} FROM {v} GROUP BY 1 HAVING count(*) > 1)"
            for link, v, k in [
                ("items_to_products", "r_products", "product_id"), ("items_to_orders", "r_orders", "order_id"),
                ("orders_to_users", "r_users", "user_id"), ("reviews_to_orders", "r_orders", "order_id"),
            ]
        )
    ),
    "source_audit": with_views(
        each(
            "SELECT '{t}' AS table_name, CAST(sum(c) AS BIGINT) AS source_rows, CAST(sum(c) - count(*) AS BIGINT) AS exact_duplicate_rows, "
            "count(*) AS rows_after_exact_dedup, CAST(count(*) - count(DISTINCT {k}) AS BIGINT) AS duplicate_keys_after_dedup "
            "FROM (SELECT {k}, c FROM (SELECT *, count(*) AS c FROM {v} GROUP BY ALL))"
        )
    ),
    "sink": with_views(
        ITEM_PRODUCT,
        f"""SELECT coalesce(d.dominant_category, 'Missing') AS dominant_category, count(*) AS orders,
      count(*) FILTER (WHERE order_status = 'returned') AS returned_orders,
      {dbl("avg(CASE WHEN order_status = 'returned' THEN 1.0 ELSE 0 END)", 'return_rate')}
    FROM r_orders o LEFT JOIN dom_cat d USING (order_id) GROUP BY 1""",
    ),
    "empty_result_guard": with_views(
        ITEM_PRODUCT,
        MONTHS,
        """SELECT 'category_rates' AS result, count(DISTINCT coalesce(d.dominant_category, 'Missing')) AS result_rows,
      count(DISTINCT coalesce(d.dominant_category, 'Missing')) AS usable_values, count(*) > 0 AS publishable
    FROM r_orders o LEFT JOIN dom_cat d USING (order_id)
    UNION ALL SELECT 'monthly_forecast', count(*) + 3, count(c) + 3, count(*) > 0 FROM spine
    UNION ALL SELECT 'overall_kpis', 8, 8, count(*) > 0 FROM r_orders""",
    ),
    "clean_numeric": with_views(DIRTY, f"SELECT order_id, {dbl('total_amount', 'total_amount', 2)} FROM d_orders"),
    "clean_timestamp": with_views(DIRTY, f"SELECT order_id, {stamp('order_date', 'order_date')} FROM d_orders"),
    "clean_label": with_views(
        "SELECT product_id, CASE WHEN category IN ('PROMO', 'SMALL') THEN 'Missing' ELSE category END AS category, brand FROM r_products"
    ),
    "trim_ids": with_views("SELECT order_id, user_id, order_status FROM r_orders"),
    "log_features": with_views(f"SELECT order_id, {dbl('ln(1 + greatest(total_amount - 250000, 0))', 'amount_log1p')} FROM r_orders"),
    "returned_flag": with_views(
        f"""SELECT order_id, {num("CASE WHEN order_status = 'returned' THEN 1 ELSE 0 END", 'returned')},
      CASE WHEN order_status = 'returned' THEN 'Returned' ELSE 'Not returned' END AS return_status FROM r_orders"""
    ),
    "required_field_filter": with_views(
        DIRTY, f"SELECT {ORDER_COLUMNS} FROM d_orders WHERE total_amount IS NOT NULL AND order_date IS NOT NULL"
    ),
    "coercion_audit": with_views(_coercion()),
    "dedupe_exact": with_views(
        f"SELECT DISTINCT product_id, product_name, category, brand, {dbl('price', 'price')}, {dbl('rating', 'rating')} FROM r_products"
    ),
    "dedupe_key_first": with_views(
        f"""SELECT {ORDER_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY order_date, order_id) AS rn
    FROM r_orders WHERE user_id IS NOT NULL) WHERE rn = 1"""
    ),
    "price_ratio": with_views(
        f"SELECT order_item_id, {dbl('item_price / nullif(price, 0)', 'price_ratio')} FROM r_items LEFT JOIN r_products USING (product_id)"
    ),
    "line_reconcile": with_views(
        f"""SELECT order_item_id, {dbl('quantity * item_price', 'line_total', 4)},
      {dbl('item_total - quantity * item_price', 'line_gap', 4)} FROM r_items"""
    ),
    "date_parts": with_views(
        f"""SELECT order_id, {day("date_trunc('month', order_date)", 'order_month')}, monthname(order_date) AS month_name,
      dayname(order_date) AS day_name, {day('order_date', 'year_month', '%Y-%m')},
      {day('order_date', 'iso_date', '%Y-%m-%dT%H:%M:%S')} FROM r_orders"""
    ),
    "tenure_fractional": with_views(
        f"SELECT order_id, {dbl('epoch_us(order_date - signup_date) / 86400000000.0', 'tenure_days')} FROM r_orders LEFT JOIN r_users USING (user_id)"
    ),
    "whole_days_clipped": with_views(
        f"SELECT order_id, {num('greatest(0, floor(epoch_us(order_date - signup_date) / 86400000000.0))', 'tenure_days')} FROM r_orders LEFT JOIN r_users USING (user_id)"
    ),
    "pii_projection": with_views(f"SELECT user_id, gender, {stamp('signup_date', 'signup_date')} FROM r_users"),
    "status_flags_ci": with_views(
        f"""SELECT order_id, {num("CAST(order_status = 'cancelled' AS INT)", 'is_cancelled')},
      {num("CAST(order_status = 'returned' AS INT)", 'is_returned')} FROM r_orders"""
    ),
    "items_with_product": with_views(
        ITEM_PRODUCT,
        f"""SELECT order_item_id, order_id, product_id, {dbl('quantity', 'quantity', 8)}, {dbl('item_price', 'item_price', 8)},
      {dbl('item_total', 'item_total', 8)}, category, brand, {dbl('product_rating', 'product_rating', 8)}, product_matched FROM ip""",
    ),
    "orders_with_rollup": with_views(ITEM_PRODUCT, f"SELECT {ORDER_COLUMNS}, {ROLLUP_COLUMNS} FROM r_orders LEFT JOIN rollup_v USING (order_id)"),
    "orders_with_user": with_views(
        f"""SELECT {ORDER_COLUMNS}, coalesce(nullif(trim(gender), ''), 'Missing') AS gender, {stamp('signup_date', 'signup_date')},
      u.user_id IS NOT NULL AS user_matched FROM r_orders o LEFT JOIN r_users u USING (user_id)"""
    ),
    "reviews_with_status": with_views(
        f"""SELECT review_id, order_id, {dbl('rating', 'rating')}, coalesce(nullif(trim(review_text), ''), 'Missing') AS review_text,
      {num("CASE WHEN order_status = 'returned' THEN 1 ELSE 0 END", 'returned')},
      CASE WHEN order_status = 'returned' THEN 'Returned' ELSE 'Not returned' END AS return_status
    FROM r_reviews JOIN r_orders USING (order_id)""",
    ),
    "fk_orphans": with_views(ORPHANS),
    "id_mismatch": with_views(MISMATCHES),
    "order_before_signup": with_views(EARLY),
    "item_order_date": with_views(f"SELECT order_item_id, {stamp('order_date', 'order_date')} FROM r_items LEFT JOIN r_orders USING (order_id)"),
    "semi_valid_orders": with_views("SELECT order_item_id, order_id FROM r_items WHERE order_id IN (SELECT order_id FROM r_orders)"),
    "spine_join": with_views(
        MONTHS,
        f"""SELECT {stamp('month', 'month')}, {num('x', 'month_index')}, {num('c', 'returned_order_count')},
      {dbl('v', 'returned_order_value', 2)}, partial AS partial_month FROM spine""",
    ),
    "order_item_rollup": with_views(ITEM_PRODUCT, f"SELECT order_id, {ROLLUP_COLUMNS} FROM rollup_v"),
    "dominant_label": with_views(ITEM_PRODUCT, "SELECT order_id, dominant_category, dominant_brand FROM dom_cat JOIN dom_brand USING (order_id)"),
    "dominant_by_sort": with_views(ITEM_PRODUCT, f"SELECT order_id, dominant_category, {num('n', 'item_lines')} FROM dom_cat"),
    "overall_kpis": with_views(_metrics("r_orders", KPI, 4)),
    "segment_return_rates": with_views(SEGMENTS, f"SELECT dimension, level, {num('orders')}, {num('returned_orders')}, {RATE} FROM seg"),
    "contingency": with_views(
        SEGMENTS,
        """SELECT text_label AS review_text, count(*) FILTER (WHERE returned = 0) AS kept,
      count(*) FILTER (WHERE returned = 1) AS returned_rows FROM reviewed GROUP BY 1""",
    ),
    "review_summary": with_views(
        SEGMENTS,
        f"""SELECT return_status, count(*) AS review_rows, count(DISTINCT order_id) AS orders_with_review,
      {dbl('avg(rating)', 'avg_rating')}, count(rating) AS rating_count, {dbl('median(rating)', 'median_rating')} FROM reviewed GROUP BY 1""",
    ),
    "review_text_distribution": with_views(
        SEGMENTS,
        f"""SELECT text_label AS review_text, count(*) FILTER (WHERE returned = 0) AS non_returned_review_rows,
      count(*) FILTER (WHERE returned = 1) AS returned_review_rows, count(*) AS total_review_rows,
      {dbl('avg(returned)', 'return_rate')} FROM reviewed GROUP BY 1""",
    ),
    "review_rating_distribution": with_views(
        SEGMENTS,
        f"""SELECT printf('%.1f', rating) AS rating, count(*) FILTER (WHERE returned = 0) AS non_returned_review_rows,
      count(*) FILTER (WHERE returned = 1) AS returned_review_rows, count(*) AS total_review_rows,
      {dbl('avg(returned)', 'return_rate')} FROM reviewed WHERE rating IS NOT NULL GROUP BY 1""",
    ),
    "category_returns": with_views(
        ITEM_PRODUCT,
        f"""SELECT order_id, coalesce(d.dominant_category, 'Missing') AS dominant_category,
      {num("CASE WHEN order_status = 'returned' THEN 1 ELSE 0 END", 'returned')} FROM r_orders LEFT JOIN dom_cat d USING (order_id)""",
    ),
    "file_quality": with_views("\nUNION ALL\n".join(_file_quality(n) for n in TABLES)),
    "column_nulls": with_views(_column_nulls()),
    "linkage_checks": with_views(LINKAGE),
    "value_frequency": with_views("SELECT order_status, count(*) AS frequency FROM r_orders GROUP BY 1"),
    "monthly_returns": with_views(
        f"""SELECT {stamp("date_trunc('month', order_date)", 'month')},
      {num("count(*) FILTER (WHERE order_status = 'returned')", 'returned_order_count')},
      {dbl("sum(total_amount) FILTER (WHERE order_status = 'returned')", 'returned_order_value', 2)},
      {stamp('max(order_date)', 'last_order')} FROM r_orders WHERE order_date IS NOT NULL GROUP BY date_trunc('month', order_date)"""
    ),
    "customer_returns": with_views(CUSTOMERS, f"SELECT {CUSTOMER_COLUMNS}, {dbl('p', 'pooled_rate')} FROM cust"),
    "customer_binomial_summary": with_views(CUSTOMERS, _metrics("tested", SUMMARY, 4)),
    "return_rate_two_bases": with_views(_metrics("r_orders", TWO_BASES)),
    "value_concentration": with_views(_concentration()),
    "lost_value_share": with_views(_metrics("r_orders", LOST, 4)),
    "order_sequence": with_views(
        f"""SELECT order_id, user_id, {num('CASE WHEN user_id IS NOT NULL THEN row_number() OVER (PARTITION BY user_id ORDER BY order_date NULLS LAST, order_id) END', 'order_sequence')}
    FROM r_orders"""
    ),
    "order_sequence_group": with_views(MART, "SELECT sequence_group, count(*) AS orders FROM mart GROUP BY 1"),
    "order_value_quintile": with_views(
        MART, f"SELECT order_id, {num('substr(value_quintile, 2, 1)', 'value_bucket')}, value_quintile FROM quint"
    ),
    "first_per_group": with_views(
        f"""SELECT review_id, order_id, {dbl('rating', 'rating')}, review_text, {stamp('review_date', 'review_date')} FROM (
      SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY review_date, review_id) AS rn FROM r_reviews) WHERE rn = 1"""
    ),
    "calendar_order": with_views(
        SEGMENTS,
        f"""SELECT dimension, level, {num('orders')}, {num('returned_orders')}, {RATE}, {dbl(LEVEL_POSITION, 'level_position')}
    FROM seg ORDER BY dimension, level_position NULLS LAST, level""",
    ),
    "numeric_label_order": with_views(
        ITEM_PRODUCT,
        """SELECT CAST(item_count AS VARCHAR) AS level, count(*) AS orders, CAST(item_count AS DOUBLE) AS level_number
    FROM rollup_v GROUP BY item_count ORDER BY level_number, level""",
    ),
    "stable_multi_key_sort": with_views(
        ITEM_PRODUCT, f"SELECT order_id, dominant_category, {num('n', 'item_lines')} FROM dom_cat ORDER BY order_id, n DESC, dominant_category"
    ),
    "order_mart": with_views(
        MART,
        f"""SELECT order_id, user_id, order_status, return_status, {num('returned')},
      {day('order_date', 'order_date', '%Y-%m-%dT%H:%M:%S')}, {day('order_month', 'order_month')}, {dbl('total_amount', 'total_amount', 2)},
      {num('item_count')}, {dbl('units', 'units', 2)}, {dbl('max_price', 'max_price', 8)},
      {dbl('avg_product_rating', 'avg_product_rating', 8)}, dominant_category, dominant_brand, gender,
      {dbl('tenure_days', 'tenure_days', 8)}, {num('order_sequence')}, sequence_group, value_quintile, day_name AS day_of_week FROM mart""",
    ),
    "chi_square_tests": with_views(
        SEGMENTS, f"SELECT dimension, {dbl('chi2', 'chi2')}, {num('degrees_freedom')}, {num('n', 'orders_tested')} FROM tests"
    ),
    "cramers_v": with_views(SEGMENTS, f"SELECT dimension, {dbl('sqrt(chi2 / n)', 'cramers_v')} FROM tests"),
    "low_expected_cells": with_views(
        SEGMENTS,
        f"""SELECT dimension, {num('low', 'expected_cells_below_5')}, {num('cells', 'expected_cell_count')},
      {dbl('low * 1.0 / nullif(cells, 0)', 'pct_expected_cells_below_5')} FROM tests""",
    ),
    "binomial_returns_test": with_views(
        CUSTOMERS, f"SELECT user_id, {num('n', 'customer_orders')}, {num('k', 'customer_returns')}, {dbl('pval', 'binomial_p_value')} FROM tested"
    ),
    "unusual_customers": with_views(
        CUSTOMERS, f"SELECT {CUSTOMER_COLUMNS}, {dbl('pval', 'binomial_p_value')}, unusual, direction FROM tested"
    ),
    "unusual_products": with_views(
        PRODUCTS,
        f"""SELECT product_id, {num('n', 'product_orders')}, {num('k', 'product_returns')}, {dbl('expected', 'expected_returns')},
      {dbl('pval', 'binomial_p_value')}, unusual, direction FROM tested""",
    ),
    "product_binomial_summary": with_views(PRODUCTS, _metrics("tested", PRODUCT_SUMMARY, 4)),
    "tested_segments": with_views(
        SEGMENTS,
        TAILS,
        f"""SELECT dimension, level, {num('orders')}, {num('returned_orders')}, {RATE}, {dbl('chi2', 'chi2')}, {dbl('p', 'p_value')},
      {dbl('sqrt(chi2 / n)', 'cramers_v')} FROM seg JOIN tails USING (dimension)""",
    ),
    "monthly_trend_forecast": MONTH_BASE + _forecast(False),
    "monthly_trend_full_months": MONTH_BASE + _forecast(True),
    "value_route": with_views(
        f"""SELECT order_id, user_id, {dbl('total_amount', 'total_amount', 2)},
      CASE WHEN total_amount IS NULL THEN 'Review amount' WHEN total_amount < {LOW} THEN 'Refund without collection'
           WHEN total_amount > {HIGH} THEN 'Inspect and exchange first' ELSE 'Standard return' END AS route
    FROM r_orders WHERE order_status = 'returned'"""
    ),
    "returns_scorecard": with_views(
        SEGMENTS,
        f"""{_metrics('r_orders', {**KPI, **TWO_BASES, **LOST}, 4)}
    UNION ALL SELECT 'Share of returned value above ' || CAST(CAST(amount_above AS BIGINT) AS VARCHAR), round(value_share, 4) FROM ({_concentration()})
    UNION ALL SELECT 'Check: ' || check_name, CAST(failing_rows AS DOUBLE) FROM ({LINKAGE})
    UNION ALL SELECT 'Strongest segment association (Cramer''s V)', round(max(sqrt(chi2 / n)), 4) FROM tests WHERE dimension NOT LIKE 'Review%'""",
    ),
    "cost_benefit_scenarios": with_views(
        f"""SELECT s AS scenario, {dbl('pts * vpp', 'value_saved', 4)}, {dbl('pts * vpp - cost', 'net_value', 4)},
      {dbl('cost / vpp', 'break_even_points', 4)} FROM (
      SELECT s, pts, cost, n * 0.01 * v * kept AS vpp FROM
        (SELECT count(*) AS n, avg(total_amount) FILTER (WHERE order_status = 'returned') AS v FROM r_orders),
        (VALUES ('low', 1.0::DOUBLE, 0.3::DOUBLE, 5e6), ('base', 3.0, 0.4, 6e6), ('high', 5.0, 0.5, 8e6)) AS sc(s, pts, kept, cost))"""
    ),
}
SQL["category_return_table"] = SQL["sink"]
