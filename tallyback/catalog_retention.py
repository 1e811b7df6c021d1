"""Catalogue: landscape, cohorts, panel, segments, baskets, text, series and anomaly scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyback.catalog_base import Query, on_tables
from tallyback.functions import columns as C
from tallyback.operators.quantiles import exact_quantile_of_table
from tallyback.operators.ranks import percent_ranks
from tallyback.plans import anomalies as A
from tallyback.plans import baskets as B
from tallyback.plans import content as T
from tallyback.plans import retention as N
from tallyback.plans import series as Y
from tallyback.sources.tables import union_all


def _panel(t):
    return N.customer_snapshot_panel(t).drop("gender", "signup_date")


def _current(t):
    return N.with_segments(N.current_customers(t))


def _chain(t):
    """Per user: orders INNER, then items, events and reviews LEFT, one row each."""
    orders = t["orders"].groupBy("user_id").agg(F.count(F.lit(1)).alias("order_count"))
    items = t["order_items"].groupBy("user_id").agg(F.sum("quantity").alias("total_quantity"))
    reviews = t["reviews"].groupBy("user_id").agg(F.count(F.lit(1)).alias("review_count"))
    return (
        t["users"].select("user_id").join(orders, "user_id").join(items, "user_id", "left").join(N.event_pivot(t), "user_id", "left")
        .join(reviews, "user_id", "left").na.fill(0)
    )


def _date_ranges(t):
    calendar = N.snapshot_calendar(t["orders"])
    final = F.lit(calendar.final).cast("timestamp_ntz")
    date = F.col("order_date")
    return t["orders"].select(
        "order_id", F.when(date < final, "history").when(C.days_between(date, final) < N.OUTCOME_DAYS, "outcome").otherwise("after").alias("period")
    )


def _temporal_split(t):
    train, test = N.temporal_split(N.snapshot_calendar(t["orders"]))
    rows = [(d, "train") for d in train] + [(d, "test") for d in test]
    dates = t["orders"].sparkSession.createDataFrame(rows, "snapshot_date timestamp_ntz, part string")
    panel = N.customer_snapshot_panel(t).select("user_id", "snapshot_date", "churn")
    return panel.join(F.broadcast(dates), "snapshot_date").groupBy("part", "snapshot_date").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("churn").alias("churned")
    )


def _class_weights(t):
    from tallyback.plans.models import class_weights

    return class_weights(t["orders"].select(C.returned_flag(F.col("order_status")).alias("label")), "label")


def _fixed_score_metrics(t):
    """Classifier metrics of a fixed score: the order amount scaled to 0..1 against the returned flag."""
    from tallyback.plans.models import classifier_metrics

    scored = t["orders"].select(
        C.returned_flag(F.col("order_status")).alias("label"), (F.round(F.col("total_amount") / 1000) / 500).alias("score")
    )
    return classifier_metrics(scored, "label", "score")


def _fixed_prediction_metrics(t):
    """Regression metrics of a fixed prediction: line price against catalogue price."""
    from tallyback.plans.models import regression_metrics

    items = t["order_items"].join(t["products"].select("product_id", "price"), "product_id")
    return regression_metrics(items, "item_price", "price")


def _all_series(t):
    return Y.daily_revenue(t).unionByName(Y.daily_category_revenue(t))


def _naive_backtest(t):
    train, test = Y.split_holdout(_all_series(t))
    return Y.forecast_errors(Y.seasonal_naive(train, Y.HOLDOUT_DAYS), test)


def _naive_and_average(t):
    train, test = Y.split_holdout(_all_series(t))
    forecasts = Y.last_value(train, Y.HOLDOUT_DAYS).unionByName(Y.moving_average(train, Y.HOLDOUT_DAYS))
    return Y.forecast_errors(forecasts, test)


def _unbought(t):
    """The most popular products each user has not bought: list depth follows the user's own purchases."""
    bought = t["order_items"].select("user_id", "product_id").distinct()
    depth = bought.groupBy("user_id").agg((F.count(F.lit(1)) + T.TOP).alias("reach"))
    wanted = depth.select("user_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("reach"))).alias("popularity_rank"))
    candidates = wanted.join(T.popular_products(bought), "popularity_rank").select("user_id", "product_id", "popularity_rank")
    return T.unseen_candidates(candidates, bought)


def _expm1_guard(t):
    """Repair of unusable numbers: log amounts that do not exist fall back to the median."""
    ratio = t["orders"].select("order_id", (F.log(F.nullif(F.greatest(F.col("total_amount") - 100_000, F.lit(0.0)), F.lit(0.0)))).alias("x"))
    middle = exact_quantile_of_table(ratio, C.finite_or(F.col("x"), F.lit(None).cast("double")), 0.5, "m").scalar()
    return ratio.select("order_id", C.finite_or(F.col("x"), middle).alias("x"))


def _group_stats(t):
    return A.items_with_price_z(t).select("order_item_id", "category", "price_median", "price_mad", "price_robust_z")


def _robust(t):
    features = A.order_features(t)
    cols = [f"{c}_z" for c in A.FOREST_INPUTS]
    return A.order_robust_z(features).select("order_id", *cols, "robust_z_flag")


def _price_gate(t):
    gate = exact_quantile_of_table(t["orders"], F.col("total_amount"), 0.75, "gate").scalar()
    return t["orders"].select("order_id", (F.col("total_amount") >= gate).alias("top_quartile"))


def _risk_band(t):
    return _current(t).select("user_id", "segment", "risk_band")


def _stack(t):
    """Actual and outlook rows in one table, told apart by a column."""
    daily = Y.daily_revenue(t)
    actual = daily.select("day", F.lit("Actual").alias("row_type"), F.col("revenue").alias("value"))
    ahead = Y.seasonal_naive(daily, Y.OUTLOOK_DAYS).select("day", F.lit("Forecast").alias("row_type"), F.col("forecast").alias("value"))
    return union_all([actual, ahead])


MONEY = (
    "revenue", "total_spend", "future_spend", "historical_spend", "avg_historical_spend", "item_total_sum",
    "item_total_gap", "item_total_gap_abs", "total_amount", "value", "forecast", "mae", "rmse",
)

QUERIES: dict[str, Query] = {
    "event_filter": on_tables(lambda t: N.engagement_events(t).select("event_id", "event_type")),
    "date_range_filter": on_tables(_date_ranges),
    "enriched_items": on_tables(N.enriched_items, digits=8),
    "order_reconcile": on_tables(N.reconciled_orders, money=MONEY),
    "reconciliation_summary": on_tables(N.reconciliation_summary),
    "order_breadth_rollup": on_tables(N.order_breadth_rollup, digits=8, money=("item_total_sum",)),
    "nonfinite_repair": on_tables(_expm1_guard),
    "snapshot_range_join": on_tables(lambda t: N.history_before(t, N.snapshot_calendar(t["orders"])), money=MONEY),
    "one_to_one_chain": on_tables(_chain),
    "group_stats_join": on_tables(_group_stats, digits=5),
    "exclude_purchased": on_tables(_unbought),
    "cohort_join": on_tables(
        lambda t: N.cohort_orders(t).groupBy("cohort_month", "months_since_signup").agg(
            F.count(F.lit(1)).alias("orders"), F.sum("before_signup").alias("orders_before_signup"))
    ),
    "daily_revenue": on_tables(Y.daily_revenue, money=MONEY, days=("day",)),
    "revenue_share": on_tables(
        lambda t: union_all([N.revenue_share(t, c).select(F.lit(c).alias("level_kind"), F.col(c).alias("level"), "revenue", "share")
                             for c in ("category", "brand")]),
        money=MONEY,
    ),
    "engagement_reach": on_tables(N.engagement_reach),
    "cohort_sizes": on_tables(N.cohort_sizes),
    "cohort_retention": on_tables(N.cohort_retention),
    "cohort_matrix": on_tables(N.cohort_matrix),
    "event_pivot": on_tables(N.event_pivot),
    "customer_history_features": on_tables(
        lambda t: N.current_customers(t).select(
            "user_id", "last_order_date", "order_count", "total_spend", "avg_order_value", "total_quantity", "unique_products",
            "category_breadth", "brand_breadth", "review_count", "avg_review_rating", "negative_review_share"),
        digits=8, money=MONEY,
    ),
    "customer_outcome": on_tables(
        lambda t: N.current_customers(t).select("user_id", "future_order_count", "future_spend", "churn"), money=MONEY
    ),
    "segment_summary": on_tables(lambda t: N.segment_summary(_current(t)), money=MONEY),
    "user_status_rates": on_tables(N.user_status_rates),
    "anomaly_rollup": on_tables(A.anomaly_rollup, digits=8, money=("item_total_sum",)),
    "robust_z": on_tables(_robust, digits=5),
    "percent_rank_avg": on_tables(
        lambda t: percent_ranks(t["reviews"], ["review_id"], {"rating_rank": F.col("rating")}), digits=8
    ),
    "quantile_gate": on_tables(_price_gate),
    "last_purchase": on_tables(lambda t: T.last_purchases(T.items_before(t, N.snapshot_calendar(t["orders"])))),
    "top_categories": on_tables(lambda t: N.top_levels(N.revenue_share(t, "category"), "category", 2), money=MONEY),
    "stack_results": on_tables(_stack, money=MONEY, days=("day",)),
    "distinct_dates": on_tables(
        lambda t: N.customer_snapshot_panel(t).select("snapshot_date").distinct().orderBy("snapshot_date")
    ),
    "snapshot_dates": on_tables(N.snapshot_dates),
    "customer_snapshot_panel": on_tables(_panel, digits=8, money=MONEY),
    "risk_score": on_tables(lambda t: N.risk_scores(N.current_customers(t)), digits=8),
    "rfm_segments": on_tables(lambda t: _current(t).select("user_id", "recency_days", "order_count", "segment")),
    "risk_band": on_tables(_risk_band),
    "temporal_split": on_tables(_temporal_split),
    "class_weights": on_tables(_class_weights),
    "classifier_metrics": on_tables(_fixed_score_metrics),
    "regression_metrics": on_tables(_fixed_prediction_metrics, digits=3),
    "kpi_summary": on_tables(lambda t: N.kpi_summary(t, _current(t)), digits=4),
    "basket_rules": on_tables(B.category_brand_rules),
    "product_rule_diagnostic": on_tables(B.product_rule_diagnostic),
    "product_tfidf": on_tables(T.product_tfidf),
    "content_similarity": on_tables(T.content_similarity),
    "content_recommendations": on_tables(lambda t: T.content_recommendations(t, N.current_customers(t))),
    "top_k_recommendations": on_tables(
        lambda t: T.content_recommendations(t, N.current_customers(t)).groupBy("segment", "recommendation_rank").agg(
            F.count(F.lit(1)).alias("recommendations"), F.avg("similarity").alias("avg_similarity"))
    ),
    "seasonal_naive": on_tables(
        lambda t: Y.seasonal_naive(Y.split_holdout(_all_series(t))[0], Y.HOLDOUT_DAYS), money=MONEY, days=("day",)
    ),
    "seasonal_naive_backtest": on_tables(_naive_backtest, money=MONEY),
    "seasonal_naive_outlook": on_tables(lambda t: Y.seasonal_naive(_all_series(t), Y.OUTLOOK_DAYS), money=MONEY, days=("day",)),
    "naive_and_average_backtest": on_tables(_naive_and_average, money=MONEY),
    "holt_winters": on_tables(
        lambda t: Y.smoothing(Y.split_holdout(_all_series(t))[0], Y.HOLDOUT_DAYS, ["Holt-Winters weekly"]), money=MONEY, days=("day",)
    ),
    "forecast_backtest": on_tables(lambda t: Y.backtest(_all_series(t)), money=MONEY),
    "future_forecast": on_tables(lambda t: Y.outlook(_all_series(t)), money=MONEY, days=("day",)),
    "smoothing_forecasts": on_tables(lambda t: Y.smoothing_backtest(_all_series(t)), money=MONEY),
}
