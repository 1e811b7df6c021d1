"""From scores to decisions: priorities, actions, budget caps, review holds and the action plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyback.operators.forest import isolation_forest
from tallyback.operators.quantiles import exact_quantile_of_table
from tallyback.operators.ranks import percent_ranks
from tallyback.plans import anomalies as A
from tallyback.plans import models as M
from tallyback.plans import retention as N
from tallyback.session import cut_lineage
from tallyback.sources.tables import Tables

# The published actions and review texts.
ACTIONS = {
    "at_risk_valuable": "Personalized category/brand bundle plus time-limited incentive",
    "At-risk": "Personalized reminder and low-cost incentive",
    "Lost": "Win-back test with strict spend cap",
    "One-time": "Second-purchase journey using content recommendations",
    "Champions": "VIP protection and cross-sell; avoid blanket discounting",
    "default": "Cross-sell and category-expansion test",
}
HOLD = "Review flagged orders before crediting recovered revenue"
NO_HOLD = "No anomaly flag in order history"
BUDGET_SHARE = 0.10

PLAN_COLUMNS = [
    "user_id", "segment", "risk_band", "churn", "churn_probability", "recency_days", "order_count", "total_spend",
    "predicted_spend", "budget_cap", "priority_score", "recommended_action", "flagged_orders", "flagged_order_value",
    "fraud_review_status",
]


def recommended_action(segment: Column, predicted: Column, gate: Column) -> Column:
    action = F.when((segment == "At-risk") & (predicted >= gate), ACTIONS["at_risk_valuable"])
    for name in ("At-risk", "Lost", "One-time", "Champions"):
        action = action.when(segment == name, ACTIONS[name])
    return action.otherwise(ACTIONS["default"])


def fraud_hold_status(flagged_orders: Column) -> Column:
    return F.when(flagged_orders > 0, HOLD).otherwise(NO_HOLD)


def decide(customers: DataFrame, user_flags: DataFrame) -> DataFrame:
    """Priority, action, cap and hold per customer.

    ``customers`` is the segmented snapshot with ``predicted_spend`` and
    ``churn_probability``; ``user_flags`` the review flags per user.
    """
    risk = N.risk_scores(customers).select("user_id", "risk_score")
    value = percent_ranks(customers, ["user_id"], {"value_rank": F.col("predicted_spend")})
    gate = exact_quantile_of_table(customers, F.col("predicted_spend"), 0.75, "gate").scalar()
    flags = user_flags.select("user_id", "flagged_orders", "flagged_order_value")
    joined = customers.join(risk, "user_id").join(value, "user_id", "left").join(flags, "user_id", "left")
    flagged = F.coalesce("flagged_orders", F.lit(0))
    return joined.withColumns(
        {
            "flagged_orders": flagged,
            "flagged_order_value": F.coalesce("flagged_order_value", F.lit(0.0)),
            "priority_score": 100 * (0.55 * F.col("value_rank") + 0.45 * F.col("risk_score")),
            "recommended_action": recommended_action(F.col("segment"), F.col("predicted_spend"), gate),
            "budget_cap": BUDGET_SHARE * F.col("predicted_spend"),
            "fraud_review_status": fraud_hold_status(flagged),
        }
    )


def rank_plan(plan: DataFrame) -> DataFrame:
    """High risk first, then Medium, then Low; highest priority first inside a band."""
    severity = F.when(F.col("risk_band") == "High", 1).when(F.col("risk_band") == "Medium", 2).otherwise(3)
    return plan.withColumn("severity", severity).orderBy("severity", F.desc("priority_score"), "user_id")


def segment_action_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("segment").agg(
        F.count_distinct("user_id").alias("customers"),
        F.sum("total_spend").alias("historical_spend"),
        F.sum("predicted_spend").alias("predicted_spend"),
        F.sum("budget_cap").alias("budget_cap"),
        F.avg("churn").alias("observed_churn_rate"),
        F.count_if(F.col("flagged_orders") > 0).alias("flagged_customers"),
    )


def anomaly_queue(t: Tables, trees: int = 300) -> DataFrame:
    """All orders with robust-z flag, forest flag, their union and the reason."""
    features = A.order_features(t)
    forest = isolation_forest(A.repaired_inputs(features), "order_id", A.FOREST_INPUTS, trees=trees)
    return A.review_queue(A.order_robust_z(features), forest)


def select_best_model(metrics: DataFrame, candidates: list[M.Candidate]) -> M.Candidate:
    """The candidate of highest AUC; one row of metrics per candidate reaches the driver."""
    best = metrics.orderBy(F.desc_nulls_last("roc_auc"), "model").first()["model"]
    return next(c for c in candidates if c.name == best)


def refitted_ridge(panel: DataFrame, calendar: N.SnapshotCalendar) -> tuple[M.PipelineModel, M.LinearFit]:
    """Scaler and ridge spend model fitted on all snapshots before the final one, as they are used for scoring."""
    earlier = cut_lineage(M.churn_frame(panel.filter(F.col("snapshot_date") < F.lit(calendar.final).cast("timestamp_ntz"))))
    pipeline = M.numeric_feature_pipeline(N.FEATURES).fit(earlier)
    return pipeline, M.value_ridge(pipeline.transform(earlier))


def scored_customers(t: Tables, candidates: list[M.Candidate] | None = None) -> DataFrame:
    """Current customers with segment, churn probability of the best model and ridge spend forecast.

    Metrics come from the temporal split; the spend model is refitted on all
    snapshots before the final one for scoring.
    """
    candidates = candidates or M.churn_candidates()
    calendar = N.snapshot_calendar(t["orders"])
    train_dates, test_dates = N.temporal_split(calendar)
    panel = cut_lineage(N.customer_snapshot_panel(t, calendar))
    prepared = M.prepare_churn(panel, train_dates, test_dates)
    metrics = M.evaluate(prepared.train, prepared.test, candidates, "row_key")
    best = select_best_model(metrics, candidates)
    current = cut_lineage(N.with_segments(panel.filter(F.col("snapshot_date") == F.lit(calendar.final).cast("timestamp_ntz"))))
    vectors = prepared.pipeline.transform(M.churn_frame(current))
    scorer = getattr(metrics, "fitted", {}).get(best.name) or M.fitted_scorer(prepared.train, best, "row_key")
    churn = scorer(vectors).select("row_key", F.col("score").alias("churn_probability"))

    pipeline, fit = refitted_ridge(panel, calendar)
    spend = M.predicted_spend(fit, pipeline.transform(M.churn_frame(current))).select("row_key", "user_id", "predicted_spend")
    return current.join(spend.join(churn, "row_key").drop("row_key"), "user_id")


def action_plan(t: Tables, candidates: list[M.Candidate] | None = None, trees: int = 300) -> DataFrame:
    """The prioritised customer table."""
    customers = cut_lineage(scored_customers(t, candidates))
    flags = A.user_flag_rates(anomaly_queue(t, trees))
    return rank_plan(decide(customers, flags)).select(*PLAN_COLUMNS)
