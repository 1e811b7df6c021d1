"""Catalogue: splits, models, clusters, forest and decisions, all with the library defaults."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyback.catalog_base import Query, on_tables
from tallyback.operators.density import density_clusters
from tallyback.plans import anomalies as A
from tallyback.plans import decisions as D
from tallyback.plans import models as M
from tallyback.plans import retention as N
from tallyback.plans import returns as R

FOREST_TREES = 300
REACH, MIN_POINTS = 0.9, 15  # density clustering of the study


def _named(candidates: list[M.Candidate], *names: str) -> list[M.Candidate]:
    return [c for c in candidates if c.name in names]


def _return_model(*names: str):
    def run(t):
        prepared = M.prepare_returns(R.order_mart(t))
        return M.evaluate(prepared.train, prepared.test, _named(M.return_candidates(), *names), "order_id")

    return run


def _churn_prepared(t) -> M.Prepared:
    calendar = N.snapshot_calendar(t["orders"])
    return M.prepare_churn(N.customer_snapshot_panel(t, calendar), *N.temporal_split(calendar))


def _churn_model(*names: str):
    def run(t):
        prepared = _churn_prepared(t)
        return M.evaluate(prepared.train, prepared.test, _named(M.churn_candidates(), *names), "row_key")

    return run


def _split(t):
    marked = M.stratified_split(t["orders"].select("order_id", R.C.returned_flag(F.col("order_status")).alias("label")), "order_id", "label")
    return marked.groupBy("label", "part").agg(F.count(F.lit(1)).alias("rows"))


def _resampled(resample):
    def run(t):
        rows = t["orders"].select("order_id", R.C.returned_flag(F.col("order_status")).alias("label"))
        return resample(rows, "order_id", "label").groupBy("label").agg(F.count(F.lit(1)).alias("rows"))

    return run


def _fixed_vote(t):
    """kNN vote over whole-numbered features on a split by key, where distances and ties have one right answer."""
    lines = t["order_items"].groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))
    number = F.regexp_extract("order_id", "(\\d+)", 1).cast("long")
    rows = t["orders"].join(lines, "order_id").select(
        "order_id", R.C.returned_flag(F.col("order_status")).alias("label"), number.alias("number"),
        M.array_to_vector(F.array(*[x.cast("double") for x in (F.col("lines"), F.col("units"), F.floor(F.col("total_amount") / 10000))])).alias("features"),
    )
    train, test = rows.filter("number % 5 != 0"), rows.filter("number % 5 = 0")
    return M.neighbour_vote(train, test, "order_id", "features", "label", 15)


def _feature_encoding(t):
    prepared = M.prepare_returns(R.order_mart(t))
    values = prepared.train.unionByName(prepared.test).select("part", M.vector_to_array("features").alias("v"))
    return values.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("v")).alias("vector_size"),
        *[F.avg(F.col("v")[i]).alias(f"mean_{n}") for i, n in enumerate(M.RETURN_NUMERIC)],
    )


_fitted: dict[tuple, DataFrame] = {}  # importance tables of this application, by the files they come from


def _importances(t):
    """Importances of the weighted return models, a table of a few rows that three queries read; fitted once per application and input."""
    orders = t["orders"]
    source = (orders.sparkSession.sparkContext.applicationId, *sorted(orders.inputFiles()))
    if source not in _fitted:
        prepared = M.prepare_returns(R.order_mart(t))
        weighted = [c for c in M.return_candidates() if c.balance == "weights"]
        found = M.grouped_importances(prepared, weighted, "order_id", M.RETURN_NUMERIC, M.RETURN_CATEGORIES)
        _fitted[source] = M.cut_lineage(found)
    return _fitted[source]


def _select_best(t):
    candidates = M.churn_candidates()
    prepared = _churn_prepared(t)
    metrics = M.evaluate(prepared.train, prepared.test, candidates, "row_key")
    best = D.select_best_model(metrics, candidates)
    return metrics.withColumn("selected", F.col("model") == best.name)


def _coefficients(t):
    prepared = _churn_prepared(t)
    model = M.fit_candidate(prepared.train, M.churn_candidates()[0], "row_key")
    return M.coefficient_frame(prepared.train.sparkSession, N.FEATURES, model.coefficients)


def _value_coefficients(t):
    """Ridge coefficients after the refit that scores the customers."""
    calendar = N.snapshot_calendar(t["orders"])
    panel = M.cut_lineage(N.customer_snapshot_panel(t, calendar))
    return M.coefficient_frame(panel.sparkSession, N.FEATURES, D.refitted_ridge(panel, calendar)[1].coefficients)


def _fixed_ridge(t):
    """Ridge with one penalty on two features, which has a closed form: order value by lines and units."""
    lines = t["order_items"].groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))
    rows = t["orders"].join(lines, "order_id").select(
        "order_id", (F.col("total_amount") / 1000).alias("value"), M.array_to_vector(F.array(F.col("lines").cast("double"), F.col("units").cast("double"))).alias("features")
    )
    fit = M.ridge(M.moments(rows, "features", F.col("value"), "order_id", M.FOLDS, M.SEED).whole, 10.0)
    values = [("intercept", fit.intercept), ("lines", float(fit.coefficients[0])), ("units", float(fit.coefficients[1]))]
    return rows.sparkSession.createDataFrame(values, "term string, coefficient double")


def _null_models(t):
    prepared = M.prepare_returns(R.order_mart(t))
    return M.null_models(prepared, M.return_candidates(), "order_id")


def _kmeans(t):
    _, scores, chosen = M.rfm_kmeans(N.current_customers(t))
    return scores.withColumn("chosen", F.col("k") == chosen)


def _density(t):
    rows = M.cluster_frame(N.current_customers(t)).select("user_id", M.vector_to_array("features").alias("v"))
    scaled = rows.select("user_id", *[F.col("v")[i].alias(c) for i, c in enumerate(M.CLUSTER_INPUTS)])
    return density_clusters(scaled, "user_id", M.CLUSTER_INPUTS, REACH, MIN_POINTS)


def _density_summary(t):
    """Rows per cluster, and the silhouette of the clustered rows when there are two clusters or more."""
    found = M.cut_lineage(_density(t))
    inside = M.VectorAssembler(inputCols=M.CLUSTER_INPUTS, outputCol="features").transform(found.filter("cluster >= 0"))
    several = found.filter("cluster >= 0").select("cluster").distinct().count() > 1
    value = ClusteringEvaluator(predictionCol="cluster").evaluate(inside) if several else None
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("customers")).withColumn("silhouette_without_noise", F.lit(value).cast("double"))


def _queue(t) -> DataFrame:
    return D.anomaly_queue(t, FOREST_TREES)


def _fixed_customers(t) -> DataFrame:
    """Current customers with a fixed spend forecast, a share of their past spend, instead of a model's."""
    forecast = F.col("total_spend") * 0.1234567
    return N.with_segments(N.current_customers(t)).withColumns({"predicted_spend": forecast, "churn_probability": F.lit(0.5)})


def _fixed_plan(t) -> DataFrame:
    """Decisions over the fixed forecast and the robust-z flag alone: everything here has one right answer."""
    robust = A.order_robust_z(A.order_features(t)).withColumn("review_flag", F.col("robust_z_flag"))
    return D.decide(M.cut_lineage(_fixed_customers(t)), A.user_flag_rates(robust))


def _plan_part(*columns: str):
    return lambda t: _fixed_plan(t).select("user_id", *columns)


def _robust_user_flags(t):
    return A.user_flag_rates(A.order_robust_z(A.order_features(t)).withColumn("review_flag", F.col("robust_z_flag")))


def _queue_rows(t):
    return _queue(t).filter("review_flag = 1").select(
        "order_id", "user_id", "item_total_sum", "robust_z_flag", "isolation_forest_flag", "isolation_score", "flag_reason"
    )


def _anomaly_queue_rows(t):
    """The queue itself: every order with its inputs, robust z-scores, isolation score, both flags, their union and the reason."""
    scores = [f"{c}_z" for c in A.FOREST_INPUTS]
    flags = ["robust_z_flag", "isolation_score", "isolation_forest_flag", "review_flag", "flag_reason"]
    return _queue(t).select("order_id", "user_id", "order_date", "total_amount", *A.FOREST_INPUTS, *scores, *flags)


def _forest_scores(t):
    features = A.repaired_inputs(A.order_features(t))
    return D.isolation_forest(features, "order_id", A.FOREST_INPUTS, trees=FOREST_TREES).select(
        "order_id", "isolation_score", "isolation_forest_flag"
    )


def _all_return_models(t):
    prepared = M.prepare_returns(R.order_mart(t))
    return M.evaluate(prepared.train, prepared.test, M.return_candidates(), "order_id")


def _action_plan(t):
    return D.action_plan(t, M.churn_candidates(), FOREST_TREES)


MONEY = ("total_spend", "value", "item_total_sum", "flagged_order_value", "historical_spend")

QUERIES: dict[str, Query] = {
    "stratified_split": on_tables(_split),
    "feature_encoding": on_tables(_feature_encoding),
    "balanced_downsample": on_tables(_resampled(M.balanced_downsample)),
    "balanced_oversample": on_tables(_resampled(M.balanced_oversample)),
    "clf_logistic": on_tables(_return_model("Logistic regression")),
    "clf_logistic_l1": on_tables(_churn_model("Logistic L1 balanced")),
    "clf_tree": on_tables(_return_model("Decision tree")),
    "clf_forest": on_tables(_return_model("Random forest")),
    "clf_gbt": on_tables(_return_model("Gradient boosting")),
    "clf_gbt_sampled": on_tables(_churn_model("Boosted trees, sampled")),
    "clf_knn": on_tables(_return_model("kNN")),
    "clf_knn_churn": on_tables(_churn_model("kNN")),
    "knn_vote_fixed": on_tables(_fixed_vote),
    "return_model_comparison": on_tables(_all_return_models),
    "clf_mlp": on_tables(_churn_model("MLP balanced")),
    "clf_mlp_returns": on_tables(_return_model("Neural network")),
    "grouped_importance": on_tables(_importances),
    "top_features": on_tables(lambda t: M.top_features(_importances(t))),
    "head_per_group": on_tables(lambda t: M.top_features(_importances(t), 5)),
    "select_best_model": on_tables(_select_best),
    "coefficients": on_tables(_coefficients),
    "value_coefficients": on_tables(_value_coefficients),
    "ridge_fixed": on_tables(_fixed_ridge),
    "value_regression": on_tables(lambda t: M.value_regression(_churn_prepared(t))),
    "price_regression": on_tables(lambda t: M.price_regression(t["products"])),
    "rfm_kmeans": on_tables(_kmeans),
    "cluster_profile": on_tables(lambda t: M.cluster_profile(M.rfm_kmeans(N.current_customers(t))[0])),
    "dbscan_grid": on_tables(_density_summary),
    "isolation_forest": on_tables(_forest_scores),
    "null_model_baselines": on_tables(_null_models),
    "user_flag_rates": on_tables(_robust_user_flags, money=MONEY),
    "flag_union": on_tables(_queue_rows, money=MONEY),
    "review_queue_totals": on_tables(lambda t: A.queue_totals(_queue(t)), money=MONEY),
    "anomaly_review_queue": on_tables(_anomaly_queue_rows, money=MONEY),
    "priority_score": on_tables(_plan_part("priority_score")),
    "recommended_action": on_tables(_plan_part("segment", "recommended_action")),
    "budget_cap": on_tables(_plan_part("predicted_spend", "budget_cap"), digits=2),
    "fraud_hold_status": on_tables(_plan_part("flagged_orders", "fraud_review_status")),
    "rank_plan": on_tables(lambda t: D.rank_plan(_fixed_plan(t)).select("severity", "risk_band", "user_id", "priority_score")),
    "segment_action_summary": on_tables(lambda t: D.segment_action_summary(_fixed_plan(t)), digits=2),
    "action_plan": on_tables(_action_plan, money=MONEY),
}
