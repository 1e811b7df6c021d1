"""Every catalogue query with a SQL statement gives the rows DuckDB gives; the others keep their invariants."""

import pytest

import __spark_entry__ as spark_entry
from checks.compare import connect, differences
from tallyback.plans import decisions as D
from tallyback.plans import models as M

QUERIES, SQL = spark_entry.queries(), spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, folder, duck):
    assert differences(QUERIES[name](spark, folder), duck, SQL[name]) == []


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["dominant_category", "orders", "returned_orders", "return_rate"]
    assert df.count() > 0


def rows(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


def test_split_shares(spark, folder):
    counts = {(r.label, r.part): r.rows for r in rows(spark, folder, "stratified_split")}
    for label in (0, 1):
        share = counts[label, "train"] / (counts[label, "train"] + counts[label, "test"])
        assert share == pytest.approx(0.8, abs=0.04)


@pytest.mark.parametrize("name", ["balanced_downsample", "balanced_oversample"])
def test_resampling_balances(name, spark, folder):
    a, b = (r.rows for r in rows(spark, folder, name))
    assert a == pytest.approx(b, rel=0.1)


def test_p_values_follow_statistics(spark, folder):
    found = rows(spark, folder, "bonferroni")
    assert len(found) == 10
    for r in found:
        assert 0 <= r.p_value <= 1
        assert r.bonferroni_p == pytest.approx(min(1, 10 * r.p_value), abs=1e-5)


def test_null_models_know_nothing(spark, folder):
    found = {r.model: r for r in rows(spark, folder, "null_model_baselines")}
    assert found["Majority class"].roc_auc == pytest.approx(0.5)
    for name, r in found.items():
        assert r.roc_auc == pytest.approx(0.5, abs=0.12), name


def test_forest_flags_two_percent(spark, folder):
    found = rows(spark, folder, "isolation_forest")
    assert sum(r.isolation_forest_flag for r in found) == pytest.approx(0.02 * len(found), abs=2)


def test_review_queue_has_every_order(spark, folder):
    found = rows(spark, folder, "anomaly_review_queue")
    totals = {r.method: r for r in rows(spark, folder, "review_queue_totals")}
    assert sorted(r.order_id for r in found) == sorted(str(r.o_orderkey) for r in spark.read.parquet(f"{folder}/orders.parquet").collect())
    flagged = [r for r in found if r.review_flag]
    assert len(flagged) == totals["Union review queue"].orders
    assert {r.flag_reason for r in flagged} <= {"both_methods", "robust_z_only", "isolation_forest_only"}
    assert all(r.review_flag == max(r.robust_z_flag, r.isolation_forest_flag) and r.max_item_price_z is not None for r in flagged)


@pytest.mark.parametrize("name", ["holt_winters", "future_forecast"])
def test_forecasts_are_not_negative(name, spark, folder):
    found = rows(spark, folder, name)
    assert found and all(r.forecast >= 0 for r in found)


def test_action_plan_is_whole_and_ranked(spark, folder):
    found = rows(spark, folder, "action_plan")
    current = rows(spark, folder, "rfm_segments")
    assert {r.user_id for r in found} == {r.user_id for r in current}
    order = [("High", "Medium", "Low").index(r.risk_band) for r in found]
    assert order == sorted(order)


def test_knn_is_scored_on_every_test_row(spark, folder):
    (metrics,) = rows(spark, folder, "clf_knn")
    counts = {(r.label, r.part): r.rows for r in rows(spark, folder, "stratified_split")}
    assert metrics.test_rows == counts[0, "test"] + counts[1, "test"]


@pytest.mark.parametrize("name,candidates", [
    ("select_best_model", M.churn_candidates), ("null_model_baselines", M.return_candidates), ("return_model_comparison", M.return_candidates),
    ("action_plan", M.churn_candidates),
])
def test_every_candidate_takes_part(name, candidates, spark, folder, monkeypatch):
    seen = []
    shape = "model string, roc_auc double, precision double, recall double, f1 double, test_rows long"

    def evaluate(train, test, given, key):
        seen.extend(c.name for c in given)
        return spark.createDataFrame([(c.name, 0.5, 0.0, 0.0, 0.0, 0) for c in given], shape)

    monkeypatch.setattr(M, "evaluate", evaluate)
    monkeypatch.setattr(D, "select_best_model", lambda metrics, given: given[0])
    QUERIES[name](spark, folder)
    assert seen == [c.name for c in candidates()]


@pytest.mark.parametrize("name,model,size", [
    ("clf_forest", "Random forest", {"trees": 300, "min_leaf": 3}), ("clf_gbt", "Gradient boosting", {"maxIter": 100}),
    ("clf_gbt_sampled", "Boosted trees, sampled", {"maxIter": 250}), ("clf_mlp", "MLP balanced", {"max_iterations": 400}),
    ("grouped_importance", "Random forest", {"trees": 300, "min_leaf": 3}), ("select_best_model", "Random forest balanced", {"trees": 250, "max_depth": 8}),
    ("null_model_baselines", "Gradient boosting", {"maxIter": 100}),
])
def test_models_have_the_size_of_the_library(name, model, size, spark, folder, monkeypatch):
    class Seen(Exception):
        pass

    def stop(*args):
        found = next(c for c in next(a for a in args if isinstance(a, list) and isinstance(a[0], M.Candidate)) if c.name == model).make()
        raise Seen({k: getattr(found, k) if hasattr(found, k) and not hasattr(found, "getOrDefault") else found.getOrDefault(k) for k in size})

    monkeypatch.setattr(M, "evaluate", stop)
    monkeypatch.setattr(M, "grouped_importances", stop)
    monkeypatch.setattr("tallyback.catalog_models._fitted", {})
    with pytest.raises(Seen) as seen:
        QUERIES[name](spark, folder)
    assert seen.value.args[0] == size


@pytest.mark.parametrize("name", ["rfm_kmeans", "cluster_profile"])
def test_kmeans_takes_the_best_of_twenty_starts(name, spark, folder, monkeypatch):
    asked, fit = [], M.fit_kmeans_grid

    def fewer(rows, key, features, ks, starts, iterations, seed):
        asked.append((list(ks), starts, iterations))
        return fit(rows, key, features, ks, 2, 5, seed)

    monkeypatch.setattr(M, "fit_kmeans_grid", fewer)
    assert QUERIES[name](spark, folder).count() >= 2
    assert asked == [([2, 3, 4, 5, 6], 20, 300)]
