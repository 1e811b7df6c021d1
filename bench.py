"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores), BENCH_QUERIES (optional comma list).
"""

from __future__ import annotations

import json
import os
import time

from tallyback.catalog import QUERIES
from tallyback.session import get_session

HEADLINE = [
    "category_return_table",
    "order_item_rollup",
    "order_mart",
    "segment_return_rates",
    "chi_square_tests",
    "order_value_quintile",
    "customer_binomial_summary",
    "file_quality",
    "linkage_checks",
    "review_summary",
    "monthly_trend_full_months",
    "returns_scorecard",
    "order_breadth_rollup",
    "cohort_retention",
    "customer_snapshot_panel",
    "risk_score",
    "segment_summary",
    "basket_rules",
    "content_similarity",
    "content_recommendations",
    "forecast_backtest",
    "robust_z",
    "isolation_forest",
    "rfm_kmeans",
    "dbscan_grid",
    "clf_logistic",
    "clf_knn",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = get_session(
        "bench",
        {
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "scan_tables", folder)  # start-up and first file listing are not part of a query
    times = {name: round(run(spark, name, folder), 3) for name in names}
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
