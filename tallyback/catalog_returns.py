"""Catalogue: sources, cleaning, joins, audits and the returns study."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyback.catalog_base import DATE_FORMATS, Query, dirty_text_tables, on_tables, present
from tallyback.functions import columns as C
from tallyback.operators import audit, joins
from tallyback.operators.ranks import first_row_per_key
from tallyback.plans import returns as R
from tallyback.session import cut_lineage, ensure_checkpoint_dir
from tallyback.sources import tables as S
from tallyback.sources.mapped import load_tables
from tallyback.sources.schemas import PRIMARY_KEYS

# Amounts of the test data reach 499,979, so the routes use these borders there.
LOW_VALUE, HIGH_VALUE = 100_000.0, 400_000.0
SCENARIOS = [("low", 1.0, 0.3, 5e6), ("base", 3.0, 0.4, 6e6), ("high", 5.0, 0.5, 8e6)]


def _cleaned(t):
    return S.clean_tables(dirty_text_tables(t), DATE_FORMATS)


def _scan(t):
    return S.union_all(
        [df.agg(F.count(F.lit(1)).alias("table_rows")).select(F.lit(n).alias("table_name"), "table_rows") for n, df in sorted(t.items())]
    )


def _unique_keys(t):
    return S.union_all(
        [
            S.duplicate_keys(df, PRIMARY_KEYS[n])
            .agg(F.count(F.lit(1)).alias("repeated_keys"))
            .select(F.lit(n).alias("table_name"), F.lit(PRIMARY_KEYS[n]).alias("key_column"), "repeated_keys")
            for n, df in sorted(t.items())
        ]
    )


def _sink(spark: SparkSession, folder: str) -> DataFrame:
    """Write the category table as Parquet and CSV next to the checkpoints and read the CSV back."""
    t = load_tables(spark, folder)
    base = f"{ensure_checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"
    S.write_table(R.category_return_table(t), f"{base}/parquet")
    S.write_table(spark.read.parquet(f"{base}/parquet"), f"{base}/csv", fmt="csv")
    back = spark.read.schema("dominant_category string, orders bigint, returned_orders bigint, return_rate double")
    return present(back.option("header", True).csv(f"{base}/csv"))


def _csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """All tables written as CSV and read back: usable rows, unreadable lines, and rows that differ from what was written.

    Lines of cancelled orders carry one value too many, as an export with an unquoted comma would.
    """
    parts = []
    for name, df in sorted(load_tables(spark, folder).items()):
        text = cut_lineage(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]))  # written twice, compared once
        path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
        broken = F.col("order_status") == "cancelled" if name == "orders" else F.lit(False)
        text.filter(~broken).write.options(header=True, compression="gzip").csv(path)
        text.filter(broken).withColumn("_extra", F.lit("x")).write.mode("append").options(header=True, compression="gzip").csv(path)
        good, bad = S.scan_csv_table(spark, name, path, df.columns)
        unlike = S.unlike_rows(text.filter(~broken), good)
        parts.append(
            good.agg(F.count(F.lit(1)).alias("table_rows")).select(
                F.lit(name).alias("table_name"), "table_rows", F.lit(bad.count()).alias("bad_rows"), F.lit(unlike).alias("unlike_rows")
            )
        )
    return present(S.union_all(parts))


def _empty_guard(t):
    return audit.non_null_counts(
        {
            "category_rates": (R.category_return_table(t), ["return_rate"]),
            "monthly_forecast": (R.monthly_forecast(t), ["returned_order_count", "forecast_order_count"]),
            "overall_kpis": (R.overall_kpis(t), ["value"]),
        }
    )


def _dedupe_exact(t):
    doubled = t["products"].unionByName(t["products"])
    return doubled.dropDuplicates()


def _dedupe_key_first(t):
    """First order per user: the key repeats, the order is explicit."""
    return first_row_per_key(t["orders"].filter("user_id IS NOT NULL"), "user_id", ["order_date", "order_id"])


def _price_ratio(t):
    prices = t["products"].select("product_id", F.col("price").alias("catalogue_price"))
    joined = t["order_items"].join(prices, "product_id", "left")
    return joined.select("order_item_id", C.ratio(F.col("item_price"), F.col("catalogue_price")).alias("price_ratio"))


def _line_reconcile(t):
    expected = F.col("quantity") * F.col("item_price")
    return t["order_items"].select(
        "order_item_id", expected.alias("line_total"), (F.col("item_total") - expected).alias("line_gap")
    )


def _date_parts(t):
    parts = R.date_parts(F.col("order_date"))
    return t["orders"].select(
        "order_id",
        F.date_format(parts["order_month"], "yyyy-MM-dd").alias("order_month"),
        parts["month_name"].alias("month_name"),
        parts["day_name"].alias("day_name"),
        F.date_format("order_date", "yyyy-MM").alias("year_month"),
        F.date_format("order_date", "yyyy-MM-dd'T'HH:mm:ss").alias("iso_date"),
    )


def _customers(t):
    return R.unusual_customers(R.binomial_returns_test(R.customer_returns(t)))


def _detail(t):
    return _customers(t).drop("pooled_rate")


def _mart_detail(t):
    return R.order_mart_export(R.order_mart(t))


def _review_contingency(t):
    return R.contingency(joins.reviews_with_status(t), "review_text", "returned", "kept", "returned_rows")


MONEY = ("returned_order_value", "total_amount", "value", "units")

QUERIES: dict[str, Query] = {
    # sources and contracts
    "scan_tables": on_tables(_scan),
    "csv_scan": _csv_scan,
    "schema_contract": on_tables(S.contract_report),
    "unique_key_guard": on_tables(_unique_keys),
    "join_cardinality_guard": on_tables(joins.cardinality_report),
    "source_audit": on_tables(audit.source_audit),
    "sink": _sink,
    "empty_result_guard": on_tables(_empty_guard),
    # cleaning
    "clean_numeric": on_tables(lambda t: _cleaned(t)["orders"].select("order_id", "total_amount"), money=MONEY),
    "clean_timestamp": on_tables(lambda t: _cleaned(t)["orders"].select("order_id", "order_date")),
    "clean_label": on_tables(
        lambda t: dirty_text_tables(t)["products"].select(
            "product_id", C.clean_label(F.col("category")).alias("category"), C.clean_label(F.col("brand")).alias("brand")
        )
    ),
    "trim_ids": on_tables(lambda t: _cleaned(t)["orders"].select("order_id", "user_id", "order_status")),
    "log_features": on_tables(
        lambda t: t["orders"].select("order_id", C.log1p_floor_zero(F.col("total_amount") - 250_000).alias("amount_log1p"))
    ),
    "returned_flag": on_tables(
        lambda t: t["orders"].select(
            "order_id",
            C.returned_flag(F.col("order_status")).alias("returned"),
            C.return_label(C.returned_flag(F.col("order_status"))).alias("return_status"),
        )
    ),
    "required_field_filter": on_tables(lambda t: S.keep_usable_rows(_cleaned(t))["orders"], money=MONEY),
    "coercion_audit": on_tables(lambda t: audit.coercion_audit(_cleaned(t))),
    "dedupe_exact": on_tables(_dedupe_exact),
    "dedupe_key_first": on_tables(_dedupe_key_first, money=MONEY),
    "price_ratio": on_tables(_price_ratio),
    "line_reconcile": on_tables(_line_reconcile, digits=4),
    "date_parts": on_tables(_date_parts),
    "tenure_fractional": on_tables(
        lambda t: joins.orders_with_user(t).select(
            "order_id", C.days_between(F.col("order_date"), F.col("signup_date")).alias("tenure_days")
        )
    ),
    "whole_days_clipped": on_tables(
        lambda t: joins.orders_with_user(t).select(
            "order_id", C.whole_days_clipped(F.col("order_date"), F.col("signup_date")).alias("tenure_days")
        )
    ),
    "pii_projection": on_tables(lambda t: t["users"].select("user_id", "gender", "signup_date")),
    "status_flags_ci": on_tables(
        lambda t: t["orders"].select(
            "order_id",
            C.status_is(F.upper("order_status"), "cancelled").alias("is_cancelled"),
            C.status_is(F.upper("order_status"), "returned").alias("is_returned"),
        )
    ),
    # joins
    "items_with_product": on_tables(joins.items_with_product, digits=8),
    "orders_with_rollup": on_tables(R.orders_with_rollup, digits=8, money=MONEY),
    "orders_with_user": on_tables(joins.orders_with_user, money=MONEY),
    "reviews_with_status": on_tables(joins.reviews_with_status),
    "fk_orphans": on_tables(joins.foreign_key_orphans),
    "id_mismatch": on_tables(joins.owner_mismatches),
    "order_before_signup": on_tables(joins.orders_before_signup),
    "item_order_date": on_tables(lambda t: joins.items_with_order_date(t).select("order_item_id", "order_date")),
    "semi_valid_orders": on_tables(lambda t: joins.items_of_valid_orders(t).select("order_item_id", "order_id")),
    "spine_join": on_tables(R.months_on_spine, money=MONEY),
    # aggregates
    "order_item_rollup": on_tables(R.order_item_rollup, digits=8, money=MONEY),
    "dominant_label": on_tables(R.dominant_labels),
    "dominant_by_sort": on_tables(R.dominant_category_by_count),
    "overall_kpis": on_tables(R.overall_kpis, digits=4),
    "segment_return_rates": on_tables(lambda t: R.segment_return_rates(R.order_mart(t))),
    "contingency": on_tables(_review_contingency),
    "review_summary": on_tables(R.review_summary),
    "review_text_distribution": on_tables(R.review_text_distribution),
    "review_rating_distribution": on_tables(R.review_rating_distribution),
    "category_return_table": on_tables(R.category_return_table),
    "category_returns": on_tables(R.category_returns),
    "file_quality": on_tables(audit.file_quality),
    "column_nulls": on_tables(audit.column_nulls),
    "linkage_checks": on_tables(R.linkage_checks),
    "value_frequency": on_tables(lambda t: audit.value_frequency(t["orders"], "order_status")),
    "monthly_returns": on_tables(R.monthly_returns, money=MONEY),
    "customer_returns": on_tables(lambda t: R.customer_returns(t), money=MONEY),
    "customer_binomial_summary": on_tables(lambda t: R.customer_binomial_summary(_customers(t)), digits=4),
    "return_rate_two_bases": on_tables(R.return_rate_two_bases),
    "value_concentration": on_tables(lambda t: R.value_concentration(t, [LOW_VALUE, HIGH_VALUE])),
    "lost_value_share": on_tables(R.lost_value_share, digits=4),
    # ranks and order
    "order_sequence": on_tables(lambda t: R.order_sequence(t["orders"]).select("order_id", "user_id", "order_sequence")),
    "order_sequence_group": on_tables(
        lambda t: R.order_sequence(t["orders"])
        .groupBy(R.sequence_group(F.col("order_sequence")).alias("sequence_group"))
        .agg(F.count(F.lit(1)).alias("orders"))
    ),
    "order_value_quintile": on_tables(lambda t: R.order_value_quintile(t["orders"])),
    "first_per_group": on_tables(
        lambda t: first_row_per_key(t["reviews"].drop("user_id", "product_id"), "order_id", ["review_date", "review_id"])
    ),
    "calendar_order": on_tables(lambda t: R.ordered_segments(R.segment_return_rates(R.order_mart(t)))),
    "numeric_label_order": on_tables(
        lambda t: R.order_item_rollup(t)
        .groupBy(F.col("item_count").cast("string").alias("level"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .withColumn("level_number", F.col("level").try_cast("double"))
        .orderBy("level_number", "level")
    ),
    "stable_multi_key_sort": on_tables(
        lambda t: R.dominant_category_by_count(t).orderBy("order_id", F.desc("item_lines"), "dominant_category")
    ),
    "order_mart": on_tables(_mart_detail, digits=8, money=MONEY),
    # tests
    "chi_square_tests": on_tables(lambda t: R.association_tests(t, R.order_mart(t)).select("dimension", "chi2", "degrees_freedom", "orders_tested")),
    "cramers_v": on_tables(lambda t: R.association_tests(t, R.order_mart(t)).select("dimension", "cramers_v")),
    "low_expected_cells": on_tables(
        lambda t: R.association_tests(t, R.order_mart(t)).select(
            "dimension", "expected_cells_below_5", "expected_cell_count", "pct_expected_cells_below_5"
        )
    ),
    "chi_square_p_values": on_tables(lambda t: R.with_p_values(R.association_tests(t, R.order_mart(t)))),
    "bonferroni": on_tables(lambda t: R.with_bonferroni(R.with_p_values(R.association_tests(t, R.order_mart(t))))),
    "binomial_returns_test": on_tables(
        lambda t: R.binomial_returns_test(R.customer_returns(t)).select("user_id", "customer_orders", "customer_returns", "binomial_p_value")
    ),
    "unusual_customers": on_tables(_detail, money=MONEY),
    "unusual_products": on_tables(R.unusual_products),
    "product_binomial_summary": on_tables(lambda t: R.product_binomial_summary(R.unusual_products(t)), digits=4),
    "tested_segments": on_tables(lambda t: R.tested_segments(R.order_mart(t))),
    # months and decisions
    "monthly_trend_forecast": on_tables(
        lambda t: R.monthly_forecast(t, full_months_only=False).drop("period_status", "included_in_trend_fit"), digits=2
    ),
    "monthly_trend_full_months": on_tables(R.monthly_forecast, digits=2),
    "value_route": on_tables(lambda t: R.value_route(t, LOW_VALUE, HIGH_VALUE), money=MONEY),
    "returns_scorecard": on_tables(lambda t: R.returns_scorecard(t, R.order_mart(t), [LOW_VALUE, HIGH_VALUE]), digits=4),
    "cost_benefit_scenarios": on_tables(lambda t: R.cost_benefit_scenarios(t, SCENARIOS), digits=4),
}
