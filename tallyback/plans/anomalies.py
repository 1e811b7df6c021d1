"""Order anomaly triage: robust z-scores per category and per order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyback.functions import columns as C
from tallyback.operators.quantiles import exact_quantile
from tallyback.operators.sizing import settle
from tallyback.plans.retention import product_dimension
from tallyback.session import cut_lineage
from tallyback.sources.tables import Tables

# Scale of a normal MAD, flag limit, and the scored order columns.
MAD_SCALE = 0.6745
FLAG_LIMIT = 3.5
SCORED = ["total_quantity", "item_line_count", "max_item_price", "max_price_robust_z", "item_total_sum"]
FOREST_INPUTS = SCORED + ["mean_price_robust_z"]


def priced_items(t: Tables) -> DataFrame:
    dims = product_dimension(t).select("product_id", "category")
    return t["order_items"].join(dims, "product_id", "left")


def category_price_stats(items: DataFrame) -> DataFrame:
    """Exact median price and median absolute deviation per category.

    The two columns are written once, since four passes read them.
    """
    known = cut_lineage(items.filter("category IS NOT NULL").select("category", "item_price"))
    medians = settle(exact_quantile(known, F.col("item_price"), 0.5, ["category"], "price_median", written=True))
    spread = F.abs(F.col("item_price") - F.col("price_median"))
    mads = exact_quantile(known.join(medians, "category"), spread, 0.5, ["category"], "price_mad", written=True)
    return settle(medians.join(mads, "category"))


def items_with_price_z(t: Tables) -> DataFrame:
    """Robust z of each item price in its category; 0 where it cannot be computed."""
    items = priced_items(t)
    z = MAD_SCALE * C.ratio(F.col("item_price") - F.col("price_median"), F.col("price_mad"))
    return items.join(category_price_stats(items), "category", "left").withColumn(
        "price_robust_z", C.finite_or(z, F.lit(0.0))
    )


def anomaly_rollup(t: Tables) -> DataFrame:
    """Per order: sums, distinct lines, highest price, highest and mean absolute price z."""
    size = F.abs("price_robust_z")
    # Laid out by order first: distinct lines are counted where the order's lines lie, instead of moving every line with its sums.
    return items_with_price_z(t).repartition("order_id").groupBy("order_id").agg(
        F.coalesce(F.sum("item_total"), F.lit(0.0)).alias("item_total_sum"),
        F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("total_quantity"),
        F.count_distinct("order_item_id").cast("double").alias("item_line_count"),
        F.max("item_price").alias("max_item_price"),
        F.max(size).alias("max_price_robust_z"),
        F.avg(size).alias("mean_price_robust_z"),
    )


def order_features(t: Tables) -> DataFrame:
    """Orders with their rollup, materialised: the medians read it several times."""
    orders = t["orders"].select("order_id", "user_id", "order_date", "total_amount")
    return cut_lineage(orders.join(anomaly_rollup(t), "order_id", "left"))


def column_medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float]:
    """Exact median of several columns of a written table in one search; one number per column reaches the driver."""
    entries = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in columns.items()])
    found = exact_quantile(df.select(F.inline(entries)), F.col("value"), 0.5, ["name"], "median", written=True).collect()
    return {row["name"]: row["median"] for row in found}


def order_robust_z(features: DataFrame) -> DataFrame:
    """Robust z per order column, nulls left out of the medians, and the flag over them.

    A column whose MAD is zero is divided by one.
    """
    medians = column_medians(features, {c: F.col(c) for c in FOREST_INPUTS})
    spreads = column_medians(features, {c: F.abs(F.col(c) - F.lit(medians[c])) for c in medians})
    scores = {
        f"{c}_z": F.lit(MAD_SCALE) * (F.col(c) - F.lit(medians[c])) / F.lit(spreads[c] if spreads[c] > 0 else 1.0)
        for c in medians
    }
    scored = features.withColumns(scores)
    largest = F.greatest(*[F.abs(f"{c}_z") for c in SCORED])
    return scored.withColumn("robust_z_flag", F.coalesce((largest > FLAG_LIMIT).cast("int"), F.lit(0)))


def repaired_inputs(features: DataFrame) -> DataFrame:
    """Null, NaN and infinite inputs replaced by the column median."""
    medians = column_medians(features, {c: C.finite_or(F.col(c), F.lit(None).cast("double")) for c in FOREST_INPUTS})
    return features.withColumns({c: C.finite_or(F.col(c), F.lit(medians.get(c, 0.0))) for c in FOREST_INPUTS})


def flag_reason(robust: Column, forest: Column) -> Column:
    return (
        F.when((robust == 1) & (forest == 1), "both_methods")
        .when(robust == 1, "robust_z_only")
        .when(forest == 1, "isolation_forest_only")
        .otherwise("none")
    )


def review_queue(robust: DataFrame, forest: DataFrame) -> DataFrame:
    """All orders with both flags, their union and the reason."""
    joined = robust.join(forest.select("order_id", "isolation_score", "isolation_forest_flag"), "order_id", "left")
    by_forest = F.coalesce("isolation_forest_flag", F.lit(0))
    return joined.withColumns(
        {
            "isolation_forest_flag": by_forest,
            "review_flag": F.greatest(F.col("robust_z_flag"), by_forest),
            "flag_reason": flag_reason(F.col("robust_z_flag"), by_forest),
        }
    )


def user_flag_rates(queue: DataFrame) -> DataFrame:
    per_user = queue.groupBy("user_id").agg(
        F.sum("review_flag").alias("flagged_orders"),
        F.count(F.lit(1)).alias("orders_reviewed"),
        F.coalesce(F.sum(F.when(F.col("review_flag") == 1, F.col("item_total_sum"))), F.lit(0.0)).alias("flagged_order_value"),
    )
    return per_user.withColumn("flagged_order_rate", C.ratio(F.col("flagged_orders").cast("double"), F.col("orders_reviewed")))


def queue_totals(queue: DataFrame) -> DataFrame:
    """Orders and value per detection method, one aggregate."""
    methods = {"Isolation Forest": "isolation_forest_flag", "Robust z-score": "robust_z_flag", "Union review queue": "review_flag"}
    aggs, entries = [], []
    for i, (name, flag) in enumerate(methods.items()):
        hit = F.col(flag) == 1
        aggs += [F.count_if(hit).alias(f"n{i}"), F.coalesce(F.sum(F.when(hit, F.col("item_total_sum"))), F.lit(0.0)).alias(f"v{i}")]
        entries.append(F.struct(F.lit(name).alias("method"), F.col(f"n{i}").alias("orders"), F.col(f"v{i}").alias("value")))
    return queue.agg(*aggs).select(F.inline(F.array(*entries)))
