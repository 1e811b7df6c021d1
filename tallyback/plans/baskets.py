"""Pair rules over order baskets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyback.operators.sizing import settle
from tallyback.plans.retention import product_dimension
from tallyback.session import cut_lineage
from tallyback.sources.tables import Tables

MIN_SHARE = 0.005
MIN_ORDERS = 20


def basket_labels(t: Tables, level: str) -> DataFrame:
    """Distinct (order, label) rows of valid orders."""
    items = t["order_items"].join(t["orders"].select("order_id"), "order_id", "left_semi").select("order_id", "product_id")
    if level != "product_id":
        items = items.join(product_dimension(t).select("product_id", level), "product_id")
    return items.select("order_id", F.col(level).alias("label")).filter("label IS NOT NULL").distinct()


def multi_label_baskets(labels: DataFrame) -> DataFrame:
    """Rows of baskets with two or more labels."""
    sizes = labels.groupBy("order_id").agg(F.count(F.lit(1)).alias("size")).filter("size >= 2").select("order_id")
    return labels.join(sizes, "order_id", "left_semi")


def basket_rules(labels: DataFrame, level: str, min_share: float = MIN_SHARE, min_orders: int = MIN_ORDERS) -> DataFrame:
    """Support, confidence and lift of all pairs in at least max(``min_orders``, share of baskets) orders.

    A pair cannot be more frequent than its rarer label, so labels below the
    minimum go first, which loses nothing. At most mean basket size /
    ``min_share`` labels remain, and that also bounds every basket, however
    large the order. Equal baskets are then merged and their pairs counted
    once with a weight; pair counts are summed before they are shuffled.
    """
    rows = cut_lineage(multi_label_baskets(labels))
    baskets = rows.agg(F.count_distinct("order_id")).first()[0]
    least = max(min_orders, math.ceil(baskets * min_share)) if baskets else 0
    frequent = settle(
        rows.groupBy("label").agg(F.count(F.lit(1)).alias("label_orders")).filter(F.col("label_orders") >= least)
    )
    distinct_baskets = (
        rows.join(frequent.select("label"), "label")
        .groupBy("order_id")
        .agg(F.sort_array(F.collect_set("label")).alias("labels"))
        .filter(F.size("labels") >= 2)
        .groupBy("labels")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    pairs = settle(
        distinct_baskets.select("labels", "weight", F.posexplode("labels").alias("place", "a"))
        .select("weight", "a", F.explode(F.slice("labels", F.col("place") + 2, F.size("labels"))).alias("b"))
        .groupBy("a", "b")
        .agg(F.sum("weight").alias("co_orders"))
        .filter(F.col("co_orders") >= least)
    )
    both_ways = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("antecedent"), F.col("b").alias("consequent"), "co_orders"),
                F.struct(F.col("b").alias("antecedent"), F.col("a").alias("consequent"), "co_orders"),
            )
        )
    )
    base = frequent.select(F.col("label").alias("antecedent"), F.col("label_orders").alias("antecedent_orders"))
    other = frequent.select(F.col("label").alias("consequent"), F.col("label_orders").alias("consequent_orders"))
    confidence = F.col("co_orders") / F.col("antecedent_orders")
    return both_ways.join(base, "antecedent").join(other, "consequent").select(
        F.lit(level).alias("rule_level"),
        "antecedent",
        "consequent",
        (F.col("co_orders") / F.lit(baskets)).alias("support"),
        confidence.alias("confidence"),
        (confidence / (F.col("consequent_orders") / F.lit(baskets))).alias("lift"),
        "co_orders",
        F.lit(least).cast("bigint").alias("min_co_orders"),
    )


def category_brand_rules(t: Tables) -> DataFrame:
    return basket_rules(basket_labels(t, "category"), "category").unionByName(basket_rules(basket_labels(t, "brand"), "brand"))


def product_rule_diagnostic(t: Tables) -> DataFrame:
    """Baskets, distinct products in them, and how many product rules reach the support limit."""
    labels = cut_lineage(basket_labels(t, "product_id"))
    rules = basket_rules(labels, "product").agg(F.count(F.lit(1)).alias("product_rules"))
    totals = labels.agg(
        F.count_distinct("order_id").alias("product_baskets"), F.count_distinct("label").alias("distinct_products")
    )
    return totals.withColumn("product_rules", rules.scalar())
