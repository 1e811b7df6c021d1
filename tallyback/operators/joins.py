"""Joins of the retail tables, cardinality checks and link audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyback.functions import columns as C
from tallyback.sources.tables import Tables, duplicate_keys, require_unique, union_all

CARDINALITIES = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")


def join_checked(left: DataFrame, right: DataFrame, on: str, how: str, cardinality: str) -> DataFrame:
    """Join after checking that the "one" sides hold unique keys."""
    if cardinality not in CARDINALITIES:
        raise ValueError(f"cardinality must be one of {CARDINALITIES}")
    left_side, right_side = cardinality.split("_to_")
    if left_side == "one":
        require_unique(left, on, "left side")
    if right_side == "one":
        require_unique(right, on, "right side")
    return left.join(right, on, how)


def cardinality_report(t: Tables) -> DataFrame:
    """Repeated keys on the "one" side of every join the jobs make."""
    sides = [
        ("items_to_products", t["products"], "product_id"),
        ("items_to_orders", t["orders"], "order_id"),
        ("orders_to_users", t["users"], "user_id"),
        ("reviews_to_orders", t["orders"], "order_id"),
    ]
    return union_all(
        [
            duplicate_keys(df, key).agg(F.count(F.lit(1)).alias("repeated_keys")).select(
                F.lit(link).alias("link"), F.lit(key).alias("key_column"), "repeated_keys"
            )
            for link, df, key in sides
        ]
    )


def items_with_product(t: Tables) -> DataFrame:
    """Items LEFT products with cleaned labels and a match marker.

    No broadcast hint: the catalogue is sent whole only when its measured size
    allows it, else adaptive execution splits the partitions of hot products.
    """
    dims = t["products"].select("product_id", "category", "brand", "rating", F.lit(True).alias("_matched"))
    return t["order_items"].join(dims, "product_id", "left").select(
        "order_item_id",
        "order_id",
        "product_id",
        "quantity",
        "item_price",
        "item_total",
        C.clean_label(F.col("category")).alias("category"),
        C.clean_label(F.col("brand")).alias("brand"),
        F.col("rating").alias("product_rating"),
        F.coalesce(F.col("_matched"), F.lit(False)).alias("product_matched"),
    )


def orders_with_user(t: Tables) -> DataFrame:
    dims = t["users"].select("user_id", "gender", "signup_date", F.lit(True).alias("_matched"))
    return t["orders"].join(dims, "user_id", "left").select(
        "order_id",
        "user_id",
        "order_date",
        "order_status",
        "total_amount",
        C.clean_label(F.col("gender")).alias("gender"),
        "signup_date",
        F.coalesce(F.col("_matched"), F.lit(False)).alias("user_matched"),
    )


def reviews_with_status(t: Tables) -> DataFrame:
    flags = t["orders"].select("order_id", C.returned_flag(F.col("order_status")).alias("returned"))
    return t["reviews"].join(flags, "order_id", "inner").select(
        "review_id",
        "order_id",
        "rating",
        C.clean_label(F.col("review_text")).alias("review_text"),
        "returned",
        C.return_label(F.col("returned")).alias("return_status"),
    )


def _orphans(link: str, child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    known = parent.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(1))
    joined = child.select(key).groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).join(known, key, "left")
    return joined.agg(
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_rows"))), F.lit(0)).alias("orphan_rows"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("child_rows"),
    ).select(F.lit(link).alias("link"), "orphan_rows", "child_rows")


def foreign_key_orphans(t: Tables) -> DataFrame:
    """Rows without a parent for the five links. Child rows collapse to one per key before the join."""
    return union_all(
        [
            _orphans("orders_without_user", t["orders"], t["users"], "user_id"),
            _orphans("orders_without_items", t["orders"], t["order_items"], "order_id"),
            _orphans("items_without_order", t["order_items"], t["orders"], "order_id"),
            _orphans("items_without_product", t["order_items"], t["products"], "product_id"),
            _orphans("reviews_without_order", t["reviews"], t["orders"], "order_id"),
        ]
    )


def _owner_mismatch(link: str, child: DataFrame, orders: DataFrame) -> DataFrame:
    owners = orders.select("order_id", F.col("user_id").alias("order_user"), F.lit(1).alias("_known"))
    pairs = child.groupBy("order_id", "user_id").agg(F.count(F.lit(1)).alias("_rows")).join(owners, "order_id")
    return pairs.agg(
        F.coalesce(F.sum(F.when(F.col("user_id") != F.col("order_user"), F.col("_rows"))), F.lit(0)).alias("mismatched_rows"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("linked_rows"),
    ).select(F.lit(link).alias("link"), "mismatched_rows", "linked_rows")


def owner_mismatches(t: Tables) -> DataFrame:
    """Child rows whose user differs from the user of their order."""
    return union_all(
        [
            _owner_mismatch("item_user_differs", t["order_items"], t["orders"]),
            _owner_mismatch("review_user_differs", t["reviews"], t["orders"]),
        ]
    )


def orders_before_signup(t: Tables) -> DataFrame:
    """Orders dated before the signup of their user, and how many orders allow the comparison."""
    both = F.col("order_date").isNotNull() & F.col("signup_date").isNotNull()
    return orders_with_user(t).agg(
        F.count_if(both & (F.col("order_date") < F.col("signup_date"))).alias("orders_before_signup"),
        F.count_if(both).alias("comparable_orders"),
    )


def items_with_order_date(t: Tables) -> DataFrame:
    """Order date per item, null when the order is unknown."""
    return t["order_items"].join(t["orders"].select("order_id", "order_date"), "order_id", "left")


def items_of_valid_orders(t: Tables) -> DataFrame:
    return t["order_items"].join(t["orders"].select("order_id"), "order_id", "left_semi")
