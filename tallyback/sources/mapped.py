"""The six retail tables derived from a folder of order, line, part, customer and event Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Map the order/line/part/customer/event files to orders, order_items, products, users, reviews, events."""

    def scan(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    orders, lines = scan("orders"), scan("lineitem")
    line_id = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    # One row per order by construction, so the optimizer drops the join wherever user_id is not read.
    owner = F.min("o_custkey").cast("string").alias("user_id")
    owned = lines.join(orders.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(owner), "l_orderkey", "left")
    # Items are joined by the order_id that later joins and groups go by, so that these find the lines of an order together already.
    order_id = F.col("l_orderkey").cast("string").alias("order_id")
    item_owner = orders.groupBy(F.col("o_orderkey").cast("string").alias("order_id")).agg(owner)
    owned_items = lines.select("*", order_id).join(item_owner, "order_id", "left")

    return {
        "orders": orders.select(
            F.col("o_orderkey").cast("string").alias("order_id"),
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("o_orderdate").alias("order_date"),
            F.expr("CASE o_orderstatus WHEN 'F' THEN 'returned' WHEN 'P' THEN 'cancelled' ELSE 'completed' END").alias(
                "order_status"
            ),
            F.col("o_totalprice").alias("total_amount"),
        ),
        "order_items": owned_items.select(
            line_id.alias("order_item_id"),
            "order_id",
            F.col("l_partkey").cast("string").alias("product_id"),
            "user_id",
            F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("item_price"),
            F.col("l_extendedprice").alias("item_total"),
        ),
        "products": scan("part").select(
            F.col("p_partkey").cast("string").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            F.col("p_retailprice").alias("price"),
            F.expr("CAST(1 + p_size % 5 AS DOUBLE)").alias("rating"),
        ),
        "users": scan("customer").select(
            F.col("c_custkey").cast("string").alias("user_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.col("c_mktsegment").alias("gender"),
            F.col("c_nationkey").cast("string").alias("city"),
            F.expr(
                "TIMESTAMP_NTZ '1995-01-01 00:00:00' + make_dt_interval(CAST((c_custkey * 37) % 2400 AS INT))"
            ).alias("signup_date"),
        ),
        # Every order line carries one review, so review jobs run over the whole line table.
        "reviews": owned.select(
            line_id.alias("review_id"),
            order_id,
            F.col("l_partkey").cast("string").alias("product_id"),
            "user_id",
            F.expr("CAST(1 + CAST(round(l_tax * 100) AS INT) % 5 AS DOUBLE)").alias("rating"),
            F.concat("l_returnflag", "l_linestatus").alias("review_text"),
            F.col("l_shipdate").alias("review_date"),
        ),
        "events": scan("events").select(
            F.col("event_id").cast("string").alias("event_id"),
            F.col("user_id").cast("string").alias("user_id"),
            F.lit(None).cast("string").alias("product_id"),
            F.expr("CASE event_type WHEN 'click' THEN 'cart' WHEN 'signup' THEN 'wishlist' ELSE event_type END").alias(
                "event_type"
            ),
            F.expr("ts - make_dt_interval(8400)").alias("event_timestamp"),
        ),
    }
