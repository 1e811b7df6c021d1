"""Table contracts: raw CSV schemas, keys and required columns."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of each input table, in file order.
TABLE_COLUMNS = {
    "orders": ["order_id", "user_id", "order_date", "order_status", "total_amount"],
    "order_items": ["order_item_id", "order_id", "product_id", "user_id", "quantity", "item_price", "item_total"],
    "products": ["product_id", "product_name", "category", "brand", "price", "rating"],
    "users": ["user_id", "name", "email", "gender", "city", "signup_date"],
    "reviews": ["review_id", "order_id", "product_id", "user_id", "rating", "review_text", "review_date"],
    "events": ["event_id", "user_id", "product_id", "event_type", "event_timestamp"],
}

# Primary key of each table.
PRIMARY_KEYS = {
    "orders": "order_id",
    "order_items": "order_item_id",
    "products": "product_id",
    "users": "user_id",
    "reviews": "review_id",
    "events": "event_id",
}

NUMERIC_COLUMNS = {
    "orders": ["total_amount"],
    "order_items": ["quantity", "item_price", "item_total"],
    "products": ["price", "rating"],
    "reviews": ["rating"],
}

TIMESTAMP_COLUMNS = {
    "orders": ["order_date"],
    "users": ["signup_date"],
    "reviews": ["review_date"],
    "events": ["event_timestamp"],
}

# Fields without which a row is of no use to the retention jobs.
REQUIRED_FIELDS = {
    "orders": ["order_id", "user_id", "order_date", "total_amount"],
    "order_items": ["order_item_id", "order_id", "product_id", "user_id", "quantity", "item_price", "item_total"],
    "products": ["product_id", "category", "brand", "price"],
    "events": ["user_id", "event_timestamp", "event_type"],
    "reviews": ["user_id", "review_date", "rating"],
    "users": ["user_id", "signup_date"],
}


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])
