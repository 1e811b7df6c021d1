"""Helpers for the query catalogue: uniform printing of results and dirty text inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyback.session import shuffles_for
from tallyback.sources.mapped import load_tables

Query = Callable[[SparkSession, str], DataFrame]
TablesQuery = Callable[[dict[str, DataFrame]], DataFrame]


def present(df: DataFrame, digits: int = 6, money: tuple[str, ...] = (), days: tuple[str, ...] = ()) -> DataFrame:
    """Print a result one way everywhere: rounded doubles, long integers, timestamps as text."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind == "double":
            col = F.round(col, 2 if name in money else digits)
        elif kind in ("int", "tinyint", "smallint"):
            col = col.cast("bigint")
        elif kind.startswith("timestamp") or kind == "date":
            col = F.date_format(col, "yyyy-MM-dd" if name in days else "yyyy-MM-dd HH:mm:ss")
        out.append(col.alias(name))
    return df.select(*out)


def on_tables(build: TablesQuery, **printing) -> Query:
    """A catalogue query over the six mapped tables; what it writes on its way is shuffled by the number of order lines."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = load_tables(spark, folder)
        with shuffles_for(t["order_items"]):
            return present(build(t), **printing)

    return run


def dirty_text_tables(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables as text, with the faults a CSV export brings, chosen by the order status or brand.

    Cancelled orders get a trailing type letter on the amount and a day-first
    date, returned ones padding; products of some brands get padding or blanks.
    """
    status = F.col("order_status")
    amount = F.col("total_amount").cast("string")
    iso, local = F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"), F.date_format("order_date", "dd/MM/yyyy")
    text = {name: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]) for name, df in t.items()}
    text["orders"] = t["orders"].select(
        F.concat(F.lit(" "), "order_id").alias("order_id"),
        F.concat("user_id", F.lit(" ")).alias("user_id"),
        F.when(status == "cancelled", local).otherwise(iso).alias("order_date"),
        "order_status",
        F.when(status == "cancelled", F.concat(amount, F.lit("d")))
        .when(status == "returned", F.concat(F.lit(" "), amount, F.lit(" ")))
        .otherwise(amount)
        .alias("total_amount"),
    )
    text["products"] = t["products"].select(
        "product_id",
        F.concat(F.lit("  "), "product_name").alias("product_name"),
        F.when(F.col("category") == "PROMO", "  ").when(F.col("category") != "SMALL", F.col("category")).alias("category"),
        F.concat(F.lit(" "), "brand", F.lit(" ")).alias("brand"),
        F.when(F.col("category") == "LARGE", F.lit("NaN")).otherwise(F.col("price").cast("string")).alias("price"),
        F.col("rating").cast("string").alias("rating"),
    )
    return text


DATE_FORMATS = {
    "order_date": "yyyy-MM-dd HH:mm:ss",
    "signup_date": "yyyy-MM-dd HH:mm:ss",
    "review_date": "yyyy-MM-dd HH:mm:ss",
    "event_timestamp": "yyyy-MM-dd HH:mm:ss",
}
