"""Daily revenue: calendar spine, naive and smoothing forecasts, back-test, outlook."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyback.functions.smoothing import SEASON, smooth_forecast
from tallyback.plans.retention import product_dimension
from tallyback.sources.tables import Tables, union_all

HOLDOUT_DAYS = 30
OUTLOOK_DAYS = 90
AVERAGE_DAYS = 7

# Smoothing models by name, as (with trend, with weekly season).
SMOOTHERS = {
    "Exponential smoothing": (False, False),
    "Holt": (True, False),
    "Holt-Winters weekly": (True, True),
}


def _on_calendar(daily: DataFrame) -> DataFrame:
    """Fill every day between a series' first and last day with zero. One row per series and calendar day."""
    spans = daily.groupBy("series").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    spine = spans.select("series", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return spine.join(daily, ["series", "day"], "left").select(
        "series", "day", F.coalesce("revenue", F.lit(0.0)).alias("revenue")
    )


def daily_revenue(t: Tables) -> DataFrame:
    """Order value per day, days without orders as zero, as the series ``total``."""
    daily = t["orders"].filter("order_date IS NOT NULL").groupBy(F.to_date("order_date").alias("day")).agg(
        F.sum("total_amount").alias("revenue")
    )
    return _on_calendar(daily.select(F.lit("total").alias("series"), "day", "revenue"))


def daily_category_revenue(t: Tables) -> DataFrame:
    """Item revenue per category and day, one series per category."""
    dims = product_dimension(t).select("product_id", "category")
    days = t["orders"].select("order_id", F.to_date("order_date").alias("day"))
    daily = (
        t["order_items"]
        .join(days, "order_id")
        .groupBy("product_id", "day")
        .agg(F.sum("item_total").alias("revenue"))
        .join(dims, "product_id")
        .filter("category IS NOT NULL AND day IS NOT NULL")
        .groupBy(F.col("category").alias("series"), "day")
        .agg(F.sum("revenue").alias("revenue"))
    )
    return _on_calendar(daily)


def split_holdout(daily: DataFrame, days: int = HOLDOUT_DAYS) -> tuple[DataFrame, DataFrame]:
    """Training part and the last ``days`` days of each series."""
    last = F.max("day").over(Window.partitionBy("series"))
    marked = daily.withColumn("held_out", F.col("day") > F.date_sub(last, days))
    return marked.filter("NOT held_out").drop("held_out"), marked.filter("held_out").drop("held_out")


def _tail(history: DataFrame, days: int) -> DataFrame:
    """Last ``days`` rows of each series with their distance from the end (1 = last)."""
    back = Window.partitionBy("series").orderBy(F.desc("day"))
    return history.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= days)


def _steps(history: DataFrame, horizon: int) -> DataFrame:
    """Series length and one row per future step."""
    ends = history.groupBy("series").agg(F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"))
    return ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        "series", F.date_add("last_day", F.col("step")).alias("day"), "step", "days"
    )


def _as_forecast(df: DataFrame, model: str, value: Column) -> DataFrame:
    return df.select("series", "day", "step", F.lit(model).alias("model"), value.alias("forecast"))


def seasonal_naive(history: DataFrame, horizon: int, season: int = SEASON) -> DataFrame:
    """Repeat the last ``season`` values. A shorter series is first padded with its last value."""
    steps = _steps(history, horizon)
    slot = F.when(F.col("days") >= season, (F.col("step") - 1) % season).otherwise((F.col("days") + F.col("step") - 1) % season)
    known = F.least(F.col("days"), F.lit(season))
    wanted = F.greatest(F.lit(1), known - slot).cast("int")
    tail = _tail(history, season).select("series", "back", "revenue")
    joined = steps.withColumn("back", wanted).join(tail, ["series", "back"])
    return _as_forecast(joined, "7-day seasonal naive", F.col("revenue"))


def last_value(history: DataFrame, horizon: int) -> DataFrame:
    tail = _tail(history, 1).select("series", "revenue")
    return _as_forecast(_steps(history, horizon).join(tail, "series"), "Naive", F.col("revenue"))


def moving_average(history: DataFrame, horizon: int, days: int = AVERAGE_DAYS) -> DataFrame:
    """Mean of the last ``days`` days for every future step."""
    mean = _tail(history, days).groupBy("series").agg(F.avg("revenue").alias("mean"))
    return _as_forecast(_steps(history, horizon).join(mean, "series"), "Moving average", F.col("mean"))


def smoothing(history: DataFrame, horizon: int, models: list[str] | None = None) -> DataFrame:
    """Exponential smoothing forecasts, one task per (series, model).

    A group holds one number per calendar day, whatever the size of the order table. A series shorter than
    two seasons has no forecast of a seasonal model.
    """
    names = models or list(SMOOTHERS)
    settings = {n: SMOOTHERS[n] for n in names}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        name = pdf["model"].iloc[0]
        trend, seasonal = settings[name]
        if seasonal and len(pdf) < 2 * SEASON:
            return pd.DataFrame({"series": [], "day": [], "step": [], "model": [], "forecast": []})
        values = smooth_forecast(pdf["revenue"].to_numpy(), horizon, trend, seasonal)
        start = pd.Timestamp(pdf["day"].iloc[-1])
        return pd.DataFrame(
            {
                "series": pdf["series"].iloc[0],
                "day": [(start + pd.Timedelta(days=int(h))).date() for h in range(1, horizon + 1)],
                "step": np.arange(1, horizon + 1),
                "model": name,
                "forecast": values,
            }
        )

    per_model = history.withColumn("model", F.explode(F.array(*map(F.lit, names))))
    return per_model.groupBy("series", "model").applyInPandas(
        fit, "series string, day date, step int, model string, forecast double"
    )


def forecast_errors(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    error = F.col("forecast") - F.col("revenue")
    return (
        forecast.join(actual.select("series", "day", "revenue"), ["series", "day"])
        .groupBy("series", "model")
        .agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))
    )


def backtest(daily: DataFrame, holdout: int = HOLDOUT_DAYS) -> DataFrame:
    """Errors of the weekly models on the held-out days, the best of each series marked."""
    train, test = split_holdout(daily, holdout)
    forecasts = seasonal_naive(train, holdout).unionByName(smoothing(train, holdout, ["Holt-Winters weekly"]))
    place = Window.partitionBy("series").orderBy("mae", "model")
    return forecast_errors(forecasts, test).withColumn("best", F.row_number().over(place) == 1)


def outlook(daily: DataFrame, horizon: int = OUTLOOK_DAYS) -> DataFrame:
    """``horizon`` days ahead of each series with the model that won its back-test."""
    winners = backtest(daily).filter("best").select("series", "model")
    candidates = seasonal_naive(daily, horizon).unionByName(smoothing(daily, horizon, ["Holt-Winters weekly"]))
    return candidates.join(winners, ["series", "model"])


def smoothing_backtest(daily: DataFrame, holdout: int = HOLDOUT_DAYS) -> DataFrame:
    """Naive, moving average, exponential smoothing and Holt on the held-out days."""
    train, test = split_holdout(daily, holdout)
    forecasts = union_all(
        [last_value(train, holdout), moving_average(train, holdout), smoothing(train, holdout, ["Exponential smoothing", "Holt"])]
    )
    return forecast_errors(forecasts, test)
