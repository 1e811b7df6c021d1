"""As-of totals: what had happened to each key before each of its points in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals_before(facts: DataFrame, points: DataFrame, key: str, at: str, sums: dict[str, Column]) -> DataFrame:
    """The rows of ``points`` with the sums of all facts of the same key strictly before them.

    Facts and points are laid into one table and sorted once, points ahead of
    facts of the same instant, so the rows sorted are facts + points and no
    fact is repeated per point. Sums run in two levels: along the rows of one
    (key, day), and along the days of a key. A key with a third of all facts
    is thus spread over its days, and its second level has one row per day.

    ``points`` needs ``key`` and ``at`` and keeps its other columns; repeated
    points each get a row. Null keys form a key of their own. A point without
    earlier facts gets 0; facts or points without a time have no place in the
    order: such facts are left out, such points get 0. Names starting with
    ``_asof`` are reserved.
    """
    others = [c for c in points.columns if c not in (key, at)]
    rest = F.struct(*[F.col(c) for c in others]) if others else F.lit(None).cast("string")
    zeros = [F.lit(None).alias(name) for name in sums]
    asked = points.select(F.col(key).alias("_asof_key"), F.col(at).alias("_asof_at"), rest.alias("_asof_rest"), F.lit(0).alias("_asof_kind"), *zeros)
    known = facts.filter(F.col(at).isNotNull()).select(
        F.col(key).alias("_asof_key"), F.col(at).alias("_asof_at"), F.lit(None).alias("_asof_rest"), F.lit(1).alias("_asof_kind"),
        *[value.alias(name) for name, value in sums.items()],
    )
    rows = known.unionByName(asked).withColumn("_asof_day", F.date_trunc("day", "_asof_at"))

    within = Window.partitionBy("_asof_key", "_asof_day").orderBy("_asof_at", "_asof_kind").rowsBetween(Window.unboundedPreceding, 0)
    same_day = rows.select("*", *[F.sum(name).over(within).alias(f"_asof_{i}") for i, name in enumerate(sums)]).filter("_asof_kind = 0")

    days = rows.groupBy("_asof_key", "_asof_day").agg(*[F.sum(name).alias(f"_asof_d{i}") for i, name in enumerate(sums)])
    earlier = Window.partitionBy("_asof_key").orderBy("_asof_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(
        F.col("_asof_key").alias("_asof_k"), F.col("_asof_day").alias("_asof_d"),
        *[F.sum(f"_asof_d{i}").over(earlier).alias(f"_asof_e{i}") for i in range(len(sums))],
    )
    same = F.col("_asof_key").eqNullSafe(F.col("_asof_k")) & (F.col("_asof_day") == F.col("_asof_d"))
    return same_day.join(carried, same, "left").select(
        F.col("_asof_key").alias(key),
        F.col("_asof_at").alias(at),
        *[F.col(f"_asof_rest.{c}").alias(c) for c in others],
        *[
            (F.coalesce(f"_asof_{i}", F.lit(0)) + F.coalesce(f"_asof_e{i}", F.lit(0))).alias(name)
            for i, name in enumerate(sums)
        ],
    )
