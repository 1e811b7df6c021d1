"""Ranks over a whole table or over large groups, without sending either to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyback.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def _slice_offsets(slices: DataFrame) -> DataFrame:
    """Running total before each range slice. One row per slice, so the bare window is tiny."""
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(slices.select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")))


def global_row_number(df: DataFrame, order_by: list[Column], out: str) -> DataFrame:
    """Number all rows 1..n by ``order_by``, which must be a total order.

    Rows are range-partitioned on the full key, so ties on the leading column
    spread over slices. The slice of each row is fixed by writing it to the
    checkpoint folder: range bounds are sampled and a recomputation after an
    executor loss could otherwise move rows between the two passes.
    """
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ordered = cut_lineage(ordered.withColumn("_position", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_slice", F.shiftright("_position", _ROW_BITS))
    local = F.col("_position").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = ordered.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    return (
        ordered.join(_slice_offsets(sizes), "_slice")
        .withColumn(out, local + F.col("_offset") + 1)
        .drop("_position", "_slice", "_offset")
    )


def total_before(df: DataFrame, order_by: list[str], weight: str, out: str) -> DataFrame:
    """Sum of ``weight`` over all rows ordered before this one; ``order_by`` must be unique per row."""
    sliced = cut_lineage(df.repartitionByRange(*order_by).withColumn("_slice", F.spark_partition_id()))
    sizes = sliced.groupBy("_slice").agg(F.sum(weight).alias("_size"))
    inside = Window.partitionBy("_slice").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(_slice_offsets(sizes), "_slice")
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_slice", "_inside", "_offset")
    )


def percent_ranks(df: DataFrame, key: list[str], values: dict[str, Column]) -> DataFrame:
    """Average-tie rank over the non-null count for several values at once.

    Returns ``key`` plus one column per entry of ``values``, one row per input
    row; null values have no rank. Only one row per distinct (name, value) is
    ordered, so a value shared by many rows costs nothing extra. Ranks go back
    to the rows by an unhinted join per value, where the planner sees the
    size of the rank table and adaptive execution splits a hot value.
    """
    # Written once: the counts read it, and so does the join of every value.
    rows = cut_lineage(df.select(*key, *[v.cast("double").alias(f"_{n}") for n, v in values.items()]))
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_{n}").alias("value")) for n in values])
    counts = (
        rows.select(F.inline(entries)).filter("value IS NOT NULL").groupBy("name", "value").agg(F.count(F.lit(1)).alias("ties"))
    )
    placed = total_before(counts, ["name", "value"], "ties", "before_all")
    spans = placed.groupBy("name").agg(F.min("before_all").alias("first_before"), F.sum("ties").alias("total"))
    average = F.col("before_all") - F.col("first_before") + (F.col("ties") + 1) / 2
    ranks = cut_lineage(placed.join(F.broadcast(spans), "name").select("name", "value", (average / F.col("total")).alias("pct_rank")))
    for n in values:
        own = ranks.filter(F.col("name") == n).select(F.col("value").alias(f"_{n}"), F.col("pct_rank").alias(n))
        rows = rows.join(own, f"_{n}", "left")
    return rows.select(*key, *values)


def row_number_by_day(df: DataFrame, group: str, ts: str, tie: str, out: str) -> DataFrame:
    """Number rows per group by (timestamp, tie), nulls last, without one task per group.

    A group with a large share of all rows is cut at day borders: rows are
    numbered inside each (group, day) and shifted by the group's total of
    earlier days, which is one row per calendar day.
    """
    day = F.coalesce(F.to_date(ts), F.lit("9999-12-31").cast("date"))
    dated = df.withColumn("_day", day)
    per_day = dated.groupBy(group, "_day").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_day.select(group, "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    # Rows without a group get no number; their tie-breaker spreads them instead of one task sorting them all.
    apart = F.when(F.col(group).isNull(), F.xxhash64(tie))
    inside = Window.partitionBy(group, "_day", apart).orderBy(F.col(ts).asc_nulls_last(), F.col(tie))
    return (
        dated.withColumn("_rn", F.row_number().over(inside))
        .join(shifts, [group, "_day"], "left")
        .withColumn(out, F.when(F.col(group).isNotNull(), F.col("_rn") + F.col("_shift")))
        .drop("_day", "_rn", "_shift")
    )


def first_row_per_key(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """Keep the first row per key by an explicit order, nulls last, as a mergeable minimum instead of a window.

    Copies of a hot key collapse on the map side, so no task sees them all.
    """
    rest = [c for c in df.columns if c != key and c not in order_by]
    ordered = [x for c in order_by + rest for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))]
    first = df.groupBy(key).agg(F.min(F.struct(*ordered)).alias("_first"))
    return first.select(*[F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns])
