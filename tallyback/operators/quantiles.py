"""Exact quantiles: a sketch finds the neighbourhood, counts inside it the value; never a sorted group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyback.operators.sizing import settle
from tallyback.session import release

DIGIT = 16  # bits decided by one pass
FEW = 1 << DIGIT  # rows that one last pass may order by their whole value
ACCURACY = 10_000  # of the sketch: its ranks are off by a ten-thousandth of the rows at most
_LOW_BITS = (1 << 63) - 1


def _turned(bits: Column) -> Column:
    """Bits of a double as a long that sorts as the double does: those below the sign turned over in negative numbers, and back."""
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(_LOW_BITS))).otherwise(bits)


def with_ordered_bits(df: DataFrame, value: str, out: str) -> DataFrame:
    """``value`` replaced by its ordered image; -0.0 counts as 0.0."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col(value) + F.lit(0.0)).cast("long")
    return df.withColumn("_bits", bits).withColumn(out, _turned(F.col("_bits"))).drop("_bits", value)


def from_ordered_bits(image: Column) -> Column:
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), _turned(image)).cast("double")


def _narrow(counts: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Per wanted rank the bucket (``_key``) that holds it, the rank inside that bucket, and the bucket's rows.

    The window runs over the buckets of one prefix, at most ``FEW`` of them.
    """
    upto = Window.partitionBy(*by, "_prefix").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
    here = (F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_end"))
    return placed.join(wanted, [*by, "_prefix"]).filter(here).select(
        *by, "_which", "_share", F.col("_key").alias("_prefix"), (F.col("_rank") - F.col("_start")).alias("_rank"), F.col("_c").alias("_size")
    )


def exact_quantile(df: DataFrame, value: Column, q: float, by: list[str], out: str, written: bool = False) -> DataFrame:
    """Exact quantile per group with linear interpolation, nulls and NaN left out.

    A sketch per group gives two values with the wanted ranks between them; one more pass counts the values below and
    those between by value, which are some hundred-thousandths of the rows and their ties. Where a rank is not between them, or
    a group is so large that many values may be, the search goes by the values' bits. Groups with a null key are left out.
    ``written`` says that ``df`` is cheap to read twice; else its values are written first.
    """
    data = df.select(*by, (value.cast("double") + F.lit(0.0)).alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)").dropna(subset=by)
    if not written:
        data = settle(data)
    found = _between_marks(data, q, by)
    if found is None:
        found = _by_bits(data, q, by)
    if not written:
        release(data)
    return found.select(*by, (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_share")).alias(out))


def _between_marks(data: DataFrame, q: float, by: list[str]) -> DataFrame | None:
    """Per group the two values around the quantile and the share between them, or nothing if a sketch does not settle it."""
    marks = F.percentile_approx("_v", [max(0.0, q - 2 / ACCURACY), min(1.0, q + 2 / ACCURACY)], ACCURACY)
    bounds = settle(data.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), marks.alias("_marks")))
    if (bounds.agg(F.max("_n")).first()[0] or 0) * 6 > FEW * ACCURACY:
        release(bounds)
        return None
    low, high = F.col("_marks")[0], F.col("_marks")[1]
    near = data.join(bounds, by).filter(F.col("_v") <= high).select(*by, "_n", F.when(F.col("_v") >= low, F.col("_v")).alias("_v"))
    counts = near.groupBy(*by, "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = F.lit(q) * (F.col("_n") - 1)
    placed = counts.withColumns({"_end": F.sum("_c").over(upto), "_position": position}).withColumn("_start", F.col("_end") - F.col("_c"))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    share = F.first(F.col("_position") - F.floor("_position"))
    found = settle(placed.groupBy(*by).agg(value_at(F.floor("_position")).alias("_v0"), value_at(F.ceil("_position")).alias("_v1"), share.alias("_share")))
    settled = found.agg(F.count_if(F.col("_v0").isNotNull() & F.col("_v1").isNotNull())).first()[0] == bounds.count()
    release(bounds)
    return found if settled else None


def _by_bits(values: DataFrame, q: float, by: list[str]) -> DataFrame:
    """The same by radix selection.

    Every pass counts the values by the next 16 bits of their ordered image, inside the buckets that hold a wanted rank, with
    map-side partial counts; what is left after a pass is one bucket per group and rank. As soon as all these buckets
    are small, one pass over their whole values ends the search: two passes on most tables, four on any. No task
    sees more than ``FEW`` buckets of a group.
    """
    data = settle(with_ordered_bits(values, "_v", "_image"))
    shift = 64 - DIGIT
    first = data.groupBy(*by, F.shiftright("_image", shift).alias("_key")).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = F.lit(q) * (F.sum("_c").over(whole) - 1)
    placed = first.withColumns({"_end": F.sum("_c").over(upto), "_position": position}).withColumn("_start", F.col("_end") - F.col("_c"))
    ends = [
        F.struct(F.lit(i).alias("_which"), (F.col("_position") - F.floor("_position")).alias("_share"), end("_position").alias("_rank"))
        for i, end in enumerate((F.floor, F.ceil))
    ]
    here = (F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_end"))
    state = settle(
        placed.select("*", F.inline(F.array(*ends))).filter(here).select(
            *by, "_which", "_share", F.col("_key").alias("_prefix"), (F.col("_rank") - F.col("_start")).alias("_rank"), F.col("_c").alias("_size")
        )
    )
    while shift:
        most = state.agg(F.max("_size")).first()[0] or 0
        after = 0 if most <= FEW else shift - DIGIT
        inside = data.withColumn("_prefix", F.shiftright("_image", shift)).join(state.select(*by, "_prefix").distinct(), [*by, "_prefix"])
        counts = inside.groupBy(*by, "_prefix", F.shiftright("_image", after).alias("_key")).agg(F.count(F.lit(1)).alias("_c"))
        narrowed = settle(_narrow(counts, state, by))
        release(state)
        state, shift = narrowed, after
    release(data)
    images = [F.max(F.when(F.col("_which") == i, F.col("_prefix"))).alias(f"_image{i}") for i in (0, 1)]
    ends = state.groupBy(*by).agg(*images, F.first("_share").alias("_share")).withColumns({f"_v{i}": from_ordered_bits(F.col(f"_image{i}")) for i in (0, 1)})
    return ends.select(*by, "_v0", "_v1", "_share")


def exact_quantile_of_table(df: DataFrame, value: Column, q: float, out: str) -> DataFrame:
    """One-row frame with the exact quantile over the whole table, null where it has no values."""
    one_group = df.select(F.lit(1).alias("_all"), value.alias("_value"))
    found = exact_quantile(one_group, F.col("_value"), q, ["_all"], out)
    return found.agg(F.max(out).alias(out))
