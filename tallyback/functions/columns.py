"""Column expressions shared by all jobs. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text cells a CSV reader takes as "no value".
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Plain decimal or exponent notation. Java's own parser also takes "1.0d", "0x1p3" and "NaN".
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

MISSING = "Missing"
SECONDS_PER_DAY = 86400


def null_tokens_to_null(text: Column) -> Column:
    return F.when(~text.isin(NULL_TOKENS), text)


def clean_numeric(text: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))


def clean_timestamp(text: Column, fmt: str) -> Column:
    """Text in exactly one format to a timestamp without zone; other formats become null."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def clean_label(text: Column) -> Column:
    """Trim; null or blank becomes the label ``Missing``."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(MISSING))


def log1p_floor_zero(value: Column) -> Column:
    """``log1p`` of the value with negatives taken as zero; null stays null."""
    return F.when(value.isNotNull(), F.log1p(F.greatest(value, F.lit(0.0))))


def returned_flag(status: Column) -> Column:
    """1 when the status is exactly ``returned``, else 0 (null counts as 0)."""
    return status.eqNullSafe("returned").cast("int")


def status_is(status: Column, wanted: str) -> Column:
    """Case-insensitive status flag, 0 for null."""
    return F.coalesce((F.lower(status) == wanted).cast("int"), F.lit(0))


def return_label(flag: Column) -> Column:
    return F.when(flag == 1, "Returned").otherwise("Not returned")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds between two zone-less timestamps, microseconds kept."""
    return (later - earlier).cast("interval second").cast("decimal(20,6)").cast("double")


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed days with their fraction; negative when ``later`` is the earlier one."""
    return seconds_between(later, earlier) / F.lit(float(SECONDS_PER_DAY))


def whole_days_clipped(later: Column, earlier: Column) -> Column:
    """Full elapsed days (rounded down), never below zero."""
    days = F.floor(days_between(later, earlier))
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0)))


def month_start(ts: Column) -> Column:
    return F.date_trunc("month", ts).cast("timestamp_ntz")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null for a zero or null denominator."""
    return F.try_divide(numerator, F.nullif(denominator, F.lit(0)))


def finite_or(value: Column, fallback: Column) -> Column:
    """Replace null, NaN and infinities by ``fallback``."""
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(usable, value).otherwise(fallback)
