"""Data-quality profiles of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyback.sources.schemas import NUMERIC_COLUMNS, PRIMARY_KEYS, TIMESTAMP_COLUMNS
from tallyback.sources.tables import Tables, union_all


def _distinct_row_counts(df: DataFrame) -> DataFrame:
    """How often each distinct row occurs; copies collapse on the map side."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))


def _repeated_key_stats(rows: DataFrame, key: str, weight: Column) -> DataFrame:
    per_key = rows.groupBy(key).agg(F.sum(weight).alias("_n"))
    extra = F.when(F.col("_n") > 1, F.col("_n") - 1).otherwise(0)
    return per_key.agg(
        F.coalesce(F.sum(extra), F.lit(0)).alias("extra_rows"),
        F.count_if((F.col("_n") > 1) & F.col(key).isNotNull()).alias("repeated_values"),
    )


def source_audit(frames: Tables) -> DataFrame:
    """Rows, exact duplicates, rows after removing them and key repeats that remain, per table."""
    parts = []
    for name in sorted(frames):
        key = PRIMARY_KEYS[name]
        per_key = _distinct_row_counts(frames[name]).groupBy(key).agg(
            F.count(F.lit(1)).alias("_distinct"), F.sum("_copies").alias("_rows")
        )
        parts.append(
            per_key.agg(
                F.coalesce(F.sum("_rows"), F.lit(0)).alias("source_rows"),
                F.coalesce(F.sum(F.col("_rows") - F.col("_distinct")), F.lit(0)).alias("exact_duplicate_rows"),
                F.coalesce(F.sum("_distinct"), F.lit(0)).alias("rows_after_exact_dedup"),
                F.coalesce(F.sum(F.col("_distinct") - 1), F.lit(0)).alias("duplicate_keys_after_dedup"),
            ).select(F.lit(name).alias("table_name"), "*")
        )
    return union_all(parts)


def file_quality(frames: Tables) -> DataFrame:
    """Null cells, rows with a null, duplicate rows, null keys and repeated keys per table."""
    parts = []
    for name in sorted(frames):
        df, key = frames[name], PRIMARY_KEYS[name]
        nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
        copies = F.col("_copies")
        distinct = _distinct_row_counts(df).withColumn("_nulls", nulls)
        per_key = distinct.groupBy(key).agg(
            F.sum(copies).alias("_rows"),
            F.count(F.lit(1)).alias("_distinct"),
            F.sum(F.col("_nulls") * copies).alias("_null_cells"),
            F.sum(F.when(F.col("_nulls") > 0, copies).otherwise(0)).alias("_null_rows"),
        )
        zero = F.lit(0)
        parts.append(
            per_key.agg(
                F.coalesce(F.sum("_rows"), zero).alias("table_rows"),
                F.coalesce(F.sum("_null_cells"), zero).alias("null_cells"),
                F.coalesce(F.sum("_null_rows"), zero).alias("rows_with_any_null"),
                F.coalesce(F.sum(F.col("_rows") - F.col("_distinct")), zero).alias("exact_duplicate_extra_rows"),
                F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_rows"))), zero).alias("key_null_rows"),
                F.coalesce(F.sum(F.col("_rows") - 1), zero).alias("repeated_key_extra_rows"),
                F.count_if((F.col("_rows") > 1) & F.col(key).isNotNull()).alias("repeated_key_values"),
            ).select(
                F.lit(name).alias("table_name"),
                F.lit(len(df.columns)).alias("table_columns"),
                F.lit(key).alias("key_column"),
                "*",
            )
        )
    return union_all(parts)


def column_nulls(frames: Tables) -> DataFrame:
    """Null count, percentage and blank text cells of every column, one aggregate per table."""
    parts = []
    for name in sorted(frames):
        df = frames[name]
        measures, entries = [F.count(F.lit(1)).alias("_n")], []
        text = {c for c, kind in df.dtypes if kind == "string"}
        for i, c in enumerate(df.columns):
            blank = F.count_if(F.trim(F.col(c)) == "") if c in text else F.lit(0).cast("bigint")
            measures += [F.count_if(F.col(c).isNull()).alias(f"_null{i}"), blank.alias(f"_blank{i}")]
            entries.append(
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.col(f"_null{i}").alias("null_count"),
                    F.try_divide(F.col(f"_null{i}") * 100.0, F.col("_n")).alias("null_pct"),
                    F.col(f"_blank{i}").alias("blank_count"),
                )
            )
        parts.append(df.agg(*measures).select(F.lit(name).alias("table_name"), F.inline(F.array(*entries))))
    return union_all(parts)


def coercion_audit(cleaned: Tables) -> DataFrame:
    """Per parsed column: how many cells hold no usable number or date after cleaning."""
    parts = []
    for name in sorted(cleaned):
        parsed = NUMERIC_COLUMNS.get(name, []) + TIMESTAMP_COLUMNS.get(name, [])
        entries = F.array(
            *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("unusable_cells")) for c in parsed]
        )
        parts.append(
            cleaned[name]
            .agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in parsed])
            .select(F.lit(name).alias("table_name"), F.inline(entries))
        )
    return union_all(parts)


def value_frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("frequency"))


def non_null_counts(results: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows and usable values per result, to spot an empty or all-null result before it is published."""
    parts = []
    for name in sorted(results):
        df, columns = results[name]
        usable = sum((F.count(c) for c in columns[1:]), F.count(columns[0]))
        parts.append(
            df.agg(F.count(F.lit(1)).alias("result_rows"), usable.alias("usable_values")).select(
                F.lit(name).alias("result"), "result_rows", "usable_values", (F.col("usable_values") > 0).alias("publishable")
            )
        )
    return union_all(parts)
