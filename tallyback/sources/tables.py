"""Reading, checking and writing tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyback.functions import columns as C
from tallyback.session import cut_lineage
from tallyback.sources.schemas import (
    NUMERIC_COLUMNS,
    PRIMARY_KEYS,
    REQUIRED_FIELDS,
    TABLE_COLUMNS,
    TIMESTAMP_COLUMNS,
    text_schema,
)

Tables = Mapping[str, DataFrame]
CORRUPT = "_unreadable_line"
BUCKETS = 1 << 16  # of digests, whose sums are compared before rows are


def read_csv_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Read one header CSV as text. Columns are matched to the file's own header, never guessed."""
    header = spark.read.option("header", True).csv(path).limit(0).columns
    raw = spark.read.schema(text_schema(header)).option("header", True).csv(path)
    require_columns({name: raw})
    return raw.select(*[C.null_tokens_to_null(F.col(c)).alias(c) for c in raw.columns])


def scan_csv_table(spark: SparkSession, name: str, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """A headed CSV as text rows, and the lines that don't have one value per column, as they stand.

    One permissive read: a line that doesn't fit is kept whole in a column of its own instead of ending the job or losing its tail.
    """
    schema = text_schema([*columns, CORRUPT])
    lines = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).csv(path)
    require_columns({name: lines})
    read = cut_lineage(lines)  # parsed once; both results are read from the table
    good = read.filter(F.col(CORRUPT).isNull()).select(*[C.null_tokens_to_null(F.col(c)).alias(c) for c in columns])
    return good, read.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))


def unlike_rows(a: DataFrame, b: DataFrame) -> int:
    """Rows that one table has more often than the other, both ways together; nulls are equal, columns go by position.

    Rows are first told apart by sums of 128-bit digests per bucket of digests. Only rows of the buckets whose sums differ are compared themselves.
    """
    marks = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in a.columns]
    low = F.lit(0xFFFFFFFF)

    def dealt(df: DataFrame) -> DataFrame:
        digests = df.toDF(*a.columns).withColumns({"_h1": F.xxhash64(F.lit(1), *marks), "_h2": F.xxhash64(F.lit(2), *marks)})
        return digests.withColumn("_bucket", F.pmod("_h1", F.lit(BUCKETS)))

    def sums(df: DataFrame, sign: int) -> DataFrame:
        halves = [half for h in ("_h1", "_h2") for half in (F.col(h).bitwiseAND(low), F.shiftrightunsigned(h, 32))]
        return df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("s0"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(halves, 1)]).select(
            "_bucket", *[(F.col(f"s{i}") * sign).alias(f"s{i}") for i in range(5)]
        )

    left, right = dealt(a), dealt(b)
    total = sums(left, 1).union(sums(right, -1)).groupBy("_bucket").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(5)])
    differ = cut_lineage(total.filter(" OR ".join(f"s{i} != 0" for i in range(5))).select("_bucket"))
    if differ.isEmpty():
        return 0
    left, right = (df.join(differ, "_bucket", "left_semi").select(*a.columns) for df in (left, right))
    return left.exceptAll(right).count() + right.exceptAll(left).count()


def read_csv_tables(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    return {name: read_csv_table(spark, name, path) for name, path in paths.items()}


def require_columns(frames: Tables) -> None:
    """Raise when a table lacks a column of its contract."""
    for name, df in frames.items():
        missing = [c for c in TABLE_COLUMNS[name] if c not in df.columns]
        if missing:
            raise ValueError(f"{name} lacks required columns {missing}; it has {df.columns}")


def contract_report(frames: Tables) -> DataFrame:
    """One row per (table, required column): is it there, and how many rows does the table hold."""
    parts = []
    for name in sorted(frames):
        df = frames[name]
        entries = F.array(
            *[F.struct(F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("present")) for c in TABLE_COLUMNS[name]]
        )
        parts.append(
            df.agg(F.count(F.lit(1)).alias("table_rows")).select(
                F.lit(name).alias("table_name"), "table_rows", F.inline(entries)
            )
        )
    return union_all(parts)


def clean_tables(frames: Tables, timestamp_formats: Mapping[str, str]) -> dict[str, DataFrame]:
    """Typed tables from text tables: ids and labels trimmed, numbers and dates parsed.

    ``timestamp_formats`` maps a column name such as ``order_date`` to its one format.
    """
    cleaned = {}
    for name, df in frames.items():
        numeric = NUMERIC_COLUMNS.get(name, [])
        stamps = TIMESTAMP_COLUMNS.get(name, [])
        out = []
        for c in df.columns:
            if c in numeric:
                out.append(C.clean_numeric(F.col(c)).alias(c))
            elif c in stamps:
                out.append(C.clean_timestamp(F.trim(F.col(c)), timestamp_formats[c]).alias(c))
            else:
                out.append(F.trim(F.col(c)).alias(c))
        cleaned[name] = df.select(*out)
    return cleaned


def drop_exact_duplicates(frames: Tables) -> dict[str, DataFrame]:
    return {name: df.dropDuplicates() for name, df in frames.items()}


def keep_usable_rows(frames: Tables) -> dict[str, DataFrame]:
    """Drop rows that lack a field their table cannot do without."""
    return {name: df.dropna(subset=REQUIRED_FIELDS[name]) for name, df in frames.items()}


def duplicate_keys(df: DataFrame, keys: str | list[str]) -> DataFrame:
    """Key values that occur more than once, with their row counts."""
    keys = [keys] if isinstance(keys, str) else keys
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_with_key")).filter("rows_with_key > 1")


def require_unique(df: DataFrame, keys: str | list[str], label: str = "table") -> None:
    """Raise when a key repeats; runs one aggregate and stops at the first repeat."""
    if duplicate_keys(df, keys).limit(1).take(1):
        raise ValueError(f"{keys} repeats in {label}; a join on it would multiply rows")


def require_unique_keys(frames: Tables) -> None:
    for name, df in frames.items():
        require_unique(df, PRIMARY_KEYS[name], name)


def require_values(df: DataFrame, columns: list[str], label: str = "result") -> None:
    """Raise when a result has no non-null value in any of ``columns``."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    if not any(counts):
        raise ValueError(f"{label} is empty or holds only nulls in {columns}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write a result table; ``fmt`` is ``parquet``, ``csv`` (with header) or ``json``."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_tables(results: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    for name, df in results.items():
        write_table(df, f"{folder}/{name}", fmt)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
