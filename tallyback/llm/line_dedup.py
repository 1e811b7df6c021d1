"""Removal of lines that many sites share, in DataFrame operations only.

A line's spread is the number of distinct sites it stands on. One HyperLogLog sketch of
sites per line hash, merged by aggregation, estimates it for all lines at once; a sketch is some tens of bytes for
a line of few sites and never grows beyond a few kilobytes, however often the line occurs. Lines well
above the threshold are boilerplate and lines well below are not; only those whose estimate lies near the
threshold get their sites counted exactly. Text never travels by line: what is shuffled is a
16-byte hash with its place, and the flags of each document go back to it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyback.llm.common import cut_lineage, release

LG_CONFIG = 11  # 2**11 registers: a relative standard error of about 2.3 %
MARGIN = 0.15  # estimates within this share of the threshold are counted exactly; over six standard errors


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """128-bit hash of a line without the blanks around it; null for a line of blanks only, which is never boilerplate."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) > 0, F.unhex(F.md5(bare.cast("binary"))))


def widespread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """Keys of lines on ``min_sites`` or more distinct sites. ``lines``: key, site; a null site is no site."""
    known = lines.filter("key IS NOT NULL AND site IS NOT NULL")
    sketched = cut_lineage(
        known.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg("site", F.lit(LG_CONFIG)).alias("sites"))
        .filter(F.col("rows") >= min_sites)  # fewer places than that can't be enough sites
        .select("key", F.hll_sketch_estimate("sites").alias("estimate"))
    )
    clear = sketched.filter(F.col("estimate") > min_sites * (1 + MARGIN)).select("key")
    near = sketched.filter(F.col("estimate").between(min_sites * (1 - MARGIN), min_sites * (1 + MARGIN))).select("key")
    exact = (
        known.join(near, "key").select("key", "site").distinct()
        .groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("key")
    )
    out = cut_lineage(clear.union(exact))
    release(sketched)
    return out


def remove_widespread_lines(
    docs: DataFrame, min_sites: int = 5, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source"
) -> DataFrame:
    """Drop every line that stands on ``min_sites`` or more distinct sites.

    Returns ``docs`` with its text changed and two columns added, n_lines and n_dropped. Lines are separated by line feeds
    and compared without the blanks around them; blank lines are never dropped. Where no line goes, the
    text stays as it is; where all go, it is empty. Null text stays null with no lines; rows of a null site count for
    no site but lose boilerplate like others. Rows are told apart by id and text, so rows repeated in full and
    null ids are treated alike; other columns pass through. An empty table gives an empty result. Columns n_lines and n_dropped of the input are replaced.
    """
    rest = docs.drop("n_lines", "n_dropped")
    text = F.col(f"`{text_col}`")
    row_key = F.unhex(F.md5(F.concat_ws("\n", F.col(f"`{id_col}`").cast("string"), text).cast("binary")))
    # The row's key and its lines are made once per row, before the lines are laid out.
    split = docs.filter(text.isNotNull()).select(
        row_key.alias("row"), F.col(f"`{site_col}`").cast("string").alias("site"), lines_of(text).alias("lines")
    )
    lines = split.select("row", "site", F.posexplode("lines").alias("pos", "line"))
    lines = lines.select("row", "site", "pos", line_key(F.col("line")).alias("key"))
    lines = cut_lineage(lines.filter("key IS NOT NULL"))
    common = widespread_lines(lines, min_sites)
    flagged = lines.join(common, "key").select("row", "pos").distinct()
    dropped = flagged.groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("gone"))
    # Lines kept between two dropped ones are slices, so the work on a text is linear in its lines.
    all_lines = lines_of(text)
    bounds = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size(all_lines)))
    gaps = F.arrays_zip(F.slice(bounds, 1, F.size(bounds) - 1).alias("a"), F.slice(bounds, 2, F.size(bounds) - 1).alias("b"))
    pieces = F.flatten(F.transform(gaps, lambda g: F.slice(F.col("_lines"), g["a"] + 2, g["b"] - g["a"] - 1)))
    joined = rest.withColumn("_row", row_key).join(dropped.withColumnRenamed("row", "_row"), "_row", "left")
    changed = joined.withColumn("_lines", all_lines).withColumn(
        "_text", F.when(F.col("gone").isNull(), text).otherwise(F.array_join(pieces, "\n"))
    )
    return changed.select(
        *[F.col("_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in rest.columns],
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
