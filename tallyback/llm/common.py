"""Spark helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyback.session import cut_lineage, release

# Rows of a text table that go to Python at once; whole texts may be long.
ROWS_PER_BATCH = "2000"


def small_batches(df: DataFrame) -> DataFrame:
    """Send texts to Python in batches of a bounded number of rows and bytes (the smaller bound holds)."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Apply ``step`` to every Arrow batch of ``df``; each batch is handled on its own."""

    def run(batches):
        for batch in batches:
            yield from step(batch)

    return small_batches(df).mapInArrow(run, schema)


def document_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that other columns can't clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def one_row_per_id(texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """What a search over documents reads of ``texts`` (doc_id, text): one row per id that is not null.

    A row repeated in full is one document; of rows that share only their id the smallest text is searched. The second table holds
    (doc_id, text) of the ids that stand in several rows, None if there are none; ``with_spans`` needs it.
    """
    known = texts.filter("doc_id IS NOT NULL")
    several = cut_lineage(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    if several.isEmpty():
        release(several)
        return known, None
    chosen = cut_lineage(known.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    return known.join(several, "doc_id", "left_anti").union(chosen), chosen


def with_spans(texts: DataFrame, per_doc: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """Every row of ``texts`` with its ``spans``; of an id that stands in several rows, those whose text was searched."""
    joined = texts.join(per_doc, "doc_id", "left")
    if chosen is None:
        return joined
    searched = chosen.select("doc_id", F.col("text").alias("searched"))
    own = F.col("searched").isNull() | F.col("text").eqNullSafe(F.col("searched"))
    return joined.join(searched, "doc_id", "left").select("doc_id", "text", F.when(own, F.col("spans")).alias("spans"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): one row (id, component) per id in an edge, component the smallest id.

    Alternates two star contractions, each a minimum per vertex and a join on the vertex,
    until no edge changes; a vertex with very many edges is a hot key of an aggregate
    with map-side minima and of a join that adaptive execution splits. Rows never
    exceed a few times the edges. No edge: no row; loops and repeats are ignored.
    """
    current = cut_lineage(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _edge_state(current)
    while state[0]:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut_lineage(
            both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )  # every larger neighbour hangs on the smallest one
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        pulled = cut_lineage(
            small.select("a", F.col("m").alias("b"))
            .union(small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        after = _edge_state(pulled)
        release(current, large)
        current = pulled
        if after == state:
            break
        state = after
    roots = current.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return roots.union(current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()).groupBy("id").agg(
        F.min("component").alias("component")
    )


def _edge_state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0))).first()
    return int(row[0]), int(row[1])
