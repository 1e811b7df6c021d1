"""Hard negatives by slot-decomposed selection.

An anchor's positives set upper limits on the score of their negatives. The limits, sorted, cut the score axis into disjoint
slots; every negative falls into one slot, a slot keeps its best k, and merging the slots from the lowest
limit upwards answers all windows, which overlap, without looking at a row twice.

Anchors travel in blocks and rows in chunks of bounded size; a task multiplies one block with one chunk and
only its best per anchor (and slot) leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyback.session import cut_lineage, release

CHUNK_ROWS = 2048  # rows of one packed chunk
BLOCK_ANCHORS = 2048  # anchors of one packed block
SHELF_CHUNKS = 32  # chunks that one copy of the blocks meets, where there are enough for all cores
SIDE_BY_SIDE = 256  # anchors whose scores are in memory at once
EXACT = 2.0**53  # whole numbers a double holds
NO_LIMIT = np.iinfo(np.int64).min


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """One row per id: (id, label, dim, v); rows without id or label, or with a null or non-finite component, take no part."""
    v = F.col("v")
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    ).filter(sound & finite)
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row"))
    return one.select("id", "row.label", F.size("row.v").alias("dim"), "row.v")


def _pack(rows: DataFrame, size: int, part: str, extra: list[str]) -> DataFrame:
    """Rows of one dimension packed into records of about ``size``; a record's number is ``part``."""
    total = rows.count()
    count = max(1, -(-total // size))
    dealt = rows.withColumn(part, F.pmod(F.xxhash64("id"), F.lit(count)))
    record = F.struct("id", "label", "v", *extra)
    return cut_lineage(dealt.groupBy("dim", part).agg(F.sort_array(F.collect_list(record)).alias("rows")).repartition(count, part))


def _tiles(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every chunk beside every block of its dimension.

    The copies of the blocks are many times the table that the planner knows, so the join is one by shuffle, never by broadcast: a
    task holds a shelf of chunks, and the blocks, a copy a shelf, stream past it.
    """
    n = max(1, chunks.count())
    shelves = min(n, max(2 * chunks.sparkSession.sparkContext.defaultParallelism, -(-n // SHELF_CHUNKS)))
    each = blocks.select("dim", F.col("rows").alias("anchors"), F.explode(F.sequence(F.lit(0), F.lit(shelves - 1).cast("int"))).alias("shelf"))
    left = chunks.withColumn("shelf", F.pmod("chunk", F.lit(shelves)).cast("int")).repartition(shelves, "shelf", "dim")
    return left.hint("shuffle_hash").join(each.repartition(shelves, "shelf", "dim"), ["shelf", "dim"]).select("rows", "anchors")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def _read(entry: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StructArray]:
    rows = entry.values
    return (
        rows.field("id").to_numpy(zero_copy_only=False), np.array(rows.field("label").to_pylist(), object), _matrix(rows.field("v"), len(rows)), rows
    )


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole inner products; where doubles could lose a unit, whole numbers without bound, cut off at 64 bits."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    limits = np.iinfo(np.int64)
    product = whole(a) @ whole(b).T
    return np.array([[min(max(x, limits.min + 1), limits.max) for x in row] for row in product], np.int64).reshape(product.shape)


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` highest allowed scores; equal scores: smaller columns first."""
    n, m = scores.shape
    k = min(k, m)
    kept = np.where(allowed, scores, NO_LIMIT)
    floor = np.partition(kept, m - k, axis=1)[:, m - k]
    row, column = np.nonzero(allowed & (kept >= floor[:, None]))  # ties at the floor are sorted out next
    order = np.lexsort((column, -kept[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _ranked(found: DataFrame, by: list[str], k: int, out: str) -> DataFrame:
    """The best ``k`` per group; the row limit is applied before the shuffle as well, so a group never meets whole."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= k)


def nearest_positives(anchors: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(anchor, id, score, place): the ``k`` other rows of the anchor's label with the highest scores."""
    blocks = _pack(anchors, BLOCK_ANCHORS, "block", [])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in range(batch.num_rows):
                ids, labels, v, _ = _read(batch.column(0)[tile])
                anchor_ids, anchor_labels, a, _ = _read(batch.column(1)[tile])
                for label in np.unique(anchor_labels.astype(str)):
                    own, mine = np.flatnonzero(labels == label), np.flatnonzero(anchor_labels == label)
                    for start in range(0, len(mine) if len(own) else 0, SIDE_BY_SIDE):
                        here = mine[start : start + SIDE_BY_SIDE]
                        scores = inner_products(a[here], v[own])
                        row, column = best(scores, anchor_ids[here][:, None] != ids[own][None, :], k)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(anchor_ids[here][row]), pa.array(ids[own][column]), pa.array(scores[row, column])], ["anchor", "id", "score"]
                        )

    found = _tiles(chunks, blocks).mapInArrow(compare, "anchor long, id long, score long")
    kept = cut_lineage(_ranked(found, ["anchor"], k, "place"))
    release(blocks)
    return kept


def slot_limits(positives: DataFrame, low: int, high: int) -> DataFrame:
    """Per positive its window [least, most] of negative scores; per anchor the distinct upper limits, highest first.

    ``low``, ``high``: percent of the positive's score. A positive whose window is empty sets no limit.
    """
    whole = F.col("score").cast("decimal(38,0)")
    windows = positives.select(
        F.col("anchor"), F.col("id").alias("positive"), F.col("score").alias("positive_score"),
        F.ceil(whole * low / 100).cast("long").alias("least"), F.floor(whole * high / 100).cast("long").alias("most"),
    ).filter("least <= most")
    per_anchor = windows.groupBy("anchor").agg(F.sort_array(F.collect_set("most"), asc=False).alias("limits"), F.min("least").alias("floor"))
    return windows.join(per_anchor, "anchor")


def slot_candidates(anchors: DataFrame, chunks: DataFrame, limits: DataFrame, k: int) -> DataFrame:
    """(anchor, slot, id, score): the best ``k`` rows of other labels in every slot. Slot s holds scores in (limit s+1, limit s]."""
    wanted = limits.groupBy(F.col("anchor").alias("id")).agg(F.first("limits").alias("limits"), F.first("floor").alias("floor"))
    blocks = _pack(anchors.join(wanted, "id"), BLOCK_ANCHORS, "block", ["limits", "floor"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in range(batch.num_rows):
                ids, labels, v, _ = _read(batch.column(0)[tile])
                anchor_ids, anchor_labels, a, rows = _read(batch.column(1)[tile])
                tops, floors = rows.field("limits").to_pylist(), rows.field("floor").to_numpy(zero_copy_only=False)
                width = max(map(len, tops))
                # Below the last limit comes the lowest score that any window takes.
                steps = np.array([t + [f - 1] * (width + 1 - len(t)) for t, f in zip(tops, floors)], np.int64)
                for start in range(0, len(a), SIDE_BY_SIDE):
                    here = slice(start, start + SIDE_BY_SIDE)
                    scores = inner_products(a[here], v)
                    other = anchor_labels[here][:, None] != labels[None, :]
                    for slot in range(width):
                        inside = other & (scores <= steps[here, slot, None]) & (scores > steps[here, slot + 1, None])
                        row, column = best(scores, inside, k)
                        if len(row):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(anchor_ids[here][row]), pa.array(np.full(len(row), slot, np.int32)), pa.array(ids[column]),
                                 pa.array(scores[row, column])],
                                ["anchor", "slot", "id", "score"],
                            )

    found = _tiles(chunks, blocks).mapInArrow(compare, "anchor long, slot int, id long, score long")
    kept = cut_lineage(_ranked(found, ["anchor", "slot"], k, "place"))
    release(blocks)
    return kept


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    label: Column | None = None,
    scale: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """For every anchor and each of its positives the hardest negatives inside the positive's score window.

    ``is_anchor`` is a condition on ``id``. ``label`` (default: column label) gives the class; ``scale`` is a whole-numbered array
    expression over ``v`` (default: floor(256 x)). The score of two rows is their whole inner product; higher comes first, ties by smaller id.
    Positives are the first ``positives`` other rows of the anchor's label; a negative is a row of another
    label with low * positive_score <= 100 * score <= high * positive_score. Rows: anchor_id, positive_id,
    rank (from 1), negative_id, positive_score, negative_score; a positive without negatives has no row.

    Rows with a null id or label, a null or empty vector, or a null or non-finite component take no part. Rows that share an id count as one, the
    smallest by (label as text, vector); vectors of unlike lengths have no score; other columns are not read; an empty
    table gives an empty result. Scores beyond 64 bits count as the largest such number.
    """
    label = F.col("label") if label is None else label
    scale = F.transform("v", lambda x: F.floor(256 * x).cast("double")) if scale is None else scale
    rows = cut_lineage(usable_rows(vectors, id_col, vector_col, label).withColumn("v", scale))
    chunks = _pack(rows, CHUNK_ROWS, "chunk", [])
    anchors = rows.filter(is_anchor)
    near = nearest_positives(anchors, chunks, positives)
    windows = cut_lineage(slot_limits(near, low, high))
    slots = slot_candidates(anchors, chunks, windows, negatives)
    # Lists of the slots, highest limit first; at most positives x negatives entries per anchor.
    lists = slots.groupBy("anchor").agg(F.collect_list(F.struct("slot", "place", "id", "score")).alias("kept"))
    inside = F.filter("kept", lambda x: x["slot"] >= F.col("first"))
    # Suffix merge: slots are disjoint and ordered, so the slots from a window's own limit down, in order, are its candidates in order.
    merged = F.slice(F.sort_array(inside), 1, negatives)
    answered = (
        windows.withColumn("first", F.array_position("limits", F.col("most")).cast("int") - 1)
        .join(lists, "anchor")
        .withColumn("answer", F.filter(merged, lambda x: x["score"] >= F.col("least")))
    )
    return answered.select("anchor", "positive", "positive_score", F.posexplode("answer").alias("at", "hit")).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.id").alias("negative_id"), "positive_score", F.col("hit.score").alias("negative_score"),
    )
