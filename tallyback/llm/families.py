"""Families of windows that share an anchor: which of them can hold repeats, and what is settled without looking inside.

A family is a row (digit, whole, doc_id, at, n): ``n`` consecutive windows from ``at`` on, the hash of their
anchor and that of everything they cover. Equal windows always lie in families of one digit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyback.llm.common import cut_lineage, release

FAMILY = "doc_id long, at long, n int, digit long, whole long"


def shared_families(families: DataFrame) -> DataFrame:
    """Families whose digit occurs more than once. All others are unique and leave here.

    ``families`` is read twice, which costs less than keeping all of it: first only digits are
    counted, with map-side sums, then families are joined with the repeated digits.
    """
    repeated = cut_lineage(families.groupBy("digit").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("digit"))
    shared = cut_lineage(families.join(repeated, "digit"))
    release(repeated)
    return shared


def distinct_families(shared: DataFrame) -> DataFrame:
    """One row per different family: digit, whole, its first place (doc_id, at, n), copies, and kinds: different families of the digit."""
    firsts = cut_lineage(
        shared.groupBy("digit", "whole").agg(F.min(F.struct("doc_id", "at", "n")).alias("first"), F.count(F.lit(1)).alias("copies"))
    )
    # Written first: a join of two scans is one that adaptive execution can split at a hot digit.
    kinds = cut_lineage(firsts.groupBy("digit").agg(F.count(F.lit(1)).alias("kinds")))
    out = cut_lineage(firsts.join(kinds, "digit").select("digit", "whole", "first.doc_id", "first.at", "first.n", "copies", "kinds"))
    release(firsts, kinds)
    return out


def whole_groups(batches: Iterable[pa.RecordBatch], key: int = 0, rows: int = 20_000) -> Iterator[pa.Table]:
    """Regroup sorted batches so that equal values of column ``key`` are never apart."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))  # sorted input
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                count = table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held)


def runs_of(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single windows as runs of consecutive ones: doc_id, first, number."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1))) if len(doc) else np.zeros(0, np.int64)
    return doc[new], at[new], np.diff(np.append(new, len(doc))) if len(doc) else new


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal runs, in order; touching ranges become one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]
