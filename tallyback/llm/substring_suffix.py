"""Removal of repeated byte strings by a depth-limited radix order of suffixes.

A suffix is ordered only through ``length`` bytes, most significant digit first; suffixes
that are equal through that depth are exactly the repeated windows. Three passes:

1. The leading digit. Suffixes are taken in families: consecutive suffixes whose first
   ``length`` bytes hold the same anchor, the leftmost ``gram``-byte gram with the
   smallest hash. Equal windows have equal anchors at the same place, so the anchor is
   a digit that all of a family share, and one short row per family (some 30 bytes of
   text) is shuffled instead of one per byte. A family alone with its digit is unique and leaves.
2. The rest of the family's bytes as one digit. Families equal in it are equal in all their
   suffixes: the first one represents them, all others are repeats of it.
3. Digits with several different families. Their bytes travel once to the digit's task, where the suffixes are radix
   sorted, eight bytes a pass, and leave as soon as they stand alone. The few digits with more than
   ``crowd`` different families are not gathered: their suffixes go on one by one under a
   128-bit digit of full depth, in an aggregate with map-side minima.

Passes 1 and 2 are aggregates with map-side combination and joins on the digit, which adaptive
execution splits where a digit is frequent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyback.llm.common import arrow_map, cut_lineage, document_texts, one_row_per_id, release, with_spans
from tallyback.llm.families import FAMILY, distinct_families, merged, runs_of, shared_families, whole_groups
from tallyback.llm.text import U64, Rolling, byte_values, chunks, concat_ranges, signed, texts_of, window_families

GRAM = 40  # bytes of an anchor; shorter anchors meet by chance, longer ones make more families
CROWD = 1024  # different families of one digit that are sorted in one task, some 150 KB of bytes

_PACKED = "crowded boolean, k1 long, k2 long, doc_id long, at long, n int, bytes binary"


def _families(length: int, gram: int):
    def step(batch: pa.RecordBatch):
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1))
        for row0, row1, data, bounds in chunks(texts):
            row, begin, count, digit, whole = window_families(Rolling(byte_values(data)), bounds, length, gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row0:row1][row]), pa.array((begin - bounds[row]).astype(np.int64)),
                 pa.array(count.astype(np.int32)), pa.array(signed(digit)), pa.array(signed(whole))],
                ["doc_id", "at", "n", "digit", "whole"],
            )

    return step


def _pack(length: int):
    """Bytes of the marked families; those of crowded digits as one row per suffix with its digit of full depth."""

    def rows(crowded, k1, k2, doc, at, n, packed):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(doc), crowded)), pa.array(k1), pa.array(k2), pa.array(doc), pa.array(at),
             pa.array(n.astype(np.int32)), packed],
            ["crowded", "k1", "k2", "doc_id", "at", "n", "bytes"],
        )

    def step(batch: pa.RecordBatch):
        ids, texts, marks = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1)), batch.column(2)
        inner = marks.flatten()
        digit, at, n, crowd = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        at, n = at.astype(np.int64), n.astype(np.int64)
        cut = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(marks.value_lengths().to_numpy(zero_copy_only=False), out=cut[1:])
        for row0, row1, data, bounds in chunks(texts):
            own = np.arange(cut[row0], cut[row1])
            row = np.repeat(np.arange(row1 - row0), np.diff(cut[row0 : row1 + 1]))
            for crowded in (False, True):
                mine = crowd[own] == crowded
                f, r = own[mine], row[mine]
                if len(f) == 0:
                    continue
                if not crowded:
                    size = n[f] - 1 + length
                    taken = data[concat_ranges(at[f] + bounds[r], size)]
                    offsets = np.zeros(len(f) + 1, np.int32)
                    np.cumsum(size, out=offsets[1:])
                    packed = pa.BinaryArray.from_buffers(pa.binary(), len(f), [None, pa.py_buffer(offsets), pa.py_buffer(taken)])
                    yield rows(False, digit[f], np.zeros(len(f), np.int64), ids[row0:row1][r], at[f], n[f], packed)
                else:
                    pos, r = concat_ranges(at[f], n[f]), np.repeat(r, n[f])
                    start = pos + bounds[r]
                    k1, k2 = (signed(Rolling(byte_values(data, w), w).ranges(start, start + length)) for w in (0, 1))
                    yield rows(True, k1, k2, ids[row0:row1][r], pos, np.ones(len(pos)), pa.nulls(len(pos), pa.binary()))

    return step


def equal_suffixes(group: np.ndarray, data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Radix sort of suffixes within groups, through ``length`` bytes, most significant eight first.

    Returns the suffixes (as positions in ``start``) that equal another of their group, and for each the number
    of its equal group. A suffix that stands alone after a pass takes no part in the next.
    """
    index = np.arange(len(start))
    padded = np.append(data, np.zeros(8, np.uint8)).astype(U64)
    digits = np.zeros(len(data) + 1, U64)
    for i in range(8):
        digits |= padded[i : i + len(digits)] << U64(56 - 8 * i)
    for depth in range(0, length, 8):
        digit = digits[start[index] + depth]
        if length - depth < 8:
            digit = digit >> U64(8 * (8 - length + depth))
        order = np.lexsort((digit, group))
        digit, group, index = digit[order], group[order], index[order]
        new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])) if len(index) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        several = np.bincount(group, minlength=1)[group] > 1
        group, index = group[several], index[several]
    return index, group


def _sort_bucket(length: int):
    def run(batches):
        for table in whole_groups(batches):
            table = table.combine_chunks()
            digit, doc, at, n = (table.column(i).to_numpy() for i in range(4))
            packed = table.column(4).combine_chunks()
            offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
            data = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            family = np.repeat(np.arange(len(digit)), n)
            start = concat_ranges(offsets[:-1] - offsets[0], n.astype(np.int64))
            place = concat_ranges(at, n.astype(np.int64))
            groups = np.cumsum(np.append(True, digit[1:] != digit[:-1])) - 1
            index, equal = equal_suffixes(groups[family], data, start, length)
            owner, place = doc[family[index]], place[index]
            order = np.lexsort((place, owner, equal))
            later = order[1:][equal[order][1:] == equal[order][:-1]]  # all of an equal group but the earliest
            d, a, c = runs_of(owner[later], place[later])
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(c.astype(np.int32))], ["doc_id", "at", "n"])

    return run


def repeated_byte_runs(docs: DataFrame, length: int = 100, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Byte ranges (doc_id, start, end) covered by a ``length``-byte string that also starts earlier.

    Earlier: in a row with a smaller doc_id, or at a smaller start of the same one. Ranges of one
    document may overlap. Expects the columns doc_id (unique, not null) and text; see ``remove_repeated_bytes``.
    """
    gram = min(gram, length)
    shared = shared_families(arrow_map(docs, _families(length, gram), FAMILY))
    firsts = distinct_families(shared)
    first = firsts.filter("copies > 1").select("digit", "whole", F.struct("doc_id", "at").alias("first"))
    copies = shared.join(first, ["digit", "whole"]).filter(F.struct("doc_id", "at") != F.col("first")).select("doc_id", "at", "n")

    unlike = firsts.filter("kinds > 1").groupBy("doc_id").agg(
        F.collect_list(F.struct("digit", "at", "n", (F.col("kinds") > crowd).alias("crowded"))).alias("marks")
    )
    packed = cut_lineage(arrow_map(docs.join(unlike, "doc_id").select("doc_id", "text", "marks"), _pack(length), _PACKED))
    sorted_here = (
        packed.filter("NOT crowded").select(F.col("k1").alias("digit"), "doc_id", "at", "n", "bytes")
        .repartition("digit").sortWithinPartitions("digit").mapInArrow(_sort_bucket(length), "doc_id long, at long, n int")
    )
    single = packed.filter("crowded").select("k1", "k2", "doc_id", "at", "n")
    place = F.struct("doc_id", "at")
    equal = single.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("size"), F.min(place).alias("first")).filter("size > 1")
    later = single.join(equal, ["k1", "k2"]).filter(place != F.col("first")).select("doc_id", "at", "n")
    parts = [cut_lineage(part) for part in (copies, sorted_here, later)]
    release(shared, firsts, packed)
    runs = parts[0].union(parts[1]).union(parts[2])
    return runs.select("doc_id", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + length).alias("end"))


def _cut(batch: pa.RecordBatch):
    ids, texts = batch.column(0), texts_of(batch.column(1))
    spans = batch.column(2)
    out = {"n_bytes": [], "n_removed": [], "removed": [], "kept": []}
    for text, own in zip(texts, spans):
        data = text.as_buffer().to_pybytes()
        own = own.as_py()
        if own:
            start, end = merged(np.array([s["start"] for s in own]), np.array([s["end"] for s in own]))
            pieces, at = [], 0
            for s, e in zip(start.tolist(), end.tolist()):
                pieces.append(data[at:s])
                at = e
            kept = b"".join([*pieces, data[at:]])
        else:
            start = end = np.zeros(0, np.int64)
            kept = data
        out["n_bytes"].append(len(data))
        out["n_removed"].append(len(data) - len(kept))
        out["removed"].append([{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist())])
        out["kept"].append(kept)
    yield pa.RecordBatch.from_arrays(
        [ids, pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
         pa.array(out["removed"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
         pa.array(out["kept"], pa.binary())],
        ["doc_id", "n_bytes", "n_removed", "removed", "kept"],
    )


def remove_repeated_bytes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut from every text each byte covered by a ``length``-byte string that also starts earlier in the corpus.

    Rows: doc_id, n_bytes, n_removed, removed (maximal byte runs, end exclusive) and kept (the remaining
    bytes; a cut may split a character, so this is binary). Null and empty texts: zero bytes, nothing removed.
    Texts shorter than ``length`` are never cut. Order among rows is by doc_id. A row repeated in full is one document,
    returned as often as it stands and cut alike each time; of rows that share only their doc_id, the smallest text is
    searched and the others are returned uncut, as is a row whose doc_id is null. An empty table gives an empty
    result; other columns are not read.
    """
    texts = document_texts(docs, id_col, text_col)
    searched, chosen = one_row_per_id(texts)
    runs = repeated_byte_runs(searched, length)
    per_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return arrow_map(
        with_spans(texts, per_doc, chosen),
        _cut,
        "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary",
    )
