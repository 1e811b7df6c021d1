"""Removal of repeated word sequences by super-k-mer partitioning.

A window is ``window`` consecutive words; its minimiser is its leftmost ``gram``-word gram with the smallest hash.
Consecutive windows of a text that share a minimiser form a super-k-mer, which travels as one packed
string to the minimiser's bucket instead of window by window; equal windows always meet in one
bucket, where sorting counts them exactly.

Digests decide beforehand which strings have to travel: a minimiser that occurs once has no repeats; of
equal super-k-mers one stands for all, and its windows are repeated by the others. Only minimisers with several different
super-k-mers need their bucket. A bucket of more than ``crowd`` different ones (a very common passage in
ever new surroundings) is not gathered: its windows go on one by one under a 128-bit
digest and are counted by an aggregate with map-side sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyback.llm.common import arrow_map, cut_lineage, document_texts, one_row_per_id, release, with_spans
from tallyback.llm.families import FAMILY, distinct_families, merged, runs_of, shared_families, whole_groups
from tallyback.llm.text import Rolling, byte_values, chunks, concat_ranges, signed, texts_of, window_families, word_bounds

GRAM = 8  # words of a minimiser
CROWD = 64  # different super-k-mers of one minimiser that are counted in one task

_PACKED = "crowded boolean, k1 long, k2 long, doc_id long, at long, n int, known boolean, packed binary"


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return Rolling(byte_values(data, which), which).ranges(starts, ends)


def _super_kmers(window: int, gram: int):
    def step(batch: pa.RecordBatch):
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1))
        for row0, row1, data, bounds in chunks(texts):
            starts, ends, firsts = word_bounds(data, bounds)
            row, begin, count, digit, whole = window_families(Rolling(_word_hashes(data, starts, ends)), firsts, window, gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row0:row1][row]), pa.array((begin - firsts[row]).astype(np.int64)),
                 pa.array(count.astype(np.int32)), pa.array(signed(digit)), pa.array(signed(whole))],
                ["doc_id", "at", "n", "digit", "whole"],
            )

    return step


def _pack(window: int):
    """The marked super-k-mers as packed strings, words joined by one space; those of crowded buckets window by window."""

    def step(batch: pa.RecordBatch):
        ids, texts, marks = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1)), batch.column(2)
        inner = marks.flatten()
        digit, at, n, known, crowd = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(5))
        at, n = at.astype(np.int64), n.astype(np.int64)
        cut = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(marks.value_lengths().to_numpy(zero_copy_only=False), out=cut[1:])
        for row0, row1, data, bounds in chunks(texts):
            starts, ends, firsts = word_bounds(data, bounds)
            own = np.arange(cut[row0], cut[row1])
            row = np.repeat(np.arange(row1 - row0), np.diff(cut[row0 : row1 + 1]))
            mine = ~crowd[own].astype(bool)
            f, first = own[mine], firsts[row[mine]] + at[own[mine]]
            last = first + n[f] - 1 + window
            texts_out = [b" ".join(data[a:b].tobytes().split()) for a, b in zip(starts[first], ends[last - 1])]
            yield _rows(False, digit[f], np.zeros(len(f), np.int64), ids[row0:row1][row[mine]], at[f], n[f], known[f], texts_out)
            f, r = own[~mine], row[~mine]
            if len(f):
                pos, begin = concat_ranges(at[f], n[f]), concat_ranges(firsts[r] + at[f], n[f])
                k1, k2 = (
                    signed(Rolling(_word_hashes(data, starts, ends, w), w).ranges(begin, begin + window)) for w in (0, 1)
                )
                doc = np.repeat(ids[row0:row1][r], n[f])
                yield _rows(True, k1, k2, doc, pos, np.ones(len(pos)), np.repeat(known[f], n[f]), [None] * len(pos))

    return step


def _rows(crowded, k1, k2, doc, at, n, known, packed):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), crowded)), pa.array(k1), pa.array(k2), pa.array(doc), pa.array(at),
         pa.array(n.astype(np.int32)), pa.array(known.astype(bool)), pa.array(packed, pa.binary())],
        ["crowded", "k1", "k2", "doc_id", "at", "n", "known", "packed"],
    )


def count_windows(bucket: np.ndarray, packed: list[bytes], n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the windows of packed super-k-mers by (bucket, words): owner of each window, and how often its words occur in the bucket."""
    numbers: dict[bytes, int] = {}
    words = [numbers.setdefault(w, len(numbers)) for text in packed for w in text.split(b" ")]
    sizes = n - 1 + window
    begin = concat_ranges(np.cumsum(sizes) - sizes, n)
    owner = np.repeat(np.arange(len(n)), n)
    # Windows are told apart word by word, most significant first; equal ones share a class number after each pass.
    spans, step = np.asarray(words, np.int64), 1
    classes = spans
    while step < window:  # double the depth: a class of 2d words is a pair of classes of d words
        ahead = min(step, window - step)
        pairs = np.stack([classes[:-ahead], classes[ahead:]], axis=1) if len(classes) > ahead else np.zeros((0, 2), np.int64)
        key = pairs[:, 0] * (classes.max(initial=0) + 1) + pairs[:, 1]
        classes = np.unique(key, return_inverse=True)[1]
        step += ahead
    keys = bucket[owner].astype(np.int64) * (classes.max(initial=0) + 1) + classes[begin]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return owner, counts[inverse]


def _count_bucket(window: int):
    def run(batches):
        for table in whole_groups(batches):
            digit, doc, at, n, known = (table.column(i).to_numpy() for i in range(5))
            n = n.astype(np.int64)
            bucket = np.cumsum(np.append(True, digit[1:] != digit[:-1])) - 1
            owner, occurs = count_windows(bucket, table.column(5).to_pylist(), n, window)
            place = concat_ranges(at, n)
            again = (occurs > 1) & ~known[owner]  # windows of known super-k-mers are removed already
            d, a, c = runs_of(doc[owner[again]], place[again])
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(c.astype(np.int32))], ["doc_id", "at", "n"])

    return run


def repeated_word_runs(docs: DataFrame, window: int = 35, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Word ranges (doc_id, start, end) covered by a window whose words also start anywhere else. Ranges may overlap.

    Expects the columns doc_id (unique, not null) and text; see ``remove_repeated_words``.
    """
    gram = min(gram, window)
    shared = shared_families(arrow_map(docs, _super_kmers(window, gram), FAMILY))
    firsts = distinct_families(shared)
    several = firsts.filter("copies > 1").select("digit", "whole")
    copies = shared.join(several, ["digit", "whole"]).select("doc_id", "at", "n")

    marks = F.struct("digit", "at", "n", (F.col("copies") > 1).alias("known"), (F.col("kinds") > crowd).alias("crowded"))
    unlike = firsts.filter("kinds > 1").groupBy("doc_id").agg(F.collect_list(marks).alias("marks"))
    packed = cut_lineage(arrow_map(docs.join(unlike, "doc_id").select("doc_id", "text", "marks"), _pack(window), _PACKED))
    in_buckets = (
        packed.filter("NOT crowded").select(F.col("k1").alias("digit"), "doc_id", "at", "n", "known", "packed")
        .repartition("digit").sortWithinPartitions("digit").mapInArrow(_count_bucket(window), "doc_id long, at long, n int")
    )
    single = packed.filter("crowded").select("k1", "k2", "doc_id", "at", "n", "known")
    again = single.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    one_by_one = single.filter("NOT known").join(again, ["k1", "k2"]).select("doc_id", "at", "n")
    parts = [cut_lineage(part) for part in (copies, in_buckets, one_by_one)]
    release(shared, firsts, packed)
    runs = parts[0].union(parts[1]).union(parts[2])
    return runs.select("doc_id", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + window).alias("end"))


def _cut(batch: pa.RecordBatch):
    texts, spans = texts_of(batch.column(1)), batch.column(2)
    out: dict[str, list] = {"n_words": [], "n_removed": [], "removed": [], "kept": []}
    for text, own in zip(texts, spans):
        words = text.as_buffer().to_pybytes().split()
        kept, ranges = words, []
        if own.is_valid:
            own = own.as_py()
            start, end = merged(np.array([s["start"] for s in own]), np.array([s["end"] for s in own]))
            kept, at = [], 0
            for s, e in zip(start.tolist(), end.tolist()):
                kept += words[at:s]
                at = e
                ranges.append({"start": s, "end": e})
            kept += words[at:]
        out["n_words"].append(len(words))
        out["n_removed"].append(len(words) - len(kept))
        out["removed"].append(ranges)
        out["kept"].append(b" ".join(kept).decode())
    yield pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
         pa.array(out["removed"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
         pa.array(out["kept"], pa.string())],
        ["doc_id", "n_words", "n_removed", "removed", "kept"],
    )


def remove_repeated_words(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut from every text each word covered by a window of ``window`` words that occurs anywhere else too.

    Words are runs of characters other than space and tab to carriage return, unchanged. Rows: doc_id, n_words, n_removed,
    removed (maximal word runs, end exclusive) and kept (the remaining words joined by one space). Windows lie
    in one document and are judged on the input; the first occurrence goes too. Null, empty and blank texts
    have no words. A row repeated in full is one document, returned as often as it stands and cut alike each time; of rows
    that share only their doc_id, the smallest text is searched and the others are returned uncut, as is a row whose doc_id is null. An empty table gives an empty result; other columns are not read.
    """
    texts = document_texts(docs, id_col, text_col)
    searched, chosen = one_row_per_id(texts)
    runs = repeated_word_runs(searched, window)
    per_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return arrow_map(
        with_spans(texts, per_doc, chosen),
        _cut,
        "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string",
    )
