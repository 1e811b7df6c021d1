"""Spelling variants over a trie-node pair dictionary.

All words form two tries, one read forwards and one backwards, whose nodes are numbered. A word with one place skipped
is the pair (node of what stands before, node of what stands behind); with a place inserted likewise. Two words differ by
one replaced code point exactly if they share a skipped pair, and by one inserted or deleted code point exactly if
a skipped pair of the longer one is an inserted pair of the shorter one. A pair of nodes leaves one place open,
so at most one word per letter of the alphabet meets at a pair: there are no large groups, however many words there are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyback.llm.common import arrow_map, document_texts, small_batches
from tallyback.llm.text import texts_of
from tallyback.operators.ranks import global_row_number
from tallyback.session import cut_lineage, release

RUN = "[A-Za-zÀ-ÿ]+"
_LOWER = {c: c + 32 for c in range(65, 91)}
ROOT = -1
_SHARED_BITS = 40  # node numbers: slice in the high bits, count inside the slice below


def damaged(doc_id: int | None, run: str, every: int) -> str:
    """The run, less one code point where ``every`` divides the crc32 of ``<doc_id>:<run>`` (no id: nothing before the colon)."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, every: int, min_length: int, min_count: int, pattern: str = RUN) -> DataFrame:
    """(word, n) of all words of the whole texts that are long and frequent enough; counted per batch before the shuffle."""

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        total: Counter[str] = Counter()
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)).to_pylist()):
            for run, n in Counter(find(text.translate(_LOWER))).items():
                word = damaged(doc_id, run, every)
                if len(word) >= min_length:
                    total[word] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counted = arrow_map(docs.select("doc_id", "text"), count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a.startswith(b[:middle]):
            low = middle
        else:
            high = middle - 1
    return low


class TrieSlice:
    """The part of a trie below one slice of the sorted words; nodes are numbered as they appear.

    ``borders`` are the first words of all slices, in order. Only nodes on a border word's path can lie in several slices: they are
    numbered by the first border word below them and their depth, below zero, which every slice works out alike.
    """

    def __init__(self, slice_no: int, borders: list[str]):
        self._slice, self._borders = slice_no, borders
        self._before, self._path, self._made = "", [ROOT], 0

    def path(self, word: str) -> list[int]:
        """Nodes along ``word``, the root first; words must come in order."""
        same = _common(self._before, word)
        del self._path[same + 1 :]
        near = {i: _common(self._borders[i], word) for i in (self._slice, self._slice + 1) if i < len(self._borders)}
        first = max(near, key=lambda i: (near[i], -i))
        shared = near[first]
        numbers = []
        reach = _common(self._borders[first - 1], word) if first else -1
        for depth in range(shared, same, -1):  # the shorter the prefix, the further left its first border word
            while reach >= depth:
                first -= 1
                reach = _common(self._borders[first - 1], word) if first else -1
            numbers.append(-((first + 1 << _SHARED_BITS) + depth))
        self._path += reversed(numbers)
        fresh = len(word) + 1 - len(self._path)
        start = (self._slice << _SHARED_BITS) + self._made
        self._path += range(start, start + fresh)
        self._made += fresh
        self._before = word
        return list(self._path)


def trie_paths(words: DataFrame, spelled: Callable[[str], Column], out: str) -> DataFrame:
    """(word_no, ``out``): the numbers of the trie nodes along each word as ``spelled``, the root first.

    Words are cut into sorted slices; each slice builds its part of the trie in order, holding one path at a time. The first word of
    every slice goes to the tasks: one word per shuffle partition, a number set by the session and not by the data.
    """
    slices = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = words.select("word_no", spelled("word").alias("spelled"))
    sliced = cut_lineage(keyed.repartitionByRange(slices, "spelled").withColumn("slice", F.spark_partition_id()))
    heads = sliced.groupBy("slice").agg(F.min("spelled").alias("head")).orderBy("slice").collect()
    borders = [r["head"] for r in heads]
    place = {r["slice"]: i for i, r in enumerate(heads)}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, trie = None, None
        for batch in batches:
            paths = []
            for word, slice_no in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if slice_no != current:
                    current, trie = slice_no, TrieSlice(place[slice_no], borders)
                paths.append(trie.path(word))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.list_(pa.int64()))], ["word_no", out])

    ordered = sliced.repartition(slices, "slice").sortWithinPartitions("slice", "spelled").select("word_no", "spelled", "slice")
    kept = cut_lineage(small_batches(ordered).mapInArrow(number, f"word_no long, {out} array<long>"))
    release(sliced)
    return kept


def open_pairs(words: DataFrame) -> DataFrame:
    """(before, behind, skipped, leads, n, no): every pair of nodes of every word with one place skipped or inserted.

    ``leads`` marks the first place of a run of equal letters: skipping any other of the run gives the same rest.
    ``no`` is the negative word number, so that larger is earlier.
    """
    forward, backward = trie_paths(words, F.col, "pre"), trie_paths(words, F.reverse, "suf")
    size = F.size("pre") - 1
    letters = F.split("word", "")

    def pair(i: Column, behind: Column, skipped: bool, leads: Column) -> Column:
        return F.struct(F.get("pre", i).alias("before"), F.get("suf", behind).alias("behind"), F.lit(skipped).alias("skipped"), leads.alias("leads"))

    skips = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: pair(i, size - 1 - i, True, (i == 0) | (F.get("letters", i) != F.get("letters", i - 1))),
    )
    gaps = F.transform(F.sequence(F.lit(0), size), lambda i: pair(i, size - i, False, F.lit(False)))
    joined = words.withColumn("letters", letters).join(forward, "word_no").join(backward, "word_no")
    return joined.select("n", (-F.col("word_no")).alias("no"), F.inline(F.concat(skips, gaps)))


def near_words(pairs: DataFrame) -> DataFrame:
    """(word_no, n_near, best): number of near words and the best of them, the one of largest n, then smallest number.

    At one pair meet at most one word per letter (skipped there) and one word with nothing there. Every two of the former are near, and
    each of them that leads its run is near the latter; a near couple meets in one of these ways exactly once.
    """
    me = F.struct("n", "no", "leads")
    met = pairs.groupBy("before", "behind").agg(
        F.sort_array(F.collect_list(F.when(F.col("skipped"), me)), asc=False).alias("open"),
        F.max(F.when(~F.col("skipped"), F.struct("n", "no"))).alias("bare"),
    )
    met = met.filter((F.size("open") > 1) | ((F.size("open") == 1) & F.col("bare").isNotNull()))
    rank = lambda x: F.struct(x["n"].alias("n"), x["no"].alias("no"))
    top, second, bare = F.get("open", F.lit(0)), F.get("open", F.lit(1)), F.col("bare")

    def of_open(x: Column) -> Column:
        other = F.when(x["no"] == top["no"], F.when(second.isNotNull(), rank(second))).otherwise(rank(top))
        shorter = F.when(x["leads"], bare)
        near = F.size("open") - 1 + F.when(x["leads"] & bare.isNotNull(), 1).otherwise(0)
        return F.struct((-x["no"]).alias("word_no"), near.cast("long").alias("n_near"), F.array_max(F.array(other, shorter)).alias("best"))

    longer = F.filter("open", lambda x: x["leads"])
    of_bare = F.struct(
        (-bare["no"]).alias("word_no"), F.size(longer).cast("long").alias("n_near"), rank(F.get(longer, F.lit(0))).alias("best")
    )
    both = F.concat(F.transform("open", of_open), F.when(bare.isNotNull() & (F.size(longer) > 0), F.array(of_bare)).otherwise(F.array()))
    return met.select(F.inline(both)).filter("n_near > 0").groupBy("word_no").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word_no, root_no) for (word_no, form_no): where following forms ends. Each pass doubles the steps taken.

    Forms grow by at least the ratio at each step, so a chain of 64-bit counts has few steps and there are no rings.
    """
    current = cut_lineage(forms.select("word_no", F.col("form_no").alias("root_no")))
    while True:
        ahead = current.select(F.col("word_no").alias("root_no"), F.col("root_no").alias("next_no"))
        moved = cut_lineage(
            current.join(ahead, "root_no", "left").select("word_no", F.coalesce("next_no", "root_no").alias("root_no"), F.col("next_no").isNotNull().alias("went"))
        )
        ended = moved.filter("went").isEmpty()
        release(current)
        current = moved.drop("went")
        current.kept_at = moved.kept_at
        if ended:
            return current


def group_spellings(
    docs: DataFrame, every: int = 199, min_length: int = 6, min_count: int = 5, ratio: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Words of the whole texts with their near words and the form they are probably variants of.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; where ``every`` divides the crc32 of
    ``<id>:<run>``, the run loses the code point at crc32 mod length. Those of at least ``min_length`` code points and ``min_count``
    occurrences take part. Near are words that differ by exactly one inserted, deleted or replaced code point. ``form`` is the near
    word of largest n (ties: first in code-point order) if its n is at least ``ratio`` times the word's, else null;
    ``root`` the last word on the way from form to form, the word itself if it has none.

    Rows: word, form, root, n, n_near, form_n, one per word. Null and empty texts have no words; texts and words of any length
    are read whole; repeated rows count as often as they stand; a null id counts as an empty one; an empty table gives an empty result; other
    columns are not read.
    """
    counts = cut_lineage(word_counts(document_texts(docs, id_col, text_col), every, min_length, min_count))
    words = cut_lineage(global_row_number(counts, [F.col("word")], "word_no"))
    near = cut_lineage(near_words(open_pairs(words)))
    ranked = cut_lineage(
        words.join(near, "word_no", "left").select(
            "word_no", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.no")).alias("form_no"),
        )
    )
    roots = last_forms(ranked.filter("form_no IS NOT NULL"))
    names = words.select(F.col("word_no").alias("form_no"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    ends = words.select(F.col("word_no").alias("root_no"), F.col("word").alias("end"))
    release(counts, near)
    return (
        ranked.join(names, "form_no", "left")
        .join(roots, "word_no", "left")
        .join(ends, "root_no", "left")
        .select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")
    )
