"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in a fixed shuffled order, repeated as often as its
target needs. A document's virtual finish time is the source's words up to and including it, divided by the
source's target. Sorting all documents by finish time and cutting at the total budget
takes from every source in proportion to its target. Both running sums (words within a source,
words over the whole mix) are prefix sums over range slices, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyback.llm.common import cut_lineage
from tallyback.operators.ranks import global_row_number, total_before

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, repeat_limit: float) -> DataFrame:
    """Targets per source: shares of all words by weight, at most ``repeat_limit`` times the source's own words.

    ``sources``: source, weight, source_size. The level (words per unit of weight) rises until the excess of the
    sources at their limit is spread over the others; each step is one aggregate of a single row.
    """
    limit = F.col("source_size") * F.lit(repeat_limit)
    level, full = None, -1
    while True:
        at_limit = F.lit(False) if level is None else limit < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(at_limit, limit).otherwise(0.0)).alias("held"),
            F.sum(F.when(at_limit, 0).otherwise(F.col("weight"))).alias("open"), F.sum(at_limit.cast("long")).alias("full"),
        ).first()
        if row.total is None or row.full == full or not row.open:
            break
        full, level = row.full, (row.total - row.held) / row.open
    level = level or 0.0
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)).cast("double"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeat_limit: int = 3, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken (words, repeats counted), copies.

    Sources in code point order, null last (a source of its own), weigh ``weights`` in turn. A document is taken
    whole, ``copies`` times, ``repeat_limit`` at most. Null and empty texts have size 0 and are never taken
    (copies 0): they add no words; a source of such rows has target 0. Rows that repeat an id are separate
    documents, told apart by their text; rows equal in id, text and source too share one
    place in the queue. Empty table: empty result. Other columns are not read. The order is a hash of id and
    text, so reruns agree.
    """
    sized = cut_lineage(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
            word_count(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("size"),
            F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("shuffle"),
            F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"),
        )
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_row_number(sizes, [F.col("source").asc_nulls_last()], "rank")
    turn = F.array(*[F.lit(w) for w in weights])
    weighed = cut_lineage(ranked.withColumn("weight", F.element_at(turn, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))))
    sources = cut_lineage(water_fill(weighed, repeat_limit).select("source", "rank", "source_size", "target"))

    same = F.expr("q.source <=> s.source")
    queued = sized.groupBy("source", "shuffle", "doc_id", "text_key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    queued = queued.filter("words > 0").alias("q").join(sources.alias("s"), same).select(
        "rank", "shuffle", "doc_id", "text_key", "words", "rows", "source_size", "target"
    )
    placed = total_before(queued, ["rank", "shuffle", "doc_id", "text_key"], "words", "before_all")
    starts = weighed.select("rank", F.col("source_size").alias("own"))
    starts = cut_lineage(total_before(starts, ["rank"], "own", "source_start").select("rank", "source_start"))
    # One entry per lap of the source: a document can come up once in each lap.
    laps = F.sequence(F.lit(0), F.least(F.lit(repeat_limit), F.ceil(F.col("target") / F.col("source_size")).cast("int") + 1) - 1)
    ends = F.col("before_all") - F.col("source_start") + F.col("words")
    finish = (F.col("lap") * F.col("source_size") + ends) / F.col("target")
    entries = (
        placed.join(starts, "rank").filter("target > 0")
        .withColumn("lap", F.explode(laps)).withColumn("finish", finish)
        .select("finish", "rank", "lap", "shuffle", "doc_id", "text_key", "words")
    )
    budget = weighed.agg(F.sum("source_size")).first()[0] or 0
    running = total_before(entries, ["finish", "rank", "lap", "shuffle", "doc_id", "text_key"], "words", "mixed_before")
    taken = (
        running.filter(F.col("mixed_before") + F.col("words") <= F.lit(budget))
        .groupBy("rank", "shuffle", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    )
    chosen = sized.alias("q").join(sources.alias("s"), same).select("q.*", "s.rank", "s.source_size", "s.target").alias("d")
    on = F.expr("d.rank = t.rank AND d.shuffle = t.shuffle AND d.doc_id <=> t.doc_id AND d.text_key = t.text_key AND d.size > 0")
    copies = F.coalesce(F.col("t.copies"), F.lit(0))
    return chosen.join(taken.alias("t"), on, "left").select(
        "d.doc_id", "d.source", "d.size", "d.source_size", "d.target", (copies * F.col("d.size")).alias("taken"),
        copies.alias("copies"), "d.text_key",
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    mix = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).filter("copies > 0")
    times = mix.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("source").alias("_source"), F.col("copies").alias("_copies")).distinct()
    same = (
        F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("_key"))
        & F.col(f"`{source_col}`").eqNullSafe(F.col("_source"))
    )
    repeated = docs.join(times, same).withColumn("_lap", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
