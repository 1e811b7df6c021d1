"""Preference formatting of chat conversations, in DataFrame operations only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered once as the
prompt; what follows on either side becomes a completion with the spans of it that a loss should count
(the assistant's turns), everything else being masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _turns(table: DataFrame, out: str) -> DataFrame:
    """One row per pair: its turns in order. A conversation is one training text, so it is gathered whole."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return table.filter("pair_id IS NOT NULL").groupBy("pair_id").agg(F.sort_array(F.collect_list(turn)).alias(out))


def render(turn: Column) -> Column:
    """``<|role|>``, a line feed, the text, ``<|end|>`` and a line feed; a null role is written as ``none``."""
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("none")), F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _completion(turns: Column, start: Column) -> tuple[Column, Column]:
    """Text of the turns from ``start`` on (0-based), and the character ranges of the assistant's texts in it."""
    rest = F.slice(turns, start + 1, F.greatest(F.size(turns) - start, F.lit(0)))
    text = F.array_join(F.transform(rest, render), "")
    head = lambda t: F.length(F.coalesce(t["role"], F.lit("none"))) + 5  # noqa: E731  <| |> and the line feed
    begun = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        start_text = acc["at"] + head(t)
        end_turn = start_text + F.length(t["text"]) + F.lit(7)  # up to and with <|end|>
        span = F.array(F.struct(start_text.cast("long").alias("start"), end_turn.cast("long").alias("end")))
        return F.struct(
            (end_turn + 1).cast("long").alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return text, F.aggregate(rest, begun, add)["spans"]


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Render pairs of conversations. ``chosen`` and ``rejected`` have the columns pair_id, turn, role, text.

    Rows: pair_id, n_common (turns of the longest common prefix), prompt, chosen, rejected (the completions), and
    chosen_spans, rejected_spans (ranges of characters the loss counts: each assistant text with its end mark).
    Turns equal in role and text are common; their numbers only give the order, ties by role and text. A conversation that is a prefix of
    the other has an empty completion; equal ones have two. Null text is empty text, a null role is a role
    of its own. A pair that lacks one side is rendered with that side empty. Rows without pair_id
    are left out; repeated rows are repeated turns. Empty tables give an empty result; other columns are not read.
    """
    both = _turns(chosen, "c").join(_turns(rejected, "r"), "pair_id", "full")
    none = F.array().cast(TURNS)
    both = both.select("pair_id", F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    unlike = lambda i: ~(
        F.element_at("c", i)["role"].eqNullSafe(F.element_at("r", i)["role"]) & (F.element_at("c", i)["text"] == F.element_at("r", i)["text"])
    )
    places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    common = F.coalesce(F.array_min(F.filter(places, unlike)) - 1, shorter)
    both = both.withColumn("n_common", common)
    prompt = F.array_join(F.transform(F.slice("c", F.lit(1), F.col("n_common")), render), "")
    c_text, c_spans = _completion(F.col("c"), F.col("n_common"))
    r_text, r_spans = _completion(F.col("r"), F.col("n_common"))
    return both.select(
        "pair_id", F.col("n_common").cast("long").alias("n_common"), prompt.alias("prompt"), c_text.alias("chosen"),
        r_text.alias("rejected"), c_spans.alias("chosen_spans"), r_spans.alias("rejected_spans"),
    )
