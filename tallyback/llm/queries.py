"""Corpus queries: each operator over its whole table, with the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers

from tallyback.llm import sql
from tallyback.llm.bpe import encode_texts
from tallyback.llm.fingerprints import compare_edited_and_next
from tallyback.llm.hard_negatives import mine_hard_negatives
from tallyback.llm.license_scan import scan_licences
from tallyback.llm.line_dedup import remove_widespread_lines
from tallyback.llm.mixing import mix_sources
from tallyback.llm.ngram_join import ngram_components
from tallyback.llm.preferences import format_preferences
from tallyback.llm.pu_quality import score_quality
from tallyback.llm.spelling import group_spellings
from tallyback.llm.substring_kmer import remove_repeated_words
from tallyback.llm.substring_suffix import remove_repeated_bytes
from tallyback.llm.vector_neighbours import near_duplicate_vectors
from tallyback.operators.ranks import global_row_number


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeated_bytes(documents(spark, folder), length=100)
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op2_ngram_tree_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(documents(spark, folder), size=5, percent=80)


def op3_site_spread_lines(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_widespread_lines(documents(spark, folder), min_sites=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"), threshold=0.3)


def op5_quantised_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"), cosine=0.93)


def op6_fair_mix(spark: SparkSession, folder: str) -> DataFrame:
    mix = mix_sources(documents(spark, folder), weights=(1, 2, 3), repeat_limit=3)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op7_super_kmers(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeated_words(documents(spark, folder), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_preference_format(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation is the chosen one; rejected is the same with its last reply taken from the next conversation.

    Next is the next larger conv_id, after the last the first. Where there is no reply to exchange, both are equal.
    """
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = F.when(F.col("role") == "assistant", F.struct("turn", "text"))
    talks = global_row_number(turns.groupBy("pair_id").agg(F.max(last).alias("last")), [F.col("pair_id")], "place")
    end = talks.agg(F.max("place")).first()[0] or 1
    following = talks.select(F.pmod(F.col("place") - 2, F.lit(end)).alias("before"), F.col("last.text").alias("other"))
    swap = talks.join(following, F.col("place") - 1 == F.col("before")).select("pair_id", F.col("last.turn").alias("swapped"), "other")
    exchanged = (F.col("turn") == F.col("swapped")) & (F.col("role") == "assistant") & F.col("other").isNotNull()
    rejected = turns.join(swap, "pair_id").select("pair_id", "turn", "role", F.when(exchanged, F.col("other")).otherwise(F.col("text")).alias("text"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(c)
    return format_preferences(turns, rejected).select(
        "pair_id", "n_common", "prompt", "chosen", "rejected", spans("chosen_spans"), spans("rejected_spans")
    )


def op9_weighted_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return compare_edited_and_next(documents(spark, folder)).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = encode_texts(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "n_tokens", F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licences(documents(spark, folder)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 50; a row whose vec_id is divisible by 7 moves to the next of ten labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("id") % 50 == 0, label=label)


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return group_spellings(documents(spark, folder))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_ngram_tree_join": op2_ngram_tree_join,
    "op3_site_spread_lines": op3_site_spread_lines,
    "op4_pu_quality": op4_pu_quality,
    "op5_quantised_vectors": op5_quantised_vectors,
    "op6_fair_mix": op6_fair_mix,
    "op7_super_kmers": op7_super_kmers,
    "op8_preference_format": op8_preference_format,
    "op9_weighted_fingerprints": op9_weighted_fingerprints,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_license_scan": op11_license_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_suffix_dedup": sql.OP1,
    "op2_ngram_tree_join": sql.OP2,
    "op3_site_spread_lines": sql.OP3,
    "op6_fair_mix": sql.OP6,
    "op7_super_kmers": sql.OP7,
    "op8_preference_format": sql.OP8,
    "op12_hard_negatives": sql.OP12,
    "op13_spelling_variants": sql.OP13,
    "pipeline": corpus_pipeline.ORACLE_SQL,
}
