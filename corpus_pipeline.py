"""From raw documents to token ids: quality, shared lines, near copies, source mix, byte-level BPE.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyback.llm.bpe import encode_texts
from tallyback.llm.common import cut_lineage
from tallyback.llm.line_dedup import remove_widespread_lines
from tallyback.llm.mixing import mixed_documents
from tallyback.llm.ngram_join import ngram_components
from tallyback.llm.pu_quality import keep_good_documents

# The classifier has no SQL form; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more sources share; n_chars follows the text."""
    cleaned = remove_widespread_lines(docs, min_sites=5)
    return cleaned.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of every component of near copies, once if its row is repeated in full.

    Rows without doc_id are linked with nothing and all stay.
    """
    groups = ngram_components(docs, size=5, percent=80)
    first = docs.join(groups.filter("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    return first.dropDuplicates().union(docs.filter("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixed_documents(docs, weights=(1, 2, 3), repeat_limit=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digest of what they decode to."""
    coded = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.col("ids_text").alias("ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_shared_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources", mix),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
