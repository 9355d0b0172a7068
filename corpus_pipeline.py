"""A training-data pipeline over `documents`: rules, line dedup, near-duplicates, mixing, encoding.

Each stage works on all rows that the one before it kept. Rows keep their own decisions, also under
repeated and null ids. The mixing stage repeats a row as often as the mix takes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm import bpe, jaccard_join, line_dedup, mixing, quality
from gridfold.llm.common import checkpoint


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't outliers of their language and source.

    A null text counts as empty, and fails; null languages and sources are ones of their own. Each row has its own verdict, also
    under a repeated or null id. An empty table gives none.
    """
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; a text may end up empty.

    Rows with one id are one document, and those with a null id are one after all others. Null texts stay null. No row goes.
    """
    kept = line_dedup.dedup_lines(docs).drop("n_lines", "n_dropped")
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group that is linked by shingle sets.

    Each row is a document of its own; of equal rows, and of rows with a null id that are linked, one stays. Empty and null texts are linked with
    nothing, and all stay.
    """
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times; each row counts for itself, and a null source is one of its own. Texts without words count 0."""
    return mixing.repeat_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and the hash of the decoded bytes of each row of the mix; a null text counts as empty."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return bpe.decode(ids, path).select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("jaccard_join", near_duplicates),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The outlier rule and the encoding have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other; each reads what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
