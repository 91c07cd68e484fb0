"""Corpus pipeline over ``documents``: five stages, each written as Parquet and reread as the next one's documents.

1. quality: documents that the classifier rejects go.
2. near_dedup: one document, the one with the smallest id, of each component
   of documents with a similarity of 0.8 or more stays.
3. substring_dedup: words that a repeat of 13 words or more covers are cut out
   of all documents but the one with the smallest id; a document that loses
   every word goes.  One that had none (also a null text) stays as it is.
4. decontaminate: documents with a run of 10 words of a benchmark item go.
5. pack: what is left is packed into sequences of 1024 tokens.

Every stage decides row by row: a row is never dropped for what another row
with its id holds.  Stages 1 to 4 return the columns that they are given.
Rows with a null id pass stages 1 to 4 like others, but are never duplicates.
:func:`run` deletes each stage's table as soon as the next has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.llm import decontaminate, neardup, packing, quality, substring
from annospark.llm.common import fresh_path, remove, table
from annospark.llm.queries import quality_model, vocabulary

#: Rejected below this score.
QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score of ``QUALITY`` at least; empty and null texts are scored as one empty line."""
    scored = quality.score(docs, quality_model(spark, sf_dir), keep=tuple(c for c in docs.columns if c != "doc_id"), out_col="__quality")
    return scored.where(F.col("__quality") >= QUALITY).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose id is the smallest of their component; repeated rows of one id and text stay or go together."""
    return neardup.without_duplicates(docs, similarity=(80, 100))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without their repeats, but for rows that had words and lose all; ``n_chars``, if there is one, is that of the new text."""
    has_word = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    left = substring.without_repeats(docs.withColumn("__had_word", has_word), window=13)
    left = left.where(has_word | ~F.col("__had_word"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return left.select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a hit word."""
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a packed document (see :func:`packing.pack`)."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=0, ranks=vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]
#: SQL cannot express the classifier, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
