"""The thin queries ``opN_<name>`` over the standard tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.llm import decontaminate, fingerprint, langid, lm, neardup, oracle, packing, quality, substring, tokens, warc
from annospark.llm.common import crc32_rest, documents, fresh_path, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.count_tokens(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), held_out=(2, 7))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "lang")
    found = langid.identify(docs.select("doc_id", "text"), docs.where(crc32_rest("doc_id", 3) != 1))
    return found.select("doc_id", F.coalesce(crc32_rest("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=0, ranks=vocabulary("byte_bpe_50k.tiktoken"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Field | quality.Constant:
    """The quality model of the labelled documents that are not held out."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(crc32_rest("doc_id", 5) != 0)
    return quality.learn(documents(spark, sf_dir), labels)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.score(documents(spark, sf_dir), quality_model(spark, sf_dir))
    return scores.select("doc_id", F.coalesce(crc32_rest("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    records = warc.archive_pages(pages, fresh_path(spark, "archives"))
    return records.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").cast("long").alias("refers_to"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.kept_words(documents(spark, sf_dir), window=13).drop("spans")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), similarity=(85, 100)).drop("text_hash")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
