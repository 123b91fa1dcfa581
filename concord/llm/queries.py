"""The queries of this subpackage, over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, byte_bpe, context_tree, crf_language, near_dedup, sentencepiece_backend, substring_dedup, token_files
from . import decontaminate as leaks
from . import url_reputation as urls

#: Fixed values of the contract.
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, bad of the labelled pages: the first part of a page's path that is a number is the document it shows; toxic or low-quality ones are bad."""
    bad = F.when(F.coalesce("toxic", F.lit(0)) == 1, 1).when(F.col("quality") == 0, 1).when(F.coalesce("toxic", "quality").isNotNull(), 0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("shows"), bad.alias("bad"))
    number = F.regexp_extract(urls.url_path(F.col("url")), r"/([0-9]+)(/|$)", 1)
    shown = table(spark, sf_dir, "pages").select("url", number.try_cast("long").alias("shows"))
    return shown.join(labels, "shows").select("url", "bad")


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir), URL_RULES)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_language.identify(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), token_files.token_folder(spark), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_digests(manifest)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_backend.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_host_reputation, op2_token_counts, op3_near_duplicates, op4_language, op5_top_k, op6_context_tree, op7_token_files, op8_benchmark_leaks, op9_sentencepiece, op10_repeated_passages)}
