"""Documents through five of the corpus operators, each stage on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import crf_language, near_dedup, sentencepiece_backend, substring_dedup
from concord.llm import decontaminate as leaks
from concord.llm.common import cut

#: A document whose language has less than this share of its words is rejected.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are mostly in one of the learnt languages; those without letters, or of no clear language, go."""
    found = crf_language.predict(docs, crf_language.learn(docs))
    kept = found.filter((F.col("lang_pred") != crf_language.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return kept.select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to 0.8 stays, the one with the least id."""
    return near_dedup.deduplicate(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window of 35 words that is also elsewhere are cut out; texts that lose none stay as they are."""
    found = substring_dedup.remove_repeats(docs, as_it_was=True)
    columns = [F.col("kept").alias(c) if c == "text" else F.length("kept").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return found.select(*columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item go."""
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_differ, round_trip: the ids of each document, checked by decoding."""
    return sentencepiece_backend.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language ID", language), ("near-duplicates", near_duplicates), ("substring dedup", substrings), ("decontamination", decontaminate), ("SentencePiece", encode)]

#: Language ID is a learnt model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
