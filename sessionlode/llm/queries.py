"""The query of each operator over the synthetic tables, with production settings, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlode.llm import bpe, language_id, line_dedup, mixing, ngram_join, pii, quality_classifier, quality_rules, token_counts, top_k
from sessionlode.llm.scratch import Scratch
from sessionlode.sources import tables


def tokenizer_path() -> str:
    """The default file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """For plans that go through the texts once and do much with each: a table whose splits cannot fill the cores is dealt out."""
    return tables.read(spark, f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no URL: source stands for the host (who published it), lang for the path (a part of that source)."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(dealt(spark, sf_dir, "documents"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(dealt(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op4_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.histogram(dealt(spark, sf_dir, "documents"), tokenizer_path())
    return token_counts.summary(Scratch(spark, "lengths").table(lengths, "histogram"))  # read more than once


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(dealt(spark, sf_dir, "documents")).drop("found")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents")).drop("languages")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents").select("doc_id", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_quality_rules": op2_quality_rules,
        "op3_bpe_round_trip": op3_bpe_round_trip,
        "op4_ball_tree_top_k": op4_ball_tree_top_k,
        "op5_ngram_join": op5_ngram_join,
        "op6_token_counts": op6_token_counts,
        "op7_pii": op7_pii,
        "op8_line_dedup": op8_line_dedup,
        "op9_language_id": op9_language_id,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.SQL,
        "op4_ball_tree_top_k": top_k.SQL,
    }
