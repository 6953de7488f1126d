"""From raw documents to tokens: quality rules, line dedup, near-duplicate removal, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; the last gives each row its place in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlode.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from sessionlode.llm.queries import tokenizer_path
from sessionlode.llm.scratch import Scratch

#: Near duplicates: five-word shingles with a Jaccard similarity of 0.8 or more.
SHINGLE, NUM, DEN = 5, 8, 10


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, if the table has it, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that lose too much or fail the base rules."""
    return _counted(quality_rules.clean(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go, and documents that consist of such lines only."""
    return _counted(line_dedup.dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays; documents without a doc_id all stay, and of rows
    that repeat a doc_id all or none."""
    linked = ngram_join.link(docs, width=SHINGLE, num=NUM, den=DEN)
    return docs.join(linked.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix. Tables that are read again lose the order; ``tokens`` gives the places again."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """mix_position, doc_id, n_tokens and the digests of the token ids and of the text decoded from them, in the order of
    the mix. The places are those of ``mixed``, which depend on the documents alone, not on the order they are read in.
    """
    columns = ["n_tokens", "ids_sha256", "decoded_sha256"]
    coded = bpe.round_trip(docs.select("doc_id", "source", "text", mixing.tied(docs).alias("tie")), tokenizer_path())
    coded = Scratch(spark, "tokens").table(coded, "coded", wide=True)  # read more than once
    return mixing.schedule(coded, tie="tie").orderBy("mix_position").select("mix_position", "doc_id", *columns)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]
#: SQL can express neither the schedule of the mix nor the merges of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage-{k}", wide=True)
            scratch.keep_only(f"stage-{k}")
    return docs
