"""Token counts from one exact length histogram.

Documents are counted by encoded length. Suffix sums over the histogram then answer, for every context limit at once, how
many documents and tokens lie beyond it and how many tokens are left if each document is cut there; running sums answer
quantiles. Suffix sums go in two levels, within ranges of lengths and over the ranges, so no task sorts all lengths.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlode.llm import bpe

#: Lengths in a range. The windows over all ranges have a row each: no more than the longest text has tokens / RANGE.
RANGE = 128


def histogram(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length of their whole texts, however long. Null and empty texts have length
    0; repeated rows count each. Other columns, whatever their names, are not looked at. An empty table gives an empty
    result."""
    return bpe.count(docs.select(F.col(f"`{text}`").alias("text")), path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def summary(lengths: DataFrame) -> DataFrame:
    """For each length L of the histogram (n_tokens, n_docs), with all sums exact:

    docs_from, tokens_from: documents of at least L tokens and their tokens; truncated_tokens: tokens left if documents are
    cut at L; docs_upto: documents of at most L tokens; quantile: their share of all documents, the only figure that is not a
    whole number.
    """
    own = lengths.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / RANGE).alias("range"))
    ranges = own.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    beyond = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("d").over(beyond), F.lit(0)).alias("docs_beyond"), F.coalesce(F.sum("t").over(beyond), F.lit(0)).alias("tokens_beyond"), F.sum("d").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_docs"), F.sum("t").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_tokens"))
    down = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = own.withColumn("docs_from", F.sum("n_docs").over(down)).withColumn("tokens_from", F.sum("tokens").over(down)).join(ranges, "range")
    docs_from, tokens_from = F.col("docs_from") + F.col("docs_beyond"), F.col("tokens_from") + F.col("tokens_beyond")
    upto = F.col("all_docs") - docs_from + F.col("n_docs")
    return rows.select(
        "n_tokens",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("all_tokens") - tokens_from + F.col("n_tokens") * docs_from).alias("truncated_tokens"),
        upto.alias("docs_upto"),
        (upto / F.col("all_docs")).alias("quantile"),
    )


def at_limits(lengths: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, tokens_total, tokens_kept, tokens_lost) for each limit, from the histogram alone."""
    spark = lengths.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    sums = [F.struct(F.lit(int(x)).cast("long").alias("limit"), F.sum(F.when(F.col("n_tokens") > int(x), F.col("n_docs")).otherwise(0)).alias("over"), F.sum(F.least(F.col("n_tokens"), F.lit(int(x))) * F.col("n_docs")).alias("kept")) for x in limits]
    made = lengths.agg(F.array(*sums).alias("s"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("total")).select(F.explode("s").alias("s"), "total")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return asked.join(made, F.col("context_limit") == F.col("s.limit")).select("context_limit", zero(F.col("s.over")).alias("docs_over"), zero(F.col("total")).alias("tokens_total"), zero(F.col("s.kept")).alias("tokens_kept"), (zero(F.col("total")) - zero(F.col("s.kept"))).alias("tokens_lost"))


def quantiles(lengths: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that this share of the documents does not exceed; without documents null.

    Shares count as the decimal fractions that they are written as, and are compared in whole numbers: n documents reach
    num / den if n * den >= num * all.
    """
    rows = summary(lengths)
    wide = lambda c: c.cast("decimal(19,0)")
    every = wide(F.col("docs_from") + F.col("docs_upto") - F.col("n_docs"))
    asked = [Fraction(str(x)) for x in shares]
    reached = lambda f: wide(F.col("docs_upto")) * F.lit(f.denominator).cast("decimal(19,0)") >= every * F.lit(f.numerator).cast("decimal(19,0)")
    found = [F.struct(F.lit(float(x)).alias("share"), F.min(F.when(reached(f), F.col("n_tokens"))).alias("n_tokens")) for x, f in zip(shares, asked, strict=True)]
    return rows.agg(F.array(*found).alias("q")).select(F.inline("q"))
