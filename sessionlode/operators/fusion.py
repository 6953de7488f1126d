"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(candidates: DataFrame, order: list, source: int) -> DataFrame:
    """A candidate list with its ranks from 1. Lists hold some dozens of rows, so one task ranks them."""
    return candidates.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("source", F.lit(source))


def merge(lists: list[DataFrame], key: str, columns: list[str], limit: int, time: str | None = "time_created", k: int = RRF_K) -> DataFrame:
    """(key, *columns, score): the sum of 1 / (k + rank) over the lists, best first, then newest, then by key.

    Columns come from the richest row: one with a command, then one with a snippet, then that of the earliest list.
    """
    union = lists[0]
    for other in lists[1:]:
        union = union.unionByName(other)
    rich = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", 0).otherwise(1)
    preference = F.struct(*[rich(c) for c in ("command", "snippet") if c in columns], F.col("source"))
    score = F.aggregate(F.sort_array(F.collect_list(F.struct("source", (1.0 / (k + F.col("rank"))).alias("x")))), F.lit(0.0), lambda s, x: s + x["x"])
    rows = union.groupBy(key).agg(score.alias("score"), F.min_by(F.struct(*columns), preference).alias("row")) if columns else union.groupBy(key).agg(score.alias("score"))
    rows = rows.select(key, *[F.col(f"row.{c}").alias(c) for c in columns], "score")
    order = [F.desc("score"), *([F.desc(time)] if time and time in columns else []), F.col(key)]
    return rows.orderBy(*order).limit(limit)
