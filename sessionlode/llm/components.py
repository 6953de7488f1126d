"""Connected components by alternating large-star and small-star steps, on the executors only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlode.llm.scratch import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v. Large: bigger neighbours move to the least one; small: smaller ones do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u > v").distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v, of one integer type); component is the least node reached.

    Loops, repeated edges and edges with a null end are ignored; no edges give no rows. Each step shuffles the edges once
    on a node, after map-side minima; the steps are about logarithmic in the length of the longest chain.
    """
    new = lambda df: scratch.table(df, f"edges-{uuid.uuid4().hex}")
    now = new(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(mark) == state or not mark[0]:
            break
        state = tuple(mark)
        now = new(_stars(_stars(now, True), False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
