"""Exact nearest neighbours by L2 distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATES = 50
#: With filters, which come after the fetch, more candidates are fetched.
FILTERED_CANDIDATES = 250


def distance(vector: Column, query: list[float]) -> Column:
    """L2 in double precision."""
    q = F.array(*[F.lit(float(x)) for x in query])
    squares = F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def knn(vectors: DataFrame, query: list[float], ties: list, k: int = CANDIDATES, vector: str = "embedding") -> DataFrame:
    """The k nearest rows with their distance. Rows of another dimension take no part; ties go by ``ties``.

    A scan with a bounded heap per task; only heaps are merged.
    """
    rows = vectors.where(F.size(vector) == len(query))
    return rows.withColumn("distance", distance(F.col(vector), query)).orderBy("distance", *ties).limit(k)


def knn_filtered(vectors: DataFrame, query: list[float], ties: list, condition: Column | None, k: int = CANDIDATES, fetch: int = FILTERED_CANDIDATES, vector: str = "embedding") -> DataFrame:
    """Fetches first and filters then, so matches beyond the fetched ones are not found; without a condition as ``knn``."""
    if condition is None:
        return knn(vectors, query, ties, k, vector)
    return knn(vectors, query, ties, fetch, vector).where(condition).orderBy("distance", *ties).limit(k)
