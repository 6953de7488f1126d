"""Embedding: a client, batches with retries, and a cache table."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 64
ATTEMPTS = 3
TIMEOUT_S = 180
PING_TIMEOUT_S = 3


class Embedder(Protocol):
    """Runs on the executors, so it must be picklable."""

    dim: int
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class EmbeddingError(RuntimeError):
    pass


class HttpEmbedder:
    """POST <url>/api/embed {model, input, keep_alive} -> {embeddings}."""

    def __init__(self, url: str, model: str, dim: int, keep_alive: str = "10m", sleep: Callable[[float], None] = time.sleep):
        self.url, self.model, self.dim, self.keep_alive, self.sleep = url.rstrip("/"), model, dim, keep_alive, sleep

    def ping(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.url}/api/tags", timeout=PING_TIMEOUT_S) as answer:
                return answer.status == 200
        except OSError:
            return False

    def _post(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts, "keep_alive": self.keep_alive}).encode()
        request = urllib.request.Request(f"{self.url}/api/embed", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
            return json.load(answer)["embeddings"]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return with_retries(self._post, texts, self.sleep)


def with_retries(post: Callable[[list[str]], list[list[float]]], texts: list[str], sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Up to three attempts, with a longer pause after each failure; as many vectors as texts or an error."""
    last: Exception | None = None
    for attempt in range(1, ATTEMPTS + 1):
        try:
            out = post(texts)
            if len(out) != len(texts):
                raise EmbeddingError(f"{len(out)} vectors for {len(texts)} texts")
            return out
        except Exception as error:
            last = error
            sleep(attempt)
    raise EmbeddingError(f"no embeddings after {ATTEMPTS} attempts: {last}") from last


def embed_query(embedder: Embedder | None, text: str) -> list[float]:
    """One vector, or an error that names what is wrong."""
    if embedder is None:
        raise EmbeddingError("no embedder")
    out = embedder.embed([text])
    if not out or not out[0]:
        raise EmbeddingError("empty embedding")
    if len(out[0]) != embedder.dim:
        raise EmbeddingError(f"dimension mismatch: {len(out[0])} instead of {embedder.dim}")
    return out[0]


def cache_key(text: Column) -> Column:
    """Hex of the first 16 bytes of SHA-256. The model is not part of it: a cache belongs to one model."""
    return F.substring(F.sha2(text, 256), 1, 32)


def embed_table(rows: DataFrame, embedder: Embedder, batch: int = BATCH, pause_s: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(id, embedding) for rows (id, text). An executor sends batches of ``batch`` texts; a wrong count or dimension fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = embedder.embed(part["text"].tolist())
                if len(vectors) != len(part) or any(len(v) != embedder.dim for v in vectors):
                    raise EmbeddingError("wrong number or dimension of vectors")
                yield pd.DataFrame({"id": part["id"].tolist(), "embedding": [list(map(float, v)) for v in vectors]})
            if pause_s:
                sleep(pause_s)

    return rows.select("id", "text").mapInPandas(run, "id string, embedding array<float>")


def embed_cached(rows: DataFrame, cache: DataFrame | None, embedder: Embedder, pause_s: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """((id, embedding) of all rows, (key, embedding) new to the cache). A vector of another dimension or none is a miss.

    Equal texts are embedded once.
    """
    keyed = rows.select("id", "text", cache_key(F.col("text")).alias("key"))
    misses = keyed.dropDuplicates(["key"])
    if cache is not None:
        known = cache.where(F.size("embedding") == embedder.dim)
        misses = misses.join(known, "key", "left_anti")
    fresh = embed_table(misses.select(F.col("key").alias("id"), "text"), embedder, pause_s=pause_s).withColumnRenamed("id", "key")
    every = fresh if cache is None else known.select("key", "embedding").unionByName(fresh)
    return keyed.join(every, "key").select("id", "embedding"), fresh


class EmbeddingCache:
    """A table of (key, embedding) under a path; one for each model, as the key does not name it.

    New vectors are appended before they are used, so what was embedded once is never embedded again, even if the run that
    needed it dies. Entries of one key are equal; the first read counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        schema = "key string, embedding array<float>"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).dropDuplicates(["key"])

    def embedded(self, rows: DataFrame, embedder: Embedder, pause_s: float = 0.0) -> DataFrame:
        """(id, embedding) of the rows (id, text); what was missing is in the cache afterwards."""
        embed_cached(rows, self.entries(), embedder, pause_s)[1].write.mode("append").parquet(self.path)
        keyed = rows.select("id", cache_key(F.col("text")).alias("key"))
        return keyed.join(self.entries().where(F.size("embedding") == embedder.dim), "key").select("id", "embedding")
