"""BM25 retrieval over texts or over a postings table.

A query is a list of phrases, each a list of terms that follow one another; AND needs every phrase, OR any. Repeated
phrases count repeatedly, occurrences may overlap. Collection statistics cover the whole table, before any filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlode.functions import text as T

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
CANDIDATES = 50


def phrase_count(terms: Column, phrase: list[str]) -> Column:
    """Occurrences of a phrase in an array of terms."""
    if not phrase:
        return F.lit(0)
    if len(phrase) == 1:
        return F.size(terms) - F.size(F.array_remove(terms, phrase[0]))

    def here(term: Column, i: Column) -> Column:
        out = term == phrase[0]
        for k, other in enumerate(phrase[1:], 1):
            out = out & (F.get(terms, i + k) == other)
        return F.coalesce(out, F.lit(False))

    held = F.array_contains(terms, phrase[0]) & F.array_contains(terms, phrase[1])
    return F.when(held, F.size(F.filter(terms, here))).otherwise(0)


def idf(n: Column | float, df: Column) -> Column:
    x = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(x > 0, x).otherwise(F.lit(LEAST_IDF))


def bm25(tfs: list[Column], idfs: list[Column], length: Column, mean: Column) -> Column:
    """Sum over the phrases; higher is better."""
    out = F.lit(0.0)
    for tf, weight in zip(tfs, idfs, strict=True):
        out = out + weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    return out


def rank_texts(docs: DataFrame, key: str, text: str, phrases: list[list[str]], keep: list[str] | None = None, every: bool = True, terms: Callable[[Column], Column] = T.terms) -> DataFrame:
    """(key, *keep, score) of the texts that match; without phrases none. Scores come from one scan for the statistics, which
    keeps a row, and one for the hits; both read the key, the text and ``keep`` only."""
    keep = keep or []
    columns = docs.select(key, *keep, terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    counted = F.struct(F.size("terms").alias("length"), *[phrase_count(F.col("terms"), p).alias(f"tf{k}") for k, p in enumerate(phrases)])
    # A generator of one row: filters on the counts stay above it, and each text is tokenized once.
    narrow = columns.select(key, *keep, F.inline(F.array(counted)))
    if not phrases:
        return narrow.select(key, *keep, F.lit(0.0).alias("score")).limit(0)
    stats = narrow.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(phrases))])
    hit = F.lit(every)
    for k in range(len(phrases)):
        hit = hit & (F.col(f"tf{k}") > 0) if every else hit | (F.col(f"tf{k}") > 0)
    hits = narrow.where(hit).join(F.broadcast(stats))  # one row
    score = bm25([F.col(f"tf{k}") for k in range(len(phrases))], [idf(F.col("n"), F.col(f"df{k}")) for k in range(len(phrases))], F.col("length"), F.col("mean"))
    return hits.select(key, *keep, score.alias("score"))


def top(scored: DataFrame, ties: list, k: int = CANDIDATES) -> DataFrame:
    """The k best rows, ties in the order of ``ties``; a heap per task and one merge, no full sort."""
    return scored.orderBy(F.desc("score"), *ties).limit(k)


def grouped(terms: Column) -> Column:
    """The distinct terms of one text with their positions, by a sort within the row."""
    placed = F.sort_array(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("position"))))
    starts = lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["term"] != F.get(x, i - 1)["term"]))
    run = lambda x, s, i, k: F.slice(x, i + 1, F.coalesce(F.get(s, k + 1), F.size(x)) - i)
    # Lambdas over one-element arrays stand for local names, so that the sort is not repeated.
    held = F.transform(F.array(placed), lambda x: F.struct(x.alias("x"), F.when(F.size(x) > 0, starts(x)).otherwise(F.array().cast("array<int>")).alias("s")))
    out = F.transform(held, lambda h: F.transform(h["s"], lambda i, k: F.struct(F.get(h["x"], i)["term"].alias("term"), F.transform(run(h["x"], h["s"], i, k), lambda p: p["position"]).alias("positions"))))
    return F.get(out, 0)


def postings(chunks: DataFrame, text: str, terms: Callable[[Column], Column] = T.terms, keep: tuple[str, ...] = ()) -> DataFrame:
    """(term, id, *keep, positions): one row per term and chunk. A chunk's row holds all its tokens, so nothing is shuffled."""
    rows = chunks.select("id", *keep, F.explode(grouped(terms(F.col(text)))).alias("p"))
    return rows.select("p.term", "id", *keep, "p.positions")


def _listed(batch: pa.RecordBatch, tokens: str) -> pa.RecordBatch:
    """The postings of a batch of texts: one sort of (text, term) for all of them."""
    lists, keep = batch.column(tokens), [c for c in batch.schema.names if c != tokens]
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    code = flat.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    key = row * max(len(flat.dictionary), 1) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    place = (np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row])[order].astype(np.int32)
    held, at = pa.array(row[order[first]]), pa.array(code[order[first]])
    lengths = pa.array(sizes.astype(np.int32)).take(held)
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(place))
    return pa.RecordBatch.from_arrays([flat.dictionary.take(at), *[batch.column(c).take(held) for c in keep], lengths, positions], ["term", *keep, "length", "positions"])


def listed(chunks: DataFrame, tokens: str, batch: int = 512) -> DataFrame:
    """As ``postings`` for a column of tokens, with their number (length); slices of ``batch`` texts are grouped at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, batch):
                yield _listed(b.slice(start, batch), tokens)

    keep = [f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields if f.name != tokens]
    return chunks.mapInArrow(run, ", ".join(["term string", *keep, "length int", "positions array<int>"]))


def _phrase_hits(table: DataFrame, phrase: list[str], name: str) -> DataFrame:
    """(id, *columns, name): occurrences of one phrase. The filter on terms reaches the scan; only listed chunks are shuffled."""
    rows = table.where(F.col("term").isin(*phrase))
    columns = [c for c in table.columns if c not in ("term", "id", "positions")]
    if len(phrase) == 1:
        return rows.select("id", *columns, F.size("positions").alias(name))
    starts = rows.groupBy("id").agg(*[F.any_value(c).alias(c) for c in columns], F.collect_list(F.struct("term", "positions")).alias("lists"))
    at = lambda term: F.element_at(F.filter("lists", lambda x: x["term"] == term)["positions"], 1)
    held = F.transform(at(phrase[0]), lambda p: p)
    for k, term in enumerate(phrase[1:], 1):
        held = F.array_intersect(held, _shifted(at(term), k))
    return starts.where(F.size("lists") == len(set(phrase))).select("id", *columns, F.size(held).alias(name)).where(F.col(name) > 0)


def _shifted(positions: Column, k: int) -> Column:
    return F.transform(positions, lambda p: p - k)


def rank_postings(table: DataFrame, phrases: list[list[str]], n: int, mean: float, every: bool = True, condition: Column | None = None) -> DataFrame:
    """(id, *columns, score) from a postings table: rows (term, id, positions, length, *columns), where length and columns are
    the chunk's. n and mean cover the table.

    ``condition`` filters after the scores are fixed and before any cut.
    """
    columns = [c for c in table.columns if c not in ("term", "id", "positions", "length")]
    tables = {tuple(p): _phrase_hits(table, p, f"tf{k}") for k, p in reversed(list(enumerate(phrases))) if p}
    if not n or not mean or not tables or (every and any(not p for p in phrases)):
        return table.select("id", *columns, F.lit(0.0).alias("score")).limit(0)
    hits, names = None, {}
    for key, found in tables.items():
        names[key] = name = found.columns[-1]
        if hits is None:
            hits = found
        elif every:
            hits = hits.join(found.select("id", name), "id")
        else:
            both = [F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in ("length", *columns)]
            old = [F.col(f"l.{c}") for c in hits.columns if c.startswith("tf")]
            hits = hits.alias("l").join(found.alias("r"), "id", "full").select("id", *both, *old, F.col(f"r.{name}"))
    for key, found in tables.items():
        hits = hits.join(F.broadcast(found.agg(F.count("*").alias(names[key].replace("tf", "df")))))  # one row
    used = [names[tuple(p)] for p in phrases if p]
    score = bm25([F.coalesce(F.col(t), F.lit(0)) for t in used], [idf(F.lit(float(n)), F.col(t.replace("tf", "df"))) for t in used], F.col("length"), F.lit(float(mean)))
    rows = hits.withColumn("score", score)
    if condition is not None:
        rows = rows.where(condition)
    return rows.select("id", *columns, "score")


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """(n_docs, avg_length, n_terms) of a table of texts."""
    rows = docs.select(T.terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    return rows.agg(F.count("*").alias("n_docs"), F.avg(F.size("terms")).alias("avg_length"), F.sum(F.size("terms")).alias("n_terms"))


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term; the counts combine before the shuffle."""
    terms = T.terms(F.coalesce(F.col(text), F.lit("")))
    # Terms in order, each with a mark on its first occurrence in the row; marks and occurrences are added up before the shuffle.
    rows = docs.select(F.sort_array(terms).alias("terms"))
    marked = F.transform("terms", lambda t, i: F.struct(t.alias("term"), F.when(F.coalesce(F.get(F.col("terms"), i - 1) == t, F.lit(False)), 0).otherwise(1).alias("first")))
    return rows.select(F.inline(marked)).groupBy("term").agg(F.sum("first").alias("df"), F.count("*").alias("cf"))

