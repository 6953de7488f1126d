"""Hybrid search: two full-text lists, one vector list, one second lexical list, fused by rank."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlode.functions import text as T
from sessionlode.functions.stemmer import stem_word
from sessionlode.operators import fulltext, fusion, vectors
from sessionlode.plans.index import Index
from sessionlode.sources.embedder import Embedder, EmbeddingError, embed_query

DEFAULT_LIMIT, MOST = 20, 50
COLUMNS = ["session_id", "project_path", "role", "part_type", "tool", "command", "snippet", "position", "time_created"]


@dataclass(frozen=True)
class Query:
    text: str
    project: str = ""
    type: str = ""
    time_from: int = 0
    limit: int = 0


@dataclass
class Result:
    results: list[dict] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    degraded: bool = True
    note: str = ""


class SearchError(ValueError):
    pass


def condition(query: Query, from_zero: bool = True) -> Column | None:
    """The filters that are set; none if none is. A negative time only counts ``from_zero``."""
    out = None
    parts = [F.col("project_path") == query.project] if query.project else []
    parts += [F.col("part_type") == query.type] if query.type else []
    parts += [F.col("time_created") >= query.time_from] if (query.time_from != 0 if from_zero else query.time_from > 0) else []
    for p in parts:
        out = p if out is None else out & p
    return out


class Searcher:
    """Sources that fail are noted and left out; only if all fail the search does."""

    def __init__(self, index: Index, embedder: Embedder | None = None, lexical: bool = True):
        self.index, self.embedder, self.lexical = index, embedder, lexical

    _ties = ["session_id", "position"]

    def _fts(self, name: str, phrases: list[list[str]], query: Query, k: int = fulltext.CANDIDATES) -> DataFrame:
        n, mean = self.index.stats(name)
        scored = fulltext.rank_postings(self.index.postings(name), phrases, n, mean, condition=condition(query))
        return fulltext.top(scored, self._ties, k)

    def _vector(self, query: Query) -> DataFrame:
        vector = embed_query(self.embedder, query.text)
        return vectors.knn_filtered(self.index.vectors(), vector, self._ties, condition(query)).withColumn("score", -F.col("distance"))

    def _lexical(self, query: Query) -> DataFrame:
        """Any word, in the stemmed or the plain form; the second analyzer has no digits."""
        k = min(query.limit, fulltext.CANDIDATES) if query.limit > 0 else fulltext.CANDIDATES
        found = None
        words = T.query_words(query.text)
        plain = [w for x in words for w in "".join(c if c.isalpha() else " " for c in x).split()]
        for name, terms in (("lex_stem", [stem_word(w) for w in words]), ("lex_simple", plain)):
            n, mean = self.index.stats(name)
            rows = fulltext.rank_postings(self.index.postings(name), [[t] for t in terms], n, mean, every=False, condition=condition(query, False))
            found = rows if found is None else found.unionByName(rows)
        keys = [c for c in found.columns if c != "score"]
        return fulltext.top(found.groupBy(*keys).agg(F.sum("score").alias("score")), self._ties, k)

    def search(self, query: Query) -> Result:
        if T.blank(query.text):
            raise SearchError("the query is empty")
        limit = min(query.limit if query.limit > 0 else DEFAULT_LIMIT, MOST)
        out, lists, notes = Result(), [], []
        sources = [
            ("fts_unicode", lambda: self._fts("fts_unicode", T.phrases(query.text), query)),
            ("fts_stem", lambda: self._fts("fts_stem", T.phrases(query.text, stem_word), query)),
            ("vector", lambda: self._vector(query)),
        ]
        if self.lexical:
            sources.append(("bleve", lambda: self._lexical(query)))
        for name, run in sources:
            try:
                if name == "bleve" and not self.index.has_lexical():
                    raise SearchError("no second lexical index")
                rows = [(r["id"], k) for k, r in enumerate(run().select("id", "score").collect(), 1)]  # some dozens at most
            except (SearchError, EmbeddingError, OSError, PySparkException) as error:  # what is wrong in the program is not a source's failure
                notes.append(f"{name}: {str(error).splitlines()[0][:200]}")
                continue
            out.sources.append(name)
            lists.append((len(lists), rows))
        if not lists:
            raise SearchError("all sources failed: " + "; ".join(notes))
        if not self.lexical:
            notes.append("bleve: not configured")
        out.degraded = not {"vector", "bleve"} <= set(out.sources)
        out.note = "; ".join(notes)
        out.results = self._merge(lists, limit)
        return out

    def _merge(self, lists: list[tuple[int, list[tuple[str, int]]]], limit: int) -> list[dict]:
        ranks = [(i, source, rank) for source, rows in lists for i, rank in rows]
        if not ranks:
            return []
        spark = self.index.spark
        wide = self.index.chunks().where(F.col("id").isin(sorted({i for i, _, _ in ranks}))).withColumnRenamed("msg_role", "role")
        wide = wide.select("id", *[F.coalesce(c, F.lit("")).alias(c) if c in ("tool", "command") else F.col(c) for c in COLUMNS])
        candidates = F.broadcast(spark.createDataFrame(ranks, "id string, source int, rank int")).join(wide, "id")
        rows = fusion.merge([candidates], "id", COLUMNS, limit)
        return [r.asDict() for r in rows.collect()]
