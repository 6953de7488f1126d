"""Registered queries that go through the engine: an index is built from conversations, searched, and read by the tools.

Conversations become a history with parts of all types. Indexes lie in the session's shared folder and are built once a
session and table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlode import cli, schemas
from sessionlode.functions import text as T
from sessionlode.functions.stemmer import stem, stem_text, stem_word
from sessionlode.plans.index import POSTINGS, Index, Stats
from sessionlode.plans.registry import query, table
from sessionlode.plans.search import Query, Searcher
from sessionlode.plans.tools import Tools, as_int, as_text
from sessionlode.sources import parts as P
from sessionlode.sources.embedder import EmbeddingCache, EmbeddingError
from sessionlode.sources.history import History
from sessionlode.sources.tables import shared_dir

WORDS, SESSION, POSITION = "with from", "7", 3
FILTERED = Query("with", project="/alpha", type="tool", time_from=1000)
LETTERS = "etao"


class LetterCounts:
    """Embeds a text as how often it has each of four letters."""

    dim, model = len(LETTERS), "letters"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(c)) for c in LETTERS] for t in texts]


class Down(LetterCounts):
    """A service that does not answer."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise EmbeddingError("no service")


def mixed_history(conversations: DataFrame) -> History:
    """A message a turn, with a text part and, by turn and role, tool, reasoning, patch, compaction, step and broken parts.
    Conversations belong to two projects or to none."""
    spark = conversations.sparkSession
    sid, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    mid, time = F.concat_ws(":", sid, turn), F.col("turn").cast("long") * 1000
    lit = F.lit
    payload = lambda kind, *fields: F.to_json(F.struct(lit(kind).alias("type"), *fields))
    state = F.struct(lit("completed").alias("status"), F.struct(F.concat(lit("turn "), turn).alias("command")).alias("input"), F.concat("text", "text", "text").alias("output"))
    kinds = [
        (lit(True), payload("text", F.concat(lit(" \t"), "text", lit("\n ")).alias("text"))),
        (F.col("role") == "assistant", payload("tool", lit("fetch").alias("tool"), lit("c").alias("callID"), state.alias("state"))),
        (F.col("turn") % 3 == 1, payload("reasoning", F.concat(lit("about "), "text").alias("text"))),
        (F.col("turn") % 5 == 0, payload("patch", lit("h").alias("hash"), F.array(F.concat(lit("/a/"), turn, lit(".py")), F.concat(lit("/b/"), sid, lit(".txt"))).alias("files"))),
        (F.col("role") == "system", payload("compaction", lit(True).alias("auto"), mid.alias("tail_start_id"))),
        (F.col("turn") % 2 == 0, payload("step-start")),
        (F.col("turn") % 7 == 6, payload("text", lit(5).alias("text"))),
    ]
    every = F.filter(F.array(*[F.when(c, F.struct(lit(k).alias("k"), d.alias("data"))) for k, (c, d) in enumerate(kinds)]), lambda x: x.isNotNull())
    times = [time.alias("time_created"), time.alias("time_updated")]
    message = conversations.select(mid.alias("id"), sid.alias("session_id"), *times, F.to_json(F.struct("role")).alias("data"))
    part = conversations.select(mid.alias("message_id"), sid.alias("session_id"), *times, "turn", F.explode(every).alias("x")).select(
        F.concat_ws(":", lit("p"), "message_id", F.col("x.k").cast("string")).alias("id"), "message_id", "session_id", "time_created", "time_updated", F.col("x.data").alias("data"), (F.col("turn").cast("long") * 10 + F.col("x.k")).alias("ord"),
    )
    none = lit("")
    session = conversations.groupBy("conv_id").agg(F.min(time).alias("time_created"), F.max(time).alias("time_updated")).select(
        sid.alias("id"), F.concat(lit("p"), (F.col("conv_id") % 3).cast("string")).alias("project_id"), none.alias("slug"), none.alias("directory"), F.concat(lit("conversation "), sid).alias("title"), none.alias("version"),
        F.when(F.col("conv_id") % 2 == 0, "build").alias("agent"), lit('{"id":"m1","providerID":"v1"}').alias("model"), "time_created", "time_updated", lit(None).cast("long").alias("time_archived"),
    )
    project = spark.createDataFrame([("p0", "/alpha", None, None), ("p1", "/beta", None, None)], schemas.PROJECT)
    return History(project, session, message, part)


_built: dict[tuple, tuple] = {}


def history(spark: SparkSession, sf_dir: str) -> History:
    """The history alone, for what reads no index."""
    return mixed_history(table(spark, sf_dir, "conversations"))


def new_index(spark: SparkSession, model: str = LetterCounts.model) -> Index:
    return Index.open(spark, f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}", LetterCounts.dim, model)


def built(spark: SparkSession, sf_dir: str) -> tuple[History, Index, Stats, Stats]:
    """The history, its index, and the counters of the run that made it and of one more."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        h, index = mixed_history(table(spark, sf_dir, "conversations")), new_index(spark)
        first = index.run(h, embedder=LetterCounts())
        _built[key] = h, index, first, index.run(h, embedder=LetterCounts())
    return _built[key]


def _tool_part(h: History) -> str:
    """The id of a tool part: the first of SESSION, or else the least of all; empty if there is none."""
    tools = lambda parts: parts.where(P.type_of(P.parse(F.col("data"))) == "tool")
    own = tools(h.part.where(F.col("session_id") == SESSION)).orderBy("ord", "id").limit(1).collect()
    return own[0]["id"] if own else tools(h.part).agg(F.min("id")).first()[0] or ""


def rows(spark: SparkSession, data: list, schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


#: The same history, its chunks, and their tokens by source, in SQL.
_TRIMMED = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
_PARTS = """
c AS (SELECT conv_id, turn, role, text, conv_id::VARCHAR AS session_id, conv_id || ':' || turn AS mid,
  CASE conv_id % 3 WHEN 0 THEN '/alpha' WHEN 1 THEN '/beta' ELSE '(global)' END AS project_path FROM conversations),
parts AS (SELECT c.*, k, kind, 'p:' || mid || ':' || k AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1)::INT AS position, (turn * 1000)::BIGINT AS time_created
  FROM c, (VALUES (0, 'text'), (1, 'tool'), (2, 'reasoning'), (3, 'patch'), (4, 'compaction'), (5, 'step-start'), (6, 'text')) v(k, kind)
  WHERE k = 0 OR k = 1 AND role = 'assistant' OR k = 2 AND turn % 3 = 1 OR k = 3 AND turn % 5 = 0 OR k = 4 AND role = 'system' OR k = 5 AND turn % 2 = 0 OR k = 6 AND turn % 7 = 6)"""
_CHUNKS = f"""{_PARTS},
chunks AS (SELECT * FROM (SELECT *, kind AS part_type, CASE k WHEN 0 THEN {_TRIMMED.format("text")} WHEN 1 THEN 'fetch: turn ' || turn || chr(10) || left(text || text || text, 4096)
  WHEN 2 THEN {_TRIMMED.format("'about ' || text")} WHEN 3 THEN '/a/' || turn || '.py' || chr(10) || '/b/' || conv_id || '.txt' END AS content FROM parts WHERE k < 4) WHERE content <> '')"""
_FROM, _TO = T.plain_letters()
_FOLDED = f"regexp_replace(translate(replace(lower({{}}), 'ς', 'σ'), '{_FROM}', '{_TO}'), '[{T.DROPPED_MARKS}]', '', 'g')"
_WORDS = r"regexp_extract_all(lower(content), '[\p{L}\p{Nd}_]+')"
#: Latin words are their own stems, so the stemmed text is the words with a space between.
TOKENS = {
    "fts_unicode": rf"regexp_extract_all({_FOLDED.format('content')}, '[\p{{L}}\p{{N}}\p{{Co}}]+')",
    "fts_stem": rf"regexp_extract_all({_FOLDED.format(f"array_to_string({_WORDS}, ' ')")}, '[\p{{L}}\p{{N}}\p{{Co}}]+')",
    "lex_stem": _WORDS,
    "lex_simple": r"regexp_extract_all(lower(content), '\p{L}+')",
}
_EMBEDDED = "coalesce(CASE WHEN part_type IN ('text', 'tool') THEN left(content, 6000) END, '')"
_VECTOR = "[" + ", ".join(f"length(e) - length(replace(e, '{x}', ''))" for x in LETTERS) + "]"


@query(f"""
WITH {_CHUNKS}, s AS (SELECT *, CASE k WHEN 3 THEN replace(content, chr(10), ', ') ELSE content END AS shown FROM chunks)
SELECT id, session_id, project_path, mid AS message_id, role AS msg_role, part_type, CASE WHEN k = 1 THEN 'fetch' ELSE '' END AS tool, CASE WHEN k = 1 THEN 'turn ' || turn ELSE '' END AS command,
  sha256(content) AS content_sha, CASE WHEN k = 3 THEN 'patch: ' ELSE '' END || CASE WHEN length(shown) > 300 THEN left(shown, 300) || '...' ELSE shown END AS snippet, coalesce(len(CASE WHEN k = 3 THEN string_split(content, chr(10)) END), -1)::INT AS n_files,
  position, time_created, k = 1 AND 3 * length(text) > 4096 AS truncated, sha256({_EMBEDDED}) AS embed_sha FROM s""")
def index_chunks(spark, sf):
    """Chunks of parts of all types as the index holds them."""
    chunks = built(spark, sf)[1].chunks()
    return chunks.select(
        "id", "session_id", "project_path", "message_id", "msg_role", "part_type", "tool", "command", F.sha2("content", 256).alias("content_sha"), "snippet", F.coalesce(F.size("files"), F.lit(-1)).alias("n_files"),
        "position", "time_created", F.coalesce("truncated", F.lit(False)).alias("truncated"), F.sha2(F.coalesce("embed_text", F.lit("")), 256).alias("embed_sha"),
    )


@query(f"""
WITH {_CHUNKS}, n AS (SELECT count(DISTINCT conv_id) AS s FROM conversations), k AS (SELECT count(*) AS n, count(*) FILTER ({_EMBEDDED} <> '') AS v FROM chunks)
SELECT 1 AS run, s AS sessions, s AS indexed, 0::BIGINT AS skipped, 0::BIGINT AS failed, k.n AS chunks, v AS embedded, 0::BIGINT AS pending FROM n, k
UNION ALL SELECT 2, s, 0, s, 0, 0, 0, 0 FROM n""")
def index_run(spark, sf):
    """Counters of a run and of another one after it."""
    _, _, first, second = built(spark, sf)
    data = [(k, s.sessions, s.indexed, s.skipped, s.failed, s.chunks, s.embedded, s.pending) for k, s in ((1, first), (2, second))]
    return rows(spark, data, "run int, sessions long, indexed long, skipped long, failed long, chunks long, embedded long, pending long")


@query(f"""
WITH {_PARTS}, t AS (SELECT conv_id, count(*) AS parts_count, count(*) FILTER (k < 4) AS chunks_count, bool_or(k = 4) AS compacted, coalesce(arg_max(mid, position) FILTER (k = 4), '') AS tail_start_id FROM parts GROUP BY conv_id)
SELECT conv_id::VARCHAR AS id, 'conversation ' || conv_id AS title, project_path, CASE WHEN conv_id % 2 = 0 THEN 'build' ELSE '' END AS agent, min(turn)::BIGINT * 1000 AS time_created, max(turn)::BIGINT * 1000 AS time_updated,
  any_value(compacted) AS compacted, any_value(tail_start_id) AS tail_start_id, any_value(parts_count) AS parts_count, any_value(chunks_count) AS chunks_count FROM c JOIN t USING (conv_id) GROUP BY conv_id, project_path""")
def index_sessions(spark, sf):
    """Session metadata: project, counts, compaction."""
    return built(spark, sf)[1].sessions().select("id", "title", "project_path", "agent", "time_created", "time_updated", "compacted", "tail_start_id", "parts_count", "chunks_count")


@query("SELECT conv_id::VARCHAR AS session_id, 'indexed' AS status, max(turn)::BIGINT * 1000 AS last_time_updated, '' AS error FROM conversations GROUP BY conv_id")
def index_state(spark, sf):
    return built(spark, sf)[1].state().select("session_id", "status", "last_time_updated", "error")


_POSTINGS = " UNION ALL ".join(f"SELECT '{x}' AS source, id, unnest({t}) AS term FROM chunks" for x, t in TOKENS.items())


@query(f"WITH {_CHUNKS}, p AS ({_POSTINGS}) SELECT source, term, count(DISTINCT id) AS df, count(*) AS cf FROM p GROUP BY source, term")
def index_postings(spark, sf):
    """The vocabulary of each source with its frequencies, from the postings."""
    index = built(spark, sf)[1]
    parts = [index.postings(x).groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("cf")).select(F.lit(x).alias("source"), "term", "df", "cf") for x in POSTINGS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_TOTALS = " UNION ALL ".join(f"SELECT '{x}' AS source, count(*) AS n, round(avg(len({t})), 6) AS mean FROM chunks" for x, t in TOKENS.items())


@query(f"WITH {_CHUNKS} {_TOTALS}")
def index_totals(spark, sf):
    """What the manifest says of each source: live chunks, and their mean number of terms."""
    index = built(spark, sf)[1]
    return rows(spark, [(x, index.stats(x)[0], round(index.stats(x)[1], 6)) for x in POSTINGS], "source string, n long, mean double")


@query(f"WITH {_CHUNKS}, v AS (SELECT id, session_id, position, {_EMBEDDED} AS e FROM chunks WHERE {_EMBEDDED} <> '') SELECT id, session_id, position, list_transform({_VECTOR}, lambda x: x::DOUBLE) AS embedding FROM v")
def index_vectors(spark, sf):
    return built(spark, sf)[1].vectors().select("id", "session_id", "position", F.col("embedding").cast("array<double>").alias("embedding"))


# Upkeep: sessions of a third of all conversations come later, and one project's conversations come anew, one turn longer.


def _early(conversations: DataFrame) -> DataFrame:
    last = conversations.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return conversations.join(last, "conv_id").where((F.col("conv_id") % 3 != 2) & ((F.col("conv_id") % 3 != 1) | (F.col("turn") < F.col("last")))).drop("last")


def outdated(spark: SparkSession, sf: str) -> tuple[Index, History, DataFrame]:
    """(the index of the early conversations, the history of all, its sessions that need a run, as the index is now)."""
    key = (spark.sparkContext.applicationId, sf, "outdated")
    if key not in _built:
        conversations, index = table(spark, sf, "conversations"), new_index(spark)
        index.run(mixed_history(_early(conversations)), embedder=LetterCounts())
        h = mixed_history(conversations)
        _built[key] = index, h, index.needs_indexing(h.session).select(F.col("id").alias("session_id"))
    return _built[key]


def upkept(spark: SparkSession, sf: str) -> tuple[Index, Stats]:
    """The index after a second run, without an embedder, and its counters."""
    key = (spark.sparkContext.applicationId, sf, "upkept")
    if key not in _built:
        index, h, _ = outdated(spark, sf)
        _built[key] = index, index.run(h)
    return _built[key]


@query("""
WITH t AS (SELECT conv_id, max(turn) AS last, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS session_id FROM t WHERE conv_id % 3 = 2 OR conv_id % 3 = 1""")
def index_needs(spark, sf):
    """Sessions without a state, and those updated since."""
    return outdated(spark, sf)[2]


@query(f"WITH {_CHUNKS} SELECT session_id, count(*) AS n, count(DISTINCT id) AS ids, max(position) AS last, sum(length(content))::BIGINT AS chars FROM chunks GROUP BY session_id")
def index_replaced(spark, sf):
    """After the second run each session has its new rows, once."""
    return upkept(spark, sf)[0].chunks().groupBy("session_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max("position").alias("last"), F.sum(F.length("content")).alias("chars"))


@query(f"""
WITH {_CHUNKS}, n AS (SELECT count(DISTINCT conv_id) AS all_sessions, count(DISTINCT conv_id) FILTER (conv_id % 3 <> 0) AS todo FROM conversations),
k AS (SELECT count(*) AS live, count(*) FILTER (conv_id % 3 <> 0) AS fresh, count(*) FILTER (conv_id % 3 = 0 AND {_EMBEDDED} <> '') AS vectors, count(*) FILTER (conv_id % 3 <> 0 AND {_EMBEDDED} <> '') AS pending,
  sum(len({TOKENS["fts_unicode"]}))::BIGINT AS terms FROM chunks)
SELECT todo AS indexed, all_sessions - todo AS skipped, fresh AS chunks, live, vectors, pending, terms FROM n, k""")
def index_upkeep(spark, sf):
    """Counters of the second run, which had no embedder; live rows, vectors and pending ones; and the manifest's totals."""
    index, s = upkept(spark, sf)
    n, mean = index.stats("fts_unicode")
    status = index.status()
    return rows(spark, [(s.indexed, s.skipped, s.chunks, n, status["vectors"], status["pending_vectors"], round(n * mean))], "indexed long, skipped long, chunks long, live long, vectors long, pending long, terms long")


@query(f"""
WITH {_CHUNKS}, p AS (SELECT id, session_id, position, {_EMBEDDED} AS e FROM chunks WHERE conv_id % 3 <> 0 AND {_EMBEDDED} <> ''), o AS (SELECT *, row_number() OVER (ORDER BY session_id, position) AS r FROM p)
SELECT id, CASE WHEN r <= 25 THEN 1 ELSE 2 END AS step, list_transform({_VECTOR}, lambda x: x::DOUBLE) AS embedding FROM o""")
def index_backfill(spark, sf):
    """Pending chunks get vectors: 25 first, in the order of insertion, then the rest; the index is compacted in between."""
    conversations, index = table(spark, sf, "conversations"), new_index(spark)
    index.run(mixed_history(conversations.where("conv_id % 3 = 0")), embedder=LetterCounts())
    before = index.vectors().select("id")
    index.run(mixed_history(conversations))
    index.backfill(LetterCounts(), limit=25)
    first = [r["id"] for r in index.vectors().join(before, "id", "left_anti").select("id").collect()]  # 25 rows
    index.compact()
    index.backfill(LetterCounts())
    fresh = index.vectors().where(F.col("session_id").cast("long") % 3 != 0)
    return fresh.select("id", F.when(F.col("id").isin(first), 1).otherwise(2).alias("step"), F.col("embedding").cast("array<double>").alias("embedding"))


@query(f"""
WITH {_CHUNKS}, f AS (SELECT conv_id, max(turn) AS t FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id ORDER BY t DESC, conv_id::VARCHAR LIMIT 5)
SELECT session_id, 'error' AS status, count(*) AS n FROM chunks JOIN f USING (conv_id) GROUP BY session_id""")
def index_failed(spark, sf):
    """A run over one project, newest five, whose embedder fails: texts are there, the sessions' state is an error."""
    index = new_index(spark)
    index.run(mixed_history(table(spark, sf, "conversations")), project="/alpha", limit=5, embedder=Down())
    return index.failed_sessions().select("session_id", "status").join(index.chunks().groupBy("session_id").agg(F.count("*").alias("n")), "session_id")


@query(f"WITH {_CHUNKS}, e AS (SELECT DISTINCT {_EMBEDDED} AS e FROM chunks WHERE {_EMBEDDED} <> '') SELECT substr(sha256(e), 1, 32) AS key, list_transform({_VECTOR}, lambda x: x::DOUBLE) AS embedding, 1 AS n FROM e")
def embedding_cache(spark, sf):
    """The cache after two indexes were made with it: each text was embedded once."""
    h = history(spark, sf)
    cache = EmbeddingCache(spark, f"{shared_dir(spark).rstrip('/')}/cache-{uuid.uuid4().hex}")
    for _ in range(2):
        new_index(spark).run(h, embedder=LetterCounts(), cache=cache)
    written = spark.read.parquet(cache.path).groupBy("key").agg(F.count("*").cast("int").alias("n"))
    return cache.entries().join(written, "key").select("key", F.col("embedding").cast("array<double>").alias("embedding"), "n")


# Search.


def _scores(name: str, phrases: list[list[str]], every: bool) -> str:
    """CTEs with the BM25 score of each chunk that matches, in one source."""
    tf = lambda p: "len(list_filter(range(1, len(t) + 1), lambda i: " + " AND ".join(f"t[i + {k}] = '{x}'" for k, x in enumerate(p)) + "))"
    idf = lambda k: f"CASE WHEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) > 0 THEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(k)}) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / mean))" for k in range(len(phrases)))
    hit = (" AND " if every else " OR ").join(f"tf{k} > 0" for k in range(len(phrases)))
    return f"""
{name}_tf AS (SELECT * EXCLUDE (t), len(t) AS dl, {", ".join(f"{tf(p)} AS tf{k}" for k, p in enumerate(phrases))} FROM (SELECT id, session_id, project_path, part_type, time_created, position, {TOKENS[name]} AS t FROM chunks)),
{name}_s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean, {", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(phrases)))} FROM {name}_tf),
{name} AS (SELECT id, session_id, project_path, part_type, time_created, position, {score} AS score FROM {name}_tf, {name}_s WHERE {hit})"""


def _search_sql(q: Query, vector: bool = True, select: str = "") -> str:
    where = " AND ".join([f"project_path = '{q.project}'"] * bool(q.project) + [f"part_type = '{q.type}'"] * bool(q.type) + [f"time_created >= {q.time_from}"] * bool(q.time_from)) or "true"
    phrases = T.phrases(q.text)
    ctes = [_CHUNKS, _scores("fts_unicode", phrases, True), _scores("fts_stem", phrases, True), _scores("lex_stem", [[w] for w in T.query_words(q.text)], False), _scores("lex_simple", [[w] for w in T.query_words(q.text)], False)]
    wanted = [q.text.count(c) for c in LETTERS]
    away = " + ".join(f"({v} - length(e) + length(replace(e, '{c}', ''))) ** 2" for v, c in zip(wanted, LETTERS, strict=True))
    ctes += [
        "lex AS (SELECT id, session_id, project_path, part_type, time_created, position, sum(score) AS score FROM (SELECT * FROM lex_stem UNION ALL SELECT * FROM lex_simple) GROUP BY ALL)",
        f"near AS (SELECT * EXCLUDE (e), {away} AS d FROM (SELECT id, session_id, project_path, part_type, time_created, position, {_EMBEDDED} AS e FROM chunks) WHERE e <> '' ORDER BY d, session_id, position LIMIT {50 if where == 'true' else 250})",
    ]
    lists = [(0, "fts_unicode", "score DESC"), (1, "fts_stem", "score DESC"), *([(2, "near", "d")] if vector else []), (3 if vector else 2, "lex", "score DESC")]
    union = " UNION ALL ".join(f"(SELECT {k} AS l, id, row_number() OVER (ORDER BY {order}, session_id, position) AS rank FROM {name} WHERE {where} ORDER BY rank LIMIT {q.limit if q.limit and name == 'lex' else 50})" for k, name, order in lists)
    return f"""
WITH {", ".join(ctes)}, u AS ({union}),
f AS (SELECT id, list_reduce(list(1.0::DOUBLE / (60 + rank) ORDER BY l), lambda a, x: a + x) AS score FROM u GROUP BY id),
best AS (SELECT f.id, score, chunks.* EXCLUDE (id) FROM f JOIN chunks ON f.id = chunks.id ORDER BY score DESC, time_created DESC, f.id LIMIT {q.limit or 20})
{select or "SELECT id, round(score, 9) AS score, session_id, project_path, role, part_type, CASE WHEN k = 1 THEN 'turn ' || turn ELSE '' END AS command, position, time_created FROM best"}"""


def _results(spark: SparkSession, found: list[dict]) -> DataFrame:
    data = [(r["id"], round(r["score"], 9), r["session_id"], r["project_path"], r["role"], r["part_type"], r["command"], r["position"], r["time_created"]) for r in found]
    return rows(spark, data, "id string, score double, session_id string, project_path string, role string, part_type string, command string, position int, time_created long")


@query(_search_sql(Query(WORDS)))
def search_hybrid(spark, sf):
    """Two full-text lists, a vector list and the second lexical list of the index, fused."""
    index = built(spark, sf)[1]
    return _results(spark, Searcher(index, LetterCounts()).search(Query(WORDS)).results)


@query(_search_sql(FILTERED))
def search_filtered(spark, sf):
    """Filters on project, type and time: before the cut of the lexical lists, after the fetch of the vector list."""
    return _results(spark, Searcher(built(spark, sf)[1], LetterCounts()).search(FILTERED).results)


@query(_search_sql(Query(WORDS), vector=False, select="SELECT id, 'fts_unicode,fts_stem,bleve' AS sources, true AS degraded, 'vector: no service' AS note FROM best"))
def search_degraded(spark, sf):
    """A source that fails is noted and left out."""
    r = Searcher(built(spark, sf)[1], Down()).search(Query(WORDS))
    return rows(spark, [(x["id"], ",".join(r.sources), r.degraded, r.note) for x in r.results], "id string, sources string, degraded boolean, note string")


# Tools and listings.


def _tools(spark: SparkSession, sf: str) -> Tools:
    h, index, *_ = built(spark, sf)
    return Tools(h, Searcher(index, LetterCounts()))


_SHOWN = """
SELECT id, role, kind AS type, CASE WHEN k = 1 THEN 'fetch' END AS tool, CASE WHEN k = 1 THEN 'turn ' || turn END AS command, CASE WHEN k = 0 THEN ' ' || chr(9) || text || chr(10) || ' ' WHEN k = 2 THEN 'about ' || text END AS text,
  CASE WHEN k = 1 THEN text || text || text END AS output, position, time_created FROM w"""


def _shown(spark: SparkSession, answer: str) -> DataFrame:
    names = ["id", "role", "type", "tool", "command", "text", "output", "position", "time_created"]
    return rows(spark, [tuple(p.get(n) for n in names) for p in json.loads(answer)["parts"]], "id string, role string, type string, tool string, command string, text string, output string, position int, time_created long")


@query(f"WITH {_PARTS}, w AS (SELECT * FROM parts WHERE session_id = '{SESSION}' AND k <> 6 AND position BETWEEN {POSITION - 3} AND {POSITION + 2}) {_SHOWN}")
def tool_read(spark, sf):
    """A window around a position, as the tool answers; arguments come as text and numbers."""
    return _shown(spark, Tools(history(spark, sf)).call("memory_read", {"session_id": int(SESSION), "position": str(POSITION), "before": 3.0, "after": 2}))


@query(f"WITH {_PARTS}, a AS (SELECT position AS p FROM parts WHERE id = 'p:{SESSION}:1:0'), w AS (SELECT parts.* FROM parts, a WHERE session_id = '{SESSION}' AND k <> 6 AND position BETWEEN p - 2 AND p + 10) {_SHOWN}")
def tool_context(spark, sf):
    """A window around a part, found by its id."""
    return _shown(spark, Tools(history(spark, sf)).call("memory_context", {"part_id": f"p:{SESSION}:1:0", "before": 2}))


@query(f"""
WITH {_PARTS}, m AS (SELECT mid, role, time_created, list(kind ORDER BY position) AS kinds FROM parts WHERE session_id = '{SESSION}' GROUP BY ALL)
SELECT 'conversation {SESSION}' AS title, '' AS agent, 'p1' AS project_id, '/beta' AS project_path, (SELECT bool_or(k = 4) FROM parts WHERE session_id = '{SESSION}') AS compacted,
  role, time_created, array_to_string(kinds, ',') AS part_types FROM m""")
def tool_session(spark, sf):
    """The map of a session."""
    a = json.loads(Tools(history(spark, sf)).call("memory_session", {"session_id": SESSION}))
    data = [(a["title"], a["agent"], a["project_id"], a["project_path"], a["compacted"], m["role"], m["time_created"], ",".join(m["part_types"])) for m in a["messages"]]
    return rows(spark, data, "title string, agent string, project_id string, project_path string, compacted boolean, role string, time_created long, part_types string")


@query(f"""
WITH {_CHUNKS} SELECT count(DISTINCT session_id) AS sessions, count(*) AS chunks, count(*) FILTER ({_EMBEDDED} <> '') AS vectors, 0::BIGINT AS pending, count(*) AS lexical, true AS vector_on,
  {LetterCounts.dim} AS embed_dim, '{LetterCounts.model}' AS embed_model, {schemas.SCHEMA_VERSION} AS schema_version FROM chunks""")
def tool_status(spark, sf):
    """Counts of the index as the status tool tells them."""
    a = json.loads(_tools(spark, sf).call("memory_status", {}))
    i = a["index"]
    data = [(i["sessions"], i["chunks"], i["vectors"], i["pending_vectors"], a["bleve"]["docs"], a["sources"]["vector"], i["embed_dim"], i["embed_model"], i["schema_version"])]
    return rows(spark, data, "sessions long, chunks long, vectors long, pending long, lexical long, vector_on boolean, embed_dim int, embed_model string, schema_version int")


@query(_search_sql(replace(FILTERED, limit=7), select="SELECT id, row_number() OVER (ORDER BY score DESC, time_created DESC, id)::INT AS rank FROM best"))
def tool_search(spark, sf):
    """A search through the tool, with its limit."""
    a = json.loads(_tools(spark, sf).call("memory_search", {"query": FILTERED.text, "project": FILTERED.project, "type": FILTERED.type, "time_from": str(FILTERED.time_from), "limit": "7"}))
    return rows(spark, [(r["id"], k) for k, r in enumerate(a["results"], 1)], "id string, rank int")


@query(f"""
WITH {_PARTS}, n AS (SELECT (SELECT count(DISTINCT conv_id) FROM c) AS s, (SELECT count(*) FROM c) AS m, (SELECT count(*) FROM parts) AS p, (SELECT count(DISTINCT conv_id) FROM parts WHERE k = 4) AS x),
l AS (SELECT conv_id, session_id, project_path, max(turn) * 1000 AS t FROM c GROUP BY ALL ORDER BY t DESC, session_id LIMIT 5)
SELECT 0 AS n, 'sessions:  ' || s AS line FROM n UNION ALL SELECT 1, 'messages:  ' || m FROM n UNION ALL SELECT 2, 'parts:     ' || p FROM n UNION ALL SELECT 3, 'projects:  2' UNION ALL SELECT 4, 'compacted: ' || x FROM n
UNION ALL SELECT 5, '--- last 5 sessions ---' UNION ALL
SELECT 5 + row_number() OVER (ORDER BY t DESC, session_id), '  ' || left(session_id, 12) || '  ' || rpad('conversation ' || conv_id, greatest(16, length('conversation ' || conv_id))::INT, ' ') || '  '
  || rpad(CASE WHEN conv_id % 2 = 0 THEN 'build' ELSE '' END, 14, ' ') || '  ' || project_path || '  [' || t || ']' FROM l""")
def cli_sessions(spark, sf):
    """The listing of sessions, line by line."""
    return rows(spark, list(enumerate(cli.summary_lines(history(spark, sf)))), "n int, line string")


@query(f"""
WITH {_PARTS}, s AS (SELECT min(time_created) AS a, max(time_created) AS b, count(*) AS n, bool_or(k = 4) AS x, coalesce(arg_max(mid, position) FILTER (k = 4), '') AS tail FROM parts WHERE session_id = '{SESSION}'),
cut AS (SELECT *, CASE WHEN length(text) > 52 THEN left(text, 54) || '...' ELSE text END AS t FROM parts WHERE session_id = '{SESSION}' AND position < 12),
d AS (SELECT position, '[' || position || '] ' || CASE k
  WHEN 0 THEN 'text: ' || CASE WHEN length(text) + 4 > 100 THEN ' ' || chr(9) || left(text, 98) || '...' ELSE ' ' || chr(9) || text || chr(10) || ' ' END
  WHEN 1 THEN 'tool fetch: turn ' || turn || ' -> ' || CASE WHEN 3 * length(text) > 60 THEN left(text || text || text, 60) || '...' ELSE text || text || text END
  WHEN 2 THEN 'reasoning: ' || CASE WHEN length(text) + 6 > 100 THEN left('about ' || text, 100) || '...' ELSE 'about ' || text END
  WHEN 3 THEN 'patch 2 files: /a/' || turn || '.py, /b/' || conv_id || '.txt' WHEN 4 THEN 'compaction (tail=' || mid || ')' WHEN 5 THEN 'step-start' ELSE 'text (parse error)' END AS line FROM cut)
SELECT v.n, v.line FROM s, (VALUES (0, 'session:   {SESSION}'), (1, 'title:     conversation {SESSION}'), (2, 'project:   /beta (p1)'), (3, 'agent:     '), (4, 'model:     v1/m1'), (8, '--- dialog (first 12 parts) ---')) v(n, line)
UNION ALL SELECT 5, 'time:      ' || a || ' .. ' || b FROM s UNION ALL SELECT 6, 'parts:     ' || n FROM s UNION ALL SELECT 7, 'compacted: ' || x || ' (tail=' || tail || ')' FROM s
UNION ALL SELECT 9 + position, line FROM d UNION ALL SELECT 21, '... ' || (n - 12) || ' more parts' FROM s WHERE n > 12""")
def cli_session(spark, sf):
    """The listing of one session: a line a part, of any type."""
    return rows(spark, list(enumerate(cli.session_lines(history(spark, sf), SESSION, 12))), "n int, line string")


@query(f"""
WITH {_PARTS} SELECT 'session' AS what, 'conversation {SESSION}' AS value UNION ALL SELECT 'part', 'tool' UNION ALL SELECT 'projects', '/alpha,/beta' UNION ALL SELECT 'model', 'm1,v1,'
UNION ALL SELECT 'messages', array_to_string(list(role ORDER BY turn), ',') FROM c WHERE session_id = '{SESSION}' UNION ALL SELECT 'missing', 'session no such session not found'""")
def history_lookups(spark, sf):
    """Single reads of the history: a session, a part, projects, a model, messages, and what is missing."""
    h = history(spark, sf)
    try:
        missing = str(h.get_session("no such session"))
    except LookupError as error:
        missing = str(error)
    model = h.session.where(F.col("id") == SESSION).select(P.model(F.col("model")).alias("m")).first()["m"]
    data = [
        ("session", h.get_session(SESSION)["title"]), ("part", h.find_part(_tool_part(h))["type"]), ("projects", ",".join(r["worktree"] for r in h.projects().orderBy("id").collect())),
        ("model", ",".join(model)), ("messages", ",".join(r["role"] for r in h.messages(SESSION).collect())), ("missing", missing),
    ]
    return rows(spark, data, "what string, value string")


#: Inflected words and their stems by the published algorithm. Fixed values.
STEMS = (
    ("подключался", "подключа"), ("подключения", "подключен"), ("узлу", "узл"), ("важная", "важн"), ("важнейший", "важн"), ("быстро", "быстр"), ("читавший", "чита"), ("красота", "красот"), ("радость", "радост"),
    ("бегали", "бега"), ("книгами", "книг"), ("и", "и"), ("redis", "redis"), ("ёлка", "елк"),
)
_STEMS = ", ".join(f"('{w}', '{s}', '{s} {s}', '{s}')" for w, s in STEMS)


@query(f"SELECT * FROM (VALUES {_STEMS}) v(word, stem, stemmed_text, query_stem)")
def stems(spark, sf):
    """Stems of words, of a text, and of a query word."""
    words = rows(spark, [(w, stem_word(w)) for w, _ in STEMS], "word string, query_stem string")
    return words.select("word", stem(F.col("word")).alias("stem"), stem_text(T.words(F.concat(F.upper("word"), F.lit(", "), "word"))).alias("stemmed_text"), "query_stem")


_ARGS = (("7.0", 7.0, 7, "7"), ("9", 9, 9, "9"), ("text 13", "13", 13, "13"), ("abc", "abc", 0, "abc"), ("list", [1], 0, ""), ("null", None, 0, ""), ("true", True, 0, ""))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i}, '{t}')" for n, _, i, t in _ARGS) + ") v(name, as_int, as_text)")
def tool_arguments(spark, sf):
    """Loosely typed arguments as numbers and as text."""
    return rows(spark, [(n, as_int(v), as_text(v)) for n, v, *_ in _ARGS], "name string, as_int int, as_text string")


_MATCHES = ("with from", 'say "of_the"', " \t", "Où Ça-va")


@query("SELECT * FROM (VALUES ('with from', '\"with\" AND \"from\"', 2), ('say \"of_the\"', '\"say\" AND \"of_the\"', 2), (' \t', '', 0), ('Où Ça-va', '\"où\" AND \"ça\" AND \"va\"', 3)) v(text, expression, phrases)")
def match_expressions(spark, sf):
    """Query texts as match expressions; one without words matches nothing."""
    return rows(spark, [(t, T.match_expression(t), len(T.phrases(t))) for t in _MATCHES], "text string, expression string, phrases int")
