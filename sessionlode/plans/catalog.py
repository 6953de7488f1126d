"""The registered queries over the driver's tables, and the SQL that gives the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlode.functions import text as T
from sessionlode.functions.stemmer import stem_text, stem_word
from sessionlode.operators import chunking, fulltext, fusion, vectors, windows
from sessionlode.plans import engine_queries  # noqa: F401  (registers its queries)
from sessionlode.plans.registry import Q, SQL, query, table
from sessionlode.sources import parts as P
from sessionlode.sources import tables
from sessionlode.sources.embedder import cache_key
from sessionlode.sources.history import from_conversations

ONE, AND2, PHRASE, MANY = "with", "with from", "of_the", "with from thing"
FILTER_SOURCE, FILTER_LANG = "src1", "en"
SESSION, POSITION, BEFORE, AFTER = "7", 2, 5, 10
K = 50


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """For plans that do much with each text: small tables are spread over the cores."""
    return tables.read(spark, f"{sf_dir}/{name}.parquet", list(columns))


# Chunking.

_TRIM = r"regexp_replace(regexp_replace(text, '^[\s\x0b\p{Z}\x{85}]+', ''), '[\s\x0b\p{Z}\x{85}]+$', '')"


@query(f"""
WITH c AS (SELECT doc_id, {_TRIM} AS content FROM documents)
SELECT doc_id, length(content)::INT AS n, CASE WHEN length(content) <= 300 THEN content ELSE left(content, 300) || '...' END AS snippet,
  sha256(left(content, 6000)) AS embed_sha, length(left(content, 6000))::INT AS embed_chars FROM c WHERE content <> ''""")
def chunk_text(spark, sf):
    """Text chunks: trimmed content, snippet, text to embed; empty ones vanish."""
    rows = texts(spark, sf, "documents", "doc_id", "text").select("doc_id", T.trim_space(F.col("text")).alias("content")).where(F.col("content") != "")
    embed = T.head(F.col("content"), T.EMBED_CHARS)
    return rows.select("doc_id", F.length("content").alias("n"), T.snippet(F.col("content")).alias("snippet"), F.sha2(embed, 256).alias("embed_sha"), F.length(embed).alias("embed_chars"))


@query(r"""
WITH c AS (SELECT page_id, regexp_replace(url, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS cmd, regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS o FROM pages),
d AS (SELECT page_id, length(o) > 4096 AS truncated, 'fetch' || CASE WHEN cmd <> '' THEN ': ' || cmd ELSE '' END || CASE WHEN o <> '' THEN chr(10) || left(o, 4096) ELSE '' END AS content FROM c)
SELECT page_id, truncated, length(content)::INT AS n, sha256(content) AS content_sha FROM d""")
def chunk_tool_output(spark, sf):
    """Tool chunks: cleaned command and output, the output cut at 4096 code points."""
    rows = texts(spark, sf, "pages", "page_id", "url", "html").select("page_id", T.clean(F.col("url")).alias("cmd"), T.clean(F.col("html")).alias("o"))
    content = chunking.tool_content(F.lit("fetch"), F.col("cmd"), T.head(F.col("o"), T.TOOL_OUTPUT_CHARS))
    return rows.select("page_id", (F.length("o") > T.TOOL_OUTPUT_CHARS).alias("truncated"), F.length(content).alias("n"), F.sha2(content, 256).alias("content_sha"))


@query("""
SELECT conv_id::VARCHAR AS session_id, 'p:' || conv_id || ':' || turn AS id, role AS msg_role, '/conversations' AS project_path, 'text' AS part_type,
  length(text)::INT AS n, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS position FROM conversations WHERE trim(text) <> ''""")
def chunkify_history(spark, sf):
    """The whole chain: history tables, positions, decoded payloads, roles, projects, chunks."""
    h = from_conversations(table(spark, sf, "conversations"))
    chunks = chunking.chunkify(h.parts(), h.messages(), h.located(h.session))
    return chunks.select("session_id", "id", "msg_role", "project_path", "part_type", F.length("content").alias("n"), "position")


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AND json_valid(props) AS valid, '{"type":"' || event_type || '"}' AS payload, event_type AS kind FROM events""")
def parse_json_part(spark, sf):
    """Decoding of JSON payloads, and the type of a part from its payload."""
    rows = table(spark, sf, "events")
    payload = F.to_json(F.struct(F.col("event_type").alias("type")))
    return rows.select("event_id", F.get_json_object("props", "$.k").alias("k"), P.valid(P.parse(F.col("props")), F.lit("other")).alias("valid"), payload.alias("payload"), P.type_of(P.parse(payload)).alias("kind"))


# Coordinates.


@query("SELECT conv_id::VARCHAR AS session_id, 'p:' || conv_id || ':' || turn AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS position FROM conversations")
def positions(spark, sf):
    return from_conversations(table(spark, sf, "conversations")).parts().select("session_id", "id", "position")


@query("SELECT conv_id::VARCHAR AS session_id, conv_id || ':' || turn AS id, role, turn::BIGINT AS time_created, 'text' AS part_types FROM conversations")
def session_map(spark, sf):
    """Messages in order with the types of their parts."""
    h = from_conversations(table(spark, sf, "conversations"))
    return windows.message_map(h.messages(), h.parts()).select("session_id", "id", "role", "time_created", F.array_join("part_types", ",").alias("part_types"))


_WINDOW = """
WITH p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS position FROM conversations WHERE conv_id = {session})
SELECT 'p:' || conv_id || ':' || turn AS id, role, 'text' AS type, text, position, turn::BIGINT AS time_created FROM p WHERE position BETWEEN {start} AND {end}"""


@query(_WINDOW.format(session=SESSION, start=POSITION - BEFORE, end=POSITION + AFTER))
def window_read(spark, sf):
    """Parts around a position of one session."""
    h = from_conversations(table(spark, sf, "conversations"))
    return windows.window(h.parts(SESSION), h.messages(SESSION), POSITION - BEFORE, POSITION + AFTER).select("id", "role", "type", "text", "position", "time_created")


@query("""
WITH p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS position FROM conversations),
a AS (SELECT conv_id, position AS start FROM p WHERE conv_id = 7 ORDER BY turn LIMIT 1)
SELECT 'p:' || conv_id || ':' || turn AS id, role, position FROM p JOIN a USING (conv_id) WHERE position BETWEEN start - 5 AND start + 10""")
def context_by_part(spark, sf):
    """The window around a part, found by its id."""
    h = from_conversations(table(spark, sf, "conversations"))
    first = h.message.where(F.col("session_id") == SESSION).agg(F.min_by("id", "time_created")).first()[0]
    part = h.find_part(f"p:{first}")
    at = h.parts(part["session_id"]).where(F.col("id") == part["id"]).first()["position"]
    return windows.window(h.parts(part["session_id"]), h.messages(part["session_id"]), at - BEFORE, at + AFTER).select("id", "role", "position")


@query("""
SELECT conv_id::VARCHAR AS id, 'conversation ' || conv_id AS title, '/conversations' AS project_path, max(turn)::BIGINT AS time_updated
FROM conversations GROUP BY conv_id ORDER BY time_updated DESC, id LIMIT 20""")
def session_list_newest(spark, sf):
    h = from_conversations(table(spark, sf, "conversations"))
    return h.located(h.sessions()).select("id", "title", "project_path", "time_updated").orderBy(F.desc("time_updated"), "id").limit(20)


@query("""
SELECT conv_id::VARCHAR AS session_id, bool_or(role = 'system') AS compacted, coalesce(arg_max(conv_id || ':' || turn, turn) FILTER (role = 'system'), '') AS tail_start_id
FROM conversations GROUP BY conv_id HAVING bool_or(role = 'system')""")
def compaction_flag(spark, sf):
    """Compaction marks; system turns become compaction parts here."""
    c = table(spark, sf, "conversations")
    h = from_conversations(c)
    mark = F.to_json(F.struct(F.lit("compaction").alias("type"), F.col("message_id").alias("tail_start_id")))
    system = h.messages().where("role = 'system'").select(F.col("id").alias("message_id"), F.lit(True).alias("mark"))
    parts = h.part.join(system, "message_id", "left").withColumn("data", F.when(F.col("mark"), mark).otherwise(F.col("data")))
    return type(h)(h.project, h.session, h.message, parts).compaction()


@query("SELECT conv_id || ':' || turn AS id, 'text: ' || CASE WHEN length(text) <= 100 THEN text ELSE left(text, 100) || '...' END AS line FROM conversations")
def describe_parts(spark, sf):
    """One line per part, as listings show them."""
    h = from_conversations(table(spark, sf, "conversations"))
    return h.part.withColumn("payload", P.parse(F.col("data"))).select(F.col("message_id").alias("id"), chunking.describe(F.col("payload"), P.type_of(F.col("payload"))).alias("line"))


# Full text. Folding in SQL: lower case, then the same letters.

_FROM, _TO = T.plain_letters()
_FOLD = f"regexp_replace(translate(replace(lower(text), 'ς', 'σ'), '{_FROM}', '{_TO}'), '[{T.DROPPED_MARKS}]', '', 'g')"
_DOCS = rf"docs AS (SELECT doc_id, source, lang, regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}\p{{Co}}]+') AS t FROM documents)"


def _bm25_sql(phrases: list[list[str]], every: bool = True, where: str = "", limit: int = K, cte: str = _DOCS) -> str:
    def tf(p: list[str]) -> str:
        test = " AND ".join(f"t[i + {k}] = '{x}'" for k, x in enumerate(p))
        return f"len(list_filter(range(1, len(t) + 1), lambda i: {test}))" if len(p) > 1 else f"len(list_filter(t, lambda x: x = '{p[0]}'))"

    tfs = ", ".join(f"{tf(p)} AS tf{k}" for k, p in enumerate(phrases))
    dfs = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(phrases)))
    idf = lambda k: f"CASE WHEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) > 0 THEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(k)}) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / mean))" for k in range(len(phrases)))
    hit = (" AND " if every else " OR ").join(f"tf{k} > 0" for k in range(len(phrases)))
    return f"""
WITH {cte}, tf AS (SELECT doc_id, source, lang, len(t) AS dl, {tfs} FROM docs), s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean, {dfs} FROM tf)
SELECT doc_id, round({score}, 9) AS score FROM tf, s WHERE ({hit}) {where} ORDER BY {score} DESC, doc_id LIMIT {limit}"""


def _fts(spark, sf, text: str, every: bool = True, condition=None, terms=T.terms, word=lambda w: w) -> DataFrame:
    docs = texts(spark, sf, "documents", "doc_id", "text", "source", "lang")
    scored = fulltext.rank_texts(docs, "doc_id", "text", T.phrases(text, word), ["source", "lang"], every, terms)
    if condition is not None:
        scored = scored.where(condition)
    return fulltext.top(scored, ["doc_id"], K)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 9).alias("score"))


@query(rf"WITH {_DOCS}, w AS (SELECT doc_id, unnest(t) AS term FROM docs) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM w GROUP BY term")
def tokenize_terms(spark, sf):
    """The vocabulary with document and collection frequencies."""
    return fulltext.document_frequencies(texts(spark, sf, "documents", "text"), "text")


@query(rf"WITH {_DOCS} SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avg_length, sum(len(t))::BIGINT AS n_terms FROM docs")
def corpus_stats(spark, sf):
    return fulltext.corpus_stats(texts(spark, sf, "documents", "text"), "text").withColumn("avg_length", F.round("avg_length", 6))


@query(rf"WITH {_DOCS}, w AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS p FROM docs) SELECT term, doc_id::VARCHAR AS id, count(*)::INT AS tf, min(p)::INT AS first_position FROM w GROUP BY ALL")
def postings(spark, sf):
    """The postings table: term, document, occurrences."""
    rows = fulltext.postings(texts(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("id"), "text"), "text")
    return rows.select("term", "id", F.size("positions").alias("tf"), F.get("positions", 0).alias("first_position"))


@query(_bm25_sql(T.phrases(ONE)))
def fts_raw(spark, sf):
    """Full-text search for one word."""
    return _rounded(_fts(spark, sf, ONE))


@query(_bm25_sql(T.phrases(AND2)))
def fts_and(spark, sf):
    """All words must occur."""
    return _rounded(_fts(spark, sf, AND2))


@query(_bm25_sql(T.phrases(PHRASE)))
def fts_phrase(spark, sf):
    """One query word that the index splits: a phrase."""
    return _rounded(_fts(spark, sf, PHRASE))


@query(_bm25_sql(T.phrases("with with")))
def fts_repeated(spark, sf):
    """A repeated word counts twice."""
    return _rounded(_fts(spark, sf, "with with"))


@query(_bm25_sql(T.phrases(ONE), where=f"AND source = '{FILTER_SOURCE}' AND lang = '{FILTER_LANG}'"))
def fts_filtered(spark, sf):
    """Filters come after the statistics and before the cut."""
    return _rounded(_fts(spark, sf, ONE, condition=(F.col("source") == FILTER_SOURCE) & (F.col("lang") == FILTER_LANG)))


@query(_bm25_sql(T.phrases(AND2)).replace("FROM documents)", "FROM (SELECT doc_id, source, lang, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}_]+'), ' ') AS text FROM documents))", 1))
def fts_stemmed(spark, sf):
    """Search in stemmed texts with a stemmed query; Latin words are their own stems."""
    return _rounded(_fts(spark, sf, AND2, terms=lambda c: T.terms(stem_text(T.words(c))), word=stem_word))


@query(_bm25_sql(T.phrases(MANY), every=False))
def lexical_or(spark, sf):
    """Any word is enough."""
    return _rounded(_fts(spark, sf, MANY, every=False))


@query("SELECT doc_id, substr(sha256(text), 1, 32) AS key FROM documents")
def embed_cache_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cache_key(F.col("text")).alias("key"))


# Vectors and fusion.

_PROBE = [round(((k * 37) % 64 - 32) / 256, 6) for k in range(64)]
_Q = "[" + ", ".join(map(str, _PROBE)) + "]::DOUBLE[]"
_NEAR = f"near AS (SELECT vec_id, label, list_distance(embedding::DOUBLE[], {_Q}) AS d FROM embeddings WHERE len(embedding) = 64)"


@query(f"WITH {_NEAR} SELECT vec_id, round(d, 9) AS distance FROM near ORDER BY d, vec_id LIMIT 50")
def knn(spark, sf):
    """Exact nearest neighbours of a vector."""
    return vectors.knn(table(spark, sf, "embeddings"), _PROBE, ["vec_id"]).select("vec_id", F.round("distance", 9).alias("distance"))


@query(f"WITH {_NEAR}, f AS (SELECT * FROM near ORDER BY d, vec_id LIMIT 250) SELECT vec_id, round(d, 9) AS distance FROM f WHERE label = 3 ORDER BY d, vec_id LIMIT 50")
def knn_filtered(spark, sf):
    """The filter comes after the fetch of 250."""
    return vectors.knn_filtered(table(spark, sf, "embeddings"), _PROBE, ["vec_id"], F.col("label") == 3).select("vec_id", F.round("distance", 9).alias("distance"))


@query("""
WITH u AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50
  UNION ALL SELECT doc_id AS id, row_number() OVER (ORDER BY quality DESC, toxic DESC, doc_id) AS rank FROM labels QUALIFY rank <= 50)
SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY id ORDER BY score DESC, id LIMIT 50""")
def rrf_merge(spark, sf):
    """Fusion of two ranked lists."""
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars").orderBy(F.desc("n_chars"), "id").limit(50)
    b = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic").orderBy(F.desc("quality"), F.desc("toxic"), "id").limit(50)
    lists = [fusion.ranked(a, [F.desc("n_chars"), "id"], 0).select("id", "rank", "source"), fusion.ranked(b, [F.desc("quality"), F.desc("toxic"), "id"], 1).select("id", "rank", "source")]
    merged = fusion.merge(lists, "id", [], 100)
    return merged.select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(50)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text search over the documents, with snippets of the hits."""
    hits = F.broadcast(_fts(spark, sf_dir, ONE).select("doc_id", "score"))  # 50 rows at most
    docs = table(spark, sf_dir, "documents")
    return docs.join(hits, "doc_id").select("doc_id", F.round("score", 9).alias("score"), T.snippet(T.trim_space(F.col("text"))).alias("snippet")).orderBy(F.desc("score"), "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

